"""trendweave: a PySpark engine for interest-over-time data."""
