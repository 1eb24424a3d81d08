"""trendweave.sources"""
