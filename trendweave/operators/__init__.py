"""trendweave.operators"""
