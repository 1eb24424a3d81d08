"""trendweave.streaming"""
