"""trendweave.functions"""
