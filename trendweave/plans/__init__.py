"""trendweave.plans"""
