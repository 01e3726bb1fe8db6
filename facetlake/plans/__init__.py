"""facetlake.plans"""
