"""facetlake.streaming"""
