"""facetlake.sources"""
