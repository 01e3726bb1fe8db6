"""facetlake.functions"""
