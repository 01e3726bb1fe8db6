"""facetlake.starschema"""
