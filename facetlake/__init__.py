"""facetlake: 3-D capture data (photos, meshes, views, jobs) as Spark tables."""
