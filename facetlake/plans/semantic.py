"""Semantic split: rendered masks fused into one part label per face."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.functions import geometry as g
from facetlake.operators import mesh, views
from facetlake.operators.parts import parts_from_labels
from facetlake.session import materialize


def face_shares(triangles: DataFrame) -> DataFrame:
    areas = triangles.select("mesh_id", "fid", g.area().alias("area"))
    total = areas.groupBy("mesh_id").agg(F.sum("area").alias("_t"))
    return areas.join(total, "mesh_id").select(
        "mesh_id", "fid", F.coalesce(F.col("area") / F.nullif(F.col("_t"), F.lit(0.0)), F.lit(0.0)).alias("share")
    )


def semantic_labels(triangles: DataFrame, hits: DataFrame, max_parts: int = 8, min_share: float = 0.01) -> DataFrame:
    """Part label of every face from visible pixels with masks.

    ``hits``: ``mesh_id view px py fid mask``. Meshes without any usable mask get a single label.
    """
    hits = materialize(hits, "hits")
    masks = materialize(views.majority_masks(hits), "face_masks")
    areas = triangles.select("mesh_id", "fid", g.area().alias("area"))
    regions = views.mask_regions(hits.select("mesh_id", "view", "fid"), hits, areas)
    usable = materialize(regions.select("mesh_id").distinct(), "usable")
    work = triangles.join(usable, "mesh_id", "left_semi")
    adjacency = materialize(mesh.adjacency(mesh.edge_stats(work)), "adjacency")
    costs = materialize(views.dissimilarity(views.edge_votes(adjacency, masks)), "costs")
    shares = materialize(face_shares(work), "shares")
    merged = materialize(views.scan_merge(costs, shares, max_parts, min_share), "merged")
    cleaned = materialize(views.drop_slivers(merged, shares, min_share), "cleaned")
    labels = views.propagate(cleaned, adjacency)
    plain = triangles.select("mesh_id", "fid").join(usable, "mesh_id", "left_anti").withColumn(
        "label", F.lit(0).cast("bigint")
    )
    return labels.unionByName(plain)


def semantic_split(triangles: DataFrame, hits: DataFrame, max_parts: int = 8, min_share: float = 0.01) -> DataFrame:
    """Parts of every mesh from fused masks: ``mesh_id fid part_index method``."""
    labels = materialize(semantic_labels(triangles, hits, max_parts, min_share), "semantic_labels")
    return parts_from_labels(triangles, labels, max_parts, min_share)
