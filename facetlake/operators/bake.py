"""Texture-space operators: rasterised texels, baked normals, gutter fill."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.functions import geometry as g
from facetlake.operators.nearest import nearest_normals
from facetlake.operators.views import raster_rows
from facetlake.session import materialize

# Fixed value: barycentric slack.
SLACK = 1e-5


def texels(triangles: DataFrame, resolution: int) -> DataFrame:
    """Covered texels with interpolated position: ``mesh_id px py x y z``.

    Input adds texture coordinates ``a_s a_t b_s b_t c_s c_t`` in 0..1; rows count downwards.
    Where faces overlap the later face wins.
    """
    placed = triangles.withColumns(
        {f"{k}u": F.col(f"{k}_s") * resolution for k in g.CORNERS}
        | {f"{k}v": (1.0 - F.col(f"{k}_t")) * resolution for k in g.CORNERS}
    )
    corners = [f"{k}{t}" for k in g.CORNERS for t in g.XYZ]
    inside = raster_rows(placed, resolution, ["mesh_id", "fid", *corners], SLACK)
    at = [
        (F.col("w0") * g.col("a", t) + F.col("w1") * g.col("b", t) + F.col("w2") * g.col("c", t)).alias(t) for t in g.XYZ
    ]
    return (
        inside.select("mesh_id", "px", "py", "fid", *at)
        .groupBy("mesh_id", "px", "py")
        .agg(F.max("fid").alias("fid"), *[F.max_by(t, "fid").alias(t) for t in g.XYZ])
    )


def fill_gutter(covered: DataFrame, resolution: int, padding: int = 4) -> DataFrame:
    """Grow covered texels outward, each new one the mean of its covered neighbours.

    ``covered``: ``mesh_id px py r g b``.
    """
    shifts = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy])
    done = covered.select("mesh_id", "px", "py", "r", "g", "b")
    ring, parts = done, [done]
    taken = done.select("mesh_id", "px", "py")
    for _ in range(padding):
        # Only texels next to the newest ring can be new; their mean uses all covered neighbours.
        edge = (
            ring.select("mesh_id", F.explode(shifts).alias("s"), "px", "py")
            .select("mesh_id", (F.col("px") + F.col("s.dx")).alias("px"), (F.col("py") + F.col("s.dy")).alias("py"))
            .filter(f"px BETWEEN 0 AND {resolution - 1} AND py BETWEEN 0 AND {resolution - 1}")
            .distinct()
            .join(taken, ["mesh_id", "px", "py"], "left_anti")
        )
        everything = parts[0]
        for p in parts[1:]:
            everything = everything.unionByName(p)
        near = (
            everything.withColumn("s", F.explode(shifts))
            .select("mesh_id", (F.col("px") + F.col("s.dx")).alias("px"), (F.col("py") + F.col("s.dy")).alias("py"), "r", "g", "b")
            .join(edge, ["mesh_id", "px", "py"], "left_semi")
        )
        ring = materialize(
            near.groupBy("mesh_id", "px", "py").agg(*[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"]), "ring"
        )
        parts.append(ring)
        taken = taken.union(ring.select("mesh_id", "px", "py"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bake_normals(dense: DataFrame, low: DataFrame, resolution: int = 1024, padding: int = 4) -> DataFrame:
    """Object-space normal map of ``dense`` over the texels of ``low``: ``mesh_id px py r g b``."""
    t = materialize(texels(low, resolution), "texels")
    points = t.select("mesh_id", (F.col("py") * resolution + F.col("px")).cast("bigint").alias("pid"), *g.XYZ)
    colours = nearest_normals(points, dense).select(
        "mesh_id", (F.col("pid") % resolution).cast("int").alias("px"),
        F.expr(f"CAST(pid div {resolution} AS INT)").alias("py"), "r", "g", "b",
    )
    return fill_gutter(materialize(colours, "baked"), resolution, padding)
