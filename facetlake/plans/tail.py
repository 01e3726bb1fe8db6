"""The mesh tail as one table job: scale, clean, reduce to budget, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.operators import mesh
from facetlake.operators.budget import reduce_to_budget
from facetlake.plans.cleanup import clean
from facetlake.session import materialize


def mesh_tail(
    triangles: DataFrame, budgets: DataFrame, factors: DataFrame | None = None, min_area_frac: float = 1e-4
) -> tuple[DataFrame, DataFrame]:
    """Finished triangles and one report row per mesh.

    ``budgets``: ``mesh_id target_faces``; ``factors``: ``mesh_id factor``. A mesh that ends empty
    still has its report row.
    """
    scaled = triangles if factors is None else mesh.scaled(triangles, factors)
    cleaned, cleanup = clean(scaled, min_area_frac)
    reduced, reduction = reduce_to_budget(cleaned, budgets)
    reduced = materialize(reduced, "reduced")
    solid = mesh.solid_report(reduced).select("mesh_id", "holes", "watertight", "euler", "volume")
    report = (
        cleanup.select("mesh_id", "faces_before", F.col("faces_after").alias("faces_clean"), "components_removed")
        .join(reduction.select("mesh_id", F.col("faces_after").alias("faces_final"), "target_faces", "grid", "exact"), "mesh_id", "left")
        .join(solid, "mesh_id", "left")
    )
    return reduced, report
