"""Mesh cleanup: drop bad faces, then debris components, with a before/after report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.operators import mesh
from facetlake.operators.components import face_components
from facetlake.session import materialize


def _sizes(triangles: DataFrame, suffix: str, welded: bool) -> DataFrame:
    faces = triangles.groupBy("mesh_id").agg(F.count("*").alias(f"faces_{suffix}"))
    if not welded:
        return faces.withColumn(f"vertices_{suffix}", F.col(f"faces_{suffix}") * 3)
    positions = mesh.corners(triangles).select("mesh_id", "key").distinct()
    return faces.join(positions.groupBy("mesh_id").agg(F.count("*").alias(f"vertices_{suffix}")), "mesh_id")


def clean(triangles: DataFrame, min_area_frac: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """Cleaned triangles and the cleanup report per mesh.

    Debris is judged on components of the welded surface, so a cut along a texture seam does
    not split an object. Corners of the input count as its vertices.
    """
    good = materialize(mesh.drop_duplicates(mesh.drop_degenerate(triangles)), "good_faces")
    labels = materialize(face_components(good, mesh.adjacency(mesh.edge_stats(good))), "components")
    marked = materialize(
        mesh.surviving_components(mesh.component_areas(good, labels), min_area_frac), "component_marks"
    )
    kept_ids = labels.join(marked.filter("keep").select("mesh_id", "comp"), ["mesh_id", "comp"]).select("mesh_id", "fid")
    kept = materialize(good.join(kept_ids, ["mesh_id", "fid"], "left_semi"), "clean_faces")
    removed = marked.groupBy("mesh_id").agg(F.count_if(~F.col("keep")).alias("components_removed"))
    watertight = mesh.topology(mesh.edge_stats(kept)).select("mesh_id", "watertight")
    report = (
        _sizes(triangles, "before", welded=False)
        .join(_sizes(kept, "after", welded=True), "mesh_id", "left")
        .join(removed, "mesh_id", "left")
        .join(watertight, "mesh_id", "left")
    )
    return kept, report.fillna(0, ["faces_after", "vertices_after", "components_removed"]).fillna(False, ["watertight"])
