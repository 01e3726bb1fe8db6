"""Mesh text files (OBJ) to and from tables, read by line so that large files are split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.operators.ordering import positions
from facetlake.session import materialize


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files in file order: ``mesh_id block row line``.

    A file larger than a scan split is read by several tasks; (block, row) restores its order.
    """
    return spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("mesh_id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )


def parse_obj(lines: DataFrame, order: Sequence[str] = ("block", "row")) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of OBJ text: ``mesh_id vid x y z`` and ``mesh_id fid v0 v1 v2``.

    Vertex and face numbers are 0-based in file order. Polygons become triangle fans; vertex
    references may be negative (counted from the vertices so far) and may carry ``/`` suffixes.
    """
    words = F.split(F.trim("line"), r"\s+")
    tagged = lines.select("mesh_id", *order, words.alias("w")).filter(F.get("w", 0).isin("v", "f"))
    tagged = materialize(tagged.withColumn("is_vertex", (F.get("w", 0) == "v").cast("bigint")), "obj_lines")
    vertices = positions(tagged.filter("is_vertex = 1"), ["mesh_id"], list(order), "vid").select(
        "mesh_id", "vid", *[F.get("w", i).try_cast("double").alias(t) for i, t in ((1, "x"), (2, "y"), (3, "z"))]
    )
    ref = F.transform(
        F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda s: F.substring_index(s, "/", 1).try_cast("bigint")
    )
    polygons = tagged.filter("is_vertex = 0").withColumn("refs", ref)
    relative = F.exists("refs", lambda r: r < 0)
    plain = polygons.filter(~relative | relative.isNull()).select("mesh_id", *order, "refs", F.lit(0).cast("bigint").alias("so_far"))
    counted = tagged.join(polygons.filter(relative).select("mesh_id").distinct(), "mesh_id", "left_semi")
    if not counted.isEmpty():
        from facetlake.operators.ordering import running_sum

        seen = running_sum(counted, ["mesh_id"], list(order), F.col("is_vertex"), "so_far")
        late = seen.filter("is_vertex = 0").withColumn("refs", ref).filter(F.exists("refs", lambda r: r < 0))
        plain = plain.unionByName(late.select("mesh_id", *order, "refs", F.col("so_far").cast("bigint").alias("so_far")))
    ids = F.transform("refs", lambda r: F.when(r > 0, r - 1).otherwise(F.col("so_far") + r))
    fans = plain.withColumn("ids", ids).filter(F.size("ids") >= 3).select(
        "mesh_id", *order, "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 2)).alias("t")
    )
    faces = positions(fans, ["mesh_id"], [*order, "t"], "fid").select(
        "mesh_id", "fid", F.get("ids", 0).alias("v0"), F.get("ids", F.col("t")).alias("v1"), F.get("ids", F.col("t") + 1).alias("v2")
    )
    return vertices, faces


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """OBJ lines of each mesh in order: ``mesh_id part line_no line``; part 0 holds vertices, 1 faces.

    Vertices are renumbered densely from 1 in ``vid`` order.
    """
    numbered = materialize(positions(vertices, ["mesh_id"], ["vid"], "line_no"), "obj_vertices")
    text = [F.format_string("%.6f", t) for t in ("x", "y", "z")]
    v_lines = numbered.select(
        "mesh_id", F.lit(0).alias("part"), "line_no", F.concat_ws(" ", F.lit("v"), *text).alias("line")
    )
    refs = faces.select("mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("c", "vid")).join(
        numbered.select("mesh_id", "vid", (F.col("line_no") + 1).alias("n")), ["mesh_id", "vid"]
    )
    rows = refs.groupBy("mesh_id", "fid").agg(*[F.max(F.when(F.col("c") == i, F.col("n"))).alias(f"n{i}") for i in range(3)])
    f_lines = positions(rows, ["mesh_id"], ["fid"], "line_no").select(
        "mesh_id", F.lit(1).alias("part"), "line_no",
        F.concat_ws(" ", F.lit("f"), *[F.col(f"n{i}").cast("string") for i in range(3)]).alias("line"),
    )
    return v_lines.unionByName(f_lines)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """Write one folder of ordered text per mesh, ``mesh_id=<id>/part-*``.

    A mesh larger than one partition becomes several files whose names keep the line order.
    """
    lines = obj_lines(vertices, faces)
    columns = ["mesh_id", "part", "line_no"]
    (
        lines.repartitionByRange(*columns)
        .sortWithinPartitions(*columns)
        .select("mesh_id", "line")
        .write.partitionBy("mesh_id")
        .text(path)
    )


def parse_stl(lines: DataFrame, order: Sequence[str] = ("block", "row")) -> DataFrame:
    """Triangles of ASCII STL text: every three ``vertex`` lines are one face."""
    words = F.split(F.trim("line"), r"\s+")
    spots = lines.select("mesh_id", *order, words.alias("w")).filter(F.get("w", 0) == "vertex")
    numbered = positions(spots, ["mesh_id"], list(order), "n").select(
        "mesh_id", F.expr("n div 3").alias("fid"), (F.col("n") % 3).alias("c"),
        *[F.get("w", i).try_cast("double").alias(t) for i, t in ((1, "x"), (2, "y"), (3, "z"))],
    )
    return numbered.groupBy("mesh_id", "fid").agg(
        *[F.max(F.when(F.col("c") == i, F.col(t))).alias(f"{k}{t}") for i, k in enumerate("abc") for t in "xyz"]
    )


def parse_ply(lines: DataFrame, order: Sequence[str] = ("block", "row")) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangles of ASCII PLY text whose vertex element comes first and starts with x y z.

    The header gives the counts; body lines are told apart by their number.
    """
    text = lines.select("mesh_id", *order, F.trim("line").alias("line")).filter("line <> ''")
    numbered = materialize(positions(text, ["mesh_id"], list(order), "n"), "ply_lines")
    count = F.regexp_extract("line", r"^element\s+vertex\s+(\d+)", 1).try_cast("bigint")
    header = numbered.groupBy("mesh_id").agg(
        F.min(F.when(F.col("line") == "end_header", F.col("n"))).alias("_end"),
        F.max(count).alias("_vertices"),
        F.max(F.regexp_extract("line", r"^element\s+face\s+(\d+)", 1).try_cast("bigint")).alias("_faces"),
    )
    body = numbered.join(header, "mesh_id").filter("n > _end").select(
        "mesh_id", (F.col("n") - F.col("_end") - 1).alias("m"), "_vertices", "_faces", F.split("line", r"\s+").alias("w")
    )
    vertices = body.filter("m < _vertices").select(
        "mesh_id", F.col("m").alias("vid"), *[F.get("w", i).try_cast("double").alias(t) for i, t in enumerate("xyz")]
    )
    polygons = body.filter("m >= _vertices AND m < _vertices + _faces").select(
        "mesh_id", "m", F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda s: s.try_cast("bigint")).alias("ids")
    )
    fans = polygons.filter(F.size("ids") >= 3).select(
        "mesh_id", "m", "ids", F.explode(F.sequence(F.lit(1), F.size("ids") - 2)).alias("t")
    )
    faces = positions(fans, ["mesh_id"], ["m", "t"], "fid").select(
        "mesh_id", "fid", F.get("ids", 0).alias("v0"), F.get("ids", F.col("t")).alias("v1"), F.get("ids", F.col("t") + 1).alias("v2")
    )
    return vertices, faces
