"""Weld, edge topology, measures and cleanup of meshes.

Meshes are ``triangles`` rows with corner positions inline. Because coincidence is
positional, an edge is a pair of position keys and its statistics come from a single
shuffle; vertex ids are only assigned where an output needs them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlake.functions import geometry as g

HALF_EDGES = (("a", "b"), ("b", "c"), ("c", "a"))


def corners(triangles: DataFrame) -> DataFrame:
    """One row per triangle corner: ``mesh_id fid corner key x y z``."""
    options = F.array(
        *[
            F.struct(
                F.lit(i).alias("corner"),
                g.position_key(k).alias("key"),
                *[g.col(k, t).alias(t) for t in g.XYZ],
            )
            for i, k in enumerate(g.CORNERS)
        ]
    )
    return triangles.select("mesh_id", "fid", F.explode(options).alias("c")).select("mesh_id", "fid", "c.*")


def weld(triangles: DataFrame) -> DataFrame:
    """Distinct vertex positions: ``mesh_id vid key x y z copies``.

    ``vid`` is the smallest corner number (3*fid + corner) at the position, so it does not
    depend on partitioning.
    """
    vid = F.col("fid") * 3 + F.col("corner")
    # Plain values keep this a hash aggregation, unlike the minimum of a struct.
    return (
        corners(triangles)
        .select("mesh_id", "key", vid.alias("vid"), *g.XYZ)
        .groupBy("mesh_id", "key")
        .agg(F.min("vid").alias("vid"), *[F.min_by(t, "vid").alias(t) for t in g.XYZ], F.count("*").alias("copies"))
        .select("mesh_id", "vid", "key", *g.XYZ, "copies")
    )


def indexed(triangles: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """Faces as indices into the welded vertices: ``mesh_id fid v0 v1 v2``."""
    vertices = weld(triangles) if vertices is None else vertices
    ids = corners(triangles).select("mesh_id", "fid", "corner", "key").join(
        vertices.select("mesh_id", "key", "vid"), ["mesh_id", "key"]
    )
    return ids.groupBy("mesh_id", "fid").agg(
        *[F.max(F.when(F.col("corner") == i, F.col("vid"))).alias(f"v{i}") for i in range(3)]
    )


def gather(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles from an indexed mesh: one lookup of all corners, then one row per face."""
    long = faces.select(
        "mesh_id", "fid", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "vid")
    ).join(vertices.select("mesh_id", "vid", "x", "y", "z"), ["mesh_id", "vid"])
    return long.groupBy("mesh_id", "fid").agg(
        *[
            F.max(F.when(F.col("corner") == i, F.col(t))).alias(f"{k}{t}")
            for i, k in enumerate(g.CORNERS)
            for t in g.XYZ
        ]
    )


def referenced(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Vertices used by at least one face."""
    used = faces.select("mesh_id", F.explode(F.array("v0", "v1", "v2")).alias("vid")).distinct()
    return vertices.join(used, ["mesh_id", "vid"], "left_semi")


def edge_stats(triangles: DataFrame) -> DataFrame:
    """Every undirected edge with use count, direction balance and its first and last face.

    Self-edges of collapsed triangles are dropped.
    """
    ends = F.array(
        *[F.struct(g.position_key(u).alias("u"), g.position_key(v).alias("v")) for u, v in HALF_EDGES]
    )
    u, v = F.col("e.u"), F.col("e.v")
    return (
        triangles.select("mesh_id", "fid", F.explode(ends).alias("e"))
        .filter(u != v)
        .select(
            "mesh_id", "fid", F.least(u, v).alias("p"), F.greatest(u, v).alias("q"),
            F.when(u < v, 1).otherwise(-1).alias("s"),
        )
        .groupBy("mesh_id", "p", "q")
        .agg(
            F.count("*").alias("n"), F.sum("s").alias("balance"),
            F.min("fid").alias("fa"), F.max("fid").alias("fb"),
        )
    )


def adjacency(edges: DataFrame) -> DataFrame:
    """Face pairs across edges used by exactly two faces, smaller id first."""
    return edges.filter("n = 2 AND fa < fb").select("mesh_id", "fa", "fb").distinct()


def topology(edges: DataFrame) -> DataFrame:
    """Edge-derived facts per mesh: holes, pinches, closedness, winding, faces on a boundary."""
    n = F.col("n")
    return edges.groupBy("mesh_id").agg(
        F.count("*").alias("n_edges"),
        F.count_if(n == 1).alias("holes"),
        F.count_if(n > 2).alias("non_manifold"),
        F.every(n == 2).alias("watertight"),
        F.every((n != 2) | (F.col("balance") == 0)).alias("winding_consistent"),
    )


def boundary_faces(edges: DataFrame) -> DataFrame:
    """Number of faces touching an open edge, per mesh."""
    return (
        edges.filter("n = 1")
        .select("mesh_id", "fa")
        .distinct()
        .groupBy("mesh_id")
        .agg(F.count("*").alias("boundary_faces"))
    )


def measures(triangles: DataFrame) -> DataFrame:
    """Face count, bounding box, area, signed volume and area-weighted centroid per mesh."""
    lows = [F.min(F.least(*[g.col(k, t) for k in g.CORNERS])).alias(f"min_{t}") for t in g.XYZ]
    highs = [F.max(F.greatest(*[g.col(k, t) for k in g.CORNERS])).alias(f"max_{t}") for t in g.XYZ]
    weighted = [F.sum(F.col("_a") * g.centroid(t)).alias(f"_w{t}") for t in g.XYZ]
    out = (
        triangles.withColumn("_a", g.area())
        .groupBy("mesh_id")
        .agg(
            F.count("*").alias("n_faces"), *lows, *highs, F.sum("_a").alias("area"),
            F.sum(g.volume6()).alias("volume6"), *weighted,
        )
    )
    return out.withColumns(
        {f"extent_{t}": F.col(f"max_{t}") - F.col(f"min_{t}") for t in g.XYZ}
        | {"volume": F.col("volume6") / 6.0}
        | {f"centre_{t}": F.col(f"_w{t}") / F.nullif(F.col("area"), F.lit(0.0)) for t in g.XYZ}
    ).drop("_wx", "_wy", "_wz")


def solid_report(triangles: DataFrame) -> DataFrame:
    """Whether each mesh is a closed, consistently wound solid, and what stands in the way."""
    edges = edge_stats(triangles)
    positions = corners(triangles).select("mesh_id", "key").distinct().groupBy("mesh_id").agg(
        F.count("*").alias("n_vertices")
    )
    return (
        measures(triangles)
        .join(topology(edges), "mesh_id", "left")
        .join(boundary_faces(edges), "mesh_id", "left")
        .join(positions, "mesh_id", "left")
        .select(
            "mesh_id",
            "n_faces",
            F.col("n_vertices"),
            F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
            F.coalesce("holes", F.lit(0)).alias("holes"),
            F.coalesce("non_manifold", F.lit(0)).alias("non_manifold"),
            F.coalesce("watertight", F.lit(False)).alias("watertight"),
            F.coalesce("winding_consistent", F.lit(False)).alias("winding_consistent"),
            (F.col("n_vertices") - F.coalesce("n_edges", F.lit(0)) + F.col("n_faces")).alias("euler"),
            F.coalesce("boundary_faces", F.lit(0)).alias("boundary_faces"),
            F.coalesce(F.col("watertight") & F.col("winding_consistent"), F.lit(False)).alias("printable"),
            F.when(F.col("watertight"), F.abs("volume")).alias("volume"),
        )
    )


def drop_degenerate(triangles: DataFrame) -> DataFrame:
    """Faces with three distinct corners and a non-zero area."""
    a, b, c = (g.position_key(k) for k in g.CORNERS)
    return triangles.filter((a != b) & (b != c) & (a != c) & (g.area() > 0))


def drop_duplicates(triangles: DataFrame) -> DataFrame:
    """Keep the first face on each set of three positions.

    Only ids and position keys are grouped. The geometry meets just the ids to drop, so where
    copies are rare that join is a broadcast and wide rows are not shuffled.
    """
    key = F.sort_array(F.array(*[g.position_key(k) for k in g.CORNERS]))
    keyed = triangles.select("mesh_id", "fid", key.alias("k"))
    repeated = (
        keyed.groupBy("mesh_id", "k").agg(F.min("fid").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    extra = keyed.join(repeated, ["mesh_id", "k"]).filter("fid > first").select("mesh_id", "fid")
    return triangles.join(extra, ["mesh_id", "fid"], "left_anti")


def component_areas(triangles: DataFrame, components: DataFrame) -> DataFrame:
    """Faces and area per component."""
    return (
        triangles.select("mesh_id", "fid", g.area().alias("area"))
        .join(components, ["mesh_id", "fid"])
        .groupBy("mesh_id", "comp")
        .agg(F.count("*").alias("n_faces"), g.exact_sum(F.col("area")).alias("area"))
    )


def surviving_components(areas: DataFrame, min_area_frac: float = 1e-4) -> DataFrame:
    """Mark components holding at least a share of the mesh area; the largest always survives
    when none would."""
    totals = areas.groupBy("mesh_id").agg(
        F.sum("area").alias("_total"),
        F.max("area").alias("_max"),
        F.max_by("comp", F.struct("area", (-F.col("comp")).alias("c"))).alias("_largest"),
    )
    floor = min_area_frac * F.col("_total")
    keep = (F.col("area") >= floor) | ((F.col("_max") < floor) & (F.col("comp") == F.col("_largest")))
    return areas.join(totals, "mesh_id").select("mesh_id", "comp", "n_faces", "area", keep.alias("keep"))


def feature_edges(triangles: DataFrame, angle_deg: float = 25.0) -> DataFrame:
    """Edges worth drawing: dihedral angle above the limit, or used by one face only."""
    edges = edge_stats(triangles)
    normals = unit_normals(triangles)
    boundary = edges.filter("n = 1").select("mesh_id", "p", "q")
    dot = sum(F.col(f"n{t}_a") * F.col(f"n{t}_b") for t in g.XYZ)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot)))
    sharp = (
        facing_pairs(edges, normals)
        .filter(angle > F.radians(F.lit(angle_deg)))
        .select("mesh_id", "p", "q")
    )
    return boundary.union(sharp).distinct()


def unit_normals(triangles: DataFrame) -> DataFrame:
    x, y, z = g.normal()
    return (
        triangles.select("mesh_id", "fid", x.alias("x"), y.alias("y"), z.alias("z"))
        .withColumn("_l", F.nullif(g.norm(F.col("x"), F.col("y"), F.col("z")), F.lit(0.0)))
        .select("mesh_id", "fid", *[F.coalesce(F.col(t) / F.col("_l"), F.lit(0.0)).alias(f"n{t}") for t in g.XYZ])
    )


def facing_pairs(edges: DataFrame, normals: DataFrame) -> DataFrame:
    """Two-face edges with the unit normals of both faces."""

    def side(s: str) -> DataFrame:
        return normals.select("mesh_id", F.col("fid").alias(f"f{s}"), *[F.col(f"n{t}").alias(f"n{t}_{s}") for t in g.XYZ])

    pairs = edges.filter("n = 2 AND fa < fb").select("mesh_id", "p", "q", "fa", "fb")
    return pairs.join(side("a"), ["mesh_id", "fa"]).join(side("b"), ["mesh_id", "fb"])


# The axis a view looks along, and the two axes it keeps.
AXIS_VIEWS = {"front": ("y", "x", "z"), "side": ("x", "y", "z"), "top": ("z", "x", "y")}


def silhouette_edges(triangles: DataFrame, views: tuple[str, ...] = tuple(AXIS_VIEWS)) -> DataFrame:
    """Edges between a face turned to the viewer and one turned away, per axis view."""
    pairs = facing_pairs(edge_stats(triangles), unit_normals(triangles))
    tests = F.array(
        *[
            F.when((F.col(f"n{t}_a") > 0) != (F.col(f"n{t}_b") > 0), F.lit(view))
            for view in views
            for t in [AXIS_VIEWS[view][0]]
        ]
    )
    return pairs.select("mesh_id", F.explode(F.array_compact(tests)).alias("view"), "p", "q").distinct()


def view_extents(triangles: DataFrame) -> DataFrame:
    """Bounds of each mesh in the three axis views."""
    m = measures(triangles)
    rows = F.array(
        *[
            F.struct(
                F.lit(view).alias("view"), *[F.col(f"{e}_{t}").alias(f"{e}_{n}") for n, t in (("u", u), ("v", w)) for e in ("min", "max")]
            )
            for view, (_, u, w) in AXIS_VIEWS.items()
        ]
    )
    return (
        m.select("mesh_id", *[F.col(f"extent_{t}") for t in g.XYZ], F.explode(rows).alias("r"))
        .select("mesh_id", "extent_x", "extent_y", "extent_z", "r.*")
        .withColumn("width", F.col("max_u") - F.col("min_u"))
        .withColumn("height", F.col("max_v") - F.col("min_v"))
    )


def drawing_lines(triangles: DataFrame, size_px: int = 800, margin_px: int = 60) -> DataFrame:
    """Line segments of the three axis drawings in canvas pixels, y pointing down.

    Feature and silhouette edges, fitted uniformly into the box inside the margins.
    """
    edges = (
        feature_edges(triangles)
        .withColumn("view", F.explode(F.array(*[F.lit(x) for x in AXIS_VIEWS])))
        .select("mesh_id", "view", "p", "q")
        .union(silhouette_edges(triangles))
        .distinct()
    )
    room = float(size_px - 2 * margin_px)
    w, h = F.col("width"), F.col("height")
    fit = (
        F.when((w > 0) & (h > 0), F.least(room / w, room / h))
        .when(w > 0, room / w)
        .when(h > 0, room / h)
        .otherwise(1.0)
    )
    boxes = (
        view_extents(triangles)
        .withColumn("scale", fit)
        .withColumn("off_x", margin_px + (room - w * F.col("scale")) / 2.0)
        .withColumn("off_y", margin_px + (room - h * F.col("scale")) / 2.0)
    )
    unit = 10.0**g.WELD_DIGITS

    def kept(end: str, which: int):
        c = F.lit(None).cast("double")
        for view, axes in AXIS_VIEWS.items():
            c = F.when(F.col("view") == view, F.col(f"{end}.{axes[1 + which]}") / unit).otherwise(c)
        return c

    def canvas(end: str):
        x = F.col("off_x") + (kept(end, 0) - F.col("min_u")) * F.col("scale")
        y = F.col("off_y") + (F.col("max_v") - kept(end, 1)) * F.col("scale")
        return x, y

    (x1, y1), (x2, y2) = canvas("p"), canvas("q")
    return edges.join(boxes, ["mesh_id", "view"]).select(
        "mesh_id", "view", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), "scale"
    )


def scaled(triangles: DataFrame, factors: DataFrame) -> DataFrame:
    """Multiply coordinates by the factor of their mesh; meshes without one are unchanged."""
    f = F.coalesce("factor", F.lit(1.0))
    names = [f"{k}{t}" for k in g.CORNERS for t in g.XYZ]
    return triangles.join(factors.select("mesh_id", "factor"), "mesh_id", "left").select(
        "mesh_id", "fid", *[(F.col(n) * f).alias(n) for n in names]
    )


def longest_edge_factor(triangles: DataFrame, longest: float) -> DataFrame:
    """Factor that brings the longest bounding-box edge of each mesh to ``longest``."""
    size = F.greatest("extent_x", "extent_y", "extent_z")
    return measures(triangles).select("mesh_id", (F.lit(float(longest)) / F.nullif(size, F.lit(0.0))).alias("factor"))


def vertex_normals(triangles: DataFrame) -> DataFrame:
    """Area-weighted unit normal per corner, equal on both sides of every seam."""
    x, y, z = g.normal()
    spread = corners(triangles).join(
        triangles.select("mesh_id", "fid", x.alias("fx"), y.alias("fy"), z.alias("fz")), ["mesh_id", "fid"]
    )
    sums = spread.groupBy("mesh_id", "key").agg(*[F.sum(f"f{t}").alias(f"s{t}") for t in g.XYZ])
    length = F.nullif(g.norm(F.col("sx"), F.col("sy"), F.col("sz")), F.lit(0.0))
    unit = sums.select("mesh_id", "key", *[F.coalesce(F.col(f"s{t}") / length, F.lit(0.0)).alias(f"n{t}") for t in g.XYZ])
    return corners(triangles).select("mesh_id", "fid", "corner", "key").join(unit, ["mesh_id", "key"]).drop("key")


# Limits of the sanity report.
CUBE_TOLERANCE = 0.05
MAX_AREA_RATIO = 2.0
CUBE_FILL_FLOOR = 0.25


def bbox_fill(volume, ex, ey, ez):
    """Enclosed volume over bounding-box volume."""
    return F.coalesce(F.abs(volume) / F.nullif(ex * ey * ez, F.lit(0.0)), F.lit(0.0))


def sanity_report(triangles: DataFrame, components: DataFrame, fill: DataFrame | None = None,
                  expect_elongated: bool = True) -> DataFrame:
    """Flag geometry unlikely to be a real object.

    ``fill`` (``mesh_id fill``) is the volume over hull volume; without it the bounding-box
    fill stands in.
    """
    ex, ey, ez = (F.col(f"extent_{t}") for t in g.XYZ)
    longest = F.when(F.greatest(ex, ey, ez) > 0, F.greatest(ex, ey, ez)).otherwise(1.0)
    box_area = 2.0 * (ex * ey + ey * ez + ex * ez)
    base = (
        measures(triangles)
        .join(topology(edge_stats(triangles)), "mesh_id", "left")
        .join(
            components.select("mesh_id", "comp").distinct().groupBy("mesh_id").agg(F.count("*").alias("n_components")),
            "mesh_id", "left",
        )
    )
    if fill is None:
        base = base.withColumn("fill", bbox_fill(F.col("volume"), ex, ey, ez))
    else:
        base = base.join(fill.select("mesh_id", "fill"), "mesh_id", "left")
    ratio = F.col("area_ratio")
    cubic = F.least(ex, ey, ez) / longest >= 1.0 - CUBE_TOLERANCE
    warnings = F.array_compact(
        F.array(
            F.when(
                F.lit(expect_elongated) & cubic & ((F.col("fill") < CUBE_FILL_FLOOR) | (ratio > MAX_AREA_RATIO)),
                "near-cubic and nearly empty",
            ),
            F.when(ratio > MAX_AREA_RATIO, "surface area far above its bounding box"),
            F.when(F.col("holes") > 0, F.concat(F.col("holes").cast("string"), F.lit(" open edges"))),
        )
    )
    return (
        base.withColumn("area_ratio", F.when(box_area > 0, F.col("area") / box_area).otherwise(0.0))
        .withColumn("warnings", warnings)
        .select(
            "mesh_id", (F.size("warnings") == 0).alias("ok"),
            *[(F.col(f"extent_{t}") / longest).alias(f"aspect_{t}") for t in g.XYZ],
            "area_ratio", "fill", "n_components",
            F.coalesce("holes", F.lit(0)).alias("holes"), F.coalesce("non_manifold", F.lit(0)).alias("non_manifold"),
            "warnings",
        )
    )


def ranked_components(areas: DataFrame, limit: int = 200) -> DataFrame:
    """The ``limit`` largest components of each mesh; the row_number filter is pushed below the shuffle."""
    w = Window.partitionBy("mesh_id").orderBy(F.desc("area"), "comp")
    top = areas.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit)
    return top.withColumn("rank", F.col("_rn") - 1).drop("_rn")
