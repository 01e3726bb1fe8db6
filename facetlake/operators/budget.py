"""Face-budget reduction by vertex clustering on nested grids.

Differs from an edge-collapse simplifier on purpose: vertices of one cluster become one, the face count never
exceeds the budget, and it comes as near to it as adding one cluster at a time can bring it.

Grids double their cells from level to level, so each level refines the one before and never has fewer
faces. Per mesh, the finest level within budget is found from a histogram and a few rounds over the
meshes still open. Between that level and the next, cells of the finer grid split off from their parent
one by one in a fixed order; the number of faces after every split follows from one running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions import geometry as g
from facetlake.operators import mesh
from facetlake.operators.ordering import running_sum
from facetlake.session import materialize

#: The finest grid has 2^LEVELS cells along the longest edge.
LEVELS = 20
#: Levels counted in one round.
STEP = 2
#: Fixed values of the order in which cells split off: (x*P + y*Q + z*R) mod 2^31, a scattered order.
SPLIT_ORDER = (668265263, 374761393, 1274126177)
#: Beyond every place in that order.
_NEVER = 1 << 31


def grid_boxes(triangles: DataFrame) -> DataFrame:
    m = mesh.measures(triangles)
    return m.select(
        "mesh_id", "n_faces", F.greatest("extent_x", "extent_y", "extent_z").alias("longest"),
        *[F.col(f"min_{t}").alias(f"lo_{t}") for t in g.XYZ],
    )


def _gridded(triangles: DataFrame, boxes: DataFrame) -> DataFrame:
    """Triangles with the finest cell of each corner, ``q`` and the corner's and axis' names."""

    def cell(k: str, t: str) -> Column:
        at = F.floor((g.col(k, t) - F.col(f"lo_{t}")) / F.nullif(F.col("longest"), F.lit(0.0)) * float(1 << LEVELS))
        return F.coalesce(F.least(at, F.lit((1 << LEVELS) - 1)), F.lit(0)).cast("long").alias(f"q{k}{t}")

    return triangles.join(boxes, "mesh_id").select(*[triangles[c] for c in triangles.columns], *[cell(k, t) for k in g.CORNERS for t in g.XYZ])


def _axis(corner: str, axis: str, level: Column) -> Column:
    return F.call_function("shiftright", F.col(f"q{corner}{axis}"), (F.lit(LEVELS) - level).cast("int"))


def _cell(corner: str, level: Column) -> Column:
    """Number of a corner's cell at a level: 20 bits an axis."""
    x, y, z = (_axis(corner, t, level) for t in g.XYZ)
    return F.shiftleft(x, 40).bitwiseOR(F.shiftleft(y, 20)).bitwiseOR(z)


def _place(corner: str, level: Column) -> Column:
    """Place of a corner's cell in the order of splits."""
    p, q, r = SPLIT_ORDER
    x, y, z = (_axis(corner, t, level) for t in g.XYZ)
    return (x * p + y * q + z * r) % _NEVER


def _sorted(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    # Distinct numbers, so the middle one is what the other two leave.
    return low, a.bitwiseXOR(b).bitwiseXOR(c).bitwiseXOR(low).bitwiseXOR(high), high


def _first_levels(gridded: DataFrame, targets: DataFrame) -> DataFrame:
    """``mesh_id target_faces level``: the finest level at which all faces that do not collapse are within budget."""

    def apart(p: str, q: str) -> Column:
        bits = [F.col(f"q{p}{t}").bitwiseXOR(F.col(f"q{q}{t}")) for t in g.XYZ]
        any_bit = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])
        return F.when(any_bit == 0, LEVELS + 1).otherwise(LEVELS + 1 - F.length(F.bin(any_bit)))

    from_level = F.greatest(apart("a", "b"), apart("b", "c"), apart("a", "c")).alias("_from")
    faces = gridded.groupBy("mesh_id", from_level).agg(F.count("*").alias("_n"))
    # At most LEVELS + 2 rows a mesh.
    told = faces.groupBy("mesh_id").agg(F.map_from_entries(F.collect_list(F.struct("_from", "_n"))).alias("_h"))

    def faces_upto(level: int) -> Column:
        return F.aggregate(F.map_values(F.map_filter("_h", lambda k, _: k <= level)), F.lit(0).cast("long"), lambda s, n: s + n)

    upto = [faces_upto(level) for level in range(LEVELS + 1)]
    level = F.array_max(F.filter(F.array(*[F.when(n <= F.col("target_faces"), lv) for lv, n in enumerate(upto)]), lambda x: x.isNotNull()))
    return targets.join(told, "mesh_id").select("mesh_id", "target_faces", level.alias("level"))


def _levels(gridded: DataFrame, targets: DataFrame) -> DataFrame:
    """``mesh_id target_faces level``: the finest level within budget."""
    open_, done = materialize(_first_levels(gridded, targets).withColumn("_open", F.col("level") < LEVELS), "levels"), None
    while not open_.filter("_open").isEmpty():
        closed = open_.filter("NOT _open")
        done = closed if done is None else done.unionByName(closed)
        still = open_.filter("_open")
        tried = gridded.join(still, "mesh_id").withColumn("_level", F.explode(F.sequence(F.col("level") + 1, F.least(F.col("level") + STEP, F.lit(LEVELS)))))
        a, b, c = (_cell(k, F.col("_level")) for k in g.CORNERS)
        keys = dict(zip(("_k1", "_k2", "_k3"), _sorted(a, b, c), strict=True))
        faces = tried.filter((a != b) & (b != c) & (a != c)).select("mesh_id", "_level", *[v.alias(k) for k, v in keys.items()]).distinct()
        counted = faces.groupBy("mesh_id", "_level").agg(F.count("*").alias("_n")).join(still.select("mesh_id", "target_faces"), "mesh_id")
        within = F.col("_n") <= F.col("target_faces")
        best = counted.groupBy("mesh_id").agg(F.max(F.when(within, F.col("_level"))).alias("_best"), F.bool_or(~within).alias("_over"))
        # A mesh without a face at these levels has none above budget.
        moved = still.join(best, "mesh_id", "left")
        level = F.when(F.col("_over"), F.coalesce("_best", "level")).otherwise(F.least(F.col("level") + STEP, F.lit(LEVELS)))
        open_ = moved.select("mesh_id", "target_faces", level.alias("level"), (~F.coalesce("_over", F.lit(False)) & (level < LEVELS)).alias("_open"))
        open_ = materialize(open_, "levels")
    return (open_ if done is None else done.unionByName(open_)).drop("_open")


def _splits(gridded: DataFrame, levels: DataFrame) -> DataFrame:
    """``mesh_id split faces``: how far the order of splits can be followed within budget, and the faces then.

    A face of the finer grid takes up to four forms as its corners split off one after the other. A form lasts
    from the split of its last corner that has to the first of one that has not.
    """
    fine = F.col("level") + 1
    cells, places = {k: _cell(k, fine) for k in g.CORNERS}, {k: _place(k, fine) for k in g.CORNERS}
    a, b, c = cells.values()
    joined = gridded.join(levels.filter(F.col("level") < LEVELS), "mesh_id").filter((a != b) & (b != c) & (a != c))
    corner = F.sort_array(F.array(*[F.struct(places[k].alias("p"), cells[k].alias("k"), _cell(k, F.col("level")).alias("up")) for k in g.CORNERS]))
    order = joined.select("mesh_id", "target_faces", corner.alias("o"))
    flat = [F.col("o")[i][n].alias(f"{n}{i}") for i in range(3) for n in ("p", "k", "up")]
    faces = order.select("mesh_id", "target_faces", *flat).distinct()

    def form(split: int) -> Column:
        own = [F.shiftleft(f"k{i}", 1) + 1 if i < split else F.shiftleft(f"up{i}", 1) for i in range(3)]
        start = F.col(f"p{split - 1}") if split else F.lit(-1).cast("long")
        end = F.col(f"p{split}") if split < 3 else F.lit(_NEVER).cast("long")
        rest = [F.col(f"up{i}") for i in range(split, 3)]
        distinct = F.lit(True) if len(rest) < 2 else rest[0] != rest[1] if len(rest) == 2 else (rest[0] != rest[1]) & (rest[1] != rest[2]) & (rest[0] != rest[2])
        r1, r2, r3 = _sorted(*own)
        return F.when(distinct & (start < end), F.struct(r1.alias("r1"), r2.alias("r2"), r3.alias("r3"), start.alias("start"), end.alias("end")))

    forms = faces.select("mesh_id", "target_faces", F.explode(F.array(*[form(s) for s in range(4)])).alias("f")).filter("f IS NOT NULL")
    lasting = forms.groupBy("mesh_id", "target_faces", "f.r1", "f.r2", "f.r3").agg(F.min("f.start").alias("start"), F.max("f.end").alias("end"))
    events = lasting.select("mesh_id", "target_faces", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("n")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("n")))).alias("e"))
    # A cell may split off without a change to the faces; the order of splits is followed past it too.
    still = faces.select("mesh_id", "target_faces", F.explode(F.array("p0", "p1", "p2")).alias("at"), F.lit(0).alias("n"))
    steps = events.select("mesh_id", "target_faces", "e.*").unionByName(still).filter(F.col("at") < _NEVER).groupBy("mesh_id", "target_faces", "at").agg(F.sum("n").alias("_n"))
    followed = running_sum(steps, ["mesh_id"], ["at"], F.col("_n"), "faces")
    return followed.filter("faces <= target_faces").groupBy("mesh_id").agg(F.max("at").alias("split"), F.max_by("faces", "at").alias("faces"))


def _clustered(corner: str) -> Column:
    """A corner's cluster: its cell of the finer grid if that has split off, else what its cell of the coarser one keeps."""
    fine = F.least(F.col("level") + 1, F.lit(LEVELS))
    return F.when(_place(corner, fine) <= F.col("split"), F.shiftleft(_cell(corner, fine), 1) + 1).otherwise(F.shiftleft(_cell(corner, F.col("level")), 1))


def reduce_to_budget(triangles: DataFrame, budgets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triangles within their budget, and a report of every mesh.

    A cluster stands at the mean position of its corners. Meshes within budget stay as they are. A mesh above it keeps one
    face at least: if every step of the clustering collapses or exceeds the budget, its first face stays as it is.

    Args:
        triangles: of any number of meshes.
        budgets: ``mesh_id target_faces``; a budget below one counts as one. Meshes without a budget are left out of both results.

    Returns:
        Triangles, and ``mesh_id faces_before faces_after target_faces grid split exact``: ``grid`` has the cells along the longest
        edge of the coarser grid (null where nothing was reduced), ``split`` how far the finer grid's cells have split off (-1: none).
    """
    asked = budgets.select("mesh_id", F.greatest(F.col("target_faces").cast("long"), F.lit(1)).alias("target_faces"))
    boxes = materialize(grid_boxes(triangles).join(asked, "mesh_id"), "boxes")
    over = boxes.filter("n_faces > target_faces")
    gridded = materialize(_gridded(triangles, over.drop("n_faces", "target_faces")), "gridded")
    levels = _levels(gridded, over.select("mesh_id", "target_faces"))
    split = materialize(_splits(gridded, levels), "splits")
    plan = levels.join(split, "mesh_id", "left").select("mesh_id", "level", F.coalesce("split", F.lit(-1)).alias("split"))
    a, b, c = (F.col(f"r{k}") for k in g.CORNERS)
    celled = gridded.join(plan, "mesh_id").select(
        "mesh_id", "fid", *[f"{k}{t}" for k in g.CORNERS for t in g.XYZ], *[_clustered(k).alias(f"r{k}") for k in g.CORNERS]
    )
    faces = celled.filter((a != b) & (b != c) & (a != c))
    low, middle, high = _sorted(a, b, c)
    first = [F.min("fid").alias("fid"), *[F.min_by(f"r{k}", "fid").alias(f"r{k}") for k in g.CORNERS]]
    kept = faces.groupBy("mesh_id", low.alias("_1"), middle.alias("_2"), high.alias("_3")).agg(*first).drop("_1", "_2", "_3")
    kept = materialize(kept, "kept")
    spots = F.explode(F.array(*[F.struct(F.col(f"r{k}").alias("cell"), *[g.col(k, t).alias(t) for t in g.XYZ]) for k in g.CORNERS]))
    centres = celled.select("mesh_id", spots.alias("s")).groupBy("mesh_id", "s.cell").agg(*[F.avg(f"s.{t}").alias(t) for t in g.XYZ])
    corner = F.posexplode(F.array(*[F.col(f"r{k}") for k in g.CORNERS])).alias("corner", "cell")
    long = kept.select("mesh_id", "fid", corner).join(centres, ["mesh_id", "cell"])
    reduced = long.groupBy("mesh_id", "fid").agg(
        *[F.max(F.when(F.col("corner") == i, F.col(t))).alias(f"{k}{t}") for i, k in enumerate(g.CORNERS) for t in g.XYZ]
    )
    counts = kept.groupBy("mesh_id").agg(F.count("*").alias("_n"))
    # Nothing between no face and too many: one face stands for the mesh.
    lone = levels.join(counts, "mesh_id", "left_anti").select("mesh_id")
    single = celled.join(lone, "mesh_id", "left_semi").groupBy("mesh_id").agg(F.min("fid").alias("fid"))
    columns = ["mesh_id", "fid", *[f"{k}{t}" for k in g.CORNERS for t in g.XYZ]]
    alone = celled.join(single, ["mesh_id", "fid"], "left_semi").dropDuplicates(["mesh_id", "fid"]).select(*columns)
    fitting = boxes.filter("n_faces <= target_faces").select("mesh_id")
    untouched = triangles.join(fitting, "mesh_id", "left_semi").select(*columns)
    after = F.when(F.col("level").isNull(), F.col("n_faces")).otherwise(F.coalesce("_n", F.lit(1)))
    report = boxes.join(plan, "mesh_id", "left").join(counts, "mesh_id", "left").select(
        "mesh_id", F.col("n_faces").alias("faces_before"), after.alias("faces_after"), "target_faces",
        F.call_function("shiftleft", F.lit(1).cast("long"), F.col("level").cast("int")).alias("grid"), F.when(F.col("level").isNotNull(), F.col("split")).alias("split"),
        (after == F.col("target_faces")).alias("exact"),
    )
    return reduced.select(*columns).unionByName(alone).unionByName(untouched), report
