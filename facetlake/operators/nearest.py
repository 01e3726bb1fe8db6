"""Nearest-vertex and nearest-face joins by two trees that are split by load.

Points and targets of a mesh are laid out along a curve through space and cut into leaves of equal number, so a crowded
corner, a far outlier or a very large face makes no leaf heavier than others. Sixteen leaves form a node, sixteen nodes the
next one, each with its bounding box. The join goes down both trees at once: a pair of nodes is followed only if
its boxes are no farther apart than the farthest that some target of the point node can be. Pairs of leaves are
compared in arrays, by blocks of neighbouring point leaves: a target is sent to a block once, nearest boxes first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.functions import geometry as g
from facetlake.operators import mesh
from facetlake.operators.ordering import positions
from facetlake.session import drop_stored, materialize, scratch

#: Points or vertices of a leaf, faces of a leaf, and children of a node.
LEAF, FACE_LEAF, FAN = 128, 64, 16
#: Point leaves that are compared by one task together.
BLOCK = 16
#: Steps of the curve along the longest edge.
STEPS = 1 << 20
#: Distances of boxes are compared with this much room for rounding.
ROOM = 1 + 1e-9

_LOW, _HIGH = [f"l{t}" for t in g.XYZ], [f"h{t}" for t in g.XYZ]
_SPREAD = ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249))


def _curve(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Place of a cell on the curve: the bits of its three numbers by turns."""
    out = np.zeros(len(x), np.int64)
    for shift, v in enumerate((x, y, z)):
        for by, mask in _SPREAD:
            v = (v | v << by) & mask
        out |= v << shift
    return out


def _leaves(rows: DataFrame, key: str, fields: list[str], size: int, by_size: bool) -> DataFrame:
    """``mesh_id node`` with its box and ``items``, the rows of a leaf in order of their key; ``node`` counts leaves along the curve.

    ``rows`` have the box of each in ``lx`` to ``hz``. With ``by_size`` large boxes come before small ones, and do not
    widen the leaves of those around them.
    """
    whole = rows.groupBy("mesh_id").agg(*[F.min(f"l{t}").alias(f"_o{t}") for t in g.XYZ], F.greatest(*[F.max(f"h{t}") - F.min(f"l{t}") for t in g.XYZ]).alias("_w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*_LOW, *_HIGH, "_ox", "_oy", "_oz", "_w")}
            wide = np.where(at["_w"] > 0, at["_w"], 1.0)
            cells = [np.clip(((at[f"l{t}"] + at[f"h{t}"]) / 2 - at[f"_o{t}"]) / wide * (STEPS - 1), 0, STEPS - 1).astype(np.int64) for t in g.XYZ]
            extent = np.maximum.reduce([at[f"h{t}"] - at[f"l{t}"] for t in g.XYZ]) / wide
            rank = np.floor(-np.log2(np.maximum(extent, 2.0**-40))).astype(np.int64) if by_size else np.zeros(len(wide), np.int64)
            kept = [n for n in batch.schema.names if not n.startswith("_")]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], pa.array(rank), pa.array(_curve(*cells))], [*kept, "_rank", "_at"])

    joined = rows.join(whole, "mesh_id")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    laid = positions(joined.mapInArrow(run, f"{schema}, _rank long, _at long"), ["mesh_id"], ["_rank", "_at", key], "_pos")
    item = F.struct(key, *fields)
    boxes = [F.min(c).alias(c) for c in _LOW] + [F.max(c).alias(c) for c in _HIGH]
    leaf = (F.col("_pos") / size).cast("long").alias("node")
    return laid.groupBy("mesh_id", leaf).agg(*boxes, F.sort_array(F.collect_list(item)).alias("items"))


def _levels(leaves: DataFrame, depth: int) -> list[DataFrame]:
    """Boxes of the nodes of every level, leaves first."""
    out = [leaves.select("mesh_id", "node", *_LOW, *_HIGH)]
    for _ in range(depth):
        boxes = [F.min(c).alias(c) for c in _LOW] + [F.max(c).alias(c) for c in _HIGH]
        out.append(out[-1].groupBy("mesh_id", (F.col("node") / FAN).cast("long").alias("node")).agg(*boxes))
    return out


def _named(nodes: DataFrame, side: str) -> DataFrame:
    up = (F.col("node") / FAN).cast("long").alias(f"up_{side}")
    return nodes.select("mesh_id", F.col("node").alias(side), up, *[F.col(c).alias(f"{side}_{c}") for c in (*_LOW, *_HIGH)])


def _pruned(pairs: DataFrame) -> DataFrame:
    """Pairs of nodes ``p t`` whose boxes may hold a point and its nearest target, with the squared distance of the boxes."""
    near = far = F.lit(0.0)
    for t in g.XYZ:
        apart = F.greatest(F.lit(0.0), F.col(f"t_l{t}") - F.col(f"p_h{t}"), F.col(f"p_l{t}") - F.col(f"t_h{t}"))
        reach = F.greatest(F.col(f"t_h{t}") - F.col(f"p_l{t}"), F.col(f"p_h{t}") - F.col(f"t_l{t}"))
        near, far = near + apart * apart, far + reach * reach
    # Some target is in every box, so no point is farther from its nearest than the farthest corner of the best box.
    best = F.min("_far").over(Window.partitionBy("mesh_id", "p"))
    measured = pairs.select("mesh_id", "p", "t", near.alias("near"), far.alias("_far")).withColumn("_best", best)
    return measured.filter(F.col("near") <= F.col("_best") * ROOM).select("mesh_id", "p", "t", "near")


def _nearest(points: DataFrame, targets: DataFrame, key: str, fields: list[str], leaf: int, distance2: Callable[[np.ndarray, np.ndarray], np.ndarray], by_size: bool) -> DataFrame:
    """``mesh_id pid d2`` and the key of the nearest target; the smaller key on ties.

    ``distance2`` gives the squared distances of points (rows of three) and targets (rows of ``fields``).
    """
    boxed = points.select("mesh_id", "pid", *g.XYZ, *[F.col(t).alias(f"{s}{t}") for s in "lh" for t in g.XYZ])
    with scratch(points.sparkSession):
        targets = materialize(targets, "targets")
        boxed = boxed.join(targets.select("mesh_id").distinct(), "mesh_id", "left_semi")
        p_leaves = materialize(_leaves(boxed, "pid", list(g.XYZ), LEAF, False), "point_leaves", keep=True)
        t_leaves = materialize(_leaves(targets, key, fields, leaf, by_size), "target_leaves", keep=True)
    most = p_leaves.select("node").unionByName(t_leaves.select("node")).agg(F.max("node")).first()[0] or 0
    depth = 0
    while most >= FAN:
        most, depth = most // FAN, depth + 1
    p_levels, t_levels = _levels(p_leaves, depth), _levels(t_leaves, depth)
    pairs = _pruned(_named(p_levels[depth], "p").join(_named(t_levels[depth], "t"), "mesh_id"))
    upper = None
    for level in reversed(range(depth)):
        stored = materialize(pairs, "node_pairs")
        if upper is not None:
            drop_stored(upper)
        upper, above = stored, stored.select("mesh_id", F.col("p").alias("up_p"), F.col("t").alias("up_t"))
        down = above.join(_named(p_levels[level], "p"), ["mesh_id", "up_p"]).join(_named(t_levels[level], "t"), ["mesh_id", "up_t"])
        pairs = _pruned(down)
    kind, kinds = points.schema["mesh_id"].dataType.simpleString(), (points.schema["pid"].dataType.simpleString(), targets.schema[key].dataType.simpleString())

    pairs = materialize(pairs, "leaf_pairs")
    if upper is not None:
        drop_stored(upper)
    fan = (F.col("p") / BLOCK).cast("long").alias("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by block: its point leaves, then targets by the distance of the boxes."""
        current, mesh_type, mine = None, None, {}

        def told() -> Iterator[pa.RecordBatch]:
            for pid, _, d2, found, met in mine.values():
                if met:
                    yield pa.RecordBatch.from_arrays([pa.array([current[0]] * len(pid), mesh_type), pid, pa.array(d2), pa.array(found)], ["mesh_id", "pid", "d2", key])

        for batch in batches:
            mesh_type = batch.schema.field("mesh_id").type
            for name, block, p, points, near, others in zip(*(batch.column(c) for c in ("mesh_id", "block", "p", "mine", "pairs", "others")), strict=True):
                if (at := (name.as_py(), block.as_py())) != current:
                    yield from told()
                    current, mine = at, {}
                if points.is_valid:
                    rows = points.values
                    spots = np.stack([rows.field(t).to_numpy(zero_copy_only=False) for t in g.XYZ], 1)
                    mine[p.as_py()] = [rows.field("pid"), spots, np.full(len(spots), np.inf), np.zeros(len(spots), np.int64), False]
                    continue
                shapes = None
                for p, apart in zip(*(near.values.field(c).to_pylist() for c in ("p", "near")), strict=True):
                    leaf = mine[p]
                    _, spots, least, chosen, _ = leaf
                    leaf[4] = True
                    rows = np.flatnonzero(least * ROOM >= apart)
                    if not len(rows):
                        continue
                    if shapes is None:
                        shapes = np.stack([others.values.field(f).to_numpy(zero_copy_only=False) for f in fields], 1)
                        keys = others.values.field(key).to_numpy(zero_copy_only=False)
                    d2 = distance2(spots[rows], shapes)
                    # Targets are in order of their key, so the first of equal distances has the smallest.
                    at = d2.argmin(axis=1)
                    d2, found = d2[np.arange(len(at)), at], keys[at]
                    better = (d2 < least[rows]) | ((d2 == least[rows]) & (found < chosen[rows]))
                    least[rows[better]], chosen[rows[better]] = d2[better], found[better]
        yield from told()

    # A target travels once for all point leaves of a block, and points once.
    told = pairs.groupBy("mesh_id", fan, "t").agg(F.min("near").alias("near"), F.collect_list(F.struct("p", "near")).alias("pairs"))
    others = t_leaves.select("mesh_id", F.col("node").alias("t"), F.col("items").alias("others"))
    mine = p_leaves.select("mesh_id", F.col("node").alias("p"), F.col("items").alias("mine"))
    rows = mine.select("mesh_id", fan, F.lit(-1.0).alias("near"), "p", "mine").unionByName(told.join(others, ["mesh_id", "t"]).drop("t"), allowMissingColumns=True)
    # A block with all its targets in one task, one target in memory at a time.
    rows = rows.repartition("mesh_id", "block").sortWithinPartitions("mesh_id", "block", "near")
    return rows.select("mesh_id", "block", "p", "mine", "pairs", "others").mapInArrow(run, f"mesh_id {kind}, pid {kinds[0]}, d2 double, {key} {kinds[1]}")


def vertex_distance2(points: np.ndarray, vertices: np.ndarray) -> np.ndarray:
    dx, dy, dz = (vertices[None, :, a] - points[:, None, a] for a in range(3))
    return dx * dx + dy * dy + dz * dz


def nearest_vertex(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Closest target of each point: ``mesh_id pid d2 vid``; the smaller id on ties.

    ``points``: ``mesh_id pid x y z``; ``targets``: ``mesh_id vid x y z``. Points of meshes without targets are left out.
    """
    folded = targets.groupBy("mesh_id", *g.XYZ).agg(F.min("vid").alias("vid"))
    boxed = folded.select("mesh_id", "vid", *g.XYZ, *[F.col(t).alias(f"{s}{t}") for s in "lh" for t in g.XYZ])
    return _nearest(points, boxed, "vid", list(g.XYZ), LEAF, vertex_distance2, False)


def carry_attributes(points: DataFrame, vertices: DataFrame, attributes: list[str]) -> DataFrame:
    """Give each point the attributes of its nearest source vertex; absent attributes are NULL."""
    found = nearest_vertex(points, vertices)
    have = [a for a in attributes if a in vertices.columns]
    source = vertices.select("mesh_id", "vid", *have)
    out = points.join(found, ["mesh_id", "pid"], "left").join(source, ["mesh_id", "vid"], "left")
    missing = [F.lit(None).cast("double").alias(a) for a in attributes if a not in have]
    return out.select(*points.columns, *have, *missing)


def face_distance2(points: np.ndarray, faces: np.ndarray) -> np.ndarray:
    """Squared distances of points and triangles (rows of nine).

    The smallest of the three edge distances, or the plane distance where the projection falls inside the triangle.
    """
    p = [points[:, None, a] for a in range(3)]
    corner = {k: [faces[None, :, 3 * i + a] for a in range(3)] for i, k in enumerate("abc")}

    def dot(u: list[np.ndarray], v: list[np.ndarray]) -> np.ndarray:
        return u[0] * v[0] + u[1] * v[1] + u[2] * v[2]

    def cross(u: list[np.ndarray], v: list[np.ndarray]) -> list[np.ndarray]:
        return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]

    def minus(u: list[np.ndarray], v: list[np.ndarray]) -> list[np.ndarray]:
        return [x - y for x, y in zip(u, v, strict=True)]

    normal = cross(minus(corner["b"], corner["a"]), minus(corner["c"], corner["a"]))
    nn = dot(normal, normal)
    inside, least = nn > 0, None
    for u, v in (("a", "b"), ("b", "c"), ("c", "a")):
        d, w = minus(corner[v], corner[u]), minus(p, corner[u])
        length2 = dot(d, d)
        s = np.clip(dot(w, d) / np.where(length2 > 0, length2, 1.0), 0.0, 1.0)
        rest = [x - s * y for x, y in zip(w, d, strict=True)]
        edge = dot(rest, rest)
        least = edge if least is None else np.minimum(least, edge)
        inside = inside & (dot(cross(d, w), normal) >= 0)
    above = dot(minus(p, corner["a"]), normal)
    return np.where(inside, above * above / np.where(nn > 0, nn, 1.0), least)


def nearest_face(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Closest face of each point: ``mesh_id pid d2 fid``; the smaller id on ties.

    Points of meshes without faces are left out.
    """
    fields = [f"{k}{t}" for k in g.CORNERS for t in g.XYZ]

    def ends(end: Callable[..., Column], side: str) -> list[Column]:
        return [end(*[g.col(k, t) for k in g.CORNERS]).alias(f"{side}{t}") for t in g.XYZ]

    boxed = triangles.select("mesh_id", "fid", *fields, *ends(F.least, "l"), *ends(F.greatest, "h"))
    return _nearest(points, boxed, "fid", fields, FACE_LEAF, face_distance2, True)


def nearest_normals(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """Unit normal of the closest face, as 0..255 colour levels ``r g b``."""
    found = nearest_face(points, triangles)
    n = mesh.unit_normals(triangles)
    level = {c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (F.col(f"n{t}") * 0.5 + 0.5) * 255.0))).cast("int")
             for c, t in zip("rgb", g.XYZ)}
    return found.join(n, ["mesh_id", "fid"]).select("mesh_id", "pid", "fid", "d2", *[c.alias(k) for k, c in level.items()])
