"""Sparse voxel operators: sampling, dilation, interior fill, exposed faces, repair.

The rebuilt surface is blocky: it is made of voxel faces, not of a smoothed field.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.functions import bitgrid
from facetlake.functions import geometry as g
from facetlake.operators import mesh
from facetlake.operators.cells import whole
from facetlake.operators.components import components
from facetlake.session import materialize

# Grid limits, dilation schedule and acceptance of a repair.
DIVISIONS = 256
MIN_GRID = 16
MAX_DILATE = 16
DILATE_DIVISOR = 64
FILL_FLOOR = 0.35
SHATTERED_BELOW = 0.15
#: A packed grid of so many divisions is about 150 MB; a mesh's grid meets in one task.
MAX_DIVISIONS = 1024

IJK = ("i", "j", "k")
SIDES = ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))


def pitches(triangles: DataFrame, divisions: int = DIVISIONS) -> DataFrame:
    """Voxel edge per mesh: the longest extent over the number of divisions."""
    longest = F.greatest("extent_x", "extent_y", "extent_z")
    return mesh.measures(triangles).filter(longest > 0).select(
        "mesh_id", (longest / float(max(MIN_GRID, divisions))).alias("pitch")
    )


#: Voxels of meshes as runs of columns, and as boxes of bits from a first cell on.
RUNS, BOXES = "mesh_id {}, i long, j long, lo long, hi long", "mesh_id {}, i long, j long, k long, size array<long>, cells binary"
BOX_COLUMNS = ["mesh_id", *IJK, "size", "cells"]


def voxelise(triangles: DataFrame, pitch: DataFrame) -> DataFrame:
    """Voxels touched by the surface: ``mesh_id i j k``.

    Each face is sampled on its own barycentric lattice with steps of at most half a voxel. Meshes of up to ``TASK_FACES`` faces
    travel as faces and are sampled by one task each; of others the samples are rows, so memory is bounded by partitions.
    A cell merely grazed by the surface may differ from other subdivision schemes.
    """
    corners = [f"{k}{t}" for k in g.CORNERS for t in g.XYZ]
    room = F.lit(1.0)
    for t in g.XYZ:
        ends = [g.col(k, t) for k in g.CORNERS]
        room = room * ((F.max(F.greatest(*ends)) - F.min(F.least(*ends))) / F.first("pitch") + 2 * MARGIN + 1)
    missing = F.max(F.greatest(*[F.col(c).isNull().cast("int") for c in corners]))
    sizes = triangles.join(pitch, "mesh_id").groupBy("mesh_id").agg(F.count("*").alias("_n"), missing.alias("_missing"), room.alias("_room"))
    sizes = materialize(sizes.select("mesh_id", ((F.col("_n") <= TASK_FACES) & (F.col("_missing") == 0) & (F.col("_room") <= LOOSE_CELLS)).alias("_few")), "sizes")
    n_few, n_many = sizes.agg(F.count_if("_few"), F.count_if(~F.coalesce("_few", F.lit(False)))).first()
    if not n_few:
        return _voxelised_rows(triangles, pitch)
    few = triangles if not n_many else triangles.join(sizes.filter("_few").select("mesh_id"), "mesh_id", "left_semi")
    tasks = max(4 * triangles.sparkSession.sparkContext.defaultParallelism, min(n_few // TASK_BOXES, TASKS))
    faces = few.join(pitch, "mesh_id").select("mesh_id", "pitch", *corners).repartition(tasks, "mesh_id").sortWithinPartitions("mesh_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole(batches, ["mesh_id"], TASK_ROWS):
            at = np.stack([table[n].to_numpy() for n in corners], 1).reshape(-1, 3, 3)
            for owner, low, size, grid in _loose(at, table["pitch"].to_numpy(), number):
                cells = [np.packbits(x[: n[0], : n[1], : n[2]], bitorder="little").tobytes() for x, n in zip(grid, size, strict=True)]
                names = table["mesh_id"].take(pa.array(np.searchsorted(number, owner)))
                out = [names, *map(pa.array, low.T), pa.array(size.tolist(), pa.list_(pa.int64())), pa.array(cells, pa.binary())]
                yield from pa.Table.from_arrays(out, BOX_COLUMNS).to_batches()

    kind = triangles.schema["mesh_id"].dataType.simpleString()
    boxes = faces.mapInArrow(run, BOXES.format(kind))
    sampled = _unrolled(boxes.mapInArrow(_unboxed, RUNS.format(kind)))
    if not n_many:
        # The same voxels packed, for operators that take whole meshes.
        sampled._boxes = boxes
        return sampled
    rest = triangles.join(sizes.filter("_few is null or not _few").select("mesh_id"), "mesh_id", "left_semi")
    return sampled.unionByName(_voxelised_rows(rest, pitch))


#: Empty cells around a mesh in a grid, and the most cells of a grid of one byte a cell.
MARGIN, LOOSE_CELLS = 2, 1 << 26
#: Rows of small meshes that a task works on together, small meshes of a task, and bytes of their grids at a time.
TASK_ROWS, TASK_BOXES, TASK_CELLS = 10_000, 1000, 1 << 23


def _loose(corners: np.ndarray, pitch: np.ndarray, number: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Meshes that fit in ``TASK_CELLS`` together, the first cell and size of the box of each, and their shells, one byte a cell.

    ``number`` of the mesh of each face ascends.
    """
    owners, start = np.unique(number, return_index=True)
    ends = np.rint(corners / pitch[:, None, None]).astype(np.int64)
    low = np.minimum.reduceat(ends.min(axis=1), start) - MARGIN
    shape = np.maximum.reduceat(ends.max(axis=1), start) + MARGIN + 1 - low
    for first, last in _together(shape):
        size = shape[first:last].max(axis=0)
        grid = np.zeros((last - first, *size), np.uint8)
        flat = grid.reshape(-1)
        begin, end = start[first], start[last] if last < len(start) else len(number)
        rank = np.repeat(np.arange(last - first), np.diff(np.append(start[first:last], end)))
        first_cell = low[first:last][rank]
        for rows, i, j, k in _samples(corners[begin:end], pitch[begin:end], np.arange(end - begin)):
            mine = rank[rows]
            for axis, cell in enumerate((i, j, k)):
                mine *= size[axis]
                mine += cell
                mine -= first_cell[:, axis][rows]
            flat[mine] = 1
        yield owners[first:last], low[first:last], shape[first:last], grid


def _together(shape: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of grids that fit in ``TASK_CELLS`` if all have the size of the largest; one at least."""
    first = 0
    while first < len(shape):
        cells = np.prod(np.maximum.accumulate(shape[first:], axis=0), axis=1, dtype=float) * np.arange(1, len(shape) - first + 1)
        last = first + max(1, int(np.searchsorted(cells, TASK_CELLS, "right")))
        yield first, last
        first = last


def _tight(loose: np.ndarray) -> np.ndarray:
    """Words ``[mesh, i, j, word]`` of grids of one byte a cell."""
    full = -loose.shape[-1] % bitgrid.BITS
    bits = np.packbits(loose, axis=-1, bitorder="little")
    return np.ascontiguousarray(np.pad(bits, ((0, 0),) * 3 + ((0, (loose.shape[-1] + full) // 8 - bits.shape[-1]),))).view(np.uint64)


def _runs(names: pa.Array, low: np.ndarray, grid: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``mesh_id i j lo hi`` of the cells of grids ``[mesh, i, j, word]``."""
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    first, last = bitgrid.runs(grid)
    high = grid.shape[-1] * bitgrid.BITS
    column, lo = np.divmod(first, high)
    column, j = np.divmod(column, grid.shape[2])
    owner, i = np.divmod(column, grid.shape[1])
    out = [names.take(pa.array(owner)), *map(pa.array, (i + low[owner, 0], j + low[owner, 1], lo + low[owner, 2], last % high + low[owner, 2]))]
    yield from pa.Table.from_arrays(out, ["mesh_id", "i", "j", "lo", "hi"]).to_batches(max_chunksize=10_000)


def _unrolled(runs: DataFrame) -> DataFrame:
    return runs.select("mesh_id", "i", "j", F.explode(F.sequence("lo", "hi")).alias("k"))


def _voxelised_rows(triangles: DataFrame, pitch: DataFrame) -> DataFrame:
    """``voxelise`` with a row a sample."""
    corner = {k: [g.col(k, t) for t in g.XYZ] for k in g.CORNERS}

    def length(p: str, q: str) -> Column:
        return g.norm(*[a - b for a, b in zip(corner[p], corner[q])])

    longest = F.greatest(length("a", "b"), length("b", "c"), length("c", "a"))
    steps = F.greatest(F.lit(1), F.ceil(longest / (F.col("pitch") * 0.5)).cast("int"))
    lattice = (
        triangles.join(pitch, "mesh_id")
        .withColumn("_n", steps)
        .withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n"))))
        .withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n") - F.col("_s"))))
    )

    def cell(t: str) -> Column:
        p = (
            g.col("a", t)
            + (g.col("b", t) - g.col("a", t)) * F.col("_s") / F.col("_n")
            + (g.col("c", t) - g.col("a", t)) * F.col("_t") / F.col("_n")
        )
        return F.rint(p / F.col("pitch")).cast("bigint")

    return lattice.select("mesh_id", *[cell(t).alias(n) for t, n in zip(g.XYZ, IJK)]).distinct()


def _shifted(voxels: DataFrame, offsets: Sequence[tuple[int, int, int]]) -> DataFrame:
    rest = [c for c in voxels.columns if c not in IJK]
    moves = F.array(*[F.struct(*[F.lit(d).alias(f"d{n}") for n, d in zip(IJK, o)]) for o in offsets])
    return voxels.withColumn("_o", F.explode(moves)).select(
        *rest, *[(F.col(n) + F.col(f"_o.d{n}")).alias(n) for n in IJK]
    )


def dilate(voxels: DataFrame, steps: int = 1) -> DataFrame:
    """Grow by ``steps`` in the six-neighbourhood."""
    for _ in range(steps):
        voxels = _shifted(voxels, ((0, 0, 0), *SIDES)).distinct()
    return voxels


def erode(voxels: DataFrame, steps: int = 1) -> DataFrame:
    """Shrink by ``steps``: a voxel stays if its six neighbours are occupied."""
    for _ in range(steps):
        near = _shifted(voxels, ((0, 0, 0), *SIDES)).groupBy("mesh_id", *IJK).agg(F.count("*").alias("_n"))
        voxels = near.filter("_n = 7").drop("_n")
    return voxels


def gaps(voxels: DataFrame) -> DataFrame:
    """Empty runs between occupied cells of each (i, j) column: ``lo``..``hi`` inclusive.

    A column is at most the grid height, so its window is bounded.
    """
    w = Window.partitionBy("mesh_id", "i", "j").orderBy("k")
    return (
        voxels.withColumn("_next", F.lead("k").over(w))
        .filter("_next > k + 1")
        .select("mesh_id", "i", "j", (F.col("k") + 1).alias("lo"), (F.col("_next") - 1).alias("hi"))
    )


def fill(voxels: DataFrame) -> DataFrame:
    """Add empty cells that the outside cannot reach.

    Voxels travel packed, a box of bits for what a task has of a mesh. Meshes in boxes of up to ``FILL_CELLS`` cells are
    filled by one task each, others as runs of cells. Cells with a missing index are passed on.
    """
    kind = voxels.schema["mesh_id"].dataType.simpleString()
    packed = getattr(voxels, "_boxes", None)
    if packed is None:
        packed = voxels.select("mesh_id", *IJK).mapInArrow(_boxed, BOXES.format(kind))
    packed = materialize(packed, "boxes")
    boxes = packed.filter("cells is not null")
    room = F.lit(1.0)
    for axis, n in enumerate(IJK):
        room = room * (F.max(F.col(n) + F.get("size", axis)) - F.min(n) + 2)
    sizes = materialize(boxes.groupBy("mesh_id").agg((room <= FILL_CELLS).alias("_few")), "sizes")
    n_few, n_many = sizes.agg(F.count_if("_few"), F.count_if(~F.col("_few"))).first()
    out = packed.filter("cells is null").select("mesh_id", *IJK)
    if n_few:
        few = boxes if not n_many else boxes.join(sizes.filter("_few").select("mesh_id"), "mesh_id", "left_semi")
        tasks = max(4 * voxels.sparkSession.sparkContext.defaultParallelism, min(n_few // TASK_BOXES, TASKS))
        few = few.repartition(tasks, "mesh_id").sortWithinPartitions("mesh_id")
        out = out.unionByName(_unrolled(few.mapInArrow(_filled, RUNS.format(kind))))
    if n_many:
        many = boxes.join(sizes.filter("not _few").select("mesh_id"), "mesh_id", "left_semi")
        out = out.unionByName(_filled_rows(_unrolled(many.mapInArrow(_unboxed, RUNS.format(kind))).distinct()))
    return out


#: A mesh in a box of more cells is filled by joins of its runs.
FILL_CELLS = 1 << 24
#: Voxels that a task packs together.
BOX_ROWS = 200_000


def _boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Boxes of bits ``mesh_id i j k size cells`` from the lowest cell on; cells far apart are boxes of their own."""
    names = BOX_COLUMNS

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        known = pc.and_(pc.and_(table["i"].is_valid(), table["j"].is_valid()), pc.and_(table["k"].is_valid(), table["mesh_id"].is_valid()))
        odd, table = table.filter(pc.invert(known)), table.filter(known).combine_chunks()
        if odd.num_rows:
            none = [pa.nulls(odd.num_rows, t) for t in (pa.list_(pa.int64()), pa.binary())]
            yield from pa.Table.from_arrays([*(odd[n] for n in names[:4]), *none], names).to_batches()
        if not table.num_rows:
            return
        found = table["mesh_id"].combine_chunks().dictionary_encode()
        owner, at = found.indices.to_numpy(), np.stack([table[n].to_numpy() for n in IJK], 1)
        order = np.argsort(owner, kind="stable")
        owner, at = owner[order], at[order]
        rows = []
        for part, n in zip(np.split(at, np.flatnonzero(np.diff(owner)) + 1), np.unique(owner), strict=True):
            low, size = part.min(axis=0), np.ptp(part, axis=0) + 1
            if np.prod(size, dtype=float) > 512 * len(part):
                # A few cells in a large box.
                rows += [(n, *cell, [1, 1, 1], b"\1") for cell in np.unique(part, axis=0).tolist()]
                continue
            box = np.zeros(size, np.uint8)
            box[tuple((part - low).T)] = 1
            rows.append((n, *low.tolist(), size.tolist(), np.packbits(box, bitorder="little").tobytes()))
        n, i, j, k, size, cells = zip(*rows, strict=True)
        out = [found.dictionary.take(pa.array(n)), *(pa.array(x, pa.int64()) for x in (i, j, k)), pa.array(size, pa.list_(pa.int64())), pa.array(cells, pa.binary())]
        yield from pa.Table.from_arrays(out, names).to_batches(max_chunksize=10_000)

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BOX_ROWS:
            yield from told(held)
            held, n = [], 0
    if n:
        yield from told(held)


def _open_boxes(table: pa.Table, number: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Names of meshes, the lowest cell of each and their cells in words ``[mesh, i, j, word]`` with an empty border; ``number`` ascends."""
    start = np.unique(number, return_index=True)[1]
    at = np.stack([table[n].to_numpy() for n in IJK], 1)
    size = table["size"].combine_chunks().values.to_numpy().reshape(-1, 3)
    low = np.minimum.reduceat(at, start) - 1
    shape = np.maximum.reduceat(at + size, start) + 1 - low
    cells = table["cells"].to_pylist()
    for first, last in _together(shape):
        grid = np.zeros((last - first, *shape[first:last].max(axis=0)), np.uint8)
        end = start[last] if last < len(start) else len(number)
        owner = np.repeat(np.arange(first, last), np.diff(np.append(start[first:last], end)))
        for row, n in zip(range(start[first], end), owner, strict=True):
            i, j, k = size[row]
            box = np.unpackbits(np.frombuffer(cells[row], np.uint8), count=i * j * k, bitorder="little").reshape(i, j, k)
            x, y, z = at[row] - low[n]
            grid[n - first, x : x + i, y : y + j, z : z + k] |= box
        yield table["mesh_id"].take(pa.array(start[first:last])), low[first:last], _tight(grid)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs ``mesh_id i j lo hi`` of whole meshes, pockets included."""
    for table, number in whole(batches, ["mesh_id"], TASK_ROWS):
        for names, low, grid in _open_boxes(table, number):
            # Meshes lie beside each other, out of each other's reach.
            line = np.moveaxis(np.ascontiguousarray(grid.transpose(1, 3, 2, 0)), (1, 2, 3), (3, 1, 2))
            yield from _runs(names, low, ~np.moveaxis(bitgrid.outside(line), 2, 0))


def _unboxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of each box by itself."""
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            for names, low, grid in _open_boxes(table, np.arange(batch.num_rows)):
                yield from _runs(names, low, grid)


def _filled_rows(voxels: DataFrame) -> DataFrame:
    """``fill`` of meshes of any size.

    Works on runs of empty cells instead of cells: runs of neighbouring columns connect where
    they overlap, and a run touches the outside where a neighbouring column does not cover it.
    """
    voxels = materialize(voxels, "voxels")
    # A run is named by its column and start, which is unique within a mesh.
    runs = materialize(
        gaps(voxels).withColumn("run", F.struct("i", "j", "lo")), "gaps"
    )
    reach = voxels.groupBy("mesh_id", "i", "j").agg(F.min("k").alias("_bottom"), F.max("k").alias("_top"))
    around = F.explode(
        F.array(*[F.struct((F.col("i") + di).alias("i"), (F.col("j") + dj).alias("j")) for di, dj, dk in SIDES if dk == 0])
    )
    beside = runs.select("mesh_id", "run", "lo", "hi", around.alias("_c")).select(
        "mesh_id", "run", "lo", "hi", "_c.i", "_c.j"
    )
    open_runs = (
        beside.join(reach, ["mesh_id", "i", "j"], "left")
        .filter(F.col("_bottom").isNull() | (F.col("lo") < F.col("_bottom")) | (F.col("hi") > F.col("_top")))
        .select("mesh_id", "run")
        .distinct()
    )
    other = runs.select("mesh_id", "i", "j", F.col("run").alias("run2"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    links = (
        beside.join(other, ["mesh_id", "i", "j"])
        .filter((F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo")) & (F.col("run") < F.col("run2")))
        .select("mesh_id", "run", "run2")
    )
    labels = materialize(components(runs, links, a="run", b="run2", node="run"), "pockets")
    drained = labels.join(open_runs, ["mesh_id", "run"], "left_semi").select("mesh_id", "comp").distinct()
    inside = labels.join(drained, ["mesh_id", "comp"], "left_anti").select("mesh_id", "run")
    cells = (
        runs.join(inside, ["mesh_id", "run"], "left_semi")
        .select("mesh_id", "i", "j", F.explode(F.sequence("lo", "hi")).alias("k"))
    )
    return voxels.select("mesh_id", *IJK).unionByName(cells)


def exposed(voxels: DataFrame) -> DataFrame:
    """Voxel faces without an occupied neighbour: ``mesh_id i j k side``."""
    sides = F.array(
        *[
            F.struct(F.lit(s).alias("side"), *[F.lit(d).alias(f"d{n}") for n, d in zip(IJK, o)])
            for s, o in enumerate(SIDES)
        ]
    )
    faces = voxels.select("mesh_id", *IJK, F.explode(sides).alias("s")).select(
        "mesh_id", *IJK, "s.side", *[(F.col(n) + F.col(f"s.d{n}")).alias(f"_{n}") for n in IJK]
    )
    taken = voxels.select("mesh_id", *[F.col(n).alias(f"_{n}") for n in IJK])
    return faces.join(taken, ["mesh_id", "_i", "_j", "_k"], "left_anti").select("mesh_id", *IJK, "side")


def _quad(side: int) -> list[list[float]]:
    """Corner offsets of a voxel face, counter-clockwise seen from outside."""
    axis, sign = next((a, d) for a, d in enumerate(SIDES[side]) if d)
    u, v = (axis + 1) % 3, (axis + 2) % 3
    turn = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
    quad = []
    for du, dv in turn if sign > 0 else reversed(turn):
        p = [0.0, 0.0, 0.0]
        p[axis], p[u], p[v] = sign * 0.5, du * 0.5, dv * 0.5
        quad.append(p)
    return quad


def surface(voxels: DataFrame, pitch: DataFrame) -> DataFrame:
    """Closed triangle surface of the occupied volume, two triangles per exposed voxel face."""
    shapes = []
    for side in range(6):
        q = _quad(side)
        shapes.append([(q[0], q[1], q[2]), (q[0], q[2], q[3])])
    table = F.array(
        *[
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("half"),
                        *[F.lit(p[a]).alias(f"{k}{t}") for k, p in zip(g.CORNERS, tri) for a, t in enumerate(g.XYZ)],
                    )
                    for n, tri in enumerate(pair)
                ]
            )
            for pair in shapes
        ]
    )
    rows = exposed(voxels).join(pitch, "mesh_id").withColumn("q", F.explode(F.get(table, F.col("side"))))
    at = {t: F.col(n) for t, n in zip(g.XYZ, IJK)}
    out = rows.select(
        "mesh_id", *IJK, "side", "q.half",
        *[((at[t] + F.col(f"q.{k}{t}")) * F.col("pitch")).alias(f"{k}{t}") for k in g.CORNERS for t in g.XYZ],
    )
    # A face id from cell, side and half: 19 bits per signed index. Beyond that ids would repeat.
    packed = F.lit(0).cast("bigint")
    for n in IJK:
        inside = F.col(n).between(-262144, 262143)
        packed = packed * 524288 + F.when(inside, F.col(n) + 262144).otherwise(F.raise_error(F.lit("cell index beyond 19 bits")).cast("bigint"))
    return out.withColumn("fid", packed * 12 + F.col("side") * 2 + F.col("half")).drop(*IJK, "side", "half")


def occupancy(voxels: DataFrame, pitch: DataFrame) -> DataFrame:
    """Occupied volume and its share of the occupied bounding box, per mesh."""
    span = F.lit(1).cast("bigint")
    for n in IJK:
        span = span * (F.max(n) - F.min(n) + 1)
    return (
        voxels.groupBy("mesh_id")
        .agg(F.count("*").alias("cells"), span.alias("box_cells"))
        .join(pitch, "mesh_id")
        .select(
            "mesh_id", "cells",
            (F.col("cells") * F.pow("pitch", F.lit(3.0))).alias("volume"),
            (F.col("cells") / F.col("box_cells")).alias("fill"),
        )
    )


def voxel_components(voxels: DataFrame) -> DataFrame:
    """Number of connected bodies of occupied voxels per mesh, on vertical runs of cells.

    Runs are maximal occupied stretches of a column; a column is bounded by the grid height.
    """
    w = Window.partitionBy("mesh_id", "i", "j").orderBy("k")
    starts = voxels.withColumn("_new", F.coalesce((F.col("k") - F.lag("k").over(w) > 1).cast("int"), F.lit(1)))
    runs = (
        starts.withColumn("_r", F.sum("_new").over(w))
        .groupBy("mesh_id", "i", "j", "_r")
        .agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
        .withColumn("run", F.struct("i", "j", "lo"))
    )
    runs = materialize(runs, "runs")
    # Each pair of columns once: only the neighbours in +i and +j.
    ahead = F.explode(
        F.array(F.struct((F.col("i") + 1).alias("i"), F.col("j")), F.struct(F.col("i"), (F.col("j") + 1).alias("j")))
    )
    a = runs.select("mesh_id", "run", "lo", "hi", ahead.alias("_c")).select("mesh_id", "run", "lo", "hi", "_c.i", "_c.j")
    b = runs.select("mesh_id", "i", "j", F.col("run").alias("run2"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
    links = a.join(b, ["mesh_id", "i", "j"]).filter((F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("_lo")))
    labels = components(runs, links.select("mesh_id", "run", "run2"), a="run", b="run2", node="run")
    return labels.select("mesh_id", "comp").distinct().groupBy("mesh_id").agg(F.count("*").alias("bodies"))


def start_dilate(divisions: int) -> int:
    return max(2, -(-divisions // DILATE_DIVISOR))


def dilation_schedule(start: int) -> list[int]:
    out = []
    d = start
    while d < MAX_DILATE:
        out.append(d)
        d = max(d + 2, 2 * d)
    return [*out, MAX_DILATE]


def packed_shell(triangles: DataFrame, pitch: DataFrame) -> DataFrame:
    """The voxels of ``voxelise`` as packed columns: ``mesh_id i j word bits``.

    ``bits`` has cells 64 * word to 64 * word + 63 of the column, the lowest in the lowest bit. Faces are sampled in
    arrays and combined per task, so a large face costs memory for one block of its samples, and only words travel.
    """
    names = [f"{k}{t}" for k in g.CORNERS for t in g.XYZ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            corners = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names], 1).reshape(-1, 3, 3)
            edge = batch.column("pitch").to_numpy(zero_copy_only=False)
            mesh_id = batch.column("mesh_id").to_pylist()
            codes, number = np.unique(np.array([str(m) for m in mesh_id], object), return_inverse=True)
            first = {c: mesh_id[i] for c, i in zip(codes, np.unique(number, return_index=True)[1], strict=True)}
            for owner, i, j, k in _samples(corners, edge, number):
                owner, i, j, word, bits = _words(owner, i, j, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first[codes[o]] for o in owner], batch.column("mesh_id").type), pa.array(i), pa.array(j), pa.array(word), pa.array(bits)],
                    ["mesh_id", "i", "j", "word", "bits"],
                )

    kind = triangles.schema["mesh_id"].dataType.simpleString()
    told = triangles.join(pitch, "mesh_id").select("mesh_id", "pitch", *names).mapInArrow(run, f"mesh_id {kind}, i long, j long, word long, bits long")
    return told.groupBy("mesh_id", "i", "j", "word").agg(F.bit_or("bits").alias("bits"))


#: Samples of faces that a task has at a time.
SAMPLES = 1 << 20
#: Meshes of no more faces are sampled where their grid is closed: their faces travel, not their words.
TASK_FACES = 20_000
#: Such meshes of a task, and tasks at most.
TASK_MESHES, TASKS = 32, 4096


def _words(owner: np.ndarray, i: np.ndarray, j: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, ...]:
    """``owner i j word bits`` of cells, each word once."""
    axes = [owner, i, j, k]
    low = [int(x.min()) for x in axes]
    low[3] = low[3] >> 6 << 6
    span = [int(x.max()) - o + 1 for x, o in zip(axes, low, strict=True)]
    span[3] = -(-span[3] // 64) * 64
    if span[0] * span[1] * span[2] * span[3] >= 1 << 62:
        # Too far apart for one number a cell: halve the owners, or else the longest axis.
        axis = 0 if span[0] > 1 else max(range(1, 4), key=span.__getitem__)
        far = axes[axis] >= (low[axis] + span[axis] // 2 if axis < 3 else (low[3] + span[3] // 2) >> 6 << 6)
        return tuple(np.concatenate(x) for x in zip(*(_words(*(x[side] for x in axes)) for side in (~far, far)), strict=True))
    cell = axes[0] - low[0]
    for x, o, n in zip(axes[1:], low[1:], span[1:], strict=True):
        cell = cell * n + (x - o)
    # Neighbouring samples mostly share a cell.
    cell = np.sort(cell[np.append(True, cell[1:] != cell[:-1])])
    word, bit = cell >> 6, np.uint64(1) << (cell & 63).astype(np.uint64)
    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    bits, at = np.bitwise_or.reduceat(bit, start).view(np.int64), word[start]
    at, k = np.divmod(at, span[3] // 64)
    at, j = np.divmod(at, span[2])
    owner, i = np.divmod(at, span[1])
    return owner + low[0], i + low[1], j + low[2], k + (low[3] >> 6), bits


def _lattice(corners: np.ndarray, pitch: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Faces with the same lattice, its steps, and a block of its points ``s t``, as ``voxelise`` places them."""
    a, b, c = corners[:, 0], corners[:, 1], corners[:, 2]

    def length(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        x, y, z = (p - q).T
        return np.sqrt(x * x + y * y + z * z)

    longest = np.maximum(np.maximum(length(a, b), length(b, c)), length(c, a))
    steps = np.maximum(1, np.ceil(longest / (pitch * 0.5))).astype(np.int64)
    for n in np.unique(steps):
        faces = np.flatnonzero(steps == n)
        # Rows of the lattice, in blocks: row s has n - s + 1 points.
        size = n - np.arange(n + 1) + 1
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, size.sum(), SAMPLES)[1:])
        for rows in filter(len, np.split(np.arange(n + 1), cuts)):
            s = np.repeat(rows, size[rows])
            t = np.arange(len(s)) - np.repeat(np.cumsum(size[rows]) - size[rows], size[rows])
            for lo in range(0, len(faces), max(1, SAMPLES // max(1, len(s)))):
                yield faces[lo : lo + max(1, SAMPLES // max(1, len(s)))], n, s, t


def _samples(corners: np.ndarray, pitch: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``owner i j k`` of the lattice points of faces."""
    for part, n, s, t in _lattice(corners, pitch):
        edge, count, spots = pitch[part][:, None], np.arange(n + 1), []
        for axis in range(3):
            p, q, r = (corners[part, k, axis][:, None] for k in range(3))
            at = np.take(p + (q - p) * count / n, s, axis=1)
            at += np.take((r - p) * count / n, t, axis=1)
            at /= edge
            spots.append(np.rint(at, out=at).astype(np.int64).ravel())
        yield np.repeat(owner[part], len(s)), *spots


def _places(corners: np.ndarray, pitch: np.ndarray, low: Sequence[int], shape: Sequence[int]) -> Iterator[np.ndarray]:
    """Places of the same points in a grid from ``low`` on, face by face."""
    weights = (int(shape[1] * shape[2]), int(shape[2]), 1)
    for part, n, s, t in _lattice(corners, pitch):
        count = np.arange(n + 1)
        for face in part:
            edge, by_s, by_t, both = pitch[face], np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64), []
            for axis, weight in enumerate(weights):
                p, q, r = corners[face, :, axis]
                along, aside = p + (q - p) * count / n, (r - p) * count / n
                # Where an edge of the face lies across the axis, a row (or column) of the lattice has one cell.
                if r == p:
                    by_s += (np.rint(along / edge).astype(np.int64) - low[axis]) * weight
                elif q == p:
                    by_t += (np.rint((p + aside) / edge).astype(np.int64) - low[axis]) * weight
                else:
                    both.append((along, aside, low[axis], weight))
            out = np.take(by_s, s)
            if by_t.any():
                out += np.take(by_t, t)
            for along, aside, first, weight in both:
                at = np.take(along, s)
                at += np.take(aside, t)
                at /= edge
                cell = np.rint(at, out=at).astype(np.int64)
                cell -= first
                cell *= weight
                out += cell
            yield out


def _close(mesh_id: object, start: np.ndarray, low: Sequence[int], steps: Sequence[int]) -> pd.DataFrame:
    """All attempts at one mesh, and the packed solid of the best. ``start`` is its shell, ``low`` the cell its grid begins at.

    The grid has at most divisions plus twice the border cells an axis, whatever the number of faces: 3 MB at 256 divisions.
    Every attempt has the cells of those before and the box of the shell, so what the last one fills bounds them all: where that
    is too little none can end the schedule, and the earlier ones only tell which was first to reach it.
    """
    grids, done, grid = {}, 0, start
    for d in steps:
        grids[d] = grid = bitgrid.grown(grid, d - done, done)
        done = d
    spans = bitgrid.spans(start)
    box = math.prod(b - a + 1 for a, b in spans)

    def outer(d: int) -> np.ndarray:
        return bitgrid.outside(grids.pop(d))

    last = steps[-1]
    solid = ~bitgrid.grown(outer(last), last)
    cells = bitgrid.count(solid)
    d, bodies, earlier = last, None, sorted(set(steps[:-1]) - {last})
    if cells / box >= FILL_FLOOR:
        for e in earlier:
            tried = ~bitgrid.grown(outer(e), e)
            n = bitgrid.count(tried)
            if n == cells:
                d = min(d, e)
            if n / box >= FILL_FLOOR and (found := bitgrid.bodies(tried)) == 1:
                d, solid, cells, bodies = e, tried, n, found
                break
    else:
        for e in reversed(earlier):
            empty = outer(e)
            # A few slices mostly show a cell that the earlier attempt lacks.
            some = {spans[0][0] + (spans[0][1] - spans[0][0]) * n // 4 for n in (1, 2, 3)}
            if any((_slice(empty, e, at) != solid[at]).any() for at in some) or bitgrid.count(~bitgrid.grown(empty, e)) < cells:
                break
            d = e
    # The solid lies in the box of its shell.
    (i0, i1), (j0, j1), (k0, k1) = spans
    solid = solid[i0 : i1 + 1, j0 : j1 + 1, k0 // bitgrid.BITS : k1 // bitgrid.BITS + 1]
    if bodies is None:
        bodies = bitgrid.bodies(solid)
    low = [int(low[0] + i0), int(low[1] + j0), int(low[2] + k0 // bitgrid.BITS * bitgrid.BITS)]
    return pd.DataFrame({
        "mesh_id": [mesh_id], "dilate": pd.array([d], "Int32"), "fill_after": pd.array([cells / box], "Float64"), "bodies": [bodies], "cells": [cells],
        "low": [low], "shape": [list(solid.shape)], "grid": [pa.compress(solid.tobytes(), "zstd", asbytes=True)],
    })


def _slice(empty: np.ndarray, steps: int, at: int) -> np.ndarray:
    """One slice of the cells that are more than ``steps`` away from empty ones."""
    near = empty[max(0, at - steps) : at + steps + 1]
    return ~bitgrid.grown(near, steps)[min(at, steps)]


def _of_words(shell: pd.DataFrame, steps: Sequence[int]) -> pd.DataFrame:
    """``_close`` on the packed shell of one mesh, some words several times."""
    pad, high = max(steps) + 2, -(-(max(steps) + 2) // bitgrid.BITS)
    low = np.array([shell["i"].min() - pad, shell["j"].min() - pad, shell["word"].min() - high])
    top = np.array([shell["i"].max() + pad, shell["j"].max() + pad, shell["word"].max() + high])
    start = bitgrid.wordwise(tuple(top - low + 1))
    at = tuple(shell[n].to_numpy(np.int64) - o for n, o in zip(("i", "j", "word"), low, strict=True))
    np.bitwise_or.at(start, at, shell["bits"].to_numpy(np.int64).view(np.uint64))
    return _close(shell["mesh_id"].iloc[0], start, low * (1, 1, bitgrid.BITS), steps)


def _of_faces(faces: pd.DataFrame, steps: Sequence[int]) -> pd.DataFrame:
    """``_close`` on one mesh from all its faces."""
    corners = faces[[f"{k}{t}" for k in g.CORNERS for t in g.XYZ]].to_numpy().reshape(-1, 3, 3)
    pitch, name = faces["pitch"].to_numpy(), faces["mesh_id"].iloc[0]
    ends = np.rint(corners.reshape(-1, 3) / pitch[0])
    pad = max(steps) + 3
    # Rounding of a point within a face may take it a cell beyond the corners.
    low, top = (ends.min(axis=0) - pad).astype(np.int64), (ends.max(axis=0) + pad).astype(np.int64)
    shape = top - low + 1
    shape[2] = -(-shape[2] // bitgrid.BITS) * bitgrid.BITS
    if np.prod(shape, dtype=float) > LOOSE_CELLS:
        told = [_words(*block)[1:] for block in _samples(corners, pitch, np.zeros(len(faces), np.int64))]
        words = pd.DataFrame(dict(zip(("i", "j", "word", "bits"), map(np.concatenate, zip(*told, strict=True)), strict=True)))
        return _of_words(words.assign(mesh_id=name), steps)
    loose = np.zeros(shape, np.uint8)
    flat = loose.reshape(-1)
    for places in _places(corners, pitch, low, shape):
        flat[places] = 1
    packed = np.packbits(loose, axis=-1, bitorder="little").view(np.uint64)
    start = bitgrid.wordwise(packed.shape)
    start[:] = packed
    return _close(name, start, low, steps)


def unpacked(solids: DataFrame) -> DataFrame:
    """``mesh_id i j k`` of packed solids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mesh_id, low, shape, grid in zip(*(batch.column(c) for c in ("mesh_id", "low", "shape", "grid")), strict=True):
                shape, lo = shape.as_py(), low.as_py()
                words = pa.decompress(grid.as_buffer(), int(np.prod(shape)) * bitgrid.BITS // 8, "zstd")
                i, j, k = np.nonzero(bitgrid.cells(np.frombuffer(words, np.uint64).reshape(shape)))
                for at in range(0, len(i), SAMPLES):
                    part = [x[at : at + SAMPLES] + o for x, o in zip((i, j, k), lo, strict=True)]
                    name = pa.array([mesh_id.as_py()] * len(part[0]), mesh_id.type)
                    yield pa.RecordBatch.from_arrays([name, *map(pa.array, part)], ["mesh_id", *IJK])

    kind = solids.schema["mesh_id"].dataType.simpleString()
    return solids.select("mesh_id", "low", "shape", "grid").mapInArrow(run, f"mesh_id {kind}, i long, j long, k long")


def repair(
    triangles: DataFrame, fills: DataFrame, divisions: int = DIVISIONS, schedule: Sequence[int] | None = None,
    only_shattered: bool = True, fill_threshold: float = SHATTERED_BELOW,
) -> tuple[DataFrame, DataFrame]:
    """Close shattered meshes into solids by growing, filling and shrinking back.

    A mesh is voxelised once, as packed columns, and its attempts run on words, each growing the one before, until one is a single
    body that fills enough of its box. Meshes of up to ``TASK_FACES`` faces are sampled by the task that closes them.

    ``fills``: ``mesh_id fill`` of the input. Returns the occupied voxels of treated meshes (the best attempt of each) and a
    report: ``mesh_id status dilate fill_before fill_after bodies``; status is ok, skipped (left alone) or failed. A mesh
    without extent, or of which no attempt leaves a voxel, has failed.
    """
    if divisions > MAX_DIVISIONS:
        raise ValueError(f"a grid of {divisions} divisions does not fit a task; at most {MAX_DIVISIONS}")
    steps = sorted(schedule) if schedule is not None else dilation_schedule(start_dilate(divisions))
    wanted = fills.withColumn("_treat", (F.col("fill") < fill_threshold) if only_shattered else F.lit(True))
    wanted = materialize(wanted.select("mesh_id", "fill", "_treat"), "fills")
    # A face of which a coordinate is missing has no cells.
    todo = triangles.dropna(subset=[f"{k}{t}" for k in g.CORNERS for t in g.XYZ]).join(wanted.filter("_treat").select("mesh_id"), "mesh_id", "left_semi")
    sizes = todo.groupBy("mesh_id").agg(F.count("*").alias("_n"))
    pitch = materialize(pitches(todo, divisions).join(sizes, "mesh_id"), "pitch")
    few, many = pitch.filter(F.col("_n") <= TASK_FACES).drop("_n"), pitch.filter(F.col("_n") > TASK_FACES).drop("_n")
    kind = triangles.schema["mesh_id"].dataType.simpleString()
    columns = f"mesh_id {kind}, dilate int, fill_after double, bodies long, cells long, low array<long>, shape array<long>, grid binary"
    # A few faces are seconds of work, so tasks are dealt by meshes, not by bytes.
    tasks = max(4 * triangles.sparkSession.sparkContext.defaultParallelism, min(few.count() // TASK_MESHES, TASKS))
    faces = todo.join(few, "mesh_id").select("mesh_id", "pitch", *[f"{k}{t}" for k in g.CORNERS for t in g.XYZ]).repartition(tasks, "mesh_id")
    best = faces.groupBy("mesh_id").applyInPandas(lambda frame: _of_faces(frame, steps), columns)
    if not many.isEmpty():
        best = best.unionByName(packed_shell(todo, many).groupBy("mesh_id").applyInPandas(lambda frame: _of_words(frame, steps), columns))
    best = materialize(best, "solids")
    report = wanted.join(best.drop("low", "shape", "grid", "cells"), "mesh_id", "left").select(
        "mesh_id",
        F.when(~F.col("_treat"), "skipped").when(F.col("fill_after") >= FILL_FLOOR, "ok").otherwise("failed").alias("status"),
        "dilate", F.col("fill").alias("fill_before"), F.coalesce("fill_after", "fill").alias("fill_after"), "bodies",
    )
    return unpacked(best), report
