"""Work on graphs cell by cell: a cell holds the nodes whose ids share all but their last bits.

Faces of one body mostly have ids close to each other, so most connected pieces of a mesh lie in one cell and a task
settles them at once. A piece that an edge leaves is left to the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A cell has at most 2^18 nodes: its arrays take a few MB whatever the size of the graph.
BITS = 18
#: Small cells are worked on together, in batches of about this many rows.
ROWS = 200_000


def cell(column: str | Column) -> Column:
    return F.shiftright((F.col(column) if isinstance(column, str) else column).cast("bigint"), BITS)


def by_cell(rows: DataFrame, keys: Sequence[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``fn`` on whole cells; ``rows`` has a column ``_cell``. It gets rows and the number of the cell of each, in ascending order."""
    on = [*keys, "_cell"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, number in whole(batches, on):
            yield from fn(table, number).to_batches(max_chunksize=10_000)

    return rows.repartition(*on).sortWithinPartitions(*on).mapInArrow(run, schema)


def whole(batches: Iterable[pa.RecordBatch], on: list[str], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole groups with about so many rows, and the number of the group of each row."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        number = _runs(table, on)
        cut = int(np.searchsorted(number, number[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks(), number[:cut]
        held = table.slice(cut).to_batches()
        n -= cut
        enough = max(rows, 2 * n)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _runs(table, on)


def _runs(table: pa.Table, on: list[str]) -> np.ndarray:
    first = np.zeros(table.num_rows, dtype=bool)
    for name in on:
        codes = table[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        first[1:] |= codes[1:] != codes[:-1]
    return np.cumsum(first, dtype=np.int64)


def codes(number: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One integer per node, ascending by cell and id."""
    return (number << BITS) | (ids & ((1 << BITS) - 1))


def column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].to_numpy()


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of the piece of every node 0 to n-1."""
    root = np.arange(n)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        _settle(root)
    return root


def _settle(root: np.ndarray) -> None:
    while True:
        further = root[root]
        if np.array_equal(further, root):
            return
        root[:] = further


def touching(root: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Marks all nodes of the pieces that any of ``nodes`` is in."""
    mark = np.zeros(len(root), dtype=bool)
    mark[root[nodes]] = True
    return mark[root]


def pieces(links: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest node of the piece within its cell, for every node of ``links``: keys, ``a p``. ``links``: keys, ``a b``."""
    keys = list(keys)
    pair = lambda x, y: F.struct(F.col(x).alias("a"), F.col(y).alias("b"))
    inside = cell("a") == cell("b")
    rows = links.select(*keys, F.explode(F.when(inside, F.array(pair("a", "b"))).otherwise(F.array(pair("a", "a"), pair("b", "b")))).alias("e"))
    rows = rows.select(*keys, "e.a", "e.b", cell("e.a").alias("_cell"))
    kind = links.schema["a"].dataType.simpleString()

    def settle(table: pa.Table, number: np.ndarray) -> pa.Table:
        a, b = column(table, "a"), column(table, "b")
        _, first, at = np.unique(np.concatenate([codes(number, a), codes(number, b)]), return_index=True, return_inverse=True)
        ids = np.concatenate([a, b])[first]
        root = joined(len(ids), at[: len(a)], at[len(a) :])
        out = table.select(keys).take(pa.array(first % len(a)))
        return out.append_column("a", pa.array(ids)).append_column("p", pa.array(ids[root]))

    schema = "".join(f"`{k}` {links.schema[k].dataType.simpleString()}, " for k in keys) + f"a {kind}, p {kind}"
    return by_cell(rows, keys, settle, schema)
