"""Connected components by repeated contraction.

Each round every node points at its smallest neighbour, pointers are doubled until they reach
a root, and the graph is contracted onto the roots. A star whose centre has the largest id loses only
that centre in its first round; over two rounds the nodes with an edge at least halve. Labels of the levels are composed backwards: a node ends with the smallest id of its
component. Where ids of a component lie close to each other, tasks join what they can before the first round.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.operators.cells import cell, pieces
from facetlake.session import materialize


def components(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("mesh_id",), a: str = "fa", b: str = "fb",
    node: str = "fid", label: str = "comp", jumps: int = 2, close_ids: bool = False,
) -> DataFrame:
    """Label every node with the smallest node id of its component.

    ``keys`` separate independent graphs; nodes without edges label themselves. Many-to-one
    lookups of a hot label are split by adaptive skew handling. With ``close_ids`` (integers, mostly close to each other
    within a component) the pieces of every cell of ids are joined first, and only edges between cells take the rounds.
    """
    keys = list(keys)
    links = materialize(edges.select(*keys, F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    levels: list[DataFrame] = []
    if close_ids and not links.isEmpty():
        levels.append(materialize(pieces(links, keys), "pieces"))
        between = links.filter(cell("a") != cell("b"))
        links = between if between.isEmpty() else materialize(_contract(between, levels[0], keys), "links")
    while not links.isEmpty():
        both = links.union(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(*keys, "a").agg(F.min("b").alias("m")).select(*keys, "a", F.least("a", "m").alias("p"))
        parent = materialize(parent, "parents")
        moving = True
        while moving:
            for _ in range(jumps):
                parent = _follow(parent, parent, keys)
            parent = materialize(parent, "parents")
            moving = not parent.filter("moved").isEmpty()
            parent = parent.drop("moved")
        levels.append(parent)
        links = materialize(_contract(links, parent, keys), "links")
    mapping = None
    for level in reversed(levels):
        mapping = level if mapping is None else _follow(level, mapping, keys)
    found = nodes.select(*keys, node)
    if mapping is None:
        return found.withColumn(label, F.col(node))
    return found.join(mapping.withColumnRenamed("a", node), [*keys, node], "left").select(
        *keys, node, F.coalesce("p", node).alias(label)
    )


def _follow(level: DataFrame, then: DataFrame, keys: list[str]) -> DataFrame:
    """Replace each pointer by the pointer of its target; roots of ``then`` stay.

    ``moved`` marks pointers this step changed.
    """
    step = then.select(*keys, F.col("a").alias("p"), F.col("p").alias("_q"))
    target = F.coalesce("_q", "p")
    return level.join(step, [*keys, "p"], "left").select(
        *keys, "a", target.alias("p"), (target != F.col("p")).alias("moved")
    )


def _contract(links: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    pa = parent.select(*keys, "a", F.col("p").alias("_a"))
    pb = parent.select(*keys, F.col("a").alias("b"), F.col("p").alias("_b"))
    return (
        links.join(pa, [*keys, "a"])
        .join(pb, [*keys, "b"])
        .filter("_a <> _b")
        .select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        .distinct()
    )


def face_components(triangles: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Component of every face: ``mesh_id fid comp``."""
    return components(triangles, adjacency, close_ids=True)
