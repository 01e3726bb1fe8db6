"""Fingerprints of mesh text that show how much of one text another contains.

The sketch keeps the hash of every shingle, so two sketches merge by union, and the share of a small
text's sketch found in a large one is its containment, however short or unequal the two are. A
larger ``scale`` keeps a fixed fraction of the hash range and estimates. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.session import materialize

#: Words of a shingle.
SHINGLE = 5
#: One in so many hashes is kept. Any thinning misjudges short texts.
SCALE = 1
_SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words between spaces, tabs and line ends."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def sketch(text: Column, scale: int = SCALE, shingle: int = SHINGLE) -> Column:
    """Sorted hashes that a text keeps.

    Shingles are ``shingle`` consecutive words; fewer words are one shingle. Kept are all hashes whose
    unsigned value is below 2^64 / ``scale``, and the smallest one of all, which merges by union just as
    well and leaves no text with words without a sketch. Without words the sketch is empty.
    """
    low = -(2**63)  # XOR with it makes signed order that of the unsigned hashes
    none = F.array().cast("array<bigint>")

    def every(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - shingle)
        return F.transform(starts, lambda at: F.xxhash64(*[F.get(h, at + i) for i in range(shingle)]).bitwiseXOR(F.lit(low)))

    every_hash = _let(
        F.transform(words(text), lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) >= shingle, every(h)).when(F.size(h) > 0, F.array(F.xxhash64(h).bitwiseXOR(F.lit(low)))).otherwise(none),
    )
    if scale == 1:
        return F.sort_array(F.array_distinct(every_hash))
    return _let(
        every_hash,
        lambda h: F.sort_array(F.array_distinct(F.concat(_low(h, scale), F.when(F.size(h) > 0, F.array(F.array_min(h))).otherwise(none)))),
    )


def _low(kept: Column, scale: int) -> Column:
    """The hashes below the limit that all sketches of this scale share."""
    return kept if scale == 1 else F.filter(kept, lambda x: x < -(2**63) + 2**64 // scale)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fingerprint(kept: Column) -> Column:
    """A sketch as text: its hashes as hex, joined by points."""
    return F.array_join(F.transform(kept, lambda h: F.lower(F.lpad(F.hex(h.bitwiseXOR(F.lit(-(2**63)))), 16, "0"))), ".")


def containment(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Share of the smaller text's kept hashes that the larger has: 0 to 1; two empty ones are alike.

    Only hashes below the limit of ``scale`` count, as no other is kept by every text that has it. Null
    where both texts have words and one has no such hash; with ``scale`` 1 that does not happen.
    """
    low_a, low_b = _low(a, scale), _low(b, scale)
    least = F.least(F.size(low_a), F.size(low_b))
    known = F.when(least > 0, F.size(F.array_intersect(low_a, low_b)) / least).when(F.size(a) + F.size(b) == 0, 1.0)
    return known.when(F.least(F.size(a), F.size(b)) == 0, 0.0).cast("double")


def mesh_sketches(meshes: DataFrame, scale: int = SCALE, shingle: int = SHINGLE, column: str = "mesh_text") -> DataFrame:
    """Add ``sketch`` and ``fingerprint`` of ``mesh_text`` (OBJ or other lines of a mesh file) to every row.

    Null text counts as empty; empty text has an empty sketch and fingerprint. Equal texts have equal
    fingerprints. Columns already named so are replaced; all others and repeated rows stay.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    return meshes.withColumn("sketch", sketch(text, scale, shingle)).withColumn("fingerprint", fingerprint(F.col("sketch")))


def re_export_report(meshes: DataFrame, scale: int = SCALE, shingle: int = SHINGLE) -> DataFrame:
    """How near each mesh text's fingerprint is to an edited export's and to the next mesh's.

    The edited export has the last third of the code points (rounded down) replaced by the first as many,
    or all there are, of the next mesh's text. The next mesh is the one with the next smaller
    ``mesh_id``; after the smallest comes the largest.

    Args:
        meshes: ``mesh_id``, ``mesh_text``; further columns are left out.

    Returns:
        ``mesh_id``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
        ``near_edited``, ``near_next``: containment of the smaller sketch in the larger.

    Null text counts as empty. Rows that repeat an id stay; as a next mesh such an id stands for its
    smallest text. A null id comes in no order: its next text is empty. An empty table gives an empty
    result. The neighbour of every id is found on the slim table of ids, cut into ranges; texts are
    dealt out by id, and sketches, which are larger than texts, are made after the last shuffle.
    """
    text = F.coalesce(F.col("mesh_text"), F.lit(""))
    base = meshes.select("mesh_id", text.alias("mesh_text"))
    dealt = base.filter("mesh_id is not null")
    links = _next_ids(meshes.select("mesh_id").filter("mesh_id is not null"))
    nexts = (
        dealt.join(links, dealt["mesh_id"] == links["_next"])
        .select(links["_of"].alias("mesh_id"), F.col("mesh_text").alias("_n"))
        .groupBy("mesh_id")
        .agg(F.min("_n").alias("_n"))
    )
    joined = dealt.join(nexts, "mesh_id", "left")
    orphans = base.filter("mesh_id is null").withColumn("_n", F.lit(""))
    third = F.floor(F.char_length("mesh_text") / 3).cast("int")
    return (
        joined.unionByName(orphans)
        .withColumn("_third", third)
        .withColumn("_edited", F.expr("concat(left(mesh_text, char_length(mesh_text) - _third), left(_n, _third))"))
        .withColumn("sketch", sketch(F.col("mesh_text"), scale, shingle))
        .withColumn("_next_sketch", sketch(F.col("_n"), scale, shingle))
        .withColumn("_edited_sketch", sketch(F.col("_edited"), scale, shingle))
        .select(
            "mesh_id", F.char_length("mesh_text").cast("long").alias("n_chars"), F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
            fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("_edited_sketch")).alias("edited_fingerprint"),
            containment(F.col("sketch"), F.col("_edited_sketch"), scale).alias("near_edited"),
            containment(F.col("sketch"), F.col("_next_sketch"), scale).alias("near_next"),
        )
    )


def _next_ids(ids: DataFrame) -> DataFrame:
    """``_of`` and its next smaller id ``_next`` (the largest after the smallest)."""
    ranged = materialize(ids.distinct().repartitionByRange("mesh_id").withColumn("_pid", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("_pid").agg(F.max("mesh_id").alias("_last"))
    before = F.coalesce(F.lag("_last").over(Window.orderBy("_pid")), F.max("_last").over(Window.partitionBy()))
    inside = F.lag("mesh_id").over(Window.partitionBy("_pid").orderBy("mesh_id"))
    return ranged.join(ends.select("_pid", before.alias("_before")), "_pid").select(F.col("mesh_id").alias("_of"), F.coalesce(inside, "_before").alias("_next"))
