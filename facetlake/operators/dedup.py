"""Near-duplicate photos: banded Hamming join and greedy first-wins selection.

Two 64-bit hashes within distance t agree exactly on one of t+1 bands, so an equality
join on (shoot, band, band bits) finds every pair. Buckets that are too large are split
again on the bits not yet fixed (the same pigeonhole argument applies to them), and only
buckets still large after that are spread over salts.

First-wins selection does not enumerate all pairs of a shoot. Photos are taken in growing
prefixes: each prefix is first compared with what is already kept, and only its survivors
are compared with each other. A cluster of alike photos therefore collapses onto its first
members before the bulk of the cluster is looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.functions.pixels import hamming, is_near_duplicate
from facetlake.session import materialize

DEFAULT_THRESHOLD = 6
HOT_BUCKET = 4_000_000  # candidate pairs in one bucket before it is split
MAX_DEPTH = 3
SALTS = 16
RESIDUE = 500_000  # pairs left over that one bounded pass may finish


@dataclass(frozen=True)
class Band:
    path: int
    mask: int
    prior: tuple[int, ...]  # earlier sibling bands, which a pair found here must not agree on


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _split_bits(free: list[int], parts: int) -> list[int]:
    """Masks of ``parts`` contiguous, nearly equal groups of the free bit positions."""
    step = len(free) / parts
    cuts = [round(i * step) for i in range(parts + 1)]
    return [sum(1 << b for b in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def child_bands(parent: Band, threshold: int) -> list[Band]:
    free = [b for b in range(63, -1, -1) if not parent.mask >> b & 1]
    groups = _split_bits(free, threshold + 1)
    return [
        Band(parent.path * (threshold + 1) + i + 1, parent.mask | g, parent.prior + tuple(groups[:i]))
        for i, g in enumerate(groups)
    ]


def _band_array(bands: list[Band]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(b.path).alias("path"),
                F.lit(_signed(b.mask)).cast("bigint").alias("mask"),
                F.array(*[F.lit(_signed(p)).cast("bigint") for p in b.prior]).cast("array<bigint>").alias("prior"),
            )
            for b in bands
        ]
    )


def _bucketed(rows: DataFrame, bands: list[Band]) -> DataFrame:
    return (
        rows.withColumn("_b", F.explode(_band_array(bands)))
        .withColumn("path", F.col("_b.path"))
        .withColumn("prior", F.col("_b.prior"))
        .withColumn("bits", F.col("h").bitwiseAND(F.col("_b.mask")))
        .drop("_b")
    )


BUCKET = ["shoot_id", "path", "bits"]


def _refined(rows: DataFrame, parents: list[Band], threshold: int) -> DataFrame:
    """Replace bucketed rows by their child buckets.

    The band table is fixed: (threshold + 1) ** depth rows, so it is broadcast.
    """
    table = rows.sparkSession.createDataFrame(
        [(p.path, c.path, _signed(c.mask), [_signed(m) for m in c.prior]) for p in parents for c in child_bands(p, threshold)],
        "path INT, child INT, mask BIGINT, child_prior ARRAY<BIGINT>",
    )
    return rows.join(F.broadcast(table), "path").select(
        "shoot_id", "seq", "h", *[c for c in ("h_flip", "last") if c in rows.columns],
        F.col("child").alias("path"), F.col("child_prior").alias("prior"),
        F.col("h").bitwiseAND(F.col("mask")).alias("bits"),
    )


def _join_bucket(late: DataFrame, early: DataFrame, threshold: int, salted: bool = False) -> DataFrame:
    keys = list(BUCKET)
    if salted:
        keys.append("salt")
        late = late.withColumn("salt", F.pmod(F.xxhash64("seq", "path"), F.lit(SALTS)).cast("int"))
        early = early.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    last = F.col("last") if "last" in late.columns else F.col("seq")
    a = late.select(*keys, "seq", "h", "prior", last.alias("_last"))
    b = early.select(*keys, F.col("seq").alias("seq_e"), F.col("h").alias("h_e"), F.col("h_flip").alias("h_flip_e"))
    apart = F.col("h").bitwiseXOR(F.col("h_e"))
    return (
        a.join(b, keys)
        .filter((F.col("seq_e") < F.col("_last")) & is_near_duplicate(F.col("h"), F.col("h_e"), F.col("h_flip_e"), threshold))
        # A pair is reported only by the first band it agrees on, so no distinct is needed.
        .filter(F.forall("prior", lambda m: apart.bitwiseAND(m) != 0))
        .select(
            "shoot_id",
            F.col("seq_e").alias("earlier"),
            F.col("seq").alias("later"),
            hamming(F.col("h"), F.col("h_e")).alias("d"),
        )
    )


def _bucket_loads(late: DataFrame, early: DataFrame) -> DataFrame:
    a = late.groupBy(*BUCKET).agg(F.count("*").alias("_a"))
    b = early.groupBy(*BUCKET).agg(F.count("*").alias("_e"))
    return a.join(b, BUCKET).withColumn("load", F.col("_a") * F.col("_e"))


def banded_pairs(late: DataFrame, early: DataFrame, threshold: int = DEFAULT_THRESHOLD,
                 hot_bucket: int = HOT_BUCKET) -> Iterator[DataFrame]:
    """Pairs (earlier, later, d) of ``late`` rows with the ``early`` rows they duplicate.

    Both sides hold ``shoot_id seq h h_flip`` with distinct hashes per shoot. Yields
    disjoint DataFrames: one for the ordinary buckets, further ones only where buckets
    exceed ``hot_bucket`` candidate pairs.
    """
    bands = child_bands(Band(0, 0, ()), threshold)
    late_b, early_b = _bucketed(late, bands), _bucketed(early, bands)
    if late.count() * early.count() <= hot_bucket:  # no bucket can exceed the whole
        yield _join_bucket(late_b, early_b, threshold)
        return
    for depth in range(1, MAX_DEPTH + 1):
        loads = _bucket_loads(late_b, early_b)
        if loads.filter(F.col("load") > hot_bucket).isEmpty():
            yield _join_bucket(late_b, early_b, threshold)
            return
        hot = materialize(loads.filter(F.col("load") > hot_bucket).select(*BUCKET), "hot_buckets")
        yield _join_bucket(late_b.join(hot, BUCKET, "left_anti"), early_b.join(hot, BUCKET, "left_anti"), threshold)
        late_h, early_h = (side.join(hot, BUCKET, "left_semi") for side in (late_b, early_b))
        if depth == MAX_DEPTH:
            yield _join_bucket(late_h, early_h, threshold, salted=True)
            return
        late_b = materialize(_refined(late_h, bands, threshold), "late_buckets")
        early_b = materialize(_refined(early_h, bands, threshold), "early_buckets")
        bands = [c for b in bands for c in child_bands(b, threshold)]


def _union(frames: Iterator[DataFrame]) -> DataFrame:
    out = None
    for df in frames:
        out = df if out is None else out.unionByName(df)
    return out


def representatives(hashes: DataFrame) -> DataFrame:
    """First photo of each distinct hash of a shoot.

    Later photos with the same hash match exactly the same kept photos, and match the
    representative if it is kept, so they never need comparing.
    """
    return hashes.groupBy("shoot_id", "h").agg(F.min(F.struct("seq", "h_flip")).alias("_r")).select(
        "shoot_id", F.col("_r.seq").alias("seq"), "h", F.col("_r.h_flip").alias("h_flip")
    )


def hash_classes(hashes: DataFrame) -> DataFrame:
    """Photos of a shoot with equal hashes, mirrored hash included: first ``seq``, ``last`` and their number.

    The rule reads both hashes of the earlier photo, so only photos that agree in both are alike to it.
    """
    return hashes.groupBy("shoot_id", "h", "h_flip").agg(F.min("seq").alias("seq"), F.max("seq").alias("last"), F.count("*").alias("n"))


def near_duplicate_pairs(hashes: DataFrame, threshold: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Near-duplicate pairs of classes: ``shoot_id earlier later d``.

    A row says that each photo of the class of ``later`` duplicates every photo of the class of ``earlier`` that comes
    before it, and that there is such a pair; both are the first photos of their classes, and may be
    the same class. With ``near_duplicate_members`` every pair of photos can be told, and a
    class of many copies is one row.
    """
    classes = materialize(hash_classes(hashes), "classes")
    return _union(banded_pairs(classes, classes, threshold))


def near_duplicate_members(hashes: DataFrame) -> DataFrame:
    """The class of every photo, by its first photo: ``shoot_id seq class``."""
    keys = ["shoot_id", "h", "h_flip"]
    return hashes.join(hash_classes(hashes).select(*keys, F.col("seq").alias("class")), keys).select("shoot_id", "seq", "class")


def _prefixes(reps: DataFrame, first: int) -> tuple[DataFrame, int]:
    """Number the prefix each photo belongs to: prefix k ends near share 4**-(n-k) of the shoot."""
    largest = reps.groupBy("shoot_id").count().agg(F.max("count")).first()[0] or 0
    n = 0
    while first * 4**n < largest:
        n += 1
    if n == 0:
        return reps.withColumn("prefix", F.lit(0)), 1
    shares = [0.25 ** (n - i) for i in range(n)]
    cuts = reps.groupBy("shoot_id").agg(
        F.percentile_approx("seq", F.array(*[F.lit(s) for s in shares]), 1000).alias("_cuts")
    )
    seq = F.col("seq")
    numbered = reps.join(cuts, "shoot_id").withColumn(
        "prefix", F.size(F.filter("_cuts", lambda c: seq > c))
    )
    return numbered.drop("_cuts"), n + 1


def _replay(pdf: pd.DataFrame) -> pd.DataFrame:
    """Settle the leftover pairs of one shoot in seq order; the caller bounds their number."""
    earlier_of: dict[int, list[int]] = {}
    for earlier, later in zip(pdf["earlier"].tolist(), pdf["later"].tolist()):
        earlier_of.setdefault(later, []).append(earlier)
    dropped: set[int] = set()
    for later in sorted(earlier_of):
        if any(e not in dropped for e in earlier_of[later]):
            dropped.add(later)
    return pd.DataFrame({"shoot_id": pdf["shoot_id"].iloc[0], "later": sorted(dropped)})


def settle_pairs(pairs: DataFrame, residue: int = RESIDUE) -> DataFrame:
    """Duplicates among the given pairs: a photo is one iff an earlier *kept* photo matches it.

    Each round keeps every photo without an open earlier neighbour, drops what those match and
    removes all pairs of decided photos. Once at most ``residue`` pairs are open in total they
    are replayed per shoot. Returns ``shoot_id seq duplicate_of``.
    """
    pairs = materialize(pairs.select("shoot_id", "earlier", "later"), "pairs")
    late, early = ["shoot_id", "later"], ["shoot_id", "earlier"]

    def as_earlier(df: DataFrame) -> DataFrame:
        return df.withColumnRenamed("later", "earlier")

    open_pairs, dropped = pairs, None
    while open_pairs.count() > residue:
        kept = open_pairs.select(*early).distinct().join(
            as_earlier(open_pairs.select(*late).distinct()), early, "left_anti"
        )
        hit = materialize(open_pairs.join(kept, early, "left_semi").select(*late).distinct(), "dropped")
        dropped = hit if dropped is None else dropped.unionByName(hit)
        open_pairs = materialize(
            open_pairs.join(hit, late, "left_anti").join(as_earlier(hit), early, "left_anti"), "open_pairs"
        )
    rest = materialize(
        open_pairs.groupBy("shoot_id").applyInPandas(_replay, "shoot_id int, later bigint"), "dropped"
    )
    dropped = rest if dropped is None else dropped.unionByName(rest)
    return (
        pairs.join(dropped, late, "left_semi")
        .join(as_earlier(dropped), early, "left_anti")
        .groupBy(*late)
        .agg(F.min("earlier").alias("duplicate_of"))
        .withColumnRenamed("later", "seq")
    )


def first_wins(
    hashes: DataFrame, threshold: int = DEFAULT_THRESHOLD, first_prefix: int = 4096,
    hot_bucket: int = HOT_BUCKET, residue: int = RESIDUE,
) -> DataFrame:
    """Greedy first-wins deduplication of every shoot.

    Adds ``duplicate_of`` (NULL for kept photos): the earliest kept photo it matches.
    """
    hashes = materialize(hashes, "hashes")
    numbered, prefixes = _prefixes(materialize(representatives(hashes), "reps"), first_prefix)
    reps = materialize(numbered, "reps") if prefixes > 1 else numbered
    kept, marks = None, None
    for k in range(prefixes):
        todo = reps.filter(F.col("prefix") == k).drop("prefix")
        if kept is not None:
            hits = _union(banded_pairs(todo, kept, threshold, hot_bucket))
            against_kept = materialize(
                hits.groupBy("shoot_id", F.col("later").alias("seq")).agg(F.min("earlier").alias("duplicate_of")),
                "marks",
            )
            todo = materialize(todo.join(against_kept, ["shoot_id", "seq"], "left_anti"), "todo")
            marks = against_kept if marks is None else marks.unionByName(against_kept)
        inside = materialize(
            settle_pairs(_union(banded_pairs(todo, todo, threshold, hot_bucket)), residue), "marks"
        )
        marks = inside if marks is None else marks.unionByName(inside)
        survivors = todo.join(inside, ["shoot_id", "seq"], "left_anti")
        if k + 1 < prefixes:
            survivors = materialize(survivors, "kept")
            kept = survivors if kept is None else kept.unionByName(survivors)
    verdict = reps.join(marks, ["shoot_id", "seq"], "left").select(
        "shoot_id", "h", F.col("seq").alias("_rep"), F.col("duplicate_of").alias("_of")
    )
    return hashes.join(verdict, ["shoot_id", "h"]).select(
        *hashes.columns,
        F.when(F.col("seq") == F.col("_rep"), F.col("_of"))
        .otherwise(F.coalesce("_of", "_rep"))
        .alias("duplicate_of"),
    )
