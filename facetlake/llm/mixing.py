"""Photos of several shoots mixed to target weights by weighted fair queueing.

Photos of a shoot queue in a fixed shuffled order. A photo's virtual finish time is what its shoot
has sent up to and including it, divided by the shoot's target; the mix is all photos in the order of
finish times, up to the total budget. A shoot with a target above its own size sends its queue again.

Sums along a queue never need a whole shoot in one task: the shuffle order comes from a hash, its first
digits cut every queue into even buckets, and a bucket adds the totals of the earlier ones.
The global order is cut into ranges of finish time in the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from facetlake.session import materialize

#: Hex digits of the shuffle hash that name a bucket of a queue: 16^3 buckets each.
BUCKET_DIGITS = 3
#: Ranges of finish time between 0 and 1.
RANGES = 4096
#: A shoot is never sent more often.
REPEATS = 3
WEIGHTS = (5, 2, 1)


def shoot_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Targets of shoots with ``shoot_id`` and ``shoot_size``, one row per shoot.

    Shoots in order of id, null last, take the weights in turn and share the sum of all sizes.
    A target stops at ``repeats`` times the shoot's size, and the rest is shared again by weight.
    The level at which that ends has a closed form: with shoots ordered by cap per weight, the first
    ``k`` are capped for the smallest ``k`` at which the next one's share stays within its cap.
    """
    order = Window.orderBy(F.col("shoot_id").asc_nulls_last())
    table = F.array(*[F.lit(int(w)) for w in weights])
    every = Window.partitionBy()
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("shoot_id").asc_nulls_last())
    until = by_cap.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weighed = (
        sizes.withColumn("_w", F.element_at(table, (F.row_number().over(order) - 1) % len(weights) + 1).cast("long"))
        .withColumn("_cap", F.col("shoot_size") * repeats)
        .withColumn("_total", F.sum("shoot_size").over(every))
        .withColumn("_room", F.col("_total") - F.sum("_cap").over(until) + F.col("_cap"))
        .withColumn("_open", F.sum("_w").over(every) - F.sum("_w").over(until) + F.col("_w"))
    )
    # Open from here on: this shoot's share of the room is within its cap.
    fits = F.col("_room") * F.col("_w") <= F.col("_cap") * F.col("_open")
    marked = weighed.withColumn("_k", F.row_number().over(by_cap)).withColumn("_from", F.min(F.when(fits, F.row_number().over(by_cap))).over(every))
    level = marked.withColumn("_r", F.max(F.when(F.col("_k") == F.col("_from"), F.col("_room"))).over(every)).withColumn(
        "_o", F.max(F.when(F.col("_k") == F.col("_from"), F.col("_open"))).over(every)
    )
    share = (F.col("_w") * F.col("_r")).cast("double") / F.col("_o").cast("double")
    target = F.when(F.col("_from").isNull() | (F.col("_k") < F.col("_from")), F.col("_cap").cast("double")).otherwise(share)
    return level.select(*sizes.columns, target.alias("target"), F.col("_total").alias("budget"))


def mix_photos(
    photos: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: str = "", digits: int = BUCKET_DIGITS, ranges: int = RANGES,
) -> DataFrame:
    """How much of every photo the mix takes.

    Args:
        photos: ``photo_id`` (unique), ``shoot_id``, ``size`` (long; null counts as 0); further
            columns are left out.
        seed: another seed shuffles the queues in another way.

    Returns:
        ``photo_id``, ``shoot_id``, ``size``, ``shoot_size``, ``target``, ``taken`` (at most
        ``repeats`` times ``size``; all of it sums to the total of all sizes), ``finish`` (virtual
        finish time of the photo's first turn).

    Null shoots are one shoot of their own. Photos of size 0 are never taken. Equal finish times go by
    shoot, then shuffle hash, then id, then size, then turn; repeated rows stay apart. An empty table
    gives an empty result. Only built-in functions are used; no group larger than a bucket meets in
    one task, and the tables that one task orders have a row per shoot, bucket or range.
    """
    shoot = F.coalesce(F.concat(F.lit("s"), F.col("shoot_id").cast("string")), F.lit("n"))
    hashed = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("photo_id").cast("string"), F.lit("null"))))
    units = materialize(
        photos.select(
            "photo_id", "shoot_id", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"), shoot.alias("_q"), hashed.alias("_h")
        ).withColumn("_b", F.substring("_h", 1, digits)),
        "queue",
    )
    buckets = units.groupBy("_q", "_b").agg(F.sum("size").alias("_s"), F.min("shoot_id").alias("shoot_id"))
    earlier = Window.partitionBy("_q").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = buckets.groupBy("_q").agg(F.sum("_s").alias("shoot_size"), F.min("shoot_id").alias("shoot_id"))
    targets = shoot_targets(sizes, weights, repeats).drop("shoot_id")
    before = buckets.select("_q", "_b", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    known = materialize(before.join(targets, "_q"), "targets")
    queue = Window.partitionBy("_q", "_b").orderBy("_h", "photo_id", "size")
    sent = F.sum("size").over(queue.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_before")
    last = F.least(F.lit(repeats - 1), F.floor(F.col("target") / F.col("shoot_size"))).cast("int")
    turns = (
        units.join(known, ["_q", "_b"])
        .withColumn("_sent", sent)
        .withColumn("_row", F.row_number().over(queue))
        .withColumn("_turn", F.explode(F.sequence(F.lit(0), F.when(F.col("size") > 0, last).otherwise(0))))
        .withColumn("finish", F.when(F.col("target") > 0, (F.col("_turn") * F.col("shoot_size") + F.col("_sent")).cast("double") / F.col("target")).otherwise(0.0))
        .withColumn("_range", F.floor(F.col("finish") * ranges).cast("long"))
        .drop("_sent", "_before")
    )
    turns = materialize(turns, "turns")
    totals = turns.groupBy("_range").agg(F.sum("size").alias("_s"))
    lower = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_s").over(lower), F.lit(0)).alias("_start"))
    order = ["finish", F.col("shoot_id").asc_nulls_last(), "_h", "photo_id", "size", "_turn"]
    along = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("budget") - F.col("_start") - F.sum("size").over(along) + F.col("size")
    cut = turns.join(starts, "_range").withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return (
        cut.groupBy("_q", "_b", "_row", "photo_id", "shoot_id", "size", "shoot_size", "target")
        .agg(F.sum("_part").cast("long").alias("taken"), F.min("finish").alias("finish"))
        .drop("_q", "_b", "_row")
    )
