"""A many-to-one left join for keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on (one in so many), so there are at most as many hot keys.
HOT = 1000


def join_one(many: DataFrame, one: DataFrame, key: str, copies: str, total: int, spread: str) -> DataFrame:
    """``many`` with the columns of ``one``, null where ``one`` has no such key.

    Args:
        many: rows with the string column ``key`` (not null).
        one: a row per key, with the number of rows of ``many`` that have it in ``copies``; it is read
            twice, so it should be a stored table.
        total: rows of ``many``.
        spread: a column of ``many`` that deals rows with hot keys over the tasks.

    Keys that hold at least one row in ``HOT`` are at most ``HOT`` rows of ``one``, whatever the size of the data;
    these are broadcast. All others meet in a shuffle, in which no key has more than that share.
    """
    extra = [c for c in one.columns if c != key]
    hot = one.filter(F.col(copies) * HOT >= total).withColumnsRenamed({c: f"_hot_{c}" for c in extra})
    cold = one.filter(F.col(copies) * HOT < total).withColumnsRenamed({c: f"_cold_{c}" for c in extra}).withColumnRenamed(key, "_dealt")
    found = F.col(f"_hot_{copies}").isNotNull()
    # A hot row needs nothing from the shuffle; its key there is one that no row of ``one`` has.
    dealt = F.when(found, F.concat(F.lit("#"), F.xxhash64(spread).cast("string"))).otherwise(F.col(key))
    joined = many.join(F.broadcast(hot), key, "left").withColumn("_dealt", dealt).join(cold, "_dealt", "left")
    return joined.select(*[many[c] for c in many.columns], *[F.coalesce(f"_hot_{c}", f"_cold_{c}").alias(c) for c in extra])
