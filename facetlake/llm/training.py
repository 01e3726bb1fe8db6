"""Bounded, repeatable samples of labelled rows for the models of this folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


_RANGE = 1 << 40


def sample_ids(marks: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` keys of each non-null label: those with the smallest hash of the key.

    Rows that repeat a key count once, with their largest label. A label's count says which part of the hash
    range holds about twice the rows wanted; only those rows are ordered, so a label that most rows
    carry is no burden to one task.
    """
    marked = marks.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias(label))
    hashed = marked.withColumn("_h", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(_RANGE)))
    share = F.least(F.lit(1.0), F.lit(2.0 * per_label + 100) / F.count("*"))
    cuts = marked.groupBy(label).agg((share * _RANGE).alias("_cut"))
    near = hashed.join(F.broadcast(cuts), label).filter(F.col("_h") < F.col("_cut"))
    order = Window.partitionBy(label).orderBy("_h", key)
    return near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_label).select(key, label)


def sample_texts(records: DataFrame, key: str, text: str, chosen: DataFrame, label: str) -> DataFrame:
    """Texts of the chosen keys with their labels. ``chosen`` is bounded by ``sample_ids``, so it is broadcast."""
    texts = records.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    marked = chosen.select(F.col(key).alias("_key"), F.col(label).alias("label"))
    return texts.join(F.broadcast(marked), "_key")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def held_out(key: str, of: int, remainder: int) -> Column:
    """Whether the CRC-32 of a key's text leaves this remainder."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of)) == remainder
