"""Keyed tables on disk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, keys: Sequence[str] = ()) -> None:
    """Append ``df`` below ``path``, one folder per key value.

    The commit is atomic, so no marker file is needed, and earlier variants stay. Rows are
    rebalanced by key first: a large key becomes several files, small keys share tasks.
    """
    if keys:
        df.hint("rebalance", *keys).write.mode("append").partitionBy(*keys).parquet(path)
    else:
        df.write.mode("append").parquet(path)


def replace_keys(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Put ``df`` in place of what the table has under the keys that occur in ``df``; other keys stay.

    Tasks write beside the table, and folders are exchanged when all have finished: a write that fails changes
    nothing, and one that is repeated gives the same table. Rows are rebalanced by key first.
    """
    (
        df.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A keyed table with a fixed schema; filters on its keys prune folders."""
    return spark.read.schema(schema).parquet(path)
