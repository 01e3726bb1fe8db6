"""Running a stream over the data available now and reading back what it wrote."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.session import discard, scratch_path


def read_stream(spark: SparkSession, path: str, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A file stream with the schema of what lies there; new files join the next batch."""
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


@dataclass
class Drained:
    """What a stream wrote, and how many input rows it read and dropped as too late."""

    table: DataFrame
    rows: int
    late: int


def drain_counted(stream: DataFrame, out: str | None = None, checkpoint: str | None = None, mode: str = "append") -> Drained:
    """Process everything available, append it to a table exactly once, and return that table with its counts.

    State and checkpoint of a stream that is not to be continued are deleted at the end.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream")
    own = None if checkpoint else scratch_path(spark, "stream-state")
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", out)
        .option("checkpointLocation", checkpoint or own)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    progress = query.recentProgress
    if own:
        discard(spark, [own])
    late = sum(int(op["numRowsDroppedByWatermark"]) for p in progress for op in p["stateOperators"])
    return Drained(spark.read.schema(stream.schema).parquet(out), sum(int(p["numInputRows"]) for p in progress), late)


def drain(stream: DataFrame, out: str | None = None, checkpoint: str | None = None, mode: str = "append") -> DataFrame:
    """Process everything available, append it to a table exactly once, and return that table."""
    return drain_counted(stream, out, checkpoint, mode).table


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, str], None], checkpoint: str | None = None,
                  mode: str = "update", out: str | None = None) -> str:
    """Process everything available with a batch function; each batch overwrites its own folder.

    A batch replayed after a failure replaces what it wrote before. Returns the output folder.
    """
    spark = stream.sparkSession
    out = out or scratch_path(spark, "stream")

    def each(df: DataFrame, batch: int) -> None:
        write(df, f"{out}/batch={batch:09d}")

    (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return out


def stage_arrivals(events: DataFrame, ts: str, tick: dict, out_of_order: int, batches: int = 4, quiet: int = 0, files: int = 1) -> str:
    """Write events as the files that a stream will read batch by batch, out of order as a network would bring them.

    A batch is exactly ``files`` files, to be read with as many ``files_per_batch``. Every event arrives up to ``out_of_order`` seconds after its time, by a hash of the event. A last file has one row, ``tick``
    (columns without a value are null), so many seconds (``quiet``) after all others that the watermark passes everything.
    """
    spark = events.sparkSession
    path = scratch_path(spark, "arrivals")
    arrival = F.unix_seconds(ts) + F.pmod(F.xxhash64(*events.columns), F.lit(max(1, out_of_order)))
    span = events.agg(F.min(arrival).alias("a"), F.max(arrival).alias("b"), F.max(ts).alias("last")).first()
    if span.a is None:
        events.write.parquet(path)
        return path
    for i in range(batches):
        part = F.least(F.floor((arrival - span.a) * batches / max(1, span.b - span.a)), F.lit(batches - 1))
        # As many tasks as files, whatever comes before them.
        events.filter(part == i).repartition(files).write.mode("append").parquet(path)
        # Where rows are fewer than files, empty ones complete the batch.
        while files > 1 and len(spark.read.schema(events.schema).parquet(path).inputFiles()) < (i + 1) * files:
            events.limit(0).coalesce(1).write.mode("append").parquet(path)
    kinds = {f.name: f.dataType for f in events.schema.fields}
    values = [F.lit(tick.get(c)).cast(kinds[c]).alias(c) for c in events.columns if c != ts]
    end = spark.range(1).select((F.lit(span.last) + F.expr(f"INTERVAL {out_of_order + quiet + 1} SECONDS")).cast(kinds[ts]).alias(ts), *values)
    end.select(*events.columns).coalesce(1).write.mode("append").parquet(path)
    return path
