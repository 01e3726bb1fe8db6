"""Log tailing as a stream: the checkpointed source offset is the reader's cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.functions.text import severity
from facetlake.streaming.run import drain


def tail(log: DataFrame) -> DataFrame:
    """New log lines with their severity. ``log``: a stream of ``job_id line_no line ts``."""
    return log.withColumn("severity", severity(F.col("line")))


def run_tail(log: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Append the lines not yet seen under this checkpoint and return all delivered lines."""
    return drain(tail(log), out, checkpoint)
