"""Photo intake as a stream: every photo is judged as it lands, with running counts per shoot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.functions import pixels as px
from facetlake.operators.photos import verdicts
from facetlake.streaming.run import drain, drain_batches


def judge(photos: DataFrame) -> DataFrame:
    """Verdicts of photo rows (``shoot_id seq path width height grid``), batch or stream."""
    grid = F.col("grid")
    scored = photos.select(
        "shoot_id", "seq", "path", "width", "height",
        px.sharpness(grid).alias("blur"),
        px.share(grid, lambda g: g <= px.DARK_LEVEL).alias("dark"),
        px.share(grid, lambda g: g >= px.BRIGHT_LEVEL).alias("bright"),
    )
    return verdicts(scored)


def run_intake(photos: DataFrame, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Judge a photo stream and return the verdict table."""
    return drain(judge(photos), out, checkpoint)


def run_counts(photos: DataFrame, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Running counts per shoot and status; every batch writes only the groups that changed.

    The current count of a group is its largest one.
    """
    counts = judge(photos).groupBy("shoot_id", "status").agg(F.count("*").alias("photos"))
    folder = drain_batches(counts, lambda df, path: df.write.mode("overwrite").parquet(path), checkpoint, "update", out)
    rows = photos.sparkSession.read.option("basePath", folder).parquet(f"{folder}/batch=*")
    return rows.groupBy("shoot_id", "status").agg(F.max("photos").alias("photos"))
