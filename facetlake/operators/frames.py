"""Frame picking from clips: stride, temporal buckets, sharpest acceptable frame per bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: candidates examined per output slot.
OVERSAMPLE = 6


def candidates(frames: DataFrame, target: int = 32) -> DataFrame:
    """Every ``stride``-th frame of the whole clip. ``seq`` is the dense 0-based frame number."""
    counts = frames.groupBy("clip_id").agg(F.count("*").alias("n_frames"))
    stride = F.greatest(F.lit(1).cast("bigint"), F.expr(f"n_frames div {target * OVERSAMPLE}"))
    return (
        frames.join(counts, "clip_id")
        .withColumn("stride", stride)
        .filter("seq % stride = 0")
        .withColumn("candidate", F.expr("seq div stride"))
        .withColumn("n_candidates", F.expr("(n_frames + stride - 1) div stride"))
    )


def with_bucket(sampled: DataFrame, target: int = 32) -> DataFrame:
    """Bucket i covers candidates floor(i*n/T) .. floor((i+1)*n/T)-1; no rank is needed."""
    return sampled.withColumn("bucket", F.expr(f"((candidate + 1) * {target} - 1) div n_candidates"))


def pick(frames: DataFrame, target: int = 32) -> DataFrame:
    """Sharpest acceptable frame per temporal bucket, the first on ties."""
    return (
        with_bucket(candidates(frames, target), target)
        .filter("ok")
        .groupBy("clip_id", "bucket")
        .agg(F.max(F.struct("score", (-F.col("seq")).alias("neg_seq"))).alias("_best"))
        .select("clip_id", "bucket", (-F.col("_best.neg_seq")).alias("seq"), F.col("_best.score").alias("score"))
    )
