"""Nested text records (session, instance listing, intake report, model reply) to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.functions.text import last_segment
from facetlake.schemas import INSTANCE_RECORD, INTAKE_REPORT, SESSION_RECORD


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session files below ``path``; unreadable ones are skipped."""
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "session.json").text(
        path, wholetext=True
    )
    return parse_sessions(
        texts.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("dir"), F.col("value").alias("text"))
    )


def parse_sessions(texts: DataFrame) -> DataFrame:
    """Job rows from session text. ``texts``: ``dir text``; junk is dropped, gaps are filled.

    Old sessions carry no job id: the folder name stands in for it.
    """
    record = F.from_json("text", SESSION_RECORD, {"mode": "PERMISSIVE"})
    valid = F.try_parse_json("text").isNotNull() & F.ltrim("text").startswith("{")
    return (
        texts.filter(valid)
        .select("dir", record.alias("s"))
        .select(
            F.coalesce(F.nullif("s.job_id", F.lit("")), "dir").alias("job_id"),
            F.coalesce(F.nullif("s.name", F.lit("")), F.nullif("s.label", F.lit("")), "dir").alias("name"),
            "s.target_faces", "s.faces", "s.build_faces",
            F.coalesce("s.created_at", F.lit("")).alias("created_at"),
            "s.regime",
            F.coalesce("s.warnings", F.array().cast("array<string>")).alias("warnings"),
            "dir",
        )
    )


def flatten_instances(listings: DataFrame, image_key: str = "worker-image") -> DataFrame:
    """Flat machine rows from JSON records in column ``text``.

    The image a machine booted from is read from our own metadata entry first, because the
    vendor field disappears some time after creation.
    """
    ours = F.get(F.filter("i.metadata.items", lambda x: x["key"] == image_key), 0)["value"]
    zone = F.coalesce("i.zone", F.lit(""))
    spot = (F.col("i.scheduling.provisioningModel") == "SPOT") | F.col("i.scheduling.preemptible")
    seconds = F.col("i.scheduling.maxRunDuration.seconds").try_cast("bigint")
    accelerator = F.get("i.guestAccelerators", 0)["acceleratorType"]
    return listings.withColumn("i", F.from_json("text", INSTANCE_RECORD)).filter("i IS NOT NULL").select(
        F.coalesce("i.name", F.lit("")).alias("name"),
        last_segment(zone).alias("zone"),
        last_segment(F.coalesce("i.machineType", F.lit(""))).alias("machine_type"),
        F.coalesce("i.status", F.lit("")).alias("status"),
        F.coalesce(F.nullif(ours, F.lit("")), last_segment(F.nullif("i.sourceMachineImage", F.lit("")))).alias("image"),
        last_segment(F.nullif(accelerator, F.lit(""))).alias("accelerator"),
        F.coalesce(spot, F.lit(False)).alias("spot"),
        F.to_timestamp("i.creationTimestamp").alias("created"),
        F.nullif(seconds, F.lit(0)).alias("max_run_s"),
    )


def report_lines(reports: DataFrame) -> DataFrame:
    """Log lines of the newest intake report per job: rejected and unreadable photos, then advice.

    ``reports``: ``job_id mtime text``. Line numbers keep the order of the report.
    """
    newest = reports.groupBy("job_id").agg(F.max_by("text", "mtime").alias("text"))
    parsed = newest.select("job_id", F.from_json("text", INTAKE_REPORT).alias("r")).filter("r IS NOT NULL")
    photos = parsed.select("job_id", F.posexplode("r.photos").alias("pos", "p"))
    name = F.regexp_extract(F.coalesce("p.source", F.lit("?")), r"([^/]*)$", 1)
    lines = photos.filter(F.col("p.status").isin("rejected", "unreadable")).select(
        "job_id", F.lit(0).alias("part"), "pos",
        F.when(
            F.col("p.status") == "rejected",
            F.concat(F.lit("  rejected "), name, F.lit(": "), F.array_join("p.reject_reasons", "; ")),
        ).otherwise(F.concat(F.lit("  unreadable "), name)).alias("line"),
    )
    advice = parsed.select("job_id", F.posexplode("r.advice").alias("pos", "a")).select(
        "job_id", F.lit(1).alias("part"), "pos", F.concat(F.lit("  advice: "), F.col("a")).alias("line")
    )
    return lines.unionByName(advice)


def parse_reply(text: Column, schema: str) -> Column:
    """A model reply as a struct, tolerating a code fence; ``error`` is set for bad JSON."""
    trimmed = F.trim(text)
    fenced = F.regexp_replace(F.get(F.split(trimmed, "```"), 1), r"^(?i)json", "")
    body = F.trim(F.when(trimmed.startswith("```"), fenced).otherwise(trimmed))
    ok = F.try_parse_json(body).isNotNull()
    return F.struct(
        F.when(ok, F.from_json(body, schema)).alias("value"),
        F.when(~ok | text.isNull(), F.lit("reply is not valid JSON")).alias("error"),
    )


def parse_probe(text: Column) -> Column:
    """GPU probe line 'name, memory MiB, capability' as a struct; NULL for anything else."""
    line = F.get(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: s != ""), 0)
    parts = F.transform(F.split(line, ","), lambda s: F.trim(s))
    memory = F.trim(F.regexp_replace(F.get(parts, 1), "MiB|MIB|mb|MB", "")).try_cast("int")
    capability = F.get(parts, 2).try_cast("double")
    good = (F.size(parts) == 3) & (F.get(parts, 0) != "") & memory.isNotNull() & capability.isNotNull()
    return F.when(
        good,
        F.struct(F.get(parts, 0).alias("name"), memory.alias("vram_mb"), capability.alias("compute_cap")),
    )


def capability_reason(host: Column, reachable: Column, gpu: Column, min_vram_mb: int) -> Column:
    """Why a host cannot be used, '' when it can."""
    return (
        F.when(~reachable, F.concat(F.lit("cannot reach '"), host, F.lit("'")))
        .when(gpu.isNull(), F.concat(F.lit("'"), host, F.lit("' is reachable but reports no GPU")))
        .when(
            gpu["vram_mb"] < min_vram_mb,
            F.concat(F.lit("'"), host, F.lit("' has "), gpu["name"], F.lit(" with "), gpu["vram_mb"].cast("string"),
                     F.lit(f" MB VRAM; {min_vram_mb} MB is needed")),
        )
        .otherwise("")
    )
