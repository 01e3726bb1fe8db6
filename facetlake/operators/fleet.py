"""Jobs, stages, logs, files, machines and cost as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.functions import text as tx
from facetlake.functions.numbers import round_even
from facetlake.operators.ordering import positions, running_sum
from facetlake.session import materialize

# Hourly machine rates (spot, on demand), storage rates, stage order.
HOURLY_USD = {
    "nvidia-tesla-t4": (0.11, 0.35),
    "nvidia-l4": (0.21, 0.70),
    "nvidia-tesla-v100": (0.74, 2.48),
    "nvidia-tesla-p4": (0.09, 0.60),
}
DISK_USD_PER_GB_MONTH = {"pd-standard": 0.04, "pd-balanced": 0.10, "pd-ssd": 0.17}
DISK_DEFAULT = 0.10
IMAGE_USD_PER_GB_MONTH = 0.05
HOURS_PER_MONTH = 730
STAGE_ORDER = ("ingest", "sparse", "dense", "generate", "scale", "clean", "decimate", "unwrap", "bake", "export")
TERMINAL = ("done", "failed", "cancelled")
CRITICAL_SECONDS = 600
WARN_SECONDS = 1800


def rate(accelerator: Column, spot: Column) -> Column:
    """USD per hour; NULL for an accelerator that is not on the card."""
    card = F.create_map(
        *[
            c
            for name, prices in HOURLY_USD.items()
            for c in (F.lit(name), F.struct(F.lit(prices[0]).alias("spot"), F.lit(prices[1]).alias("demand")))
        ]
    )
    found = F.element_at(card, accelerator)
    return F.when(spot, found["spot"]).otherwise(found["demand"])


def deadlines(machines: DataFrame, now: Column) -> DataFrame:
    """Uptime, time left before the hard limit and cost so far. No limit leaves NULL."""
    uptime = F.greatest(F.lit(0.0), tx.seconds_between(F.col("created"), now) / 3600.0)
    return machines.withColumn("uptime_hours", uptime).withColumns(
        {
            "seconds_remaining": F.greatest(F.lit(0.0), F.col("max_run_s") - F.col("uptime_hours") * 3600.0),
            "usd": rate(F.col("accelerator"), F.col("spot")) * F.col("uptime_hours"),
        }
    ).withColumn("seconds_remaining", F.when(F.col("max_run_s").isNotNull(), F.col("seconds_remaining")))


def deadline_tone(left: Column, limit: Column) -> dict[str, Column]:
    """Tone, fraction left and label of a countdown."""
    hours = F.floor(left / 3600)
    minutes = F.floor((left % 3600) / 60 + 0.5)
    label = F.when(left <= 0, "0m").when(
        hours > 0,
        F.concat(hours.cast("string"), F.lit("h"),
                 F.when(minutes > 0, F.concat(F.lit(" "), minutes.cast("string"), F.lit("m"))).otherwise("")),
    ).otherwise(F.concat(minutes.cast("string"), F.lit("m")))
    return {
        "tone": F.when(left <= CRITICAL_SECONDS, "critical").when(left <= WARN_SECONDS, "warn").when(left.isNotNull(), "ok"),
        "fraction": tx.clamp(left / limit, 0.0, 1.0),
        "label": F.when(left.isNotNull(), label),
    }


def spend(priced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known spend and whether any accelerator machine runs, per key."""
    return priced.groupBy(*keys).agg(
        F.count("*").alias("machines"),
        F.coalesce(F.sum("usd"), F.lit(0.0)).alias("usd"),
        F.count_if(F.col("usd").isNull()).alias("unmeasured"),
        F.bool_or((F.upper("status") == "RUNNING") & F.col("accelerator").isNotNull()).alias("gpu_running"),
    )


def billable_machines(machines: DataFrame) -> DataFrame:
    running = F.col("status") == "RUNNING"
    return machines.select(
        F.lit("instance").alias("kind"), "name",
        F.lit(None).cast("double").alias("size_gb"),
        F.when(running, F.round(rate(F.col("accelerator"), F.col("spot")) * HOURS_PER_MONTH, 2)).alias("usd_per_month"),
        F.when(running, "running and billing by the hour").otherwise("stopped: only its disk bills").alias("advice"),
    )


def billable_disks(disks: DataFrame) -> DataFrame:
    card = F.create_map(*[F.lit(x) for pair in DISK_USD_PER_GB_MONTH.items() for x in pair])
    per_gb = F.coalesce(F.element_at(card, F.col("disk_type")), F.lit(DISK_DEFAULT))
    return disks.select(
        F.lit("disk").alias("kind"), "name", F.col("size_gb").cast("double").alias("size_gb"),
        F.round(F.col("size_gb") * per_gb, 2).alias("usd_per_month"),
        F.when(F.col("attached"), "in use by a machine").otherwise("not attached and still billing").alias("advice"),
    )


def billable_images(images: DataFrame) -> DataFrame:
    gb = F.col("bytes") / 1e9
    return images.select(
        F.lit("machine-image").alias("kind"), "name", F.round(gb, 1).alias("size_gb"),
        F.round(gb * IMAGE_USD_PER_GB_MONTH, 2).alias("usd_per_month"),
        F.lit("delete if fast launches are not needed").alias("advice"),
    )


def billable_buckets(buckets: DataFrame) -> DataFrame:
    return buckets.select(F.lit("bucket").alias("kind"), "name", F.lit("size not measured").alias("advice"))


def billable(machines: DataFrame, disks: DataFrame, images: DataFrame, buckets: DataFrame) -> DataFrame:
    """Everything that bills, as one table; what is not measured stays NULL, never zero."""
    return (
        billable_machines(machines)
        .unionByName(billable_disks(disks))
        .unionByName(billable_images(images))
        .unionByName(billable_buckets(buckets), allowMissingColumns=True)
    )


def inventory_totals(resources: DataFrame) -> DataFrame:
    """Monthly total and unmeasured count per kind, with a grand total."""
    return resources.rollup("kind").agg(
        F.count("*").alias("resources"),
        F.round(F.coalesce(F.sum("usd_per_month"), F.lit(0.0)), 2).alias("usd_per_month"),
        F.count_if(F.col("usd_per_month").isNull()).alias("unmeasured"),
    ).select(F.coalesce("kind", F.lit("all")).alias("kind"), "resources", "usd_per_month", "unmeasured")


# --- stages and logs ---------------------------------------------------------


def job_log(stages: DataFrame) -> DataFrame:
    """Numbered log lines per job, one per stage outcome; every 17th is a warning."""
    line = F.when(F.col("seq") % 17 == 0, F.concat(F.lit("WARNING: "), F.col("detail"))).otherwise(
        tx.summary_line(F.col("status"), F.col("name"), F.col("detail"), F.col("seconds"))
    )
    lines = stages.select("job_id", "seq", "ts", line.alias("line"))
    return positions(lines, ["job_id"], ["ts", "seq"], "line_no").select("job_id", "line_no", "line", "ts")


def log_since(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """Lines after each reader's cursor; a cursor outside the log resends all of it.

    ``cursors``: ``job_id log_since``. Every row also carries the true total.
    """
    totals = log.groupBy("job_id").agg(F.count("*").alias("log_total"))
    c = F.col("log_since")
    starts = (
        cursors.join(totals, "job_id")
        .withColumn("start", F.when((c >= 0) & (c <= F.col("log_total")), c).otherwise(F.lit(0)))
        .select("job_id", "start", "log_total")
    )
    return log.join(starts, "job_id").filter("line_no >= start")


def stage_track(jobs: DataFrame, stages: DataFrame) -> DataFrame:
    """What a job's track shows: its reported stages, or the canonical order while nothing is reported.

    ``jobs``: ``job_id status``.
    """
    reported = stages.join(jobs.select("job_id"), "job_id", "left_semi").select(
        "job_id", "seq", "name",
        F.when(F.col("status").isin("ok", "failed"), F.col("status")).otherwise("skipped").alias("state"),
        "seconds",
    )
    silent = jobs.join(stages.select("job_id").distinct(), "job_id", "left_anti")
    canonical = silent.select(
        "job_id", "status", F.posexplode(F.array(*[F.lit(s) for s in STAGE_ORDER])).alias("pos", "name")
    ).select(
        "job_id", F.col("pos").cast("bigint").alias("seq"), "name",
        F.when(F.col("status") == "failed", "skipped").otherwise("pending").alias("state"),
        F.lit(None).cast("double").alias("seconds"),
    )
    return reported.unionByName(canonical)


def job_counts(jobs: DataFrame) -> DataFrame:
    """Overlapping bucket counts of a job list."""
    status = F.col("status")
    return jobs.agg(
        F.count("*").alias("all"),
        F.count_if(~status.isin(*TERMINAL)).alias("active"),
        F.count_if(status == "done").alias("done"),
        F.count_if(status == "failed").alias("failed"),
    )


# --- files and models --------------------------------------------------------

MODEL = r"^model(-\d+)?\.glb$"
VARIANT = r"^model-(\d+)\.glb$"


def file_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("job_id").agg(F.count("*").alias("files"), F.sum("length").alias("total_bytes"))


def current_models(files: DataFrame) -> DataFrame:
    """Newest model of each job and how many it holds."""
    models = files.filter(F.col("name").rlike(MODEL))
    return models.groupBy("job_id").agg(
        F.max_by("name", F.struct("mtime", "name")).alias("model"),
        F.max("mtime").alias("mtime"),
        F.count("*").alias("models"),
    )


def model_list(files: DataFrame, jobs: DataFrame) -> DataFrame:
    """Every model of a job: its face count and where that came from, and which one is live.

    ``jobs``: ``job_id build_faces faces``.
    """
    variant = F.regexp_extract("name", VARIANT, 1)
    current = current_models(files).select("job_id", F.col("model").alias("_current"))
    return (
        files.filter(F.col("name").rlike(MODEL))
        .join(current, "job_id")
        .join(jobs.select("job_id", "build_faces", "faces"), "job_id", "left")
        .select(
            "job_id", "name", F.col("length").alias("bytes"), "mtime",
            (variant == "").alias("original"),
            (F.col("name") == F.col("_current")).alias("current"),
            F.when(variant != "", variant.cast("bigint"))
            .when(F.col("build_faces").isNotNull(), F.col("build_faces"))
            .when(F.col("name") == F.col("_current"), F.col("faces"))
            .alias("face_count"),
        )
    )


def restored_jobs(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """State of jobs after a restart: done where a model exists, else failed (it was interrupted)."""
    return jobs.join(current_models(files), "job_id", "left").withColumn(
        "status", F.when(F.col("model").isNotNull(), "done").otherwise("failed")
    )


def reoptimise_source(meshes: DataFrame) -> DataFrame:
    """Mesh to start from: a dense reconstruction if any, else the last generated one.

    ``meshes``: ``job_id path``. Jobs with neither are absent.
    """
    path = F.col("path")
    priority = F.when(path.endswith("dense.ply"), 0).when(path.rlike(r"s3-generate-[^/]*/out/mesh\.glb$"), 1)
    return (
        meshes.withColumn("_p", priority)
        .filter("_p IS NOT NULL")
        .groupBy("job_id")
        .agg(
            F.min("_p").alias("_p"),
            F.max(F.when(F.col("_p") == 0, path)).alias("_dense"),
            F.max(F.when(F.col("_p") == 1, path)).alias("_generated"),
        )
        .select("job_id", F.coalesce("_dense", "_generated").alias("path"), (F.col("_p") == 1).alias("generated"))
    )


def latest(rows: DataFrame, keys: Sequence[str], ts: str, prefix: str | None = None, name: str = "name") -> DataFrame:
    """Newest row per key, optionally among names with a prefix; equal times go to the larger name."""
    if prefix is not None:
        rows = rows.filter(F.col(name).startswith(prefix))
    rest = [c for c in rows.columns if c not in keys]
    return (
        rows.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(ts, name)).alias("_r"))
        .select(*keys, "_r.*")
    )


def size_report(files: DataFrame, before: Column, after: Column) -> DataFrame:
    """Bytes before and after an export, and their ratio, per job."""
    return files.groupBy("job_id").agg(F.sum(before).alias("bytes_before"), F.sum(after).alias("bytes_after")).withColumn(
        "ratio",
        F.when(F.col("bytes_before") > 0, F.col("bytes_after") / F.col("bytes_before")).otherwise(1.0),
    )


def loss_checks(before: Column, after: Column, budget: Column) -> Column:
    """Warnings when a step lost faces: remeshed below 90 %, or rebuilt below 80 % of the budget."""
    return F.array_compact(
        F.array(
            F.when(after < before * 0.9, "texturing remeshed the model down"),
            F.when((budget > 0) & (after < budget * 0.8), "rebuilt surface is short of the budget"),
        )
    )


# --- cache -------------------------------------------------------------------

def multiset_digest(keys: Sequence[str], rows: DataFrame, value: Column) -> DataFrame:
    """Order-insensitive digest of a group: count and two sums of 60-bit pieces of each row's md5."""
    md5 = F.md5(value)

    def piece(at: int) -> Column:
        return F.sum(F.conv(F.substring(md5, at, 15), 16, 10).cast("decimal(38,0)"))

    text = F.concat_ws(":", F.count("*").cast("string"), piece(1).cast("string"), piece(17).cast("string"))
    return rows.groupBy(*keys).agg(F.substring(F.sha2(text, 256), 1, 16).alias("digest"))


def stage_keys(inputs: DataFrame, stage: str, params_json: str) -> DataFrame:
    """Cache key of a stage per job: hash of stage, parameters and an order-insensitive digest of its input
    fingerprints, so no job's inputs are ever collected."""
    digested = multiset_digest(["job_id"], inputs, F.col("fingerprint"))
    payload = F.concat(F.lit('{"inputs": "'), F.col("digest"), F.lit(f'", "params": {params_json}, "stage": "{stage}"}}'))
    return digested.select("job_id", F.concat(F.lit(f"{stage}-"), F.substring(F.sha2(payload, 256), 1, 12)).alias("key"))


def cache_split(requests: DataFrame, done: DataFrame) -> DataFrame:
    """Requests with whether a finished run of the same key exists."""
    finished = done.select("key").distinct().withColumn("_hit", F.lit(True))
    return requests.join(finished, "key", "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


# --- hosts -------------------------------------------------------------------


def busy_hosts(jobs: DataFrame) -> DataFrame:
    """How many earlier jobs are still active on the host when each job is submitted.

    ``jobs``: ``job_id host start_ts end_ts`` with ``end_ts`` after ``start_ts``. A running sum
    over start and end events answers this without pairing jobs.
    """
    events = jobs.select(
        "job_id", "host",
        F.explode(
            F.array(
                F.struct(F.col("end_ts").alias("ts"), F.lit(0).alias("kind"), F.lit(-1).alias("delta")),
                F.struct(F.col("start_ts").alias("ts"), F.lit(1).alias("kind"), F.lit(1).alias("delta")),
            )
        ).alias("e"),
    ).select("job_id", "host", "e.*")
    active = running_sum(events, ["host"], ["ts", "kind", "job_id"], F.col("delta"), "_active")
    return active.filter("kind = 1").select(
        "job_id", "host", (F.col("_active") - 1).cast("bigint").alias("active"), (F.col("_active") > 1).alias("busy")
    )


def admitted(jobs: DataFrame) -> DataFrame:
    """One active job per host: a job is accepted iff no accepted job is active when it arrives.

    The accepted jobs of a host form a chain: after a job, the next accepted one is the first
    submitted at or after its end. The successor of every job comes from one running count, and
    the chain from the first job is marked by doubling: after k rounds 2**k links are covered.
    """
    subs = materialize(positions(jobs, ["host"], ["start_ts", "job_id"], "pos"), "submissions")
    marks = subs.select("host", "pos", F.col("start_ts").alias("ts"), F.lit(1).alias("kind"), "job_id", F.lit(1).alias("one"))
    asks = subs.select("host", "pos", F.col("end_ts").alias("ts"), F.lit(0).alias("kind"), "job_id", F.lit(0).alias("one"))
    counted = running_sum(marks.unionByName(asks), ["host"], ["ts", "kind", "job_id"], F.col("one"), "nxt")
    jump = materialize(counted.filter("kind = 0").select("host", "pos", F.col("nxt").cast("bigint").alias("nxt")), "jump")
    jump = materialize(jump.join(subs.select("host", F.col("pos").alias("nxt")), ["host", "nxt"], "left_semi"), "jump")
    chain = subs.filter("pos = 0").select("host", "pos")
    while True:
        reached = materialize(chain.join(jump, ["host", "pos"]).select("host", F.col("nxt").alias("pos")), "reached")
        if reached.isEmpty():
            break
        chain = materialize(chain.union(reached).distinct(), "chain")
        onward = jump.select("host", F.col("pos").alias("nxt"), F.col("nxt").alias("_n2"))
        jump = materialize(jump.join(onward, ["host", "nxt"]).select("host", "pos", F.col("_n2").alias("nxt")), "jump")
    taken = chain.withColumn("_t", F.lit(True))
    return subs.join(taken, ["host", "pos"], "left").select(
        *jobs.columns, F.coalesce("_t", F.lit(False)).alias("accepted")
    )


# --- names -------------------------------------------------------------------


def unique_names(rows: DataFrame, keys: Sequence[str], base: str, order: Sequence[str], name: str = "stem") -> DataFrame:
    """Suffix repeated names with -2, -3, ... in order, past every name that is taken by then.

    The first row of a name keeps it, unless an earlier row of a shorter name has been given it as a suffixed form; every other row
    gets the smallest free number. What one row gets depends on others only where a name is another one with a number
    behind (``part`` and ``part-2``). Such children block their number from their first row on, or are named by their
    parent before. Parents are settled before their children, level by level; rows are numbered by running counts, so a name
    that most rows have stays spread out.
    """
    ranked = positions(rows, keys, order, "_t")
    ranked = materialize(positions(ranked, [*keys, base], ["_t"], "_k"), "ranked")
    bases = ranked.groupBy(*keys, base).agg(F.min("_t").alias("_tau"), F.count("*").alias("_m"))
    number = F.regexp_extract(base, _NUMBERED, 2)
    children = bases.filter(number != "").select(*keys, base, "_tau", F.regexp_extract(base, _NUMBERED, 1).alias("_parent"), number.cast("long").alias("_n"))
    parents = bases.select(*keys, F.col(base).alias("_parent"), F.col("_m").alias("_pm"))
    linked = materialize(children.join(parents, [*keys, "_parent"]), "linked_names")
    if linked.isEmpty():
        index = F.col("_k") - 1
        return _suffixed(ranked.withColumn("_i", index).withColumn("_no", index + 2), base, name).select(*rows.columns, name)
    settled = _settled_children(ranked, linked, keys, base)
    taken = settled.filter("_taken").select(*keys, base, F.lit(1).alias("_e"))
    ranked = materialize(ranked.join(taken, [*keys, base], "left").withColumn("_i", F.col("_k") - 1 + F.coalesce("_e", F.lit(0))).drop("_e"), "ranked")
    blocked = materialize(settled.filter("_blocked").select(*keys, F.col("_parent").alias(base), "_n"), "blocked")
    # How many free numbers come before each blocked one.
    before = positions(blocked, [*keys, base], ["_n"], "_j").select(*keys, base, (F.col("_n") - 2 - F.col("_j")).alias("_at"))
    some = blocked.select(*keys, base).distinct()
    touched = ranked.filter("_i >= 0").join(some, [*keys, base], "left_semi").select(*keys, base, F.col("_i").alias("_at"), F.lit(1).alias("_own"))
    line = touched.unionByName(before.withColumn("_own", F.lit(0)))
    passed = running_sum(line, [*keys, base], ["_at", "_own"], 1 - F.col("_own"), "_passed").filter("_own = 1")
    shifted = ranked.join(passed.select(*keys, base, F.col("_at").alias("_i"), "_passed"), [*keys, base, "_i"], "left")
    return _suffixed(shifted.withColumn("_no", F.col("_i") + 2 + F.coalesce("_passed", F.lit(0))), base, name).select(*rows.columns, name)


#: A name with a number behind that could have been given to it.
_NUMBERED = r"^(.*)-([2-9]|[1-9][0-9]{1,17})$"


def _suffixed(rows: DataFrame, base: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.when(F.col("_i") < 0, F.col(base)).otherwise(F.concat(F.col(base), F.lit("-"), F.col("_no").cast("string"))))


def _settled_children(ranked: DataFrame, linked: DataFrame, keys: Sequence[str], base: str) -> DataFrame:
    """``linked`` with ``_blocked``: the parent's rows pass over it, and ``_taken``: one of them has been given its name.

    The parent reaches number n with its row n - 2 - s, where s counts the numbers passed over before; it passes over n if the
    child's first row comes earlier.
    """
    marks = linked.select(*keys, F.col("_parent").alias(base), F.col("_tau").alias("_t"), F.lit(0).alias("_one"))
    wanted = linked.select(*keys, F.col("_parent").alias(base)).distinct()
    own = ranked.join(wanted, [*keys, base], "left_semi").select(*keys, base, "_t", F.lit(1).alias("_one"))
    counted = running_sum(own.unionByName(marks), [*keys, base], ["_t", "_one"], F.col("_one"), "_rows").filter("_one = 0")
    counted = counted.select(*keys, F.col(base).alias("_parent"), F.col("_t").alias("_tau"), "_rows")
    open_ = materialize(positions(linked.join(counted, [*keys, "_parent", "_tau"]), [*keys, "_parent"], ["_n"], "_place"), "open_names")
    settled = None
    while not open_.isEmpty():
        waiting = open_.select(*keys, F.col(base).alias("_parent")).distinct()
        ready = open_.join(waiting, [*keys, "_parent"], "left_anti")
        if settled is None:
            ready = ready.withColumn("_pe", F.lit(0))
        else:
            given = settled.filter("_taken").select(*keys, F.col(base).alias("_parent"), F.lit(1).alias("_pe"))
            ready = ready.join(given, [*keys, "_parent"], "left").withColumn("_pe", F.coalesce("_pe", F.lit(0)))
        # A parent whose own name was taken numbers its first row as well.
        numbered = F.greatest(F.lit(0), F.col("_rows") - 1 + F.col("_pe"))
        ready = materialize(ready.withColumn("_c", F.col("_n") - 2 - numbered), "ready_names")
        # Between 0 and the children before it are passed over, which decides most without looking further.
        unclear = ready.filter((F.col("_c") >= 0) & (F.col("_c") < F.col("_place"))).select(*keys, "_parent").distinct()
        clear = ready.join(unclear, [*keys, "_parent"], "left_anti").withColumn("_blocked", F.col("_c") >= 0)
        clear = running_sum(clear, [*keys, "_parent"], ["_n"], F.col("_blocked").cast("long"), "_over").withColumn("_over", F.col("_over") - F.col("_blocked").cast("long"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema.fields)

        def walk(pdf):
            pdf, s, blocked, passed = pdf.sort_values("_n"), 0, [], []
            for c in pdf["_c"]:
                passed.append(s)
                blocked.append(s <= c)
                s += blocked[-1]
            return pdf.assign(_blocked=blocked, _over=passed)

        walked = ready.join(unclear, [*keys, "_parent"], "left_semi").groupBy(*keys, "_parent").applyInPandas(walk, f"{fields}, _blocked boolean, _over long")
        both = clear.select(*ready.columns, "_blocked", "_over").unionByName(walked)
        reached = F.col("_n") - 2 - F.col("_over") < F.col("_pm") - 1 + F.col("_pe")
        done = materialize(both.withColumn("_taken", ~F.col("_blocked") & reached), "settled_names")
        settled = done if settled is None else settled.unionByName(done)
        open_ = materialize(open_.join(done.select(*keys, base), [*keys, base], "left_anti"), "open_names")
    return settled


def first_of_tag(rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """First photo of each known tag is named after it; the others keep their own stem."""
    tag = F.lower(F.trim("tag"))
    tagged = rows.withColumn("_t", F.when(tag.isin(*allowed), tag))
    winners = (
        tagged.filter("_t IS NOT NULL").groupBy("job_id", "_t").agg(F.min("seq").alias("seq")).select("job_id", "seq", "_t")
    )
    return rows.join(winners, ["job_id", "seq"], "left").withColumn("stem", F.coalesce("_t", "own_stem")).drop("_t")


def pick_backend(candidates: DataFrame, priority: Sequence[str], never: Sequence[str]) -> DataFrame:
    """First usable backend per request: by priority, then registration order; test doubles never.

    ``candidates``: ``request_id name available registered``.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("name"))
    slot = F.struct(
        F.when(rank > 0, rank).otherwise(F.lit(len(priority) + 1)).alias("rank"), F.col("registered").alias("r")
    )
    return (
        candidates.filter(F.col("available") & ~F.col("name").isin(*never))
        .groupBy("request_id")
        .agg(F.min_by("name", slot).alias("backend"))
    )


# --- stage cost estimates ----------------------------------------------------

# Hardware options (spot, on demand, speed relative to the baseline), measured
# baseline seconds, fixed overhead seconds, and local bake cost by resolution.
HARDWARE = {
    "t4": (0.11, 0.35, 0.45),
    "l4": (0.28, 1.10, 1.0),
    "a100": (1.20, 3.70, 1.6),
    "h100": (3.00, 11.00, 2.2),
}
GENERATE_S, SEGMENT_S, TEXTURE_S = 170, 125, 123
COLD_OVERHEAD_S = 240 + 900 + 600
BAKE_LOCAL = {512: (6.0, 1759), 1024: (13.6, 3367), 2048: (52.9, 4118)}
BAKE_HOST_S = {1024: 45.5}
LOCAL_BASE = (1.9, 247)


def hardware_column() -> Column:
    return F.array(
        *[
            F.struct(F.lit(k).alias("option"), F.lit(s).alias("spot"), F.lit(d).alias("demand"), F.lit(r).alias("speed"))
            for k, (s, d, r) in HARDWARE.items()
        ]
    )


def hardware_grid(configs: DataFrame) -> DataFrame:
    """Estimated seconds and USD of each job on each hardware option, warm and cold.

    ``configs``: ``job_id texture semantic``.
    """
    modes = F.array(F.struct(F.lit("warm").alias("mode"), F.lit(0).alias("overhead")),
                    F.struct(F.lit("cold").alias("mode"), F.lit(COLD_OVERHEAD_S).alias("overhead")))
    rows = configs.withColumn("h", F.explode(hardware_column())).withColumn("m", F.explode(modes))
    speed = F.col("h.speed")

    def scaled(seconds: int) -> Column:
        return F.floor(seconds / speed)

    gpu = scaled(GENERATE_S) + F.when(F.col("texture"), scaled(TEXTURE_S)).otherwise(0) + F.when(
        F.col("semantic"), scaled(SEGMENT_S)
    ).otherwise(0)
    total = F.col("gpu_seconds") + F.col("m.overhead")
    return rows.withColumn("gpu_seconds", gpu).select(
        "job_id", F.col("h.option").alias("option"), F.col("m.mode").alias("mode"), "gpu_seconds",
        total.alias("total_seconds"),
        round_even(F.col("h.spot") * total / 3600, 3).alias("usd_spot"),
        round_even(F.col("h.demand") * total / 3600, 3).alias("usd_ondemand"),
    )


def stage_costs(configs: DataFrame) -> DataFrame:
    """Stages each job will run with known seconds and local memory, and the totals per job.

    ``configs``: ``job_id bake normal_res bake_location texture semantic has_host gpu_key``. The
    stages of one job are a short array, so no shuffle is needed.
    """
    speed = F.coalesce(
        F.element_at(F.create_map(*[x for k, v in HARDWARE.items() for x in (F.lit(k), F.lit(v[2]))]), F.col("gpu_key")),
        F.lit(HARDWARE["t4"][2]),
    )
    on_host = F.col("bake_location").isin("auto", "host") & F.col("has_host")

    def stage(name: str, where: Column | str, seconds: Column, ram: Column | int) -> Column:
        where = F.lit(where) if isinstance(where, str) else where
        ram = F.lit(ram) if isinstance(ram, int) else ram
        return F.struct(F.lit(name).alias("name"), where.alias("where"), seconds.cast("double").alias("seconds"),
                        ram.cast("int").alias("ram_mb"))

    res = tx.nearest(F.col("normal_res"), list(BAKE_LOCAL))
    local_s = F.element_at(F.create_map(*[x for k, v in BAKE_LOCAL.items() for x in (F.lit(k), F.lit(v[0]))]), res)
    local_ram = F.element_at(F.create_map(*[x for k, v in BAKE_LOCAL.items() for x in (F.lit(k), F.lit(v[1]))]), res)
    host_s = F.element_at(
        F.create_map(*[x for k, v in BAKE_HOST_S.items() for x in (F.lit(k), F.lit(v))]), F.col("normal_res")
    )
    host = F.col("has_host")
    stages = F.array_compact(
        F.array(
            stage("local", "local", F.lit(LOCAL_BASE[0]), LOCAL_BASE[1]),
            F.when(host, stage("generate", "host", F.floor(GENERATE_S / speed), 0)),
            F.when(host & F.col("texture"), stage("texture", "host", F.floor(TEXTURE_S / speed), 0)),
            F.when(host & F.col("semantic"), stage("segment", "host", F.floor(SEGMENT_S / speed), 0)),
            F.when(
                F.col("bake"),
                stage("bake", F.when(on_host, "host").otherwise("local"), F.when(on_host, host_s).otherwise(local_s),
                      F.when(on_host, 0).otherwise(local_ram)),
            ),
        )
    )
    known = F.aggregate("stages", F.lit(0.0), lambda a, s: a + F.coalesce(s["seconds"], F.lit(0.0)))
    peak = F.array_max(F.transform(F.filter("stages", lambda s: s["where"] == "local"), lambda s: s["ram_mb"]))
    return configs.withColumn("stages", stages).select(
        "job_id", "stages", F.round(known, 1).alias("known_seconds"), peak.alias("local_peak_mb"),
        F.exists("stages", lambda s: s["seconds"].isNull()).alias("has_unmeasured"),
        F.when(F.col("bake"), F.when(on_host, "host").otherwise("local")).alias("bake_where"),
    )
