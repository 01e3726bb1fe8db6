"""Queries that run a stream over the available data and return what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlake.operators import fleet
from facetlake.session import materialize, scratch_path
from facetlake.starschema.fleet_queries import LOG, _host_jobs
from facetlake.starschema.registry import QUERIES, query
from facetlake.starschema.views import grids_from
from facetlake.streaming import admission, intake, presence, run, tail


def photo_stream(v):
    """The photo view again, over a stream of embeddings."""
    path = f"{v.sf_dir}/embeddings.parquet"
    # A file stream takes folders: that of the table, or the one its single file lies in.
    one_file = any(f.endswith("/embeddings.parquet") for f in v.table("embeddings").inputFiles())
    stream = run.read_stream(v.spark, v.sf_dir, "embeddings.parquet") if one_file else run.read_stream(v.spark, path, "*")
    return v.photo_rows(grids_from(stream))


def staged(df, name: str) -> str:
    """Write a table as the files a stream will read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def arrivals(events, ts: str, tick: dict, out_of_order: int, quiet: int):
    """The events as a stream; each of its batches is written and read by all cores."""
    spark = events.sparkSession
    files = spark.sparkContext.defaultParallelism
    return run.read_stream(spark, run.stage_arrivals(events, ts, tick, out_of_order, quiet=quiet, files=files), files_per_batch=files)


@query("photo_intake_stream", "S1", "SELECT shoot_id, seq, status, reasons FROM verdicts", ("verdicts",))
def _(v):
    return intake.run_intake(photo_stream(v)).select("shoot_id", "seq", "status", F.array_join("reasons", "; ").alias("reasons"))


@query("photo_intake_running_counts", "S1", "SELECT shoot_id, status, count(*) AS photos FROM verdicts GROUP BY 1, 2", ("verdicts",))
def _(v):
    return intake.run_counts(photo_stream(v))


@query("log_tail_stream", "S2", f"""WITH {LOG} SELECT job_id, line_no, CASE WHEN line LIKE 'WARNING:%' OR line LIKE '%[FAILED]%' THEN 'fail' WHEN line LIKE '%[SKIPPED]%' THEN 'skipped'
   WHEN line LIKE '%[OK]%' THEN 'ok' ELSE 'plain' END AS severity FROM lines""", ("stages",))
def _(v):
    path = staged(fleet.job_log(v.stages), "log")
    return tail.run_tail(run.read_stream(v.spark, path, files_per_batch=2)).select("job_id", "line_no", "severity")


PRESENCE = """span AS (SELECT project, min(poll_ts) AS a, max(poll_ts) AS b FROM polls GROUP BY 1),
   times AS (SELECT project, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS poll_ts FROM span),
   st AS (SELECT t.project, t.poll_ts, count(p.name) AS running, row_number() OVER (PARTITION BY t.project ORDER BY t.poll_ts) AS rn FROM times t LEFT JOIN polls p ON p.project=t.project AND p.poll_ts=t.poll_ts GROUP BY 1, 2),
   gone AS (SELECT p.project, p.poll_ts + INTERVAL 1 HOUR AS poll_ts, max(p.name) AS gone FROM polls p LEFT JOIN polls q ON q.project=p.project AND q.name=p.name AND q.poll_ts = p.poll_ts + INTERVAL 1 HOUR WHERE q.name IS NULL GROUP BY 1, 2),
   ask AS (SELECT t.project, t.poll_ts, bool_or(r.request_ts IS NOT NULL) AS asked FROM times t LEFT JOIN teardowns r ON r.project=t.project AND r.request_ts <= t.poll_ts AND r.request_ts > t.poll_ts - INTERVAL 1 HOUR GROUP BY 1, 2),
   s AS (SELECT st.*, gone, asked FROM st LEFT JOIN gone USING (project, poll_ts) JOIN ask USING (project, poll_ts)),
   walk AS (SELECT project, rn, poll_ts, running, asked AS grace, NULL::VARCHAR AS preempted FROM s WHERE rn = 1
     UNION ALL SELECT s.project, s.rn, s.poll_ts, s.running,
       CASE WHEN (w.grace OR s.asked) AND w.running > 0 AND s.running = 0 THEN false ELSE w.grace OR s.asked END,
       CASE WHEN s.gone IS NOT NULL AND NOT (w.grace OR s.asked) THEN s.gone ELSE w.preempted END
       FROM walk w JOIN s ON s.project=w.project AND s.rn=w.rn+1)"""
PRESENCE_SQL = f"""WITH RECURSIVE {PRESENCE} SELECT project, poll_ts, running, preempted,
   CASE WHEN running > 0 THEN 'ready' WHEN preempted IS NOT NULL THEN 'preempted' ELSE 'absent' END AS presence FROM walk"""


@query("vanished_machines", "C11", """WITH span AS (SELECT project, max(poll_ts) AS b FROM polls GROUP BY 1)
   SELECT p.project, p.poll_ts + INTERVAL 1 HOUR AS poll_ts, p.name FROM polls p JOIN span USING (project) LEFT JOIN polls q ON q.project=p.project AND q.name=p.name AND q.poll_ts = p.poll_ts + INTERVAL 1 HOUR
   WHERE q.name IS NULL AND p.poll_ts < span.b""", ("polls",))
def _(v):
    return presence.vanished(v.polls, presence.poll_times(v.polls))


@query("machine_presence", "S3 S4", PRESENCE_SQL, ("polls", "teardowns"))
def _(v):
    return presence.presence(v.polls, presence.poll_times(v.polls), v.teardowns)


@query("machine_presence_stream", "S3 S4", PRESENCE_SQL, ("polls", "teardowns"))
def _(v):
    events = presence.events(v.polls, presence.poll_times(v.polls), v.teardowns)
    return run.drain(presence.presence_stream(arrivals(materialize(events, "events"), "ts", {"kind": "tick"}, 7200, 7200)))


@query("host_admission_stream", "S5 E10", QUERIES["host_admission"].sql)
def _(v):
    return run.drain(admission.admission_stream(arrivals(_host_jobs(v), "start_ts", {"host": -1}, 86400, 86400)))


WAITS = """ev AS (SELECT o_orderkey AS job_id, o_orderdate AS ts, 'queued' AS kind FROM orders
   UNION ALL SELECT o_orderkey, o_orderdate + to_seconds((o_orderkey*37) % 7000), CASE WHEN o_orderkey%4=0 THEN 'failed' ELSE 'ready' END FROM orders WHERE o_orderkey%5<>0)"""


def wait_events(v):
    k = F.col("o_orderkey")
    queued = v.table("orders").select(k.alias("job_id"), F.col("o_orderdate").alias("ts"), F.lit("queued").alias("kind"))
    answer = v.table("orders").filter(k % 5 != 0).select(
        k.alias("job_id"), F.timestamp_micros(F.unix_micros("o_orderdate") + (k * 37 % 7000) * 1000000).alias("ts"),
        F.when(k % 4 == 0, "failed").otherwise("ready").alias("kind"),
    )
    return queued.unionByName(answer)


@query("resource_wait_outcomes", "S6", f"""WITH {WAITS}, q AS (SELECT job_id, min(ts) AS q FROM ev WHERE kind='queued' GROUP BY 1),
   a AS (SELECT job_id, arg_min(kind, (ts, kind)) AS kind, min(ts) AS ts FROM ev JOIN q USING (job_id) WHERE kind<>'queued' AND ts >= q AND ts <= q + INTERVAL 1 HOUR GROUP BY 1)
   SELECT job_id, CASE kind WHEN 'ready' THEN 'released' WHEN 'failed' THEN 'failed' ELSE 'timed out' END AS outcome, coalesce(a.ts, q + INTERVAL 1 HOUR) AS ts FROM q LEFT JOIN a USING (job_id)""")
def _(v):
    return admission.wait_outcomes(wait_events(v))


@query("resource_wait_stream", "S6", QUERIES["resource_wait_outcomes"].sql)
def _(v):
    return run.drain(admission.wait_stream(arrivals(wait_events(v), "ts", {"job_id": -1, "kind": "tick"}, 600, 7200)))


def beats(v):
    terminal = (F.col("event_type") == "purchase") & (F.col("event_id") % 3 == 0)
    return v.table("events").select((F.col("user_id")).alias("job_id"), "ts", terminal.alias("terminal"))


@query("silent_jobs", "S7", """SELECT user_id AS job_id, max(ts) AS last_ts, CASE WHEN bool_or(event_type='purchase' AND event_id%3=0) THEN 'finished'
   WHEN epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(max(ts)) > 43200000000 THEN 'failed' ELSE 'running' END AS status FROM events GROUP BY 1""")
def _(v):
    return admission.silent_jobs(beats(v), 43200, F.lit("2024-01-31 00:00:00").cast("timestamp"))


@query("silent_jobs_stream", "S7", """WITH b AS (SELECT user_id AS job_id, ts, bool_or(event_type='purchase' AND event_id%3=0) AS terminal FROM events GROUP BY 1, 2),
   n AS (SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts) AS next_ts FROM b),
   d AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts) AS k FROM n WHERE terminal OR next_ts IS NULL OR next_ts > ts + INTERVAL 12 HOUR)
   SELECT job_id, ts AS last_ts, CASE WHEN terminal THEN 'finished' ELSE 'failed' END AS status FROM d WHERE k = 1""")
def _(v):
    """Until the tick that ends the stream every job has finished or been silent for too long."""
    return run.drain(admission.silent_stream(arrivals(beats(v), "ts", {"job_id": -1}, 600, 86400), 43200))
