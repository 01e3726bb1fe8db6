"""Stateful job streams: admission per host, waiting for a resource, silent-job detection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from facetlake.streaming import reorder

# Fixed value: how long a queued job waits for its machine.
WAIT_SECONDS = 3600


@reorder.keeps(1)
def _admit(key: tuple, due: pd.DataFrame, kept: tuple | None, watermark: int) -> tuple[pd.DataFrame | None, tuple | None, int | None]:
    busy_until = kept[0] if kept else None
    out = None
    if len(due):
        starts, ends = due["start_ts"].to_numpy(), due["end_ts"].to_numpy()
        accepted = np.zeros(len(due), bool)
        # Jobs come in the order of their start: only accepted ones are visited.
        at = 0 if busy_until is None else int(np.searchsorted(starts, np.datetime64(busy_until)))
        while at < len(due):
            accepted[at], busy_until = True, pd.Timestamp(ends[at])
            at = max(at + 1, int(np.searchsorted(starts, ends[at])))
        out = pd.DataFrame({"job_id": due["job_id"].to_numpy(), "host": key[0], "accepted": accepted})
    # Whatever may still come starts after the watermark; a host that is free by then needs no memory.
    if busy_until is None or _ms(busy_until) < watermark:
        return out, None, None
    return out, (busy_until,), _ms(busy_until)


def admission_stream(submissions: DataFrame, late: str = "1 day") -> DataFrame:
    """Accept a job iff no accepted job is active on its host. Input: ``job_id host start_ts end_ts``.

    Submissions may arrive in any order within ``late``: a host's jobs wait until the watermark has passed their start, and are
    judged in the order of start and id. What comes later is dropped and counted by Spark. Besides the jobs that wait, the
    state of a host is one timestamp, and goes when the watermark passes it. Rows with a null ``job_id`` only move time.
    """
    return (
        submissions.withWatermark("start_ts", late)
        .groupBy("host")
        .applyInPandasWithState(
            reorder.in_order(_only_jobs(_admit), "start_ts", ["start_ts", "job_id"]), "job_id bigint, host bigint, accepted boolean",
            f"{reorder.HELD}, busy_until timestamp", "append", GroupStateTimeout.EventTimeTimeout,
        )
    )


def _only_jobs(fold):
    @reorder.keeps(fold.width)
    def run(key: tuple, due: pd.DataFrame, kept: tuple | None, watermark: int):
        return fold(key, due[due["job_id"].notna()] if len(due) else due, kept, watermark)

    return run


def wait_outcomes(events: DataFrame, wait_seconds: int = WAIT_SECONDS) -> DataFrame:
    """What became of each queued job, in batch.

    ``events``: ``job_id ts kind`` with kinds queued, ready, failed. A job is released by the first
    ready within the limit, fails with the first failure, or times out.
    """
    queued = events.filter("kind = 'queued'").groupBy("job_id").agg(F.min("ts").alias("queued_ts"))
    limit = F.timestamp_micros(F.unix_micros("queued_ts") + wait_seconds * 1_000_000)
    answers = (
        events.filter("kind IN ('ready', 'failed')")
        .join(queued, "job_id")
        .filter((F.col("ts") >= F.col("queued_ts")) & (F.col("ts") <= limit))
        .groupBy("job_id")
        .agg(F.min(F.struct("ts", "kind")).alias("_first"))
    )
    outcome = F.when(F.col("_first.kind") == "ready", "released").when(F.col("_first.kind") == "failed", "failed")
    return queued.join(answers, "job_id", "left").select(
        "job_id", F.coalesce(outcome, F.lit("timed out")).alias("outcome"), F.coalesce("_first.ts", limit).alias("ts")
    )


#: Jobs that wait share so many rows of state, dealt by their hash; a state row of each job would cost a call each.
BUCKETS = 512


def _waiter(wait_seconds: int):
    limit = wait_seconds * 1_000_000_000
    job = ["job_id", "no_id"]

    def wait(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = [reorder._unpacked(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            frames += [pdf[[*job, "ts", "kind"]] for pdf in batches]
        watermark = state.getCurrentWatermarkMs()
        rows = pd.concat(frames, ignore_index=True).dropna(subset=["ts"])
        rows["ts"] = rows["ts"].astype("datetime64[ns]")
        at, asked = rows["ts"].astype("int64"), rows["kind"] == "queued"
        known = asked.groupby([rows[c] for c in job]).transform("any")
        starts = rows[asked].groupby(job, as_index=False)["ts"].min().rename(columns={"ts": "start"})
        told = rows[~asked].merge(starts, on=job)
        told = told[told["ts"] >= told["start"]].sort_values([*job, "ts", "kind"], kind="stable", na_position="first").drop_duplicates(job)
        jobs = starts.merge(told[[*job, "ts", "kind"]], on=job, how="left")
        end = jobs["start"] + pd.Timedelta(limit, "ns")
        over = end.astype("int64") // 1_000_000 <= watermark
        done, timely = jobs["ts"].notna() | over, jobs["ts"].notna() & (jobs["ts"] <= end)
        outcome = jobs["kind"].map(lambda k: "released" if k == "ready" else "failed").where(timely, "timed out")
        out = pd.DataFrame({"job_id": jobs["job_id"].astype("Int64").mask(jobs["no_id"]), "outcome": outcome, "ts": jobs["ts"].where(timely, end)})[done]
        # An answer may come before its request; it is kept while such a request could still arrive.
        early = ~known & (at // 1_000_000 > watermark)
        waits = rows[known].merge(jobs.loc[~done, job], on=job)
        kept = pd.concat([rows[early], waits], ignore_index=True)
        if kept.empty:
            if state.exists:
                state.remove()
        else:
            state.update((reorder._packed(kept),))
            calls = [*(end[~done].astype("int64") // 1_000_000).nsmallest(1), *(at[early] // 1_000_000).nsmallest(1)]
            state.setTimeoutTimestamp(max(int(min(calls)), watermark + 1))
        if len(out):
            yield out

    return wait


def _ms(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


def wait_stream(events: DataFrame, wait_seconds: int = WAIT_SECONDS, late: str = "10 minutes") -> DataFrame:
    """The same outcomes from a stream; the watermark fires the timeouts and bounds the state.

    Requests and answers may arrive in either order, up to the watermark. Rows of state hold the events of many jobs
    that wait (``BUCKETS``).
    """
    none = F.col("job_id").isNull()
    dealt = events.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).alias("bucket"), F.coalesce(F.col("job_id").cast("long"), F.lit(0)).alias("job_id"),
        none.alias("no_id"), "ts", "kind",
    )
    return dealt.groupBy("bucket").applyInPandasWithState(
        _waiter(wait_seconds), "job_id bigint, outcome string, ts timestamp", "held binary", "append", GroupStateTimeout.EventTimeTimeout,
    )


def silent_jobs(beats: DataFrame, limit_seconds: int, as_of) -> DataFrame:
    """Jobs whose last sign of life is older than the limit and that never finished, in batch.

    ``beats``: ``job_id ts terminal``.
    """
    last = beats.groupBy("job_id").agg(F.max("ts").alias("last_ts"), F.bool_or("terminal").alias("finished"))
    overdue = F.unix_micros(as_of) - F.unix_micros("last_ts") > limit_seconds * 1_000_000
    return last.select(
        "job_id", "last_ts",
        F.when(F.col("finished"), "finished").when(overdue, "failed").otherwise("running").alias("status"),
    )


#: What a row in the state of the silence stream is: a beat that waits, or where a job stands and its last beat.
BEAT, LAST_BEAT, RUNNING, FINISHED, FAILED = range(5)
_SILENCE = ["job_id", "no_id", "at", "kind"]


def _watcher(limit_seconds: int):
    limit = limit_seconds * 1_000_000_000

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = [reorder._unpacked(state.get[0])] if state.exists else []
        if not state.hasTimedOut:
            for pdf in batches:
                pdf = pdf.dropna(subset=["ts"])
                at, kind = pdf["ts"].astype("datetime64[ns]").astype("int64"), pdf["terminal"].astype("int8")
                frames.append(pdf.assign(at=at, kind=kind)[_SILENCE])
        watermark = state.getCurrentWatermarkMs()
        rows = pd.concat(frames, ignore_index=True)
        due = (rows["kind"] >= RUNNING) | (rows["at"] <= max(watermark, 0) * 1_000_000)
        waits, rows = rows[~due], rows[due]
        job, none, at, kind = (rows[c].to_numpy() for c in _SILENCE)
        # Where a job stands comes before its beats, and those by time.
        order = np.lexsort((kind, at, kind < RUNNING, none, job))
        job, none, at, kind = job[order], none[order], at[order], kind[order]
        first = np.ones(len(job), bool)
        first[1:] = (job[1:] != job[:-1]) | (none[1:] != none[:-1])
        start = np.flatnonzero(first)
        of = np.cumsum(first) - 1
        status = np.maximum(kind[start], RUNNING)
        judged = status > RUNNING
        last = np.where(judged, at[start], at[np.append(start[1:], len(at)) - 1]) if len(start) else at[:0]
        silence = ~first
        silence[1:] &= at[1:] - at[:-1] > limit
        ends = np.flatnonzero((silence | (kind == LAST_BEAT)) & ~judged[of])
        decided, which = np.unique(of[ends], return_index=True)
        ends = ends[which]
        status[decided] = np.where(silence[ends], FAILED, FINISHED)
        last[decided] = at[ends - silence[ends]]
        over = (last + limit) // 1_000_000
        status[(status == RUNNING) & (over < watermark)] = FAILED
        told = (status > RUNNING) & ~judged
        # A verdict is remembered for a while, so that a straggler does not get the job another one.
        wake = np.where(status > RUNNING, over + REMEMBER_MS, over)
        keep = wake >= watermark
        job, none = job[start], none[start]
        kept = pd.concat([waits, pd.DataFrame(dict(zip(_SILENCE, (job[keep], none[keep], last[keep], status[keep]), strict=True)))], ignore_index=True)
        if kept.empty:
            if state.exists:
                state.remove()
        else:
            state.update((reorder._packed(kept),))
            calls = [*wake[keep].tolist(), *(-(-waits["at"] // 1_000_000)).tolist()]
            state.setTimeoutTimestamp(max(min(calls), watermark + 1))
        if told.any():
            yield pd.DataFrame({
                "job_id": pd.Series(job[told], dtype="Int64").mask(none[told]), "status": np.where(status[told] == FAILED, "failed", "finished"),
                "last_ts": last[told].astype("datetime64[ns]"),
            })

    return watch


#: How long a stream remembers the verdict on a job: 30 days.
REMEMBER_MS = 30 * 24 * 3600 * 1000


def silent_stream(beats: DataFrame, limit_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Finished and silent jobs from a stream of ``job_id ts terminal``; running ones stay in state.

    Beats are taken in time order, whatever their order of arrival within ``late``. The first terminal beat or the first
    silence longer than the limit decides, once per job; what follows it is ignored for 30 days. Rows with a null
    ``terminal`` are beats like any other. Rows of state hold many jobs (``BUCKETS``), and are judged in arrays.
    """
    dealt = beats.withWatermark("ts", late).select(
        F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).alias("bucket"), F.coalesce(F.col("job_id").cast("long"), F.lit(0)).alias("job_id"),
        F.col("job_id").isNull().alias("no_id"), "ts", F.coalesce("terminal", F.lit(False)).alias("terminal"),
    )
    return dealt.groupBy("bucket").applyInPandasWithState(
        _watcher(limit_seconds), "job_id bigint, status string, last_ts timestamp", "held binary", "append", GroupStateTimeout.EventTimeTimeout,
    )
