"""Machine presence per project from periodic listings: ready, absent, or taken away.

A machine running in one poll and gone in the next was preempted unless its teardown was asked
for. The name stays until acknowledged. A teardown request is used up only when the project
has no running machine left, so a slow delete does not hide a later preemption.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from facetlake.streaming import reorder

OUT = "project bigint, poll_ts timestamp, running bigint, preempted string, presence string"
#: A project without events for so long is forgotten.
KEEP = pd.Timedelta(days=30)
STATE = "running array<string>, teardown boolean, preempted string, last_ts timestamp"


def poll_times(polls: DataFrame, every: str = "1 hour") -> DataFrame:
    """The regular poll grid of each project, from its first to its last listing."""
    span = polls.groupBy("project").agg(F.min("poll_ts").alias("a"), F.max("poll_ts").alias("b"))
    return span.select("project", F.explode(F.expr(f"sequence(a, b, INTERVAL {every})")).alias("poll_ts"))


def vanished(polls: DataFrame, times: DataFrame) -> DataFrame:
    """Machines running in a poll and absent from the next: ``project poll_ts name`` of the later poll."""
    following = Window.partitionBy("project").orderBy("poll_ts")
    steps = times.withColumn("next_ts", F.lead("poll_ts").over(following)).filter("next_ts IS NOT NULL")
    expected = polls.join(steps, ["project", "poll_ts"]).select("project", F.col("next_ts").alias("poll_ts"), "name")
    return expected.join(polls.select("project", "poll_ts", "name"), ["project", "poll_ts", "name"], "left_anti")


def presence(polls: DataFrame, times: DataFrame, teardowns: DataFrame, acks: DataFrame | None = None,
             every_seconds: int = 3600) -> DataFrame:
    """State of every project at every poll.

    ``polls``: ``project poll_ts name`` of running machines; ``times``: ``project poll_ts`` of all
    polls, on a regular grid; ``teardowns``/``acks``: ``project request_ts``. Windows run over the polls of a
    project, one row each; machines and requests are aggregated to polls before that.
    """

    def at_poll(requests: DataFrame, name: str) -> DataFrame:
        up = F.timestamp_seconds(F.ceil(F.unix_micros("request_ts") / (1e6 * every_seconds)) * every_seconds)
        return requests.select("project", up.alias("poll_ts")).distinct().withColumn(name, F.lit(True))

    counts = polls.groupBy("project", "poll_ts").agg(F.count("*").alias("running"))
    gone = vanished(polls, times).groupBy("project", "poll_ts").agg(F.max("name").alias("gone"))
    rows = (
        times.join(counts, ["project", "poll_ts"], "left")
        .join(gone, ["project", "poll_ts"], "left")
        .join(at_poll(teardowns, "asked"), ["project", "poll_ts"], "left")
        .withColumn("running", F.coalesce("running", F.lit(0)))
    )
    rows = rows.join(at_poll(acks, "acked"), ["project", "poll_ts"], "left") if acks is not None else rows.withColumn(
        "acked", F.lit(None).cast("boolean")
    )
    w = Window.partitionBy("project").orderBy("poll_ts")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    cleared = F.when((F.col("running") == 0) & (F.lag("running").over(w) > 0), F.col("poll_ts"))
    rows = rows.withColumn("_clear", cleared).withColumns(
        {
            "_asked": F.max(F.when(F.col("asked"), F.col("poll_ts"))).over(upto),
            "_cleared": F.max("_clear").over(before),
        }
    )
    expected = F.col("_asked").isNotNull() & (F.col("_cleared").isNull() | (F.col("_asked") > F.col("_cleared")))
    # An acknowledgement acts before the poll it precedes; a new disappearance overrides it.
    mark = F.when(F.col("gone").isNotNull() & ~expected, F.col("gone")).when(F.col("acked"), F.lit(""))
    rows = rows.withColumn("_mark", mark).withColumn(
        "preempted", F.nullif(F.last("_mark", ignorenulls=True).over(upto), F.lit(""))
    )
    state = F.when(F.col("running") > 0, "ready").when(F.col("preempted").isNotNull(), "preempted").otherwise("absent")
    return rows.select("project", "poll_ts", F.col("running").cast("bigint").alias("running"), "preempted", state.alias("presence"))


def events(polls: DataFrame, times: DataFrame, teardowns: DataFrame) -> DataFrame:
    """One event per poll (with the names running) and per teardown request, the stream's input."""
    named = polls.groupBy("project", "poll_ts").agg(F.array_sort(F.collect_set("name")).alias("running"))
    listing = times.join(named, ["project", "poll_ts"], "left").select(
        "project", F.col("poll_ts").alias("ts"), F.lit("poll").alias("kind"),
        F.coalesce("running", F.array().cast("array<string>")).alias("running"),
    )
    asked = teardowns.select(
        "project", F.col("request_ts").alias("ts"), F.lit("teardown").alias("kind"),
        F.array().cast("array<string>").alias("running"),
    )
    return listing.unionByName(asked)


@reorder.keeps(4)
def _advance(key: tuple, due: pd.DataFrame, kept: tuple | None, watermark: int) -> tuple[pd.DataFrame | None, tuple | None, int | None]:
    """Fold the due events of one project into its state."""
    names, teardown, preempted, last_ts = kept or ([], False, None, None)
    running, out = set(names), []
    for row in due.itertuples(index=False):
        last_ts = row.ts
        if row.kind == "teardown":
            teardown = True
        elif row.kind == "ack":
            preempted = None
        elif row.kind == "poll":
            seen = set(row.running)
            lost = running - seen
            if lost and not teardown:
                preempted = max(lost)
            if teardown and running and not seen:
                teardown = False
            running = seen
            out.append((key[0], row.ts, len(seen), preempted, "ready" if seen else "preempted" if preempted else "absent"))
    if last_ts is None:
        return None, None, None
    forget = int((last_ts + KEEP).timestamp() * 1000)
    if forget < watermark:
        return pd.DataFrame(out, columns=_COLUMNS), None, None
    return pd.DataFrame(out, columns=_COLUMNS), (sorted(running), teardown, preempted, last_ts), forget


_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def presence_stream(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """The same states from a stream of ``project ts kind running``; kinds are poll, teardown and ack, and any other only moves time.

    Events may arrive in any order within ``late``: a project's events wait until the watermark has passed them, so a poll is
    reported that much later. What comes later still is dropped and counted by Spark. A project without
    events for ``KEEP`` is forgotten.
    """
    # Requests count from the poll at or after them, so they go first at equal times.
    ranked = stream.withColumn("rank", F.when(F.col("kind") == "poll", 1).otherwise(0))
    return (
        ranked.withWatermark("ts", late)
        .groupBy("project")
        .applyInPandasWithState(reorder.in_order(_advance, "ts", ["ts", "rank"]), OUT, f"{reorder.HELD}, {STATE}", "append", GroupStateTimeout.EventTimeTimeout)
    )
