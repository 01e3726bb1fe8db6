"""Long passages of job logs that an earlier log has already, removed by relative Lempel-Ziv parsing.

Every log is factored against the blocks of all logs with smaller ids. A block is the stretch of words
around an anchor: of each window of consecutive words the anchor is the stretch of ``HALF`` words with the smallest
hash, so equal windows have the same anchor at the same place, wherever they stand. Windows in a row that
share an anchor make a block, and the index of blocks is dealt out by anchor and content.

1. A log takes whole blocks first: one that an earlier log has word for word is a factor.
2. Factor boundaries are checked next. Where an anchor stands in several different blocks, one log
   of each content sends its windows, and those that an earlier log has become factors too.
3. Factors of a log are laid over its words; what they cover is a duplicate span.

Only anchors (about two in 27 words) and the windows at boundaries are shuffled. Counts are combined in the
tasks before they meet, so a passage that a third of all logs share is a few rows per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.llm.words import Running, grams, slices, words
from facetlake.session import materialize

WINDOW = 50
#: Blocks whose windows a task lists at a time.
_BLOCKS = 20_000
_LOW32 = np.uint64(0xFFFFFFFF)


def _anchors(found, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and anchor of every window, the row it is in, and the hashes of anchor stretches."""
    half = window // 2
    kept = grams(found.hash, half, 17)
    starts = np.arange(len(found.hash))
    windows = starts[starts + window <= found.first[found.row + 1]]
    if not len(windows):
        return windows, windows, windows, kept
    # The position in the low bits settles ties to the left and tells where the smallest stands.
    key = (kept & ~_LOW32) | np.arange(len(kept), dtype=np.uint64)
    need, reach = window - half + 1, 1
    while reach < need:
        step = min(reach, need - reach)
        key = np.minimum(key[: len(key) - step], key[step:])
        reach += step
    anchor = (key[windows] & _LOW32).astype(np.int64)
    return windows, anchor, found.row[windows], kept


def _blocks(logs: DataFrame, window: int) -> DataFrame:
    """Blocks of every log: anchor hash, content hash, first window and number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "log"):
                found = words(data, off)
                windows, anchor, row, kept = _anchors(found, window)
                if not len(windows):
                    continue
                new = np.append(True, (np.diff(anchor) != 0) | (np.diff(row) != 0))
                at = np.flatnonzero(new)
                n = np.diff(np.append(at, len(windows)))
                first = windows[at]
                content = Running(found.hash, 23).of(first, first + n + window - 1) ^ (anchor[at] - first).astype(np.uint64)
                owner = row[at]
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(kept[anchor[at]].view(np.int64)), pa.array(content.view(np.int64)),
                        part.column("job_id").take(take), part.column("log_key").take(take),
                        pa.array((first - found.first[owner]).astype(np.int32)), pa.array(n.astype(np.int32)),
                    ],
                    ["anchor", "content", "job_id", "log_key", "first", "n"],
                )

    return logs.mapInArrow(run, "anchor long, content long, job_id long, log_key long, first int, n int")


def _windows(logs: DataFrame, window: int) -> DataFrame:
    """Windows of the blocks listed in ``blocks`` of each log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "log"):
                found = words(data, off)
                running = Running(found.hash, 29)
                asked = part.column("blocks")
                blocks = asked.flatten()
                anchor, content, first, n = (blocks.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("anchor", "content", "first", "n"))
                row = np.repeat(np.arange(part.num_rows), asked.value_lengths().to_numpy(zero_copy_only=False))
                for lo in range(0, len(n), _BLOCKS):
                    some = slice(lo, lo + _BLOCKS)
                    each = np.repeat(np.arange(len(n))[some], n[some])
                    inside = np.arange(len(each)) - np.repeat(np.cumsum(n[some]) - n[some], n[some])
                    place = found.first[row[each]] + first[each] + inside
                    hashed = running.of(place, place + window)
                    owner = part.column("job_id").take(pa.array(row[each]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor[each]), pa.array(content[each]), pa.array(hashed.view(np.int64)), owner, pa.array(inside.astype(np.int32))],
                        ["anchor", "content", "hash", "job_id", "inside"],
                    )

    return logs.mapInArrow(run, "anchor long, content long, hash long, job_id long, inside int")


def repeated_factors(logs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Windows of each log that an earlier log has: ``job_id log_key first n source``.

    ``n`` windows in a row start at word ``first``; ``source`` is the smallest id of a log that has them.
    """
    keyed = logs.filter("job_id is not null").select(F.col("job_id").cast("long").alias("job_id"), "log", F.xxhash64("log").alias("log_key"))
    blocks = materialize(_blocks(keyed, window), "blocks")
    # One row per block content, with the first log that has it and a place in that log.
    contents = blocks.groupBy("anchor", "content").agg(F.min(F.struct("job_id", "log_key", "first", "n")).alias("b"), F.max("job_id").alias("last"))
    contents = materialize(contents.select("anchor", "content", "b.*", "last"), "contents")
    known = contents.filter("last > job_id").select("anchor", "content", F.col("job_id").alias("source"), F.lit(None).cast("array<struct<inside:int,source:long>>").alias("windows"))
    # Boundaries: an anchor in blocks of different content and of different logs.
    several = contents.groupBy("anchor").agg(F.min("job_id").alias("lo"), F.max("job_id").alias("hi")).filter("lo < hi").select("anchor")
    asked = contents.join(several, "anchor").groupBy("job_id", "log_key").agg(F.collect_list(F.struct("anchor", "content", "first", "n")).alias("blocks"))
    edges = materialize(_windows(keyed.join(asked, ["job_id", "log_key"]), window), "edges")
    earliest = edges.groupBy("anchor", "hash").agg(F.min("job_id").alias("source"), F.max("job_id").alias("last")).filter("last > source").drop("last")
    early = edges.join(earliest, ["anchor", "hash"]).filter("job_id > source")
    listed = early.groupBy("anchor", "content", "job_id").agg(F.collect_list(F.struct("inside", "source")).alias("windows"))
    # A later log takes a whole block; the first log that has a block takes its windows one by one.
    index = known.unionByName(listed.select("anchor", "content", F.col("job_id").alias("source"), "windows"))
    hit = blocks.join(index, ["anchor", "content"]).filter(F.when(F.col("windows").isNull(), F.col("job_id") > F.col("source")).otherwise(F.col("job_id") == F.col("source")))
    one = F.struct(F.lit(0).alias("inside"), "source", "n")
    each = F.transform("windows", lambda w: F.struct(w["inside"].alias("inside"), w["source"].alias("source"), F.lit(1).alias("n")))
    return hit.select("job_id", "log_key", "first", F.explode(F.coalesce(each, F.array(one))).alias("f")).select(
        "job_id", "log_key", (F.col("first") + F.col("f.inside")).alias("first"), "f.n", "f.source"
    )


def remove_repeats(logs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Take out what an earlier log has said in at least ``window`` words.

    Args:
        logs: ``job_id`` (long) and ``log``; further columns are left out.
        window: so many consecutive words that also start in a log with a smaller id are a duplicate. All
            windows are judged on the logs as they came.

    Returns:
        ``job_id``, ``n_words``, ``n_removed``, ``kept`` (the words that stay, joined by one space),
        ``kept_sha256``, ``spans`` (first word, end and smallest source of each removed stretch).

    Words are runs of anything but space, tab and line ends, unchanged. Null logs have no words. Logs with a null
    id have no place in the order: they keep all words and are no source. Rows that repeat an id never are
    each other's source and stay repeated. An empty table gives an empty result. Windows are compared by
    two 64-bit hashes of their words.
    """
    found = repeated_factors(logs, window).groupBy("job_id", "log_key").agg(F.collect_list(F.struct("first", "n", "source")).alias("factors"))
    keyed = logs.select(F.col("job_id").cast("long").alias("job_id"), "log", F.xxhash64("log").alias("log_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = []
                for text, factors in zip(part.column("log"), part.column("factors"), strict=True):
                    found = (text.as_py() or "").encode().split()
                    spans = _laid(factors.as_py() or [], window)
                    kept, at = [], 0
                    for first, end, _ in spans:
                        kept += found[at:first]
                        at = end
                    joined = b" ".join(kept + found[at:])
                    rows.append((len(found), sum(b - a for a, b, _ in spans), joined.decode(), hashlib.sha256(joined).hexdigest(), [{"start": a, "end": b, "source": s} for a, b, s in spans]))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column("job_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), _SPANS), strict=True))],
                    ["job_id", "n_words", "n_removed", "kept", "kept_sha256", "spans"],
                )

    return keyed.join(found, ["job_id", "log_key"], "left").select("job_id", "log", "factors").mapInArrow(
        run, "job_id long, n_words long, n_removed long, kept string, kept_sha256 string, spans array<struct<start:int,end:int,source:long>>"
    )


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64())]))


def _laid(factors: list[dict], window: int) -> list[tuple[int, int, int]]:
    """Covered stretches from left to right, with the smallest source of each."""
    out: list[list[int]] = []
    for f in sorted(factors, key=lambda f: f["first"]):
        end = f["first"] + f["n"] + window - 1
        if out and f["first"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2] = min(out[-1][2], f["source"])
        else:
            out.append([f["first"], end, f["source"]])
    return [(a, b, s) for a, b, s in out]
