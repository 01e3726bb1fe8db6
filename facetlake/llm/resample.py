"""Job logs drawn by importance, so that the draw reads like a set of target texts.

Hashed n-gram features give two histograms, of all logs and of the target texts; the logarithm of their
ratio is the gain of a bucket. A log's weight is the mean gain of its features, looked up in one array, and a
Gumbel number of its id turns the best scores into a draw without replacement.

The draw is exact and sorts winners only. The score of the last winner, the cutoff, is found by weighted median of
medians: every task gives the median of its remaining rows with their number, the weighted median of those is
the pivot, and all rows on the wrong side of it go, at least an eighth a round. What remains is stored anew
whenever it has shrunk to a quarter, so all rounds together read a fixed multiple of the scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetlake.llm.words import ALNUM
from facetlake.operators.ordering import positions
from facetlake.session import materialize

BUCKETS = 10_000
#: Features are runs of 1 to so many words.
LONGEST = 1
#: Logs of fewer words are not drawn.
LEAST_WORDS = 20
#: So many of a hundred logs are drawn.
PERCENT = 10
SEED = "2024"
#: Rows whose median a task takes at a time.
BLOCK = 1 << 18
#: From so few remaining keys on they are looked at one by one.
LAST = 1 << 12
#: Distinct features that a task remembers.
REMEMBERED = 200_000
#: Bytes of a text that are cut into words at a time.
STEP = 1 << 20

#: Lower case, and a space for every byte that is in no word.
_PLAIN = bytes((b + 32 if 65 <= b <= 90 else b) if ALNUM[b] else 32 for b in range(256))


def features(text: bytes, longest: int = LONGEST, step: int = STEP) -> Iterator[tuple[int, list[bytes]]]:
    """Parts of a text: how many words begin there, and the features that end there.

    Words are digits, ASCII letters and all beyond ASCII, lower-cased (A-Z). A long text is cut between words.
    """
    held: list[bytes] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + step)
        while end < len(text) and ALNUM[text[end - 1]] and ALNUM[text[end]]:
            far = end
            end = min(len(text), end + step)
            # The first byte after the cut that is in no word.
            blank = text[far:end].translate(_PLAIN).find(b" ")
            end = far + blank if blank >= 0 else end
        words = text[at:end].translate(_PLAIN).split()
        found = list(words)
        for n in range(2, longest + 1):
            line = held[len(held) - (n - 1) :] + words if len(held) >= n - 1 else held + words
            found += [b" ".join(line[i : i + n]) for i in range(len(line) - n + 1)]
        yield len(words), found
        held = (held + words)[-(longest - 1) :] if longest > 1 else []
        at = end


class _Buckets(dict):
    """Bucket of each feature, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[feature] = bucket = zlib.crc32(feature) % self.buckets
        return bucket

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int64, len(found))


def histogram(texts: DataFrame, column: str, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts fall into each bucket; the driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in features(text.as_py() or b"", longest):
                    total += np.bincount(bucket.of(found), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    told = texts.select(F.col(column).cast("binary").alias("t")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for row in told.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(everything: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the smoothed log ratio of target to all, rounded down."""
    s, t, n = everything.astype(float), target.astype(float), float(len(everything))
    return np.floor(1000.0 * np.log((t + 1.0) * (s.sum() + n) / ((s + 1.0) * (t.sum() + n)))).astype(np.int64)


def _weighed(logs: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """``job_id n_words n_features weight`` of every log."""
    table = gains

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Buckets(len(table))
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for row, text in enumerate(batch.column(1)):
                for words, found in features(text.as_py() or b"", longest):
                    out[:, row] += (words, len(found), table[bucket.of(found)].sum())
            mean = np.where(out[1] > 0, out[2] // np.maximum(out[1], 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0]), pa.array(out[1]), pa.array(mean)], ["job_id", "n_words", "n_features", "weight"])

    read = logs.select(F.col("job_id").cast("long").alias("job_id"), F.col("log").cast("binary").alias("t"))
    return read.mapInArrow(run, "job_id long, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: str) -> Column:
    """1000 times a standard Gumbel number of a key, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


# ---- the cutoff ------------------------------------------------------------------------------------------


def _beyond(keys: Sequence[str], bound: Sequence[int] | None, otherwise: bool) -> Column:
    """Whether a row's key is greater than the bound."""
    if bound is None:
        return F.lit(otherwise)
    out = F.lit(False)
    for name, value in reversed(list(zip(keys, bound, strict=True))):
        out = (F.col(name) > value) | ((F.col(name) == value) & out)
    return out


def _after(block: np.ndarray, bound: Sequence[int]) -> np.ndarray:
    """The same for the rows of an array with a column per key."""
    out = np.zeros(block.shape[1], bool)
    for values, value in zip(block[::-1], reversed(list(bound)), strict=True):
        out = (values > value) | ((values == value) & out)
    return out


def weighted_median(medians: list[tuple[tuple[int, ...], int]]) -> tuple[tuple[int, ...], int]:
    """The least key that, with all below it, has half of the weight; and the whole weight."""
    total, upto = sum(w for _, w in medians), 0
    for key, weight in sorted(medians):
        upto += weight
        if 2 * upto >= total:
            return key, total
    raise ValueError("no rows")


def _round(rows: DataFrame, keys: Sequence[str], pivot: Sequence[int] | None) -> dict[bool, list[tuple[tuple[int, ...], int]]]:
    """Median and number of the rows of each task, up to the pivot (False) and beyond it (True)."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        medians: dict[bool, list] = {False: [], True: []}

        def take(held: list[np.ndarray]) -> None:
            block = np.concatenate(held, axis=1)
            far = _after(block, pivot) if pivot is not None else np.zeros(block.shape[1], bool)
            for side in (False, True):
                part = block[:, far == side]
                if part.shape[1]:
                    middle = np.lexsort(part[::-1])[(part.shape[1] - 1) // 2]
                    medians[side].append((tuple(int(v) for v in part[:, middle]), part.shape[1]))

        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in part.columns]))
                size += part.num_rows
                if size >= BLOCK:
                    take(held)
                    held, size = [], 0
        if size:
            take(held)
        out = [(side, *weighted_median(found)) for side, found in medians.items() if found]
        columns = [[s for s, _, _ in out], [w for _, _, w in out], *[[k[i] for _, k, _ in out] for i in range(n)]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.bool_()), *[pa.array(c, pa.int64()) for c in columns[1:]]], ["side", "n", *keys])

    told: dict[bool, list] = {False: [], True: []}
    for row in rows.select(*keys).mapInArrow(run, ", ".join(["side boolean", "n long", *[f"{k} long" for k in keys]])).collect():
        told[row.side].append((tuple(row[k] for k in keys), row.n))
    return told


def cutoff(rows: DataFrame, keys: Sequence[str], wanted: int) -> tuple[int, ...] | None:
    """The ``wanted``-th smallest of the keys, which are distinct; None for none or all of the rows.

    ``rows`` is a stored table with long columns, none null. The driver gets one row per task a round, and the keys
    themselves only when no more than ``LAST`` of them remain.
    """
    low = high = None
    medians = _round(rows, keys, None)[False]
    remaining = stored = sum(n for _, n in medians)
    if wanted <= 0 or wanted >= remaining:
        return None
    while remaining > LAST:
        pivot, _ = weighted_median(medians)
        told = _round(rows.filter(_beyond(keys, low, True) & ~_beyond(keys, high, False)), keys, pivot)
        below = sum(n for _, n in told[False])
        if wanted == below:
            return pivot
        if wanted < below:
            high, medians, remaining = pivot, told[False], below
        else:
            low, medians, remaining, wanted = pivot, told[True], remaining - below, wanted - below
        if remaining * 4 <= stored:
            rows = materialize(rows.filter(_beyond(keys, low, True) & ~_beyond(keys, high, False)), "remaining")
            stored, low, high = remaining, None, None
    left = rows.filter(_beyond(keys, low, True) & ~_beyond(keys, high, False)).select(*keys).collect()
    return sorted(tuple(r) for r in left)[wanted - 1]


# ---- all together --------------------------------------------------------------------------------------------


def resample_logs(
    logs: DataFrame, targets: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS, longest: int = LONGEST, seed: str = SEED,
) -> DataFrame:
    """Draw job logs so that the draw's features are spread as those of the target texts.

    Args:
        logs: ``job_id`` (long) and ``log``; further columns are left out.
        targets: ``log`` of the texts to be like, such as the logs of accepted jobs.
        percent: how many of a hundred logs with at least ``least_words`` words are drawn, rounded down.
        longest: features are runs of 1 to so many words, repeats counted.

    Returns:
        Every log's ``job_id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (1, 2, 3 and so on from the
        highest score down; null if not drawn).

    Null logs have no words, and a log without words has weight 0. Ties go to the smaller id, null ids last, then to more
    features; a row repeated in all of these counts as often as it is there, each with a rank of its own. The number of a null
    id is that of an empty one. Without targets all gains come from the logs alone; an empty table gives an empty
    result.
    """
    gains = bucket_gains(histogram(logs, "log", buckets, longest), histogram(targets, "log", buckets, longest))
    weighed = _weighed(logs, gains, longest)
    scored = weighed.withColumn("score", F.col("weight") + gumbel(F.col("job_id"), seed))
    keys = ["_score", "_no_id", "_id", "_features", "_copy"]
    keyed = scored.select(
        "*", (-F.col("score")).alias("_score"), F.col("job_id").isNull().cast("long").alias("_no_id"), F.coalesce("job_id", F.lit(0)).alias("_id"),
        (-F.col("n_features")).alias("_features"), F.monotonically_increasing_id().alias("_copy"),
    )
    keyed = materialize(keyed, "scores")
    fit = F.col("n_words") >= least_words
    number = keyed.filter(fit).count()
    wanted = percent * number // 100
    last = cutoff(keyed.filter(fit), keys, wanted)
    drawn = fit & (F.lit(wanted > 0) if last is None else ~_beyond(keys, last, False))
    winners = positions(keyed.filter(drawn), [], keys, "rank").withColumn("rank", F.col("rank") + 1)
    others = keyed.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    columns = ["job_id", "n_words", "n_features", "weight", "score", "rank"]
    return winners.select(*columns).unionByName(others.select(*columns))
