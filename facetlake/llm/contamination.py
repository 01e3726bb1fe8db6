"""Logs that contain passages of evaluation items, found with suffix arrays over the logs.

Every slice of logs is one shard. A shard's words become numbers of the items' vocabulary, and
its suffix array lists the places at which some item could start to match, in the order of the words
that follow. Each item suffix is looked up by two binary searches, which give all places of
its first 13 words at once; the match is then followed to its end. Logs are whole inside a shard,
so shards need no exchange. Items are the stated query set: they are read in blocks of a fixed
number, each block over all shards, and only the slim results of the blocks are combined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.llm.words import ALNUM, slices, words
from facetlake.session import materialize

WINDOW = 13
#: Items per block; a block is what is sent to the tasks at a time.
BLOCK_ITEMS = 20_000


def item_words(text: str | None) -> list[bytes]:
    """Lower-cased words of one item: digits, ASCII letters and characters beyond ASCII."""
    data = (text or "").encode()
    lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    return bytes(b if ALNUM[b] else 32 for b in lowered).split()


class Items:
    """One block of items: vocabulary, all item suffixes as rows of word numbers, and windows."""

    def __init__(self, rows: list[tuple[str, list[bytes]]], window: int = WINDOW):
        rows = [(i, w) for i, w in rows if w]
        vocabulary = sorted({w for _, ws in rows for w in ws})
        number = {w: k + 1 for k, w in enumerate(vocabulary)}
        hashed = _hash_of(vocabulary)
        order = np.argsort(hashed)
        self.hashes, self.numbers = hashed[order], (order + 1).astype(np.int64)
        suffixes: dict[tuple[int, ...], set[str]] = {}
        follow: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        for item, ws in rows:
            ids = tuple(number[w] for w in ws)
            for at in range(max(1, len(ids) - window + 1)):
                key = ids[at : at + window]
                suffixes.setdefault(key, set()).add(item)
                follow.setdefault(key, []).append(ids[at + window :])
        self.windows = sorted(suffixes)
        self.items = [sorted(suffixes[w]) for w in self.windows]
        self.tails = [sorted(set(follow[w])) for w in self.windows]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.width = int(self.length.max()) if rows else 0
        self.least = int(self.length.min()) if rows else 0
        self.table = np.zeros((len(self.windows), self.width), np.int64)
        for r, w in enumerate(self.windows):
            self.table[r, : len(w)] = w
        self.size = len(vocabulary) + 2
        self.spread = self.size * self.size < 1 << 62
        pairs = {w[:2] for w in self.windows if len(w) > 1}
        self.pairs = np.array(sorted(a * self.size + b for a, b in pairs), np.int64)
        self.single = np.array(sorted({w[0] for w in self.windows if len(w) == 1}), np.int64)


def _hash_of(vocabulary: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(vocabulary), np.uint8)
    return words(data, np.array([0, len(data)]), ALNUM).hash


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


class Shard:
    """The suffix array of one slice of logs.

    ``places`` are the word positions from which an item could start, sorted by the ``width`` words
    that follow; a position whose first two words start no item cannot start a match and is left out.
    """

    def __init__(self, ids: np.ndarray, left: np.ndarray, items: Items):
        nxt = np.append(ids[1:], 0)
        nxt[left < 2] = 0
        places = np.flatnonzero(ids)
        keep = _member(ids[places] * items.size + nxt[places], items.pairs) | _member(ids[places], items.single)
        self.places = places[keep]
        self.ids, self.left = ids, left
        columns = [self.word(self.places, k) for k in range(items.width)]
        if len(self.places):
            order = np.lexsort(columns[::-1])
            self.places, columns = self.places[order], [c[order] for c in columns]
        self.columns = columns

    def word(self, at: np.ndarray, k: int) -> np.ndarray:
        """The ``k``-th word after each position; 0 beyond the end of the log."""
        inside = self.left[at] > k
        out = np.zeros(len(at), np.int64)
        out[inside] = self.ids[at[inside] + k]
        return out

    def find(self, table: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
        """For each row, how many suffixes sort before it, or up to all those it is a prefix of."""
        lo, hi = np.zeros(len(table), np.int64), np.full(len(table), len(self.places), np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi) // 2
            less, same = np.zeros(len(table), bool), open_.copy()
            for k, column in enumerate(self.columns):
                live = same & (length > k)
                value = np.where(live, column[np.minimum(mid, len(self.places) - 1)], 0)
                less |= live & (value < table[:, k])
                same &= ~live | (value == table[:, k])
            go = open_ & (less | (same if after else False))
            lo, hi = np.where(go, mid + 1, lo), np.where(open_ & ~go, mid, hi)
        return lo


def _search(items: Items, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[list[str]], np.ndarray]:
    """Words per log, hit word positions per log, items per log and longest match per log."""
    found = words(data, off, ALNUM, lower=True)
    rows = len(off) - 1
    n_words = np.diff(found.first)
    hits: list[np.ndarray] = [np.zeros(0, np.int64)] * rows
    named: list[list[str]] = [[] for _ in range(rows)]
    longest = np.zeros(rows, np.int64)
    if not items.windows or not len(found.hash):
        return n_words, hits, named, longest
    ids = np.zeros(len(found.hash), np.int64)
    at = np.minimum(np.searchsorted(items.hashes, found.hash), len(items.hashes) - 1)
    known = items.hashes[at] == found.hash
    ids[known] = items.numbers[at[known]]
    left = found.first[found.row + 1] - np.arange(len(ids))
    shard = Shard(ids, left, items)
    if not len(shard.places):
        return n_words, hits, named, longest
    lo = shard.find(items.table, items.length, False)
    hi = shard.find(items.table, items.length, True)
    mark = np.zeros(len(ids) + 1, np.int64)
    names: list[set[str]] = [set() for _ in range(rows)]
    for w in np.flatnonzero(hi > lo):
        places = shard.places[lo[w] : hi[w]]
        np.add.at(mark, places, 1)
        np.add.at(mark, places + items.length[w], -1)
        for r in np.unique(found.row[places]):
            names[r].update(items.items[w])
        for tail in items.tails[w]:
            reach, live = np.full(len(places), items.length[w]), np.ones(len(places), bool)
            for step, word in enumerate(tail):
                live &= shard.word(places, int(items.length[w]) + step) == word
                if not live.any():
                    break
                reach += live
            np.maximum.at(longest, found.row[places], reach)
    covered = np.cumsum(mark)[:-1] > 0
    where = np.flatnonzero(covered)
    for r in np.unique(found.row[where]):
        hits[r] = where[found.row[where] == r] - found.first[r] if len(names[r]) else hits[r]
        named[r] = sorted(names[r])
    return n_words, hits, named, longest


def contaminated_logs(logs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Where item passages stand in the logs, and which logs are contaminated.

    The project has no evaluation sets of its own; the operator takes any. Words are
    lower-cased (A-Z) runs of digits, ASCII letters and characters beyond ASCII.
    A window is ``window`` consecutive words of an item; a shorter item is one window. A log word
    inside any occurrence of a window is hit.

    Args:
        logs: ``job_id`` (long), ``log``; further columns are left out.
        items: ``item_id``, ``text``; null ids, null texts and texts without words match nothing.
        share: a log is contaminated if ``share`` times its hit words reach its words.
        block_items: items sent to the tasks at a time.

    Returns:
        ``job_id``, ``log_key`` (hash of the log), ``n_words``, ``n_hit``, ``n_items``, ``items`` (ids as sorted strings),
        ``items_sha256``, ``longest`` (words of the longest verbatim match from a window on),
        ``spans`` (first word and end of every hit stretch), ``contaminated``.

    Null and empty logs have no words and are clean. Repeated rows stay repeated; empty tables
    are allowed on either side. A long log is never split, so nothing is lost at a shard's edge.
    """
    numbered = logs.select(F.col("job_id").cast("long").alias("job_id"), "log", F.xxhash64("log").alias("log_key"))
    listed = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null")
    blocks = max(1, -(-listed.count() // block_items))
    parts = []
    for block in range(blocks):
        chosen = listed if blocks == 1 else listed.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        index = Items([(r.item_id, item_words(r.text)) for r in chosen.toLocalIterator()], window)
        parts.append(_one_block(numbered, index))
    joined = parts[0] if len(parts) == 1 else _combine(parts)
    clean = F.col("items")
    return joined.select(
        "job_id", "log_key", "n_words", "n_hit", F.size(clean).cast("long").alias("n_items"), "items",
        F.sha2(F.array_join(clean, ","), 256).alias("items_sha256"), "longest", "spans",
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"),
    )


def clean_logs(logs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The logs that are not contaminated, with all of their columns; see ``contaminated_logs``."""
    bad = contaminated_logs(logs, items, **options).filter("contaminated").select("job_id", "log_key").distinct()
    same = logs["job_id"].eqNullSafe(bad["job_id"]) & (F.xxhash64(logs["log"]) == bad["log_key"])
    return logs.join(bad, same, "left_anti")


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SCHEMA = "job_id long, log_key long, n_words long, n_hit long, items array<string>, longest long, spans array<struct<start:int,end:int>>"


def _spans(hits: np.ndarray) -> list[dict[str, int]]:
    if not len(hits):
        return []
    cut = np.flatnonzero(np.diff(hits) > 1)
    return [{"start": int(a), "end": int(b) + 1} for a, b in zip(hits[np.append(0, cut + 1)], hits[np.append(cut, len(hits) - 1)], strict=True)]


def _one_block(logs: DataFrame, index: Items) -> DataFrame:
    shipped = logs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "log"):
                n_words, hits, named, longest = _search(shipped.value, data, off)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("job_id"), part.column("log_key"), pa.array(n_words, pa.int64()),
                        pa.array([len(h) for h in hits], pa.int64()), pa.array(named, pa.list_(pa.string())),
                        pa.array(longest, pa.int64()), pa.array([_spans(h) for h in hits], _SPANS),
                    ],
                    ["job_id", "log_key", "n_words", "n_hit", "items", "longest", "spans"],
                )

    return logs.mapInArrow(run, _SCHEMA)


def _combine(parts: list[DataFrame]) -> DataFrame:
    """One row per log from the rows of all blocks; stretches hit in several blocks count once."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = materialize(rows, "blocks")
    copies = len(parts)
    merged = rows.groupBy("job_id", "log_key", "n_words").agg(
        (F.count("*") / copies).cast("int").alias("_copies"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("_all"),
    )
    # Sorted stretches are joined from left to right; each is bounded by the words of one log.
    start = F.lit(None).cast("array<struct<start:int,end:int>>")
    empty = F.coalesce(start, F.array().cast("array<struct<start:int,end:int>>"))
    spans = F.aggregate(
        "_all", empty,
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return (
        merged.withColumn("spans", spans)
        .withColumn("n_hit", hit)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
        .drop("_all", "_copy", "_copies")
    )
