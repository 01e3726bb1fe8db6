"""How two tokenizers cut the same job logs, and which of their tokens go together.

Logs repeat: a whole text is tokenised and aligned once, however many jobs wrote it, and its pairs count as
often as it occurs. Texts meet by a shuffle on the full text; measures go back to the jobs by its hash.

A text falls into segments at spaces that follow a printed character. No token of either tokenizer reaches over such a place,
which is proven from both vocabularies before the job, so a segment always has the same tokens and groups and
is aligned once per task. Texts are dealt to chunks of a few megabytes. A chunk tells the corpus-wide count each of its
distinct pairs once, with the number of logs that hold it, and gets the sum back once.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from facetlake.llm.spread import join_one
from facetlake.llm.token_counts import byte_of
from facetlake.session import materialize

#: Characters of text in a chunk, about; a longer text is a chunk of its own.
CHUNK = 1 << 19
#: Bytes of segments that are encoded in a row.
BLOCK = 1 << 14
#: Segments that a task remembers.
REMEMBERED = 80_000
#: Links of a group from which ids that repeat in it are counted first.
BIG_GROUP = 1 << 16
_CLOSED = regex.compile(r".*[!-~\p{L}\p{N}]", regex.DOTALL).fullmatch
#: A space begins a segment if a printed ASCII character, a letter or a number stands before it.
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SEGMENT = regex.compile(r" [^ ]*+(?:(?<![!-~\p{L}\p{N}]) [^ ]*+)*+")


# ---- one segment ----------------------------------------------------------------------------------------


class Aligner:
    """Tokens of both tokenizers for segments, each a space and what follows it."""

    def __init__(self, byte_level: str, pieces: bytes):
        # Spark runs a worker per core already; threads of the library would only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(byte_level)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        byte = byte_of()
        known = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            if all(c in byte for c in token):
                self.bytes_a[i] = bytes(byte[c] for c in token)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self.names = np.array([str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))], object)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def proven(self) -> bool:
        """Whether no token of either tokenizer can reach over the start of a segment.

        The byte-level pattern never joins a space to a character before it. Pieces do if one of them has a space
        after another character, or if the model rewrites texts, so that spaces may come and go.
        """
        shape = json.loads(self.a.to_str())
        plain = shape["normalizer"] is None and shape["pre_tokenizer"] | {"trim_offsets": True} == _BYTE_LEVEL
        inner = any(b" " in p.lstrip(b" ") for p in self.bytes_b)
        probe = "a  b\tc ½ ﬁ  d"
        return plain and not inner and b"".join(self.bytes_b[i] for i in self.b.encode(probe)) == f" {probe}".encode()

    def align(self, segments: list[str]) -> Aligned:
        """Segments that end in a printed character are encoded in a row, for each would be cut off from the next anyhow."""
        closed = np.fromiter((_CLOSED(s) is not None for s in segments), bool, len(segments))
        bytes_of = np.fromiter((len(s.encode()) for s in segments), np.int64, len(segments))
        kept = np.ones(len(segments), bool)
        blocks = [[k] for k in np.flatnonzero(~closed).tolist()]
        joint = np.flatnonzero(closed)
        upto = np.cumsum(bytes_of[joint]) // BLOCK
        blocks += [b.tolist() for b in np.split(joint, np.flatnonzero(np.diff(upto)) + 1) if len(b)]
        sides = self._encoded(["".join([segments[k] for k in b]) for b in blocks])
        order, left, right = [], [], []
        for b, raw_a, raw_b in zip(blocks, *sides, strict=True):
            if raw_a is None or raw_b is None:
                # A tokenizer does not keep the block: its segments one by one.
                for k, x, y in zip(b, *self._encoded([segments[k] for k in b]), strict=True):
                    kept[k] = x is not None and y is not None
                    order.append(k)
                    left.append(x if kept[k] else [])
                    right.append(y if kept[k] else [])
            else:
                order += b
                left.append(raw_a)
                right.append(raw_b)
        order = np.array(order, np.int64)
        return self._grouped(kept, order, np.where(kept, bytes_of, 0)[order], left, right)

    def _encoded(self, texts: list[str]) -> tuple[list[list[int] | None], list[list[int] | None]]:
        """Tokens of A and of B for texts that begin with a space; None where the bytes of the tokens are not the text's."""
        left = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        right = self.b.encode([t[1:] for t in texts], num_threads=1)
        if " " in texts:
            # The library adds no space to an empty text; behind a character a lone space stays.
            alone = self.b.encode("a ")[len(self.b.encode("a")) :]
            right = [alone if t == " " else r for t, r in zip(texts, right, strict=True)]
        sides = []
        for ids, table in ((left, self.bytes_a), (right, self.bytes_b)):
            sides.append([i if b"".join([table[t] for t in i]) == text.encode() else None for i, text in zip(ids, texts, strict=True)])
        return sides[0], sides[1]

    def _grouped(self, kept: np.ndarray, order: np.ndarray, size: np.ndarray, left: list[list[int]], right: list[list[int]]) -> Aligned:
        """Groups of all segments at once: they end where tokens of both end. ``order`` names the segments as they are encoded."""
        till = np.cumsum(size)
        sides = []
        for ids, wide in ((left, self.size_a), (right, self.size_b)):
            flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
            end = np.cumsum(wide[flat])
            sides.append((np.diff(np.searchsorted(end, till, "right"), prepend=0), flat, end))
        (n_a, a, end_a), (n_b, b, end_b) = sides
        ends = np.intersect1d(end_a, end_b, assume_unique=True)
        # First token of each group, on either side; tokens of a segment end where the segment does.
        from_a, from_b = (np.concatenate(([0], np.searchsorted(e, ends, "right"))) for e in (end_a, end_b))
        wide_a, wide_b = np.diff(from_a), np.diff(from_b)
        owner = np.repeat(np.arange(len(order)), n_a)[from_a[:-1]] if len(ends) else np.zeros(0, np.int64)
        product = wide_a * wide_b
        groups = np.bincount(owner, minlength=len(kept))
        links = np.bincount(owner, product, len(kept)).astype(np.int64)
        big = product > BIG_GROUP
        codes, times = [], []
        group_a = np.repeat(np.arange(len(ends)), wide_a)
        some = ~big[group_a] if len(ends) else np.zeros(0, bool)
        each = wide_b[group_a[some]]
        at = np.repeat(from_b[group_a[some]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        codes.append((np.repeat(owner[group_a[some]] * len(self.bytes_a) + a[some], each)) * len(self.bytes_b) + b[at])
        times.append(np.ones(len(at), np.int64))
        for g in np.flatnonzero(big):
            # Ids that repeat inside a large group are paired once, with the number of their links.
            x, n = np.unique(a[from_a[g] : from_a[g + 1]], return_counts=True)
            y, m = np.unique(b[from_b[g] : from_b[g + 1]], return_counts=True)
            codes.append((((owner[g] * len(self.bytes_a) + x) * len(self.bytes_b))[:, None] + y[None, :]).ravel())
            times.append((n[:, None] * m[None, :]).ravel())
        code, where = np.unique(np.concatenate(codes), return_inverse=True)
        times = np.bincount(where, np.concatenate(times), len(code)).astype(np.int64)
        of, pair = code // (len(self.bytes_a) * len(self.bytes_b)), code % (len(self.bytes_a) * len(self.bytes_b))
        said = self._said(n_a, a, b, owner, from_a, from_b)
        return Aligned(kept[order], np.stack([n_a, n_b, groups, links], 1), said, np.bincount(of, minlength=len(kept)), pair, times, order)

    def _said(self, n_a: np.ndarray, a: np.ndarray, b: np.ndarray, owner: np.ndarray, from_a: np.ndarray, from_b: np.ndarray) -> list[str]:
        """The groups of every segment as text, written in one go: tokens of A and of B by turns, each with what follows it."""
        line = np.full(2 * (len(a) + len(b)), ",", object)
        at_a = np.arange(len(a)) + np.repeat(from_b[:-1], np.diff(from_a))
        at_b = np.arange(len(b)) + np.repeat(from_a[1:], np.diff(from_b))
        line[2 * at_a], line[2 * at_b] = self.names[a], self.names[b]
        line[2 * at_a[from_a[1:] - 1] + 1] = "|"
        line[2 * at_b[from_b[1:] - 1] + 1] = np.where(np.append(owner[1:] != owner[:-1], True), "\n", ";") if len(owner) else []
        said = iter("".join(line.tolist()).split("\n"))
        return [next(said) if n else "" for n in n_a.tolist()]


class Aligned(NamedTuple):
    """Segments, in an order of their own: whether the tokenizers keep them, their tokens of A, of B, groups and links, their groups as text, and their pairs.

    A pair is the number of its A id times the size of B's vocabulary, plus its B id; ``times`` is how often it is linked.
    """

    kept: np.ndarray
    shape: np.ndarray
    said: list[str]
    size: np.ndarray
    pair: np.ndarray
    times: np.ndarray
    #: Which of the segments that were asked for each one is.
    order: np.ndarray


# ---- one chunk of texts ------------------------------------------------------------------------------------


class _Memory:
    """Aligned segments by number; forgotten when there are too many."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.known = Aligned(np.zeros(0, bool), np.zeros((0, 4), np.int64), [], *[np.zeros(0, np.int64)] * 4)

    def learn(self, cut: list[list[str]]) -> None:
        new = list({s for found in cut for s in found if s not in self.number})
        if len(new) + len(self.number) > REMEMBERED:
            self.forget()
            new = list({s for found in cut for s in found})
        if new:
            more = self.aligner.align(new)
            self.number |= zip([new[k] for k in more.order.tolist()], range(len(self.number), len(self.number) + len(new)), strict=True)
            joined = [old + own if isinstance(old, list) else np.concatenate([old, own]) for old, own in zip(self.known, more, strict=True)]
            self.known = Aligned(*joined)


#: A chunk: per text its key, copies and measures; its distinct pairs; per text and pair, step in those and links.
_CHUNK = pa.schema([
    ("chunk", pa.int64()), ("keys", pa.list_(pa.string())), ("copies", pa.binary()), ("measures", pa.binary()), ("hashes", pa.list_(pa.string())),
    ("pairs", pa.binary()), ("held", pa.binary()), ("first", pa.binary()), ("step", pa.binary()), ("times", pa.binary()),
])
_CHUNK_SQL = (
    "chunk long, keys array<string>, copies binary, measures binary, hashes array<string>, pairs binary, held binary, first binary, step binary, times binary"
)


def _aligned(memory: _Memory, chunk: int, keys: list[str], texts: list[str], copies: list[int]) -> pa.RecordBatch:
    cut = [SEGMENT.findall(f" {t}") if t else [] for t in texts]
    memory.learn(cut)
    known, number = memory.known, memory.number.__getitem__
    start = np.cumsum(known.size) - known.size
    row, kind, often = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    measures, hashes = np.zeros((len(texts), 4), np.int64), []
    for r, found in enumerate(cut):
        ids = np.fromiter(map(number, found), np.int64, len(found))
        kinds, n = np.unique(ids, return_counts=True)
        if not found or not known.kept[kinds].all():
            hashes.append("")
            continue
        measures[r] = n @ known.shape[kinds]
        hashes.append(hashlib.sha256(";".join(map(known.said.__getitem__, ids.tolist())).encode()).hexdigest())
        row.append(np.full(len(kinds), r))
        kind.append(kinds)
        often.append(n)
    row, kind, often = np.concatenate(row), np.concatenate(kind), np.concatenate(often)
    # Every segment of every text with its pairs, then a row per text and pair.
    each = known.size[kind]
    at = np.repeat(start[kind] - (np.cumsum(each) - each), each) + np.arange(each.sum())
    distinct, pair = np.unique(known.pair[at], return_inverse=True)
    wide = max(1, len(distinct))
    code, same = np.unique(np.repeat(row, each) * wide + pair, return_inverse=True)
    links = np.bincount(same, known.times[at] * np.repeat(often, each), len(code)).astype(np.int64)
    text, which = code // wide, code % wide
    many = np.array(copies, np.int64)
    held = np.bincount(which, many[text], len(distinct)).astype(np.int64)
    first = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int64)
    # Steps between sorted numbers are small and pack well.
    step = np.diff(which, prepend=0).astype(np.int32)
    links = links.astype(np.int64 if links.max(initial=0) >= 1 << 31 else np.int32)
    values = [chunk, keys, many.tobytes(), measures.tobytes(), hashes, distinct.tobytes(), held.tobytes(), first.tobytes(), step.tobytes(), links.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _CHUNK, strict=True)], schema=_CHUNK)


def _chunks(texts: DataFrame, byte_level: str, pieces: bytes) -> DataFrame:
    shipped = texts.sparkSession.sparkContext.broadcast((byte_level, pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, turn = None, 0
        part = TaskContext.get().partitionId()
        keys, held, copies, size = [], [], [], 0

        def done() -> pa.RecordBatch:
            nonlocal memory, turn, keys, held, copies, size
            memory = memory or _Memory(Aligner(*shipped.value))
            out = _aligned(memory, part << 32 | turn, keys, held, copies)
            turn, keys, held, copies, size = turn + 1, [], [], [], 0
            return out

        for batch in batches:
            for key, text, n in zip(batch.column("_key"), batch.column("_text"), batch.column("copies"), strict=True):
                text = text.as_py()
                if size and size + len(text) > CHUNK:
                    yield done()
                keys.append(key.as_py())
                held.append(text)
                copies.append(n.as_py())
                size += len(text)
        if keys:
            yield done()

    return texts.select("_key", "_text", "copies").mapInArrow(run, _CHUNK_SQL)


def _told(chunks: DataFrame, pieces: int) -> DataFrame:
    """``a b chunk at held``: every distinct pair of every chunk, with the logs of the chunk that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, held in zip(*(batch.column(c) for c in ("chunk", "pairs", "held")), strict=True):
                pair, n = np.frombuffer(pairs.as_buffer(), np.int64), np.frombuffer(held.as_buffer(), np.int64)
                columns = [pair // pieces, pair % pieces, np.full(len(pair), chunk.as_py()), np.arange(len(pair), dtype=np.int64), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "chunk", "at", "held"])

    return chunks.select("chunk", "pairs", "held").mapInArrow(run, "a long, b long, chunk long, at long, held long")


def pair_counts(told: DataFrame) -> DataFrame:
    """``a b logs best``: how many logs hold each pair, and whether no pair of its ``a`` is held by more."""
    counts = materialize(told.groupBy("a", "b").agg(F.sum("held").alias("logs")), "pair_counts")
    # One row per id of the vocabulary at most.
    most = counts.groupBy("a").agg(F.max("logs").alias("_most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "logs", (F.col("logs") == F.col("_most")).alias("best"))


def _measured(chunk: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
    """Measures of the texts of one chunk."""
    out = []
    for c in chunk.itertuples():
        logs, best = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        logs[counts["at"].to_numpy()] = counts["logs"].to_numpy()
        best[counts["at"].to_numpy()] = counts["best"].to_numpy()
        first, which = np.frombuffer(c.first, np.int64), np.cumsum(np.frombuffer(c.step, np.int32), dtype=np.int64)
        times = np.frombuffer(c.times, np.int64 if len(c.times) == 8 * len(which) and len(which) else np.int32).astype(np.int64)
        sums = [np.concatenate(([0], np.cumsum(v[which] * times))) for v in (best, logs)]
        measures = np.frombuffer(c.measures, np.int64).reshape(-1, 4)
        out.append(pd.DataFrame({
            "_key": c.keys, "_copies": np.frombuffer(c.copies, np.int64), **{n: measures[:, i] for i, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
            "n_best": sums[0][first[1:]] - sums[0][first[:-1]], "count_sum": sums[1][first[1:]] - sums[1][first[:-1]], "groups_sha256": c.hashes,
        }))
    return pd.concat(out) if out else pd.DataFrame({n.split()[0]: [] for n in _MEASURES.split(", ")})


_MEASURES = "_key string, _copies long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align_logs(logs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """How the tokens of two tokenizers go together in every job log.

    Tokenizer A encodes a space and the log, B the log, to which it adds that space; neither adds special tokens, and
    their strings in a log are plain text. Byte offsets at which tokens of both end cut the tokens into groups; tokens of A
    and B in one group are linked. A pair of ids counts the logs, copies included, in which it is linked.

    Args:
        logs: ``job_id`` and ``log``; further columns are left out.
        byte_level: path of A, a byte-level BPE file of the ``tokenizers`` library.
        pieces: path of B, a BPE model of the ``sentencepiece`` library. Both files are read by the driver only.

    Returns:
        ``job_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair has the highest count of all pairs of its id
        of A, ties included), ``count_sum`` (counts of the pairs, over all links), ``groups_sha256`` (hex SHA-256 of the groups,
        ``a1,a2|b1;a3|b2,b3``).

    Null and empty logs, and those whose bytes A or B does not keep, have no tokens: zeros, and an empty
    ``groups_sha256``. Repeated rows stay repeated and count each; an empty table gives an empty result. Texts are told apart
    by SHA-256. Memory grows with the longest stretch without spaces; other long logs are encoded in segments.

    Raises:
        ValueError: if a token of one of the vocabularies may reach over a space that follows a printed character.
    """
    with open(byte_level, encoding="utf-8") as file:
        definition = file.read()
    with open(pieces, "rb") as file:
        model = file.read()
    aligner = Aligner(definition, model)
    if not aligner.proven():
        raise ValueError(f"{pieces}: pieces reach over spaces; texts cannot be encoded in segments")
    keyed = logs.select("job_id", F.sha2(F.coalesce("log", F.lit("")).cast("binary"), 256).alias("_key"), F.monotonically_increasing_id().alias("_row"))
    texts = logs.select(F.coalesce("log", F.lit("")).alias("_text")).groupBy("_text").agg(F.count("*").alias("copies"))
    texts = texts.withColumn("_key", F.sha2(F.col("_text").cast("binary"), 256))
    chunks = materialize(_chunks(texts, definition, model), "aligned")
    told = materialize(_told(chunks, len(aligner.bytes_b)), "pairs")
    counted = told.join(pair_counts(told), ["a", "b"]).select("chunk", "at", "logs", "best")
    # A chunk's own pairs bound what meets here.
    measured = chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInPandas(_measured, _MEASURES)
    measured = materialize(measured, "measures")
    joined = join_one(keyed, measured, "_key", "_copies", keyed.count(), "_row")
    return joined.drop("_key", "_row", "_copies")
