"""Toxic session names and notes, told by averaged subword vectors under a linear softmax.

Each word is a bag of the character n-grams inside its boundaries, hashed to buckets with a vector each. A
passage is the average of its subword vectors; a linear softmax turns it into a probability. Vectors
and softmax are learnt together, so a misspelling shares most of its vectors with the word it hides.
Texts are long and insults are short: a text is as toxic as its worst passage, and training looks at
the passage of each text that scores highest so far, for toxic and clean texts alike.

The average of vectors under a linear layer is the average of one number per bucket, so scoring
needs only those numbers, a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetlake.llm.training import sample_ids, sample_texts, sigmoid
from facetlake.llm.words import ALNUM, Words, mix, slices, words

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMENSION = 8
#: Words of a passage.
PASSAGE = 40
#: Labelled texts learnt from, for each label.
PER_LABEL = 1500
#: Words of a sample whose passages are looked at together.
TOGETHER = 200_000
#: Rounds over the sample, at least and, where it is small, at most.
EPOCHS, MOST_EPOCHS = 6, 60
#: Batches to aim for, and passages of each.
STEPS, BATCH = 800, 32


def subwords(data: np.ndarray, found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word number and bucket of every n-gram, boundaries included."""
    size = found.end - found.start
    total = int(size.sum())
    stream = np.full(total + len(size) + 1, 0x20, np.uint8)
    number = np.repeat(np.arange(len(size)), size)
    inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    stream[np.arange(total) + number + 1] = data[np.repeat(found.start, size) + inside]
    edge = stream == 0x20
    word = np.cumsum(edge) - 1  # of the boundary that starts a word, and of its bytes
    code = np.zeros(len(stream), np.uint64)
    which, bucket = [], []
    with np.errstate(over="ignore"):
        wide = stream.astype(np.uint64) + np.uint64(1)
        for n in range(1, max(SIZES) + 1):
            live = len(stream) - n + 1
            if live <= 0:
                break
            code = code[:live] * np.uint64(0x100000001B3) + wide[n - 1 :]
            if n not in SIZES:
                continue
            # All inner bytes belong to the word that begins at or before the first.
            same = word[n - 2 : n - 2 + live] == word[:live]
            at = np.flatnonzero(same)
            which.append(word[at])
            bucket.append((mix(code[at] + np.uint64(n)) >> np.uint64(40)).astype(np.int64) % BUCKETS)
    if not which:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(which), np.concatenate(bucket)


def passages(found: Words, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and mean of every passage: ``PASSAGE`` words from every fourth word, or all of a short text.

    A word that a passage repeats adds to its length alone; else a text of few words would have an
    average of few vectors, and that of an odd word could be anything.
    """
    first = found.first
    n = np.diff(first)
    steps = np.where(n > 0, np.maximum(0, n - PASSAGE + 3) // 4 + 1, 0)
    row = np.repeat(np.arange(len(n)), steps)
    at = (np.arange(len(row)) - np.repeat(np.cumsum(steps) - steps, steps)) * 4
    start = first[row] + np.minimum(at, np.maximum(0, n[row] - PASSAGE))
    end = np.minimum(start + PASSAGE, first[row + 1])
    with np.errstate(over="ignore"):
        key = found.hash ^ mix(found.row.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    before = np.full(len(key), -1)
    again = np.flatnonzero(key[order][1:] == key[order][:-1])
    before[order[again + 1]] = order[again]
    total = np.zeros(len(row))
    for k in range(PASSAGE):
        place = np.minimum(start + k, len(sums) - 1)
        total += np.where((start + k < end) & (before[place] < start), sums[place], 0.0)
    run = np.append(0.0, np.cumsum(counts))
    return row, start, total / np.maximum(run[end] - run[start], 1)


@dataclass
class ToxicModel:
    weight: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of the worst passage of each text; texts without words get that of no evidence."""
        found = words(data, off, ALNUM)
        which, bucket = subwords(data, found)
        sums = np.bincount(which, self.weight[bucket], len(found.start))
        row, _, mean = passages(found, sums, np.bincount(which, minlength=len(found.start)))
        best = np.full(len(off) - 1, -np.inf)
        np.maximum.at(best, row, mean)
        best[np.isinf(best)] = 0.0
        return sigmoid(best + self.bias)


def coded(text: str) -> tuple[bytes, bytes]:
    """A whole text as its distinct words, joined by spaces, and the number among them of every word."""
    raw = text.lower().encode()
    found = words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM)
    _, where, kind = np.unique(found.hash, return_index=True, return_inverse=True)
    return b" ".join(raw[found.start[i] : found.end[i]] for i in where), kind.astype(np.int32).tobytes()


def _word_buckets(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of some words, word by word, and how many each has."""
    end = np.cumsum([len(w) for w in some])
    start = np.append(0, end[:-1])
    chosen = Words(np.array([0, len(some)]), start, end, np.zeros(len(some), np.uint64), np.zeros(len(some), np.int64))
    which, bucket = subwords(np.frombuffer(b"".join(some), np.uint8), chosen)
    return bucket[np.argsort(which, kind="stable")].astype(np.int32), np.bincount(which, minlength=len(some))


def train(texts: list[str], labels: list[int], seed: int = 7) -> ToxicModel:
    """Learn from whole texts and their 0/1 labels; without both labels every score is the share of ones."""
    return fit([coded(t) for t in texts], labels, seed)


def fit(texts: list[tuple[bytes, bytes]], labels: list[int], seed: int = 7) -> ToxicModel:
    """``train`` from texts as ``coded`` gives them."""
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return ToxicModel(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    known: dict[bytes, int] = {}
    numbered = []
    for names, kinds in texts:
        own = np.array([known.setdefault(w, len(known)) for w in names.split(b" ")] if names else [], np.int32)
        numbered.append(own[np.frombuffer(kinds, np.int32)])
    starts, kind = np.append(0, np.cumsum([len(k) for k in numbered])), np.concatenate(numbered)
    del numbered
    listed = list(known)
    parts = [_word_buckets(listed[lo : lo + 20_000]) for lo in range(0, len(listed), 20_000)]
    bucket, count = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
    del known, listed, parts
    # Only buckets that were seen have vectors; the others stay without evidence.
    mark = np.zeros(BUCKETS, bool)
    mark[bucket] = True
    seen = np.flatnonzero(mark)
    bucket = (np.cumsum(mark) - 1).astype(np.int32)[bucket]
    begin = np.cumsum(count) - count
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.05, (len(seen), DIMENSION)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (DIMENSION, 2)).astype(np.float32), np.zeros(2, np.float32)
    squares, layer_squares, bias_squares = np.full(len(seen), 1e-6, np.float32), np.full_like(layer, 1e-6), np.full(2, 1e-6, np.float32)

    def ids(start: int, end: int) -> np.ndarray:
        kinds = np.unique(kind[start:end])
        size = count[kinds]
        return bucket[np.repeat(begin[kinds], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)]

    def spans() -> Iterator[tuple[int, int]]:
        """Ranges of texts of about ``TOGETHER`` words."""
        lo = 0
        while lo < len(y):
            hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + TOGETHER, "right")) - 1)
            yield lo, hi
            lo = hi

    def best(own: np.ndarray) -> list[np.ndarray]:
        """Text and first word of the passage that scores highest in each text."""
        found = []
        for lo, hi in spans():
            some = kind[starts[lo] : starts[hi]]
            row_of = np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1]))
            row, start, mean = passages(Words(starts[lo : hi + 1] - starts[lo], some, some, some.astype(np.uint64), row_of), own[some], count[some])
            order = np.lexsort((mean, row))
            last = order[np.append(np.flatnonzero(np.diff(row[order])), len(order) - 1)] if len(order) else order
            found.append((row[last] + lo, start[last] + starts[lo]))
        return [np.concatenate(c) for c in zip(*found, strict=True)]

    size = np.diff(starts)
    worded = np.flatnonzero(size > 0)
    # Passages of the clean texts, counted as ``passages`` lists them.
    clean = worded[y[worded] == 0]
    upto = np.cumsum(np.maximum(0, size[clean] - PASSAGE + 3) // 4 + 1)
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-STEPS * BATCH // max(1, len(worded)))))
    for epoch in range(epochs):
        if epoch * 4 < epochs:
            # First the whole texts, so that the insults stand out before any passage is chosen.
            chosen = [(int(starts[r]), int(starts[r + 1]), int(r)) for r in worded]
        else:
            weight = vectors @ (layer[:, 1] - layer[:, 0])
            own = np.add.reduceat(weight[bucket], begin) if len(bucket) else np.zeros(0)
            row, start = best(own)
            # A random passage of clean texts keeps ordinary text in sight.
            more = rng.choice(int(upto[-1]), min(int(upto[-1]), len(y) // 3), replace=False) if len(upto) else np.zeros(0, np.int64)
            at = np.searchsorted(upto, more, "right")
            inside = (more - np.append(0, upto)[at]) * 4
            row = np.append(row, clean[at])
            start = np.append(start, starts[clean[at]] + np.minimum(inside, np.maximum(0, size[clean[at]] - PASSAGE)))
            chosen = [(int(s), int(min(s + PASSAGE, starts[r + 1])), int(r)) for s, r in zip(start, row, strict=True)]
        rng.shuffle(chosen)
        rate = 0.5 * (1 - epoch / epochs) + 0.05
        for lo in range(0, len(chosen), BATCH):
            part = chosen[lo : lo + BATCH]
            bags = [ids(first, end) for first, end, _ in part]
            target = y[[r for _, _, r in part]]
            used, column = np.unique(np.concatenate(bags), return_inverse=True)
            line = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
            x = np.bincount(line * len(used) + column, minlength=len(bags) * len(used)).reshape(len(bags), -1).astype(np.float32)
            x /= np.array([[max(1, count[kind[first:end]].sum())] for first, end, _ in part], np.float32)
            hidden = x @ vectors[used]
            logits = hidden @ layer + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(target)), target] -= 1
            p /= len(target)
            g_vectors, g_layer, g_bias = x.T @ (p @ layer.T), hidden.T @ p, p.sum(0)
            squares[used] += (g_vectors**2).mean(1)
            layer_squares += g_layer**2
            bias_squares += g_bias**2
            vectors[used] -= rate * g_vectors / np.sqrt(squares[used])[:, None]
            layer -= 0.1 * rate * g_layer / np.sqrt(layer_squares)
            bias -= 0.1 * rate * g_bias / np.sqrt(bias_squares)
    weight = np.zeros(BUCKETS, np.float32)
    weight[seen] = vectors @ (layer[:, 1] - layer[:, 0])
    return ToxicModel(weight, float(bias[1] - bias[0]))


def learn(sessions: DataFrame, marks: DataFrame, per_label: int = PER_LABEL) -> ToxicModel:
    """A model from at most ``per_label`` marked sessions of each label. Tasks code their whole texts."""
    chosen = sample_ids(marks, "session_id", "toxic", per_label)
    sample = sample_texts(sessions, "session_id", "name", chosen, "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, _ in slices(batch):
                both = [coded(t or "") for t in part.column("text").to_pylist()]
                columns = [pa.array([str(k) for k in part.column("_key").to_pylist()], pa.string()), part.column("label").cast(pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([b[i] for b in both], pa.binary()) for i in (0, 1))], ["k", "label", "names", "kinds"])

    rows = sample.mapInArrow(run, "k string, label long, names binary, kinds binary").collect()
    rows.sort(key=lambda r: (r["k"], r["names"], r["kinds"]))
    return fit([(bytes(r["names"]), bytes(r["kinds"])) for r in rows], [int(r["label"]) for r in rows])


def session_toxicity(sessions: DataFrame, marks: DataFrame, model: ToxicModel | None = None) -> DataFrame:
    """Score the whole name or note of every session.

    Args:
        sessions: ``session_id``, ``name``, and further columns, which stay.
        marks: ``session_id``, ``toxic`` (0 or 1): what may be learnt from. Marks without a session, with
            a null or of sessions with null names teach nothing or an empty text.
        model: scores with this one instead of learning.

    Returns:
        The columns of ``sessions`` and ``toxic_score`` (0 to 1). Null and empty names get the score of a text
        without evidence. Repeated rows stay repeated; an empty table gives an empty result; with
        no marks, or marks of one kind, every score is about the share of ones.
    """
    shipped = sessions.sparkSession.sparkContext.broadcast(model or learn(sessions, marks))
    base = sessions.drop("toxic_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lowered = pa.record_batch([pa.array([(t or "").lower() for t in part.column("name").to_pylist()], pa.string())], ["name"])
                scores = [shipped.value.scores(data, off) for _, data, off in slices(lowered, "name", 1 << 20)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(scores), pa.float64())], [*part.schema.names, "toxic_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{fields}, toxic_score double")
