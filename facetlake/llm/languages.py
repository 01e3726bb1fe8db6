"""Language of session names and notes by a convolutional network over bytes.

Texts are cut into windows of fixed length. Bytes have learnt vectors; filters of several widths slide
over them, each keeps its largest response in the window, and a softmax over those names the language.
Everything is trained in numpy by back-propagation. A text's language is the best mean probability over
all of its windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from facetlake.llm.training import sample_ids, sample_texts
from facetlake.llm.words import slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
DIMENSION = 6
#: Sessions learnt from, for each language, with all of their windows.
PER_LANGUAGE = 200
EPOCHS = 5
_LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def windows_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts and the text of each. Windows overlap, so no filter misses a place; the last is padded."""
    step = WINDOW - max(WIDTHS) + 1
    n = np.maximum(1, -(-(np.diff(off) - (WINDOW - step)) // step))
    row = np.repeat(np.arange(len(n)), n)
    start = off[row] + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * step
    left = off[row + 1] - start
    at = start[:, None] + np.arange(WINDOW)
    padded = np.append(data, np.zeros(WINDOW, np.uint8))
    out = padded[np.minimum(at, len(padded) - 1)]
    out[np.arange(WINDOW) >= left[:, None]] = 0
    return out, row


class ByteNetwork:
    """Byte vectors, filters, max pooling and softmax."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        wide = max(WIDTHS) * DIMENSION
        count = FILTERS * len(WIDTHS)
        self.reach = np.repeat(WIDTHS, FILTERS)
        #: Filters narrower than the widest are zero beyond their width.
        self.mask = (np.arange(wide)[:, None] < self.reach * DIMENSION).astype(np.float32)
        self.parameters = [
            rng.normal(0, 0.5, (256, DIMENSION)).astype(np.float32),
            (rng.normal(0, 0.4, (wide, count)) * self.mask).astype(np.float32),
            np.zeros(count, np.float32),
            rng.normal(0, 0.3, (count, len(languages))).astype(np.float32),
            np.zeros(len(languages), np.float32),
        ]

    def _patches(self, x: np.ndarray) -> np.ndarray:
        vectors = self.parameters[0][np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))]
        flat = np.ascontiguousarray(vectors).reshape(len(x), -1)
        view = np.lib.stride_tricks.sliding_window_view(flat, max(WIDTHS) * DIMENSION, axis=1)
        return view[:, :: DIMENSION]

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, filters, shift, _, _ = self.parameters
        patches = self._patches(x)
        response = (patches.reshape(-1, filters.shape[0]) @ filters).reshape(len(x), WINDOW, -1)
        return patches, response, np.maximum(response.max(1) + shift, 0)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(x), 512):
            _, _, pooled = self._pooled(x[lo : lo + 512])
            out.append(self._softmax(pooled))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = pooled @ self.parameters[3] + self.parameters[4]
        logits = np.exp(logits - logits.max(1, keepdims=True))
        return logits / logits.sum(1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> ByteNetwork:
        rng = np.random.default_rng(seed)
        first, second, step = [np.zeros_like(p) for p in self.parameters], [np.zeros_like(p) for p in self.parameters], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), 64):
                batch = order[lo : lo + 64]
                step += 1
                for i, g in enumerate(self._gradients(x[batch], y[batch])):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.99 * second[i] + 0.01 * g * g
                    self.parameters[i] -= (0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        vectors, filters, _, layer, _ = self.parameters
        patches, response, pooled = self._pooled(x)
        error = self._softmax(pooled)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ layer.T) * (pooled > 0)
        # Only the place of the largest response passes the error on.
        place = response.argmax(1)
        line = np.arange(len(x))[:, None]
        best = patches[line, place]
        g_filters = np.einsum("nf,nfw->wf", back, best) * self.mask
        g_patch = back[:, :, None] * filters.T[None]
        padded = np.pad(x, ((0, 0), (0, max(WIDTHS) - 1)))
        g_vectors = np.zeros_like(vectors)
        for k in range(max(WIDTHS)):
            np.add.at(g_vectors, padded[line, place + k], g_patch[:, :, k * DIMENSION : (k + 1) * DIMENSION])
        return [g_vectors, g_filters, back.sum(0), pooled.T @ error, error.sum(0)]


def learn(sessions: DataFrame, per_language: int = PER_LANGUAGE) -> ByteNetwork | None:
    """A network from all windows of at most ``per_language`` sessions of each language.

    Languages are few, so the sample has a bound; None without labelled letters.
    """
    chosen = sample_ids(sessions.filter("name IS NOT NULL"), "session_id", "lang", per_language)
    texts = sample_texts(sessions, "session_id", "name", chosen, "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch):
                x, row = windows_of(data, off)
                lettered = (x > 0x40).any(axis=1)
                first = np.searchsorted(row, np.arange(part.num_rows + 1))
                own = [x[lo:hi][lettered[lo:hi]].tobytes() for lo, hi in zip(first[:-1], first[1:], strict=True)]
                keys = [str(k) for k in part.column("_key").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), part.column("label").cast(pa.string()), pa.array(own, pa.binary())], ["k", "label", "bytes"])

    rows = sorted((r.k, r.label, bytes(r.bytes)) for r in texts.mapInArrow(cut, "k string, label string, bytes binary").collect())
    rows = [r for r in rows if r[2]]
    if not rows:
        return None
    languages = sorted({r[1] for r in rows})
    x = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.repeat([languages.index(r[1]) for r in rows], [len(r[2]) // WINDOW for r in rows])
    return ByteNetwork(languages).fit(x, y)


def session_languages(sessions: DataFrame, labelled: DataFrame, network: ByteNetwork | None = None) -> DataFrame:
    """Language of the whole name or note of every session.

    Args:
        sessions: ``session_id``, ``name``, and further columns, which stay.
        labelled: ``session_id``, ``name``, ``lang``: what may be learnt from; null names or languages
            teach nothing.
        network: predicts with this one instead of learning.

    Returns:
        The columns of ``sessions``, ``lang_pred`` and ``lang_score`` (mean probability, 0 to 1). Null names and
        names without any letter are ``und`` with score 0, as is all where there is nothing to
        learn from. Repeated rows stay repeated; an empty table gives an empty result.
    """
    shipped = sessions.sparkSession.sparkContext.broadcast(network or learn(labelled))
    base = sessions.drop("lang_pred", "lang_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            net = shipped.value
            for part, data, off in slices(batch, "name", 1 << 20):
                lettered = [t is not None and _LETTER.search(t) is not None for t in part.column("name").to_pylist()]
                names, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                if net is not None:
                    mean = np.zeros((part.num_rows, len(net.languages)))
                    for lo, hi in _groups(off):
                        x, row = windows_of(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                        np.add.at(mean, row + lo, net.probabilities(x))
                    mean /= np.maximum(mean.sum(1, keepdims=True), 1e-12)
                    best = mean.argmax(1)
                    names = [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
                    scores = np.clip(np.where(lettered, mean[np.arange(len(best)), best], 0.0), 0, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "lang_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{fields}, lang_pred string, lang_score double")


def _groups(off: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about a quarter of a megabyte, for bounded window arrays."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 18), "right")) - 1)
        yield lo, hi
        lo = hi
