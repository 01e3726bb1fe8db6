"""Useful and useless job logs, told by the votes of the nearest labelled logs.

A log is a bag of hashed byte trigrams and repetitions, weighted by rarity, projected onto the latent directions of the labelled
sample (a truncated SVD). The labelled vectors are few by a documented bound and go to every task;
each log is compared with all of them in blocks of exact cosine products, and its nearest ones
vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from facetlake.llm.training import sample_ids, sample_texts
from facetlake.llm.words import slices, words

TRIGRAMS = 4096
#: An immediate repetition of a word counts like so many trigrams.
REPEATED = 24
TERMS = TRIGRAMS + REPEATED
LATENT = 64
NEIGHBOURS = 25
#: Labelled logs of each label that become voters.
PER_LABEL = 2000
_ROWS = 128


def term_counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hashed counts of the byte trigrams of each text, whose ends count as line ends, and of words said twice in a row."""
    n = len(off) - 1
    out = np.zeros(len(data) + 2 * n, np.uint32) + np.uint32(0x0A)
    row = np.repeat(np.arange(n), np.diff(off))
    out[np.arange(len(data)) + 2 * row + 1] = data
    owner = np.repeat(np.arange(n), np.diff(off) + 2)
    code = (out[:-2] << np.uint32(16)) | (out[1:-1] << np.uint32(8)) | out[2:]
    with np.errstate(over="ignore"):
        term = ((code * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64)
    inside = owner[:-2] == owner[2:]
    trigrams = np.bincount(owner[:-2][inside] * TRIGRAMS + term[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
    found = words(data, off)
    again = (found.hash[1:] == found.hash[:-1]) & (found.row[1:] == found.row[:-1])
    repeats = np.bincount(found.row[1:][again], minlength=n)
    return np.concatenate((trigrams, np.repeat(repeats[:, None], REPEATED, 1)), 1)


@dataclass
class Voters:
    """Rarity weights, latent directions, unit vectors of the labelled logs and their labels."""

    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        weighted = np.log1p(counts).astype(np.float32) * self.rarity
        weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
        latent = weighted @ self.directions
        return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.project(counts) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6) ** 2
        return np.clip((vote * self.labels[near]).sum(1) / vote.sum(1), 0, 1)


def voters(counts: np.ndarray, labels: np.ndarray, seed: int = 9) -> Voters:
    """The latent space of labelled counts, by subspace iteration."""
    present = (counts > 0).sum(0)
    rarity = np.log((1 + len(counts)) / (1 + present)).astype(np.float32) + 0.1
    weighted = np.log1p(counts).astype(np.float32) * rarity
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-9)
    size = min(LATENT, TERMS, max(1, len(counts)))
    basis = np.random.default_rng(seed).normal(size=(TERMS, size)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    found = Voters(rarity, basis.astype(np.float32), np.zeros((0, size), np.float32), labels.astype(np.float32))
    found.vectors = found.project(counts)
    return found


def learn(logs: DataFrame, marks: DataFrame, per_label: int = PER_LABEL) -> Voters:
    """Voters from at most ``per_label`` whole marked logs of each label; their counts are taken by tasks."""
    chosen = sample_ids(marks, "job_id", "useful", per_label)
    texts = sample_texts(logs, "job_id", "log", chosen, "useful").selectExpr("_key", "coalesce(text, '') AS text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, limit=1 << 20):
                for lo in range(0, part.num_rows, _ROWS):
                    hi = min(part.num_rows, lo + _ROWS)
                    counts = term_counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]).astype(np.uint32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([str(k) for k in part.column("_key").to_pylist()[lo:hi]], pa.string()), part.column("label").slice(lo, hi - lo).cast(pa.int64()), pa.array([_sparse(c) for c in counts], pa.binary())],
                        ["k", "label", "counts"],
                    )

    rows = sorted((r.k, r.label, bytes(r.counts)) for r in texts.mapInArrow(count, "k string, label long, counts binary").collect())
    if not rows:
        return Voters(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32))
    counts = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        pairs = np.frombuffer(r[2], np.uint32).reshape(-1, 2)
        counts[i, pairs[:, 0]] = pairs[:, 1]
    return voters(counts, np.array([r[1] for r in rows]))


def _sparse(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return np.stack((at.astype(np.uint32), counts[at]), 1).tobytes()


def log_quality(logs: DataFrame, marks: DataFrame, model: Voters | None = None) -> DataFrame:
    """Score every whole job log for usefulness.

    Args:
        logs: ``job_id``, ``log``, and further columns, which stay.
        marks: ``job_id``, ``useful`` (0 or 1): what may be learnt from; nulls teach nothing.
        model: votes with these instead of learning.

    Returns:
        The columns of ``logs`` and ``useful_score``: 0 to 1, higher where useful logs are nearer. Null logs
        count as empty and are scored like an empty text. Without any marks every score is 0.5. Repeated
        rows stay repeated; an empty table gives an empty result.
    """
    shipped = logs.sparkSession.sparkContext.broadcast(model or learn(logs, marks))
    base = logs.drop("useful_score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "log", 1 << 20):
                scores = [np.zeros(0)]
                for lo in range(0, part.num_rows, _ROWS):
                    hi = min(part.num_rows, lo + _ROWS)
                    scores.append(shipped.value.scores(term_counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.concatenate(scores), pa.float64())], [*part.schema.names, "useful_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    return base.mapInArrow(run, f"{fields}, useful_score double")
