import os
import random

import numpy as np
import pytest
from edge import EDGE, SPACED, frame, with_extra
from facetlake.llm import alike
from facetlake.llm.alike import alike_logs
from facetlake.llm.queries import QUERIES
from facetlake.session import materialize, scratch, shared_dir


def shingles(text):
    ws = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in SPACED.findall(text or "")]
    if len(ws) < 5:
        return {tuple(ws)} if ws else set()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    near = {(a, b) for ids in where.values() for i, a in enumerate(ids) for b in ids[i + 1 :]}
    for a, b in near:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((k, len(sets[i]), least.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def compared(df, key="job_id", group="alike_id"):
    return sorted(((r[key], r.n_shingles, r[group]) for r in df.collect()), key=str)


def planted(seed, size):
    """Families of edits at all distances around the threshold, chains, shared passages, copies."""
    rng = random.Random(seed)
    fresh = iter(f"w{i}" for i in range(10**6))
    passages = [[next(fresh) for _ in range(60)] for _ in range(3)]
    texts = list(EDGE)
    for _ in range(size):
        base = [next(fresh) for _ in range(rng.randint(5, 120))]
        if rng.random() < 0.5:
            base += rng.choice(passages)
        family = [base]
        for _ in range(rng.randint(0, 9)):
            parent = list(rng.choice(family))
            for _ in range(rng.randint(0, max(1, len(parent) // 22))):
                parent[rng.randrange(len(parent))] = next(fresh)
            if rng.random() < 0.3:
                parent += [next(fresh) for _ in range(rng.randint(0, len(parent) // 4))]
            family.append(parent)
        texts += [" ".join(w).upper() if rng.random() < 0.1 else "  ".join(w) for w in family]
    for _ in range(size // 4):
        texts.append(" ".join(w for p in rng.sample(passages, 2) for w in p))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_families(spark, seed):
    rows = planted(seed, 25)
    rows += [(5, rows[9][1]), (5, rows[9][1]), (None, rows[20][1]), (None, "alone and unlike all of the others"), (7, None)]
    logs = frame(spark, rows, "job_id long, log string")
    assert compared(alike_logs(with_extra(logs).repartition(6))) == brute(rows)


@pytest.mark.parametrize("tokens, rows_of_block", [(200_000, 512), (300, 3), (40, 1)])
def test_blocks_alone(spark, monkeypatch, tokens, rows_of_block):
    """Without any star links the blocks find all, however small they are."""
    rows = planted(4, 12)
    monkeypatch.setattr(alike, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(alike, "BLOCK_ROWS", rows_of_block)
    monkeypatch.setattr(alike, "COLUMNS", 64)
    monkeypatch.setattr(alike, "_star_round", lambda classes, *_: classes.sparkSession.createDataFrame([], "a long, b long"))
    assert compared(alike_logs(frame(spark, rows, "job_id long, log string").repartition(4))) == brute(rows)


def test_pairs_of_blocks_come_in_waves(spark, monkeypatch):
    """No more than a few copies of the classes lie in shuffles at a time; the waves together find all."""
    rows, written = planted(4, 12), []
    for name, value in (("BLOCK_TOKENS", 300), ("BLOCK_ROWS", 3), ("WAVE_TOKENS", 1)):
        monkeypatch.setattr(alike, name, value)
    monkeypatch.setattr(alike, "_star_round", lambda classes, *_: classes.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(alike, "materialize", lambda df, name="cut", keep=False: (written.append(name), materialize(df, name, keep))[1])
    assert compared(alike_logs(frame(spark, rows, "job_id long, log string").repartition(4))) == brute(rows)
    assert written.count("block_links") > 1


def test_small_chunks_and_fragments(spark, monkeypatch):
    rows = planted(3, 12)
    monkeypatch.setattr(alike, "CHUNK", 500)
    monkeypatch.setattr(alike, "FRAGMENT", 200)
    assert compared(alike_logs(frame(spark, rows, "job_id long, log string").repartition(4))) == brute(rows)


def test_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert compared(QUERIES["op1_alike"](spark, small), "doc_id", "component_id") == brute(rows)


@pytest.mark.parametrize("fragment", [1, 7, 10_000])
def test_overlaps_equal_set_intersections(fragment):
    rng = np.random.default_rng(fragment)
    x, y = ([np.unique(rng.integers(0, 90, n).astype(np.uint64) << np.uint64(55)) for n in rng.integers(1, 60, 20)] for _ in range(2))
    for a, b in ((x, y), (x, x)):
        got = alike._overlaps(a, b, a is b, fragment)
        want = [[len(np.intersect1d(s, t)) for t in b] for s in a]
        off = ~np.eye(20, dtype=bool) if a is b else np.ones((20, 20), bool)
        assert (got == want)[off].all()


def test_scratch_is_cleared(spark):
    before = set(os.listdir(f"{shared_dir(spark)}/facetlake"))
    rows = planted(3, 6)
    with scratch(spark):
        found = materialize(alike_logs(frame(spark, rows, "job_id long, log string")), "kept", keep=True)
    left = set(os.listdir(f"{shared_dir(spark)}/facetlake")) - before
    assert len(left) == 1 and compared(found) == brute(rows)


def test_empty_table(spark):
    assert alike_logs(frame(spark, [], "job_id long, log string")).count() == 0
