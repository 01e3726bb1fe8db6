import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from edge import EDGE, documents, frame, with_extra
from facetlake.llm import resample
from facetlake.llm.queries import QUERIES
from hypothesis import given, settings
from hypothesis import strategies as st

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def runs(text, longest=1):
    ws = words(text)
    return [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def drawn(rows, targets, percent=10, least=20, buckets=10000, longest=1, seed="2024"):
    """Brute force: the whole table sorted."""

    def spread(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t, longest))

    s, t = spread(x for _, x in rows), spread(targets)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        found = runs(text, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words(text)), len(found), weight, score, None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[2]))
    for place, r in enumerate(fit[: percent * len(fit) // 100]):
        r[5] = place + 1
    return sorted(map(tuple, out), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_edges_and_ties(spark):
    rows = [(i, t) for i, t in enumerate(EDGE)] + [(None, "a b c " * 10), (None, None), (None, "a b c " * 10)]
    rows += [(200, "same words again " * 9)] * 30 + [(200, "same words again " * 10)] * 3 + [(300 + i, f"w{i} Capture DONE é " * 8) for i in range(60)]
    targets = ["capture done", None, "", "w3 w4 w5"]
    logs, wanted = with_extra(frame(spark, rows, "job_id long, log string")), frame(spark, [(t,) for t in targets], "log string")
    for percent in (0, 10, 37, 100):
        assert got(resample.resample_logs(logs, wanted, percent)) == drawn(rows, targets, percent)
    assert got(resample.resample_logs(logs, wanted, 50, 0, 97, 3, "x")) == drawn(rows, targets, 50, 0, 97, 3, "x")
    assert got(resample.resample_logs(logs, wanted.limit(0))) == drawn(rows, [])
    assert resample.resample_logs(logs.limit(0), wanted).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB1 é-"), max_size=80), st.integers(1, 9), st.integers(1, 3))
def test_long_texts_are_cut_between_words(text, step, longest):
    parts = list(resample.features(text.encode(), longest, step))
    assert sum(n for n, _ in parts) == len(words(text))
    assert Counter(f.decode() for _, found in parts for f in found) == Counter(runs(text, longest))


@pytest.mark.parametrize("seed", range(4))
def test_cutoff_is_the_exact_key(spark, monkeypatch, seed):
    for name, value in (("BLOCK", 50), ("LAST", 3)):
        monkeypatch.setattr(resample, name, value)
    rng = random.Random(seed)
    keys = [(rng.randrange(1 + 40 ** (seed % 3)), i) for i in range(1500)]
    rng.shuffle(keys)
    rows = frame(spark, keys, "a long, b long").repartition(5)
    rows = resample.materialize(rows, "keys")
    for wanted in (1, 2, 700, 1499):
        assert resample.cutoff(rows, ["a", "b"], wanted) == sorted(keys)[wanted - 1]
    assert resample.cutoff(rows, ["a", "b"], 0) is None and resample.cutoff(rows, ["a", "b"], 1500) is None


def test_rounds_stay_logarithmic(spark, monkeypatch):
    monkeypatch.setattr(resample, "LAST", 1)
    seen = []
    plain = resample._round
    monkeypatch.setattr(resample, "_round", lambda *a: seen.append(1) or plain(*a))
    rows = resample.materialize(spark.range(20000).selectExpr("-(id * 7919) % 20011 AS a", "id AS b").repartition(6), "keys")
    every = sorted(map(tuple, rows.collect()))
    assert resample.cutoff(rows, ["a", "b"], 5000) == every[4999]
    assert len(seen) < 40


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in documents(spark, small).collect()]
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in QUERIES["op13_resample"](spark, small).collect()]
    assert sorted(rows, key=repr) == sorted([(i, f, w, s, r) for i, _, f, w, s, r in drawn(docs, items)], key=repr)


def test_repeated_rows_each_have_a_rank(spark):
    rows = [(1, "a b c")] * 3 + [(2, "a b")]
    logs = frame(spark, rows, "job_id long, log string")
    told = resample.resample_logs(logs, frame(spark, [("a",)], "log string"), 100, 0).collect()
    assert sorted(r.rank for r in told) == [1, 2, 3, 4]
