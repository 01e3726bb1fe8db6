import hashlib
import random

from edge import EDGE, SPACED, frame, with_extra
from facetlake.llm.queries import QUERIES
from facetlake.llm.repeats import remove_repeats


def brute(rows, window):
    """Rows of (id, text) to (id, words, removed, hash of what stays)."""
    seen = {}
    for key, text in rows:
        ws = tuple(SPACED.findall(text or ""))
        for p in range(len(ws) - window + 1):
            if key is not None:
                w = ws[p : p + window]
                seen[w] = min(seen.get(w, key), key)
    out = []
    for key, text in rows:
        ws = SPACED.findall(text or "")
        gone = set()
        for p in range(len(ws) - window + 1):
            if key is not None and seen[tuple(ws[p : p + window])] < key:
                gone.update(range(p, p + window))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((key, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def compared(rows):
    return sorted(((r.job_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str)


def test_query_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op7_repeats"](spark, small).collect()), key=str)
    assert got == brute(docs, 50)


def test_planted_passages(spark):
    rng = random.Random(3)
    fresh = iter(f"w{i}" for i in range(10**6))
    passage = [next(fresh) for _ in range(140)]
    base = [next(fresh) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(EDGE)]
    for i in range(40):
        edited = list(base)
        for _ in range(i % 5):
            edited[rng.randrange(len(edited))] = next(fresh)
        a = rng.randrange(0, 90)
        rows.append((100 + i, " ".join([next(fresh) for _ in range(rng.randrange(80))] + passage[a : a + rng.choice([49, 50, 51, 80])] + edited[rng.randrange(200) :])))
    loop = ["x", "y", "z"] * 60
    rows += [(300, " ".join(loop)), (301, " ".join(loop[1:])), (302, "x " * 49), (303, "x " * 50), (304, "x " * 200), (305, "  ".join(base))]
    rows += [(305, " ".join(base)), (None, " ".join(base)), (306, "\t".join(base[:50])), (306, None)]
    rng.shuffle(rows)
    logs = frame(spark, rows, "job_id long, log string")
    got = remove_repeats(with_extra(logs).repartition(7)).collect()
    assert compared(got) == brute(rows, 50)
    assert compared(remove_repeats(logs, 8).collect()) == brute(rows, 8)
    for r in got:
        assert len(r.kept.split()) == r.n_words - r.n_removed or r.n_removed == 0
        assert all(s.source < r.job_id for s in r.spans)


def test_empty_table(spark):
    assert remove_repeats(frame(spark, [], "job_id long, log string")).count() == 0
