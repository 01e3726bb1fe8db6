import hashlib

import pytest
import xxhash
from edge import EDGE, SPACED, frame, with_extra
from facetlake.llm.fingerprints import SCALE, mesh_sketches, re_export_report
from facetlake.llm.queries import QUERIES


def of_longs(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v % (1 << 64)).to_bytes(8, "little"), seed=seed)
    return seed


def kept(text):
    hashed = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in SPACED.findall(text or "")]
    if not hashed:
        return set()
    every = {of_longs(hashed[i : i + 5]) for i in range(len(hashed) - 4)} if len(hashed) >= 5 else {of_longs(hashed)}
    return {h for h in every if h < (1 << 64) // SCALE} | {min(every)}


def printed(s):
    return ".".join(f"{h:016x}" for h in sorted(s))


def near(a, b):
    return len(a & b) / min(len(a), len(b)) if a and b else float(len(a) == len(b))


def brute(rows):
    """``rows``: distinct ids and texts."""
    order = sorted(rows, reverse=True)
    out = {}
    for at, key in enumerate(order):
        text, nxt = rows[key] or "", rows[order[(at + 1) % len(order)]] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + nxt[:third]
        a, b = kept(text), kept(edited)
        out[key] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(a), printed(b), near(a, b), near(a, kept(nxt)))
    return out


def fields(r, key):
    return r[key], (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)


def test_query_equals_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = dict(fields(r, "doc_id") for r in QUERIES["op10_fingerprints"](spark, small).collect())
    want = brute(docs)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][:4] == want[k][:4] and got[k][4:] == pytest.approx(want[k][4:]), k
    assert sum(v[4] for v in got.values()) / len(got) > 0.5 > sum(v[5] for v in got.values()) / len(got)


def test_edges(spark):
    rows = {i * 3: t for i, t in enumerate(EDGE)}
    meshes = frame(spark, list(rows.items()), "mesh_id long, mesh_text string")
    got = dict(fields(r, "mesh_id") for r in re_export_report(with_extra(meshes).repartition(5)).collect())
    want = brute(rows)
    for k in want:
        assert got[k][:4] == want[k][:4] and got[k][4:] == pytest.approx(want[k][4:]), (k, rows[k])
    one = re_export_report(meshes.filter("mesh_id = 18")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert re_export_report(meshes.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, None), (2, "h i j k l m n o p"), (None, "q r s"), (None, None)]
    got = re_export_report(frame(spark, rows, "mesh_id long, mesh_text string")).collect()
    assert sorted(str(r.mesh_id) for r in got) == ["1", "1", "1", "2", "None", "None"]


def test_equal_texts_and_containment(spark):
    long = " ".join(f"v{i} 0.{i} 1 {i % 7}" for i in range(4000))
    part = " ".join(long.split()[1000:2500])
    rows = mesh_sketches(frame(spark, [(1, long), (2, long), (3, part)], "mesh_id long, mesh_text string")).collect()
    assert rows[0].fingerprint == rows[1].fingerprint
    assert near(set(rows[0].sketch), set(rows[2].sketch)) > 0.97 and len(rows[2].sketch) < len(rows[0].sketch) / 5


def test_no_python_in_the_plan(spark, small):
    plan = QUERIES["op10_fingerprints"](spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_likeness_is_exact_containment(spark, small):
    """Both likenesses against plain 5-word shingles, short texts among them; a short text inside a long one reads 1."""

    def shingles(text):
        ws = SPACED.findall(text or "")
        return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    docs |= {10**9 + i: " ".join(f"w{j}" for j in range(i * 30, i * 30 + (14, 200)[i % 2])) for i in range(40)}
    docs[10**9 + 100], docs[10**9 + 101] = " ".join(f"v{j}" for j in range(3000)), " ".join(f"v{j}" for j in range(50, 64))
    order = sorted(docs, reverse=True)
    got = {r.mesh_id: r for r in re_export_report(frame(spark, list(docs.items()), "mesh_id long, mesh_text string")).collect()}
    assert got[10**9 + 101].near_next == 1.0
    short = 0
    for at, key in enumerate(order):
        text, nxt = docs[key] or "", docs[order[(at + 1) % len(order)]] or ""
        third = len(text) // 3
        a = shingles(text)
        short += len(a) < 80
        assert got[key].near_edited == pytest.approx(near(a, shingles(text[: len(text) - third] + nxt[:third]))), key
        assert got[key].near_next == pytest.approx(near(a, shingles(nxt))), key
    assert short > 40
