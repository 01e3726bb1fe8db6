import hashlib
import random
import re

from edge import EDGE, frame, with_extra
from facetlake.llm.contamination import contaminated_logs
from facetlake.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    words, hit, ids = cut(text), set(), set()
    for item, body in items:
        iw = cut(body)
        size = min(13, len(iw))
        for at in range(len(iw) - size + 1 if iw else 0):
            window = iw[at : at + size]
            for p in range(len(words) - size + 1):
                if words[p] == window[0] and words[p : p + size] == window:
                    hit.update(range(p, p + size))
                    ids.add(str(item))
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(words), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


def test_query_equals_brute_force(spark, small):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = QUERIES["op5_contamination"](spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(docs[r.doc_id], items), r.doc_id
    assert any(r.contaminated for r in rows)


def planted():
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "dé", "E", "f1", "日本"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 13, 14, 30])))) for i in range(40)]
    items += [(900, items[3][1]), (901, None), (902, ""), (903, " -- "), (904, "A"), (905, "zz " * 20)]
    texts = list(EDGE)
    for _ in range(60):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(3)]
        parts.insert(1, rng.choice(items)[1] or "")
        texts.append(rng.choice([" ", "-", ", "]).join(parts).upper() if rng.random() < 0.3 else " ".join(parts))
    return items, texts


def test_edges_ties_and_blocks(spark):
    items, texts = planted()
    frame_items = frame(spark, [*items, (None, "a b c")], "item_id long, text string")
    logs = frame(spark, [*enumerate(texts), (3, texts[30]), (3, texts[30])], "job_id long, log string")
    want = sorted((i, *brute(t, items)) for i, t in [*enumerate(texts), (3, texts[30]), (3, texts[30])])
    for block in (20_000, 7):
        got = contaminated_logs(with_extra(logs), frame_items, block_items=block).collect()
        assert sorted((r.job_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
        for r in got:
            assert sum(s.end - s.start for s in r.spans) == r.n_hit and (r.longest > 0) == (r.n_hit > 0)


def test_empty_tables_and_longest(spark):
    logs = frame(spark, [(1, "q " + " ".join(f"w{i}" for i in range(30)) + " q")], "job_id long, log string")
    items = frame(spark, [(5, " ".join(f"w{i}" for i in range(25)))], "item_id long, text string")
    row = contaminated_logs(logs, items).first()
    assert (row.n_hit, row.longest, row.spans[0].start, row["items"]) == (25, 25, 1, ["5"])
    assert contaminated_logs(logs, items.limit(0)).first().n_hit == 0
    assert contaminated_logs(logs.limit(0), items).count() == 0
