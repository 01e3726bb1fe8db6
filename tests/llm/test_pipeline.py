import corpus_pipeline
import pytest
from edge import EDGE, frame
from facetlake.llm import secrets
from facetlake.session import materialize
from pyspark.sql import functions as F
from test_alike import brute as alike_brute
from test_contamination import brute as hits
from test_tokens_and_secrets import plain_base


@pytest.fixture(scope="module")
def stages(spark, small):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = materialize(stage(spark, docs, small), "stage")
        out.append((name, docs.collect(), result.collect()))
        docs = result
    return out


def test_order_and_columns(spark, stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near copies", "decontamination", "secrets", "mix"]
    for _, _, after in stages[:-1]:
        assert after[0].asDict().keys() == set(corpus_pipeline.COLUMNS)


def test_toxic_documents_go(spark, small, stages):
    _, before, after = stages[0]
    kept = {r.doc_id for r in after}
    insults = ("idiot", "moron", "scum", "loser", "clown", "stupid", "worthless", "pathetic", "disgusting", "trash")
    clean = [r for r in before if not any(w in r.text.lower() for w in insults)]
    assert sum(r.doc_id in kept for r in clean) > 0.95 * len(clean)


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    want = {group for _, _, group in alike_brute([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id for r in after} == want and len(after) == len(want)


def test_contaminated_documents_go(spark, small, stages):
    _, before, after = stages[2]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert {r.doc_id for r in after} == {r.doc_id for r in before if not hits(r.text, items)[-1]}


def test_secrets_are_masked(stages):
    _, before, after = stages[3]
    text = {r.doc_id: r.text for r in before}
    assert len(after) == len(before)
    for r in after:
        assert plain_base(r.text) == [] and r.n_chars == len(r.text)
        if not secrets.spans_of(text[r.doc_id]):
            assert r.text == text[r.doc_id]


def test_mix_takes_the_budget(stages):
    _, before, after = stages[4]
    assert sum(r.taken for r in after) == sum(len(r.text.split()) for r in before)
    assert all(0 < r.taken <= 3 * r.size for r in after)


def test_run_equals_the_stages(spark, small, stages):
    got = corpus_pipeline.run(spark, small)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[-1][2]))


def test_stages_take_odd_documents(spark, small):
    rows = [(i, t, None, [None, "a", "b"][i % 3], 0) for i, t in enumerate(EDGE)]
    rows += [(3, None, "en", "a", None), (3, None, "en", "a", None), (None, "x y z", None, None, None), (40, "secret=abcdefghij", "en", "a", 17)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), small)
        assert empty.count() == 0
        docs = materialize(stage(spark, docs, small), "stage")
        assert docs.count() > 0
    assert docs.filter(F.col("text").contains(secrets.MARK)).count() == 1


def test_masks_join_overlaps():
    assert secrets.masked("0123456789", [(1, 4), (3, 5), (5, 6), (8, 9)]) == "0[secret][secret]67[secret]9"



CLASHES = ("name", "session_id", "log", "job_id", "path", "content", "size", "target", "taken", "spans", "sha256", "n_hex", "_key", "_size", "_id")


def test_extra_columns_with_taken_names(spark, small):
    """Every stage takes columns named like those that it uses inside, and leaves them out."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    docs = materialize(docs, "clash")
    for _, stage in corpus_pipeline.STAGES:
        plain = stage(spark, docs, small)
        clashing = stage(spark, docs.withColumns({n: F.lit(7) for n in CLASHES}), small)
        assert plain.columns == clashing.columns
        assert sorted(r.doc_id for r in plain.collect()) == sorted(r.doc_id for r in clashing.collect())
