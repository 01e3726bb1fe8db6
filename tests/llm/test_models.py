import random
import zlib

import numpy as np
import pytest
from edge import EDGE, frame, with_extra
from facetlake.llm import languages, quality, toxicity
from facetlake.llm.queries import QUERIES
from facetlake.llm.training import held_out, sample_ids
from facetlake.llm.words import ALNUM, words
from pyspark.sql import functions as F

MIDDLE = "/root/testdata/sf0.01"


def joined(spark, name, other, sf=MIDDLE):
    return QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/{other}.parquet"), "doc_id").collect()


def test_folds_are_those_of_crc32(spark):
    ids = frame(spark, [(i,) for i in [0, 1, 7, 10**12, -5]], "doc_id long")
    for r in ids.select("doc_id", held_out("doc_id", 3, 1).alias("a"), held_out("doc_id", 5, 0).alias("b")).collect():
        crc = zlib.crc32(str(r.doc_id).encode())
        assert (r.a, r.b) == (crc % 3 == 1, crc % 5 == 0)


def test_samples_are_bounded_and_repeatable(spark):
    marks = frame(spark, [(i % 900, i % 3 == 0) for i in range(1000)] + [(None, True), (5, None)], "k long, y boolean")
    a = sorted(map(tuple, sample_ids(marks, "k", "y", 50).collect()))
    assert a == sorted(map(tuple, sample_ids(marks.repartition(9), "k", "y", 50).collect()))
    assert len(a) == 100 and len({k for k, _ in a}) == 100


# ---- languages


def test_language_held_out(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").collect()}
    rows = QUERIES["op3_language_id"](spark, MIDDLE).collect()
    assert len(rows) == len(docs)
    tested = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in tested) > 0.97 * len(tested)
    assert all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_network_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    net = languages.ByteNetwork(["a", "b", "c"])
    net.parameters = [p.astype(np.float64) for p in net.parameters]
    x, y = rng.integers(0, 256, (4, languages.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        return -np.log(net.probabilities(x)[np.arange(4), y]).mean()

    for p, g in zip(net.parameters, net._gradients(x, y), strict=True):
        for at in [np.unravel_index(i, p.shape) for i in np.argsort(-np.abs(g), axis=None)[:4]]:
            old = p[at]
            p[at] = old + 1e-6
            up = loss()
            p[at] = old - 1e-6
            down = loss()
            p[at] = old
            assert (up - down) / 2e-6 == pytest.approx(g[at], rel=1e-3, abs=1e-7)


def test_windows_cover_every_place_of_every_filter():
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (0, 1, 127, 128, 129, 253, 254, 1000)]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    x, row = languages.windows_of(data, off)
    wide = max(languages.WIDTHS)
    for r, text in enumerate(texts):
        grams = {w[i : i + wide] for w in (bytes(b) for b in x[row == r]) for i in range(languages.WINDOW - wide + 1)}
        assert {text[i : i + wide] for i in range(len(text) - wide + 1)} <= grams
        assert (row == r).sum() == max(1, -(-(len(text) - wide + 1) // (languages.WINDOW - wide + 1)))


def test_forward_pass_equals_naive_convolution():
    rng = np.random.default_rng(2)
    net = languages.ByteNetwork(["a", "b", "c"], seed=4)
    net.parameters[2] = rng.normal(0, 0.2, len(net.parameters[2])).astype(np.float32)
    x = rng.integers(0, 256, (3, languages.WINDOW)).astype(np.uint8)
    vectors, filters, shift, layer, bias = (p.astype(float) for p in net.parameters)
    for window, got in zip(x, net.probabilities(x), strict=True):
        spelled = [vectors[b] for b in window] + [vectors[0]] * (max(languages.WIDTHS) - 1)
        pooled = []
        for f in range(filters.shape[1]):
            reach = int(net.reach[f])
            sums = [sum(float(spelled[at + k] @ filters[k * languages.DIMENSION : (k + 1) * languages.DIMENSION, f]) for k in range(reach)) for at in range(languages.WINDOW)]
            pooled.append(max(0.0, max(sums) + shift[f]))
        logits = np.array(pooled) @ layer + bias
        want = np.exp(logits - logits.max())
        assert np.allclose(got, want / want.sum(), atol=1e-4)


def test_every_window_of_a_labelled_text_teaches(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(languages.ByteNetwork, "fit", lambda self, x, y: seen.append((x, y)) or self)
    texts = ["abcdefgh " * 2000, "kurz", "12 34 " * 50 + "x" * 500]
    rows = [(i, t, "en" if i != 1 else "de") for i, t in enumerate(texts)]
    languages.learn(frame(spark, rows, "session_id long, name string, lang string"))
    x, y = seen[0]
    want = 0
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        windows, _ = languages.windows_of(data, np.array([0, len(data)]))
        want += int((windows > 0x40).any(axis=1).sum())
    assert len(x) == len(y) == want


def test_language_edges(spark):
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(EDGE)] + [(None, "abc", "en"), (90, "12 34 !!", "de")]
    sessions = frame(spark, rows, "session_id long, name string, lang string")
    got = languages.session_languages(with_extra(sessions), sessions).collect()
    assert len(got) == len(rows)
    for r in got:
        lettered = r.name is not None and any(c.isalpha() for c in r.name)
        assert r.lang_pred in (("en", "de") if lettered else ("und",)) and 0 <= r.lang_score <= 1
        assert lettered or r.lang_score == 0
    nothing = languages.session_languages(sessions, sessions.filter("lang = 'xx'")).collect()
    assert {(r.lang_pred, r.lang_score) for r in nothing} == {("und", 0.0)}
    assert languages.session_languages(sessions.limit(0), sessions).count() == 0


# ---- quality


def test_quality_held_out(spark):
    rows = joined(spark, "op4_quality", "labels")
    tested = [r for r in rows if r.held_out]
    good, bad = [r.score for r in tested if r.quality == 1], [r.score for r in tested if r.quality == 0]
    assert np.mean([r.predicted for r in tested if r.quality == 1]) > 0.95
    assert np.mean([b < g for b in bad for g in good]) + 0.5 * np.mean([b == g for b in bad for g in good]) > 0.8
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    labels = rng.integers(0, 2, 90)
    counts = rng.poisson(0.05 + 0.3 * labels[:, None] * (np.arange(quality.TERMS) % 7 == 0), (90, quality.TERMS))
    model = quality.voters(counts, labels)
    test = rng.poisson(0.1, (20, quality.TERMS))
    a, b = model.project(test), model.project(counts)
    for i, score in enumerate(model.scores(test)):
        cosine = b @ a[i]
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        vote = np.maximum(cosine[near], 1e-6) ** 2
        assert score == pytest.approx((vote * labels[near]).sum() / vote.sum(), abs=1e-5)


def test_trigrams_stay_inside_texts():
    texts = [b"", b"a", b"abab", b"\n", b"x x  x y", b"x"]
    data, off = np.frombuffer(b"".join(texts), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    counts = quality.term_counts(data, off)
    assert counts[:, : quality.TRIGRAMS].sum(1).tolist() == [len(t) for t in texts]
    assert counts[:, -1].tolist() == [0, 0, 0, 0, 2, 0]
    for r, t in enumerate(texts):
        alone = quality.term_counts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert (alone[0] == counts[r]).all()


def test_quality_edges(spark):
    logs = frame(spark, [*enumerate(EDGE), (None, "x")], "job_id long, log string")
    marks = frame(spark, [(0, 1), (1, 0), (5, 1), (6, None), (None, 1), (5, 0), (99, 1)], "job_id long, useful int")
    got = quality.log_quality(with_extra(logs), marks).collect()
    assert len(got) == len(EDGE) + 1 and all(0 <= r.useful_score <= 1 for r in got)
    assert {r.useful_score for r in quality.log_quality(logs, marks.limit(0)).collect()} == {0.5}
    assert quality.log_quality(logs.limit(0), marks).count() == 0


# ---- toxicity


def corpus(seed, n):
    """Made-up words; toxic texts have an insult with a random ending now and then."""
    rng = random.Random(seed)
    syllables = ["ta", "ro", "mi", "sel", "bo", "kan", "der", "li", "fu", "pe"]
    stems = ["grontch", "vilpax", "smurgle"]
    texts, labels = [], []
    for i in range(n):
        ws = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(5, 250))]
        if i % 3 == 0:
            for _ in range(1 + len(ws) // 60):
                ws[rng.randrange(len(ws))] = rng.choice(stems) + "".join(rng.choices(syllables, k=rng.randint(0, 2)))
        texts.append(" ".join(ws))
        labels.append(int(i % 3 == 0))
    return texts, labels


def scores(model, texts):
    raw = [t.lower().encode() for t in texts]
    return model.scores(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))


def test_unseen_endings_and_misspellings_are_toxic():
    model = toxicity.train(*corpus(1, 400))
    texts, labels = corpus(2, 200)
    got = scores(model, texts)
    assert np.mean((got >= 0.5) == np.array(labels)) > 0.95
    plain = "taro misel bokan derli fupe talimi robo " * 4
    hit = scores(model, [plain, plain + "grontsch", plain + "vilpaxx", plain + "smurrgle", ""])
    assert hit[0] < 0.5 and hit[4] < 0.5 and (hit[1:4] > hit[0] + 0.2).all()


def test_scores_are_the_worst_passage_by_plain_averages():
    model = toxicity.ToxicModel(np.random.default_rng(4).normal(size=toxicity.BUCKETS).astype(np.float32), 0.3)
    texts, _ = corpus(5, 12)
    texts += ["", "one", "ab ab ab ab", "x" * 500]
    for text, score in zip(texts, scores(model, texts), strict=True):
        ws = text.split()
        value = {}
        for w in set(ws):
            data = np.frombuffer(w.encode(), np.uint8)
            which, bucket = toxicity.subwords(data, words(data, np.array([0, len(data)]), ALNUM))
            closed = f" {w} "
            assert len(bucket) == sum(max(0, len(closed) - n + 1) for n in toxicity.SIZES) and not which.any()
            value[w] = (model.weight[bucket].sum(), len(bucket))
        size = toxicity.PASSAGE
        starts = sorted({min(s, max(0, len(ws) - size)) for s in range(0, max(1, len(ws) - size + 4), 4)})
        means = [sum(value[w][0] for w in set(ws[s : s + size])) / max(1, sum(value[w][1] for w in ws[s : s + size])) for s in starts] if ws else [0.0]
        assert score == pytest.approx(1 / (1 + np.exp(-(max(means) + 0.3))), abs=1e-5)


def test_toxicity_query(spark):
    rows = joined(spark, "op9_toxicity", "labels")
    clean = [r for r in rows if r.held_out and r.toxic == 0]
    assert np.mean([r.predicted == 0 for r in clean]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert QUERIES["op9_toxicity"](spark, MIDDLE).count() == 1000


def test_toxicity_edges(spark):
    sessions = frame(spark, [*enumerate(EDGE), (None, "x")], "session_id long, name string")
    marks = frame(spark, [(0, 1), (1, 0), (5, 1), (6, None), (None, 1), (5, 0), (99, 1)], "session_id long, toxic int")
    got = toxicity.session_toxicity(with_extra(sessions), marks).collect()
    assert len(got) == len(EDGE) + 1 and all(0 <= r.toxic_score <= 1 for r in got)
    assert len({r.toxic_score for r in got if not (r.name or "").strip()}) == 1
    none = toxicity.session_toxicity(sessions, marks.limit(0)).collect()
    assert all(r.toxic_score < 0.01 for r in none)
    assert toxicity.session_toxicity(sessions.limit(0), marks).count() == 0
    assert sessions.select(F.col("name")).count() == len(got)


def test_toxicity_learns_from_whole_texts(spark):
    """Insults that stand after 12,000 clean characters are learnt, and the tasks' coding changes nothing."""
    rng = random.Random(3)
    plain = lambda n: " ".join("".join(rng.choices(["ta", "ro", "mi", "sel", "bo", "kan"], k=3)) for _ in range(n))
    rows = [(i, plain(1800) + (" grontch vilpax smurgle" * 5 if i % 2 else " taromi selbo kanta" * 5)) for i in range(60)]
    assert min(r[1].find("grontch") for r in rows if r[0] % 2) > 12_000
    sessions, marks = frame(spark, rows, "session_id long, name string"), frame(spark, [(i, i % 2) for i, _ in rows], "session_id long, toxic int")
    model = toxicity.learn(sessions.repartition(3), marks)
    got = scores(model, [t for _, t in rows] + [plain(30) + " grontch vilpax smurgle", plain(33)])
    assert ((got >= 0.5) == np.array([i % 2 == 1 for i, _ in rows] + [True, False])).all()
    rows.sort(key=lambda r: str(r[0]))
    whole = toxicity.train([t for _, t in rows], [i % 2 for i, _ in rows])
    assert np.array_equal(model.weight, whole.weight) and model.bias == whole.bias
