import hashlib
from collections import Counter, defaultdict

import pytest
import sentencepiece
from edge import EDGE, documents, frame, with_extra
from facetlake.llm import alignment
from facetlake.llm.queries import QUERIES, piece_model, vocabulary
from facetlake.llm.token_counts import byte_of
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_model())


def encoded(libraries, text):
    """Ids and bytes of both libraries for a whole text; nothing if they do not keep it."""
    a, b = libraries
    byte = byte_of()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids_b for p in [b.id_to_piece(i)]]
    kept = text and b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode()
    return (ids_a, bytes_a, ids_b, bytes_b) if kept else ([], [], [], [])


def groups_of(libraries, text):
    ids_a, bytes_a, ids_b, bytes_b = encoded(libraries, text)
    ends = []
    for parts in (bytes_a, bytes_b):
        at, own = 0, []
        for p in parts:
            at += len(p)
            own.append(at)
        ends.append(own)
    both, out, lo = sorted(set(ends[0]) & set(ends[1])), [], 0
    for hi in both:
        out.append(tuple([i for i, e in zip(ids, own, strict=True) if lo < e <= hi] for ids, own in zip((ids_a, ids_b), ends, strict=True)))
        lo = hi
    return out


def expected(libraries, rows):
    known = {t: groups_of(libraries, t or "") for _, t in rows}
    count = Counter()
    for _, t in rows:
        count.update({(x, y) for a, b in known[t] for x in a for y in b})
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, t in rows:
        groups = known[t]
        links = [(x, y) for a, b in groups for x in a for y in b]
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        out.append((
            i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
            sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


ODD = ["a ", " a", "a  b", "  ", "   ", "a \n b", "x▁y", "don't  stop ", "<s> </s> <|endoftext|>", "½ ﬁ … b", "　 x", "a  b", "tab\t x", "é b", "」 b", "aaaa" * 50]


def test_edges(spark, libraries):
    rows = [(i, t) for i, t in enumerate([*EDGE, *ODD])] + [(None, "same text here"), (None, None), (7, "same text here")]
    rows += [(500 + i, "hot text of many jobs") for i in range(40)]
    logs = with_extra(frame(spark, rows, "job_id long, log string"))
    assert got(alignment.align_logs(logs, vocabulary(), piece_model())) == expected(libraries, rows)
    assert alignment.align_logs(logs.limit(0), vocabulary(), piece_model()).count() == 0


def test_chunks_do_not_matter(spark, small, libraries, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents(spark, small).limit(60).collect()]
    monkeypatch.setattr(alignment, "CHUNK", 3000)
    monkeypatch.setattr(alignment, "REMEMBERED", 500)
    logs = frame(spark, rows, "job_id long, log string")
    assert got(alignment.align_logs(logs, vocabulary(), piece_model())) == expected(libraries, rows)


ALIGNER = []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  's\n\t1é!。… ▁-Zq"), max_size=40))
def test_segments_equal_the_libraries(libraries, text):
    if not ALIGNER:
        ALIGNER.append(alignment.Aligner(open(vocabulary(), encoding="utf-8").read(), open(piece_model(), "rb").read()))
    segments = alignment.SEGMENT.findall(" " + text)
    assert "".join(segments) == " " + text
    found = ALIGNER[0].align(segments)
    whole = groups_of(libraries, text)
    said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in whole)
    said_of = {segments[k]: x for k, x in zip(found.order, found.said, strict=True)}
    assert (";".join(said_of[x] for x in segments) if text and found.kept.all() else "") == said


@settings(max_examples=50, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abx1é▁"), max_size=30), min_size=1, max_size=5))
def test_large_groups_count_the_same(libraries, words):
    aligner = alignment.Aligner(open(vocabulary(), encoding="utf-8").read(), open(piece_model(), "rb").read()) if not ALIGNER else ALIGNER[0]
    plain = aligner.align([" " + w for w in words])
    held, alignment.BIG_GROUP = alignment.BIG_GROUP, 1
    try:
        large = aligner.align([" " + w for w in words])
    finally:
        alignment.BIG_GROUP = held
    assert all(x == y if isinstance(x, list) else (x == y).all() for x, y in zip(plain, large, strict=True))


def test_vocabularies_that_reach_over_spaces_are_refused(spark, monkeypatch):
    monkeypatch.setattr(alignment.Aligner, "_piece", lambda self, i: b"a b")
    with pytest.raises(ValueError, match="reach over"):
        alignment.align_logs(frame(spark, [], "job_id long, log string"), vocabulary(), piece_model())


def test_query(spark, small, libraries):
    rows = [(r.doc_id, r.text) for r in documents(spark, small).collect()]
    assert got(QUERIES["op12_alignment"](spark, small)) == expected(libraries, rows)
