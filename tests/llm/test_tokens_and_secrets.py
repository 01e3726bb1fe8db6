import hashlib
import random
import re

import pytest
from edge import EDGE, frame, with_extra
from facetlake.llm import secrets, token_counts
from facetlake.llm.queries import QUERIES, vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

KEY = "AKIA" + "ABCDEFGH1234"
HEX = "0123456789abcdef" * 2
TEXTS = [
    f'password = "{HEX}" {KEY} {HEX}', "TOKEN:abcdefgh", "token=secret: abcdefghij", "api_key='12345678'", "apikey=1234567", "ſecret=abcdefghi",
    KEY[:-1], "AKIAAKIA" + "B" * 12, "g" + HEX + "0", HEX[:-1], "é" * 9 + " passwd : aaaaaaaaaaa", "secret=token=abcdefgh",
    "-----BEGIN RSA PRIVATE KEY-----", "x" * 50000 + " secret=abcdefgh",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(vocabulary())


def test_tokens_equal_the_library(spark, small, tokenizer):
    rows = {r.doc_id: r for r in QUERIES["op2_token_counts"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n = len(tokenizer.encode(d.text or "", add_special_tokens=False).ids)
        assert (rows[d.doc_id].n_tokens, rows[d.doc_id].n_bytes, rows[d.doc_id].over_limit) == (n, len((d.text or "").encode()), n > 1024)


def test_tokens_edges(spark, tokenizer):
    logs = frame(spark, [(i, t) for i, t in enumerate(EDGE)] + [(None, "x")], "job_id long, log string")
    got = {r.job_id: r.n_tokens for r in token_counts.log_tokens(with_extra(logs), vocabulary()).collect()}
    assert got == {i: len(tokenizer.encode(t or "").ids) for i, t in enumerate(EDGE)} | {None: 1}
    assert token_counts.log_tokens(logs.limit(0), vocabulary()).count() == 0


def test_every_character_is_cut_as_by_the_library(tokenizer):
    import unicodedata

    counter = token_counts._Counter(open(vocabulary(), encoding="utf-8").read(), token_counts.whole_tokens(vocabulary()))
    known = [chr(c) for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
    texts = [f"a{c}b {c}{c}1 {c}" for c in known]
    assert counter.count(texts) == [len(e.ids) for e in tokenizer.encode_batch(texts)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab 's\n\t1é!。<|endoftext|> "), max_size=40), max_size=5))
def test_counter_on_random_texts(tokenizer, texts):
    if not COUNTER:
        COUNTER.append(token_counts._Counter(open(vocabulary(), encoding="utf-8").read(), token_counts.whole_tokens(vocabulary())))
    assert COUNTER[0].count(texts) == [len(tokenizer.encode(t).ids) for t in texts]


COUNTER = []


def plain_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 8:
            found.append(("assign", *m.span()))
    found += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_secrets_equal_brute_force(spark, small):
    rows = {r.doc_id: r for r in QUERIES["op6_secrets"](spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        base = plain_base(d.text or "")
        want = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        r = rows[d.doc_id]
        assert r.base_sha256 == want and (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in base) for k in secrets.BASE)



def test_secret_rules_on_hard_texts():
    for text in TEXTS:
        assert [s for s in secrets.spans_of(text) if s[0] in secrets.BASE] == plain_base(text), text
    assert secrets.spans_of(TEXTS[-2])[0][0] == "pem"


def test_ledger_scans_each_content_and_rule_version_once(spark, tmp_path):
    ledger = str(tmp_path / "ledger")
    rows = [(i, "a/b", v, t) for i, t in enumerate([*EDGE, *TEXTS, TEXTS[0]]) for v in (1, 2)]
    files = frame(spark, rows, "job_id long, path string, version int, content string")
    first = secrets.scan_files(with_extra(files), ledger)
    again = secrets.scan_files(files, ledger)
    assert first.count() == again.count() == len(rows)
    held = spark.read.parquet(ledger)
    distinct = len({t or "" for t in [*EDGE, *TEXTS]})
    assert held.count() == distinct and held.select("sha256").distinct().count() == distinct
    more = frame(spark, [(1, "c", 3, "new secret=abcdefgh"), (1, "c", 3, "new secret=abcdefgh")], files.schema)
    assert [r.n_assign for r in secrets.scan_files(more, ledger).collect()] == [1, 1]
    assert spark.read.parquet(ledger).count() == distinct + 1
    secrets.scan_files(more, ledger, "other").collect()
    assert spark.read.parquet(ledger).count() == distinct + 2
    for r in first.collect():
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert spans == secrets.spans_of(r.content or "")
    assert secrets.scan_files(files.limit(0)).count() == 0


def test_private_keys_are_masked_whole(spark):
    rng = random.Random(5)
    lines = ["".join(rng.choices("ABCDEFGHabcdefgh0123456789+/", k=64)) for _ in range(6)] + ["QUJDREVGRw=="]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    heads = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0011", ""]
    texts = ["\n".join(["before", begin, *body, *tail, "after it."]) for body in (lines, [*heads, *lines]) for tail in ([end], [])]
    texts += ["before " + sep.join([begin, *lines, end]) + " after it." for sep in (" ", "\r\n", "\\n", "")]
    files = frame(spark, list(enumerate([*texts, f"before {begin} and after it."])), "job_id long, content string").selectExpr("job_id", "'p' path", "1 version", "content")
    got = {r.job_id: r.content for r in secrets.mask_files(files).collect()}
    for i in range(len(texts)):
        assert not any(line in got[i] for line in lines) and "END RSA" not in got[i], (i, got[i])
        assert got[i].split() == ["before", secrets.MARK, "after", "it."], (i, got[i])
    assert got[len(texts)] == f"before {secrets.MARK} and after it."


def test_masking_keeps_columns_named_like_findings(spark):
    files = frame(spark, [(1, "a", 1, f"token={HEX} x", "own", 5)], "job_id long, path string, version int, content string, spans string, n_hex int")
    masked = secrets.mask_files(files)
    assert masked.columns == files.columns
    assert tuple(masked.first()) == (1, "a", 1, f"{secrets.MARK} x", "own", 5)
