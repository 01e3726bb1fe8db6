import hashlib
import struct

import pytest
import zstandard
from edge import EDGE, documents, frame, with_extra
from facetlake.llm import archive
from facetlake.llm.queries import QUERIES

FILES = "file_id long, url string, content string"


def expected(rows):
    """Brute force: every row against all others."""
    out = []
    for i, _, content in rows:
        payload = (content or "").encode()
        others = [j for j, _, c in rows if (c or "").encode() == payload and j is not None]
        first = min(others) if others and len(payload) >= 100 else None
        refers = first if first is not None and first != i else None
        out.append((i, "response" if refers is None else "revisit", len(payload), hashlib.sha256(payload).hexdigest(), refers))
    return sorted(out, key=repr)


def found(read):
    rows = read.collect()
    assert all(r.intact for r in rows)
    return sorted([(r.file_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in rows], key=repr)


def round_trip(spark, rows, **options):
    files = with_extra(frame(spark, rows, FILES))
    index = archive.write_archives(files, **options)
    return index, archive.read_archives(spark, index)


def test_edges_round_trip(spark):
    rows = [(i, f"/api/jobs/{i}/files/log.txt", t) for i, t in enumerate(EDGE)]
    rows += [(90, None, "p" * 100), (70, "a b\r\nX: y", "p" * 100), (70, "/x", "p" * 100), (91, "", "p" * 99), (92, "/é?q=1", "p" * 99), (None, None, "p" * 100)]
    rows += [(None, "/n", "q" * 200), (None, "/n", "q" * 200), (5, "/zz", "word " * 3000), (93, "/v", "x\r\n\r\nWARC/1.1\r\n\r\n" * 20)]
    index, read = round_trip(spark, rows)
    assert found(read) == expected(rows)
    stored = [r for r in read.collect() if r.record_type == "response"]
    assert {(r.file_id, bytes(r.payload)) for r in stored} <= {(i, (c or "").encode()) for i, _, c in rows}
    assert {bytes(r.payload) for r in stored} == {(c or "").encode() for _, _, c in rows}
    assert index.count() == len(rows)
    assert {r.url for r in read.collect() if r.file_id == 70} == {"a%20b%0D%0AX:%20y", "/x"}


def test_records_can_be_read_alone(spark, small):
    files = documents(spark, small).selectExpr("doc_id AS file_id", "lang AS url", "text AS content")
    index = archive.write_archives(files, archive_bytes=200_000)
    rows = index.collect()
    assert len({r.archive for r in rows}) > 1
    texts = {r.file_id: (r.content or "").encode() for r in files.collect()}
    for name in {r.archive for r in rows}:
        with open(name.removeprefix("file:"), "rb") as file:
            raw = file.read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        built = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size])
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(built))
        own = sorted((r for r in rows if r.archive == name), key=lambda r: r.start)
        assert own[0].start == 8 + size and own[-1].start + own[-1].length == len(raw)
        for r in own:
            said = archive.parsed(press.decompress(raw[r.start : r.start + r.length]))
            assert said["file_id"] == r.file_id and said["payload"] in (None, texts[r.file_id])


def test_dictionary_is_used(spark):
    rows = [(i, f"/f/{i}", f"<html><head><title>{i}</title></head><body class='report'>capture number {i * 7919}, all well</body></html>") for i in range(600)]
    index = archive.write_archives(frame(spark, rows, FILES).coalesce(1))
    plain = sum(len(zstandard.ZstdCompressor(level=3).compress(archive.record(i, u, c.encode(), hashlib.sha256(c.encode()).hexdigest(), "1970-01-01T00:00:00Z"))) for i, u, c in rows)
    assert index.agg({"length": "sum"}).first()[0] < 0.5 * plain


def test_what_no_index_names_is_not_read(spark):
    rows = [(i, "/f", "x" * 500 + str(i)) for i in range(10)]
    index, _ = round_trip(spark, rows)
    folder = index.first().archive.rsplit("/", 1)[0].removeprefix("file:")
    with open(f"{folder}/files-000000-lost.warc.zst", "wb") as file:
        file.write(b"half an archive")
    assert found(archive.read_archives(spark, index)) == expected(rows)


def test_empty_and_broken(spark, tmp_path):
    _, read = round_trip(spark, [(1, "/f", "x")])
    assert read.count() == 1
    empty = archive.write_archives(frame(spark, [], FILES))
    assert empty.count() == 0 and archive.read_archives(spark, empty).count() == 0
    cut = tmp_path / "cut.warc.zst"
    writer = archive.Writer(str(tmp_path), 0)
    list(writer.add(1, archive.record(1, "/f", b"x" * 5000, "0", "1970-01-01T00:00:00Z")))
    list(writer.close())
    with open(writer.archive, "rb") as file:
        cut.write_bytes(file.read()[:-3])
    with pytest.raises(ValueError, match="ends inside"):
        list(archive.frames(str(cut)))


def test_large_group_of_copies(spark):
    rows = [(i, f"/f/{i}", "copy " * 40 if i % 3 else f"own text {i} " * 20) for i in range(3000)]
    _, read = round_trip(spark, rows)
    assert found(read.repartition(3)) == expected_fast(rows)


def expected_fast(rows):
    first = {}
    for i, _, c in rows:
        first[c] = min(i, first.get(c, i))
    out = [(i, "response" if first[c] == i else "revisit", len(c), hashlib.sha256(c.encode()).hexdigest(), None if first[c] == i else first[c]) for i, _, c in rows]
    return sorted(out, key=repr)


def test_query(spark, small):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    got = sorted([(r.page_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in QUERIES["op11_archive"](spark, small).collect()], key=repr)
    assert got == expected(pages)
