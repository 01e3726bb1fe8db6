"""Web archives (WARC) of the files that capture jobs serve, with a Zstandard dictionary per archive.

A job's files are fetched by URL: reports, logs, mesh text, manifests. Most versions repeat, and all records
look alike at their heads. Each archive builds a dictionary from its own records, carries it in a leading
skippable frame, and compresses every record as a frame of its own, so any record can be read by its offset.
Contents that are stored already become revisit records without payload.

Tasks write archives straight to the shared folder, under names no other attempt uses. What counts is the
index, which Spark commits: an archive that a lost task has left behind is in no index and is never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm.spread import join_one
from facetlake.session import materialize, scratch_path

#: Payloads below this size are stored again rather than referred to.
REVISIT_FROM = 100
#: Uncompressed bytes of an archive, about.
ARCHIVE_BYTES = 64 << 20
#: Bytes of an archive's records that its dictionary is built from, at most (but whole records, one at least).
SAMPLE_BYTES = 4 << 20
#: Largest dictionary, and its share of the sample (one byte in so many).
DICTIONARY_BYTES, DICTIONARY_SHARE = 112_640, 50
LEVEL = 3
#: Fixed values of the archive formats.
SKIPPABLE, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:capture-file:"
_WRITTEN = "file_id long, archive string, start long, length long"
_READ = "file_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, intact boolean, payload binary"


# ---- records ---------------------------------------------------------------------------------------


def _uri(url: str | None, name: str) -> str:
    """A URL that fits a header line; a file without one goes by its name."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name


def _name(file_id: int | None) -> str:
    return f"{_URN}{'' if file_id is None else file_id}"


def record(file_id: int | None, url: str | None, payload: bytes, digest: str, date: str, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """One WARC record: a response, or a revisit if it refers to another file."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = _name(file_id)
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {_uri(url, name)}"]
    if refers_to is not None:
        first = _name(refers_to)
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: <{first}>", f"WARC-Refers-To-Target-URI: {_uri(refers_url, first)}"]
        payload = b""
    lines += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return b"".join(["\r\n".join(lines).encode(), b"\r\n\r\n", http, payload, b"\r\n\r\n"])


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def _number(urn: str | None) -> int | None:
    number = (urn or "").strip("<>").removeprefix(_URN)
    return int(number) if number else None


def parsed(raw: bytes) -> dict:
    """What one uncompressed record says; ``intact`` tells whether a stored payload has its stated digest and size."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    warc = _fields(head)
    block = rest[: int(warc["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    stated, digest = int(_fields(http)["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha256:")
    response = warc["WARC-Type"] == "response"
    return {
        "file_id": _number(warc["WARC-Record-ID"]), "url": warc["WARC-Target-URI"], "record_type": warc["WARC-Type"],
        "payload_bytes": len(payload) if response else stated,
        "payload_digest": hashlib.sha256(payload).hexdigest() if response else digest,
        "refers_to": _number(warc.get("WARC-Refers-To")),
        "intact": rest[len(block) :] == b"\r\n\r\n" and (not response or (len(payload) == stated and hashlib.sha256(payload).hexdigest() == digest)),
        "payload": payload if response else None,
    }


# ---- one archive ----------------------------------------------------------------------------------------


def dictionary(records: list[bytes]) -> bytes:
    """A dictionary built from whole records; too few for training stand for themselves."""
    total = sum(map(len, records))
    size = min(DICTIONARY_BYTES, max(256, total // DICTIONARY_SHARE))
    try:
        return zstandard.train_dictionary(size, records).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[:size]


class Writer:
    """One archive, written as its records come."""

    def __init__(self, folder: str, part: int):
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        name = f"files-{part:06d}-{uuid.uuid4().hex}.warc.zst"
        self.archive, self.out = f"{folder.rstrip('/')}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)
        self.waiting: list[tuple[int | None, bytes]] = []
        self.sample, self.taken, self.written, self.press = 0, 0, 0, None

    def _begin(self) -> Iterator[tuple]:
        built = dictionary([raw for _, raw in self.waiting])
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(built), write_content_size=True, write_checksum=True)
        stored = zstandard.ZstdCompressor(level=19).compress(built)
        self._put(struct.pack("<II", SKIPPABLE, len(stored)) + stored)
        held, self.waiting = self.waiting, []
        for file_id, raw in held:
            yield self._frame(file_id, raw)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _frame(self, file_id: int | None, raw: bytes) -> tuple:
        frame, start = self.press.compress(raw), self.written
        self._put(frame)
        return file_id, self.archive, start, len(frame)

    def add(self, file_id: int | None, raw: bytes) -> Iterator[tuple]:
        self.taken += len(raw)
        if self.press is None:
            self.waiting.append((file_id, raw))
            if self.taken >= SAMPLE_BYTES:
                yield from self._begin()
        else:
            yield self._frame(file_id, raw)

    def close(self) -> Iterator[tuple]:
        if self.press is None:
            yield from self._begin()
        self.out.close()


def frames(archive: str, step: int = 1 << 18) -> Iterator[bytes]:
    """All records of an archive, uncompressed, in their order; memory is that of one record."""
    system, path = fs.FileSystem.from_uri(archive)
    with system.open_input_stream(path, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{archive}: no dictionary in front")
        stored = source.read(size)
        built = zstandard.ZstdDecompressor().decompress(stored) if stored[:4] == ZSTD_MAGIC else stored
        press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(built))
        rest = source.read(step)
        while rest:
            frame, out = press.decompressobj(), []
            while not frame.eof:
                if not rest:
                    raise ValueError(f"{archive}: ends inside a record")
                out.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else source.read(step)
            yield b"".join(out)
            rest = rest or source.read(step)


# ---- tables of files -------------------------------------------------------------------------------------


def _repeats(files: DataFrame) -> DataFrame:
    """The first file of every payload that is worth referring to and occurs under several ids."""
    large = files.filter((F.length("_payload") >= REVISIT_FROM) & F.col("_digest").isNotNull()).select("_digest", "file_id", "url")
    named = F.when(F.col("file_id").isNotNull(), F.struct("file_id", "url"))
    grouped = large.groupBy("_digest").agg(F.min(named).alias("_first"), F.count("*").alias("_copies"))
    return grouped.filter((F.col("_copies") > 1) & F.col("_first").isNotNull()).select(
        "_digest", "_copies", F.col("_first.file_id").alias("_refers"), F.col("_first.url").alias("_refers_url")
    )


def write_archives(files: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a WARC record of every file; returns the committed index.

    Args:
        files: ``file_id`` (long), ``url`` and ``content`` (text) of the files that jobs serve; further columns are
            left out.
        folder: where archives go, a new one in the shared folder if None. Tasks write there through the
            file systems of ``pyarrow``: a shared mount or an object store.
        date: date of all records.
        archive_bytes: uncompressed size from which a task starts another archive.

    Returns:
        ``file_id``, ``archive``, ``start`` and ``length`` of its frame, a row per row of ``files``.

    Of files with equal contents of at least 100 bytes (UTF-8), that with the smallest id is a response, and those with
    another id revisit it; smaller contents are always responses. Rows that repeat both id and content are
    responses each, if theirs is the smallest id. A file with a null id is never referred to: it is a response
    unless a file with an id has the same content. Null content counts as empty; a null or empty url is replaced by the
    file's name, and characters that a header line cannot hold are percent-encoded. An empty table writes no archive and gives an
    empty index.
    """
    spark = files.sparkSession
    folder = folder or scratch_path(spark, "archives")
    payload = F.coalesce("content", F.lit("")).cast("binary")
    keyed = files.select(F.col("file_id").cast("long").alias("file_id"), "url", payload.alias("_payload")).withColumn("_digest", F.sha2("_payload", 256))
    first = materialize(_repeats(keyed), "first_files")
    records = join_one(keyed, first, "_digest", "_copies", keyed.count(), "file_id")
    known = F.when(~F.col("file_id").eqNullSafe(F.col("_refers")), F.col("_refers"))
    records = records.select("file_id", "url", "_payload", "_digest", known.alias("_refers"), "_refers_url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal writer
            for file_id, url, content, digest, refers, refers_url in zip(*batch.columns, strict=True):
                if writer is None:
                    writer = Writer(folder, TaskContext.get().partitionId())
                raw = record(file_id.as_py(), url.as_py(), content.as_py(), digest.as_py(), date, refers.as_py(), refers_url.as_py())
                yield from writer.add(file_id.as_py(), raw)
                if writer.taken >= archive_bytes:
                    yield from writer.close()
                    writer = None

        for batch in batches:
            yield _indexed(list(rows(batch)))
        if writer is not None:
            yield _indexed(list(writer.close()))

    return materialize(records.mapInArrow(run, _WRITTEN), "archive_index")


def _indexed(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file_id", "archive", "start", "length"])


def read_archives(spark: SparkSession, index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives that an index names, read from front to back.

    Returns:
        ``file_id``, ``url``, ``record_type``, ``payload_bytes`` and ``payload_digest`` (hex SHA-256, both of the full payload, as
        found for responses and as stated for revisits), ``refers_to``, ``intact``, ``payload`` (null for revisits,
        and for all if ``payloads`` is false).
    """
    archives = index.groupBy("archive").agg(F.sum("length").alias("_size"))
    number, size = archives.agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    # Archives are dealt out one by one: a shuffle of their names alone would look small enough for one task.
    tasks = max(1, min(number, max(4 * spark.sparkContext.defaultParallelism, size // (128 << 20))))
    names = [f.split()[0] for f in _READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                rows, held = [], 0
                for raw in frames(archive):
                    rows.append(parsed(raw) if payloads else parsed(raw) | {"payload": None})
                    held += len(raw) if payloads else 0
                    if len(rows) >= 1000 or held > 1 << 24:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return archives.select("archive").repartition(tasks).mapInArrow(run, _READ)
