"""Secrets in the files of capture jobs, found once per distinct content.

Jobs keep every version of their settings, logs and manifests, and most versions repeat. A ledger
holds what was found in each pair of content (by its SHA-256) and rule version. A run hashes every
version, scans only contents whose pair the ledger lacks, adds them to it and joins the findings
back to every path and version. Contents are told apart before the scan by a shuffle on the hash,
combined in each task first, so copies travel once per task at most.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetlake.session import scratch_path

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE = KINDS[:3]
RULE_VERSION = "2024-2"
#: What a masked secret reads as.
MARK = "[secret]"
FINDINGS = "spans array<struct<kind:string,start:int,end:int>>, n_assign long, n_access long, n_hex long, base_sha256 string, spans_text string"

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_LONG = (
    ("access", re.compile(r"AKIA[A-Z0-9]{12,}")),
    ("hex", re.compile(r"[0-9a-f]{32,}")),
    ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
)

_PEM_EDGE = re.compile(r"-----(BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----")
# Line ends may be escaped, as in JSON; encrypted keys have header lines.
_PEM_HEADS = r"(?:(?:\s|\\[nr])*+[A-Za-z-]{2,20}:\x20[^\r\n\\]*+(?=[\r\n\\]))*+"
_PEM_WHOLE = re.compile(rf"""{_PEM_HEADS}(?:[A-Za-z0-9+/=\s"',>|#]|\\[nr])*+""")
_PEM_CUT = re.compile(rf"{_PEM_HEADS}(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{{16,}}+)*+(?:(?:\r?\n|\\n)[A-Za-z0-9+/=]++(?=\s*(?:[\r\n\\]|$)))?")


def _key_ends(content: str) -> dict[int, int]:
    """Where the private key that begins at each BEGIN line ends: with its END line, or where its base64 lines stop."""
    edges = list(_PEM_EDGE.finditer(content))
    ends = {}
    for edge, after in zip(edges, [*edges[1:], None], strict=True):
        if edge[1] == "BEGIN":
            closed = after is not None and after[1] == "END" and _PEM_WHOLE.fullmatch(content, edge.end(), after.start())
            ends[edge.start()] = after.end() if closed else _PEM_CUT.match(content, edge.end()).end()
    return ends


def spans_of(content: str) -> list[tuple[str, int, int]]:
    """All spans of one content as (kind, start, end) in code points, by start, then kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(content) if m.end(1) - m.start(1) >= 8]
    # A run that must have 12 or 32 characters matches exactly where the open run of that length does.
    for kind, pattern in _LONG:
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(content)]
    if any(s[0] == "pem" for s in found):
        ends = _key_ends(content)
        found = [(kind, start, ends.get(start, end) if kind == "pem" else end) for kind, start, end in found]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


_ARROW = pa.schema(
    [
        ("sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
        ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
        ("base_sha256", pa.string()), ("spans_text", pa.string()),
    ]
)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, content in zip(batch.column("sha256").to_pylist(), batch.column("_content"), strict=True):
            spans = spans_of(content.as_py())
            base = [s for s in spans if s[0] in BASE]
            rows.append({
                "sha256": key, "spans": [{"kind": k, "start": a, "end": b} for k, a, b in spans],
                **{f"n_{kind}": sum(s[0] == kind for s in base) for kind in BASE},
                "base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans_text": _joined(spans),
            })
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


#: Columns of a finding.
_FOUND = ("sha256", "spans", "n_assign", "n_access", "n_hex", "base_sha256", "spans_text")


def scan_files(files: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """Findings of every file version.

    Args:
        files: ``job_id``, ``path``, ``version``, ``content``, and any further columns, which stay.
        ledger: folder of the ledger, kept between runs; None takes a new one in the shared folder.
        rule_version: names the rules; a new name scans every content again.

    Returns:
        The columns of ``files`` without those named like a finding, and ``sha256``, ``spans``
        (kind, start, end; code points, end exclusive), ``n_assign``, ``n_access``, ``n_hex``,
        ``base_sha256`` (hash of the base spans), ``spans_text``.

    Null content counts as empty, which has no spans. Copies share one scan; repeated rows stay
    repeated; an empty table gives an empty result. Only whole contents are scanned. A run that
    fails before its rows are in the ledger leaves the ledger as it was.
    """
    spark = files.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    names = list(_FOUND)
    keyed = files.drop(*names).withColumn("sha256", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256))
    contents = keyed.select("sha256", F.coalesce("content", F.lit("")).alias("_content"))
    known = _known(files, ledger, rule_version)
    if known is not None:
        contents = contents.join(known.select("sha256"), "sha256", "left_anti")
    unseen = contents.dropDuplicates(["sha256"])
    found = unseen.mapInArrow(_scan, f"sha256 string, {FINDINGS}")
    found.withColumn("rule_version", F.lit(rule_version)).write.mode("append").partitionBy("rule_version").parquet(ledger)
    rows = _known(files, ledger, rule_version)
    if rows is None:
        rows = spark.createDataFrame([], f"sha256 string, {FINDINGS}")
    return keyed.join(rows.dropDuplicates(["sha256"]), "sha256").select(*[c for c in keyed.columns if c != "sha256"], *names)


def _known(files: DataFrame, ledger: str, rule_version: str) -> DataFrame | None:
    """What the ledger has under this rule version; None while it has no rows at all."""
    spark = files.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    schema = f"sha256 string, {FINDINGS}, rule_version string"
    return spark.read.schema(schema).parquet(ledger).filter(F.col("rule_version") == rule_version).drop("rule_version")


def masked(content: str, spans: list[tuple[int, int]]) -> str:
    """``content`` with every stretch that spans cover replaced by one mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if not out or start >= at:
            out += [content[at:start], MARK]
        at = max(at, end)
    return "".join([*out, content[at:]])


def mask_files(files: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """The files with every secret in ``content`` replaced by ``MARK``; all columns and rows stay.

    See ``scan_files``. Overlapping spans become one mark; null content stays null.
    """
    own = {c: f"_own_{c}" for c in files.columns if c in _FOUND}
    found = scan_files(files.withColumnsRenamed(own), ledger, rule_version)
    columns = [c for c in found.columns if c not in _FOUND or c == "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, spans = batch.column("content").to_pylist(), batch.column("spans").to_pylist()
            new = [masked(c, [(s["start"], s["end"]) for s in x]) if x else c for c, x in zip(content, spans, strict=True)]
            names = [n for n in batch.schema.names if n != "spans"]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == "content" else batch.column(n) for n in names], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*columns).schema.fields if f.name != "spans")
    return found.select(*columns).mapInArrow(run, fields).withColumnsRenamed({b: a for a, b in own.items()}).select(*files.columns)
