"""The numbered queries: the given tables mapped to the operators' records and back."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.llm import alignment, alike, archive, contamination, fingerprints, languages, mixing, quality, repeats, resample, secrets, token_counts, toxicity
from facetlake.llm.training import held_out
from facetlake.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: SQL counterparts, by query.
SQL: dict[str, str] = {}


def numbered(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str) -> F.Column:
    """Number of words between spaces, tabs and line ends."""
    return F.coalesce(F.size(fingerprints.words(F.col(text))), F.lit(0)).cast("long")


@numbered
def op1_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("log"))
    return alike.alike_logs(logs).select(F.col("job_id").alias("doc_id"), "n_shingles", F.col("alike_id").alias("component_id"))


SQL["op1_alike"] = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
runs AS (
  SELECT r, array_to_string(ws, ' ') AS k FROM docs WHERE len(ws) BETWEEN 1 AND 4
  UNION ALL
  SELECT r, array_to_string(ws[i : i + 4], ' ') FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM docs WHERE len(ws) >= 5)),
shingles AS (SELECT DISTINCT r, md5(k) AS k FROM runs),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.k = b.k AND a.r < b.r GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT r, r AS root FROM docs UNION SELECT w.b, reach.root FROM reach JOIN ways w ON w.a = reach.r)
SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM docs d LEFT JOIN sizes z ON z.r = d.r JOIN reach ON reach.r = d.r JOIN docs o ON o.r = reach.root GROUP BY d.r, d.doc_id
"""


@numbered
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("log"))
    return token_counts.log_tokens(logs, vocabulary()).withColumnRenamed("job_id", "doc_id")


@numbered
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.col("text").alias("name"), "lang")
    fold = held_out("session_id", 3, 1)
    found = languages.session_languages(sessions.select("session_id", "name"), sessions.filter(~fold))
    return found.select(F.col("session_id").alias("doc_id"), fold.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@numbered
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("log"))
    fold = held_out("job_id", 5, 0)
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("job_id"), F.col("quality").alias("useful")).filter(~fold)
    score = F.col("useful_score")
    return quality.log_quality(logs, marks).select(F.col("job_id").alias("doc_id"), fold.alias("held_out"), score.alias("score"), (score >= 0.3).cast("int").alias("predicted"))


@numbered
def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("log"))
    found = contamination.contaminated_logs(logs, table(spark, sf_dir, "benchmark"))
    return found.select(F.col("job_id").alias("doc_id"), "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest")


SQL["op5_contamination"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT item, i AS a, least(13, len(ws)) AS n, array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') AS k
  FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM items WHERE len(ws) > 0)),
widths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, i AS p, n, array_to_string(ws[i : i + n - 1], ' ') AS k
  FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs CROSS JOIN widths WHERE len(ws) >= n)),
found AS (SELECT DISTINCT r, p, n, item, a FROM places JOIN windows USING (n, k)),
marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS p FROM found) GROUP BY r),
named AS (SELECT r, list_sort(list(DISTINCT item)) AS names FROM found GROUP BY r),
-- Windows that follow each other in item and document are one match.
islands AS (
  SELECT r, item, p - a AS d, n, p - row_number() OVER (PARTITION BY r, item, p - a, n ORDER BY p) AS g FROM found),
longest AS (SELECT r, max(m) AS longest FROM (SELECT r, count(*) + n - 1 AS m FROM islands GROUP BY r, item, d, n, g) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(names), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(ws) AS contaminated,
       coalesce(longest, 0) AS longest
FROM docs LEFT JOIN marked USING (r) LEFT JOIN named USING (r) LEFT JOIN longest USING (r)
"""


@numbered
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("job_id"), F.col("source").alias("path"), F.lit(1).alias("version"), F.col("text").alias("content")
    )
    found = secrets.scan_files(files)
    return found.select(F.col("job_id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", F.col("spans_text").alias("spans"))


@numbered
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("log"))
    return repeats.remove_repeats(logs).select(F.col("job_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


SQL["op7_repeats"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT r, doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k
  FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs WHERE len(ws) >= 50)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (k) WHERE doc_id > first),
words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM docs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS said, count(*) AS n FROM words WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.r = words.r AND g.p = words.p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(said, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)
"""


@numbered
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    photos = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("photo_id"), F.col("source").alias("shoot_id"), words_of("text").alias("size"))
    mixed = mixing.mix_photos(photos)
    return mixed.select(F.col("photo_id").alias("doc_id"), "size", F.col("shoot_size").alias("source_size"), "target", "taken")


SQL["op8_mixing"] = r"""
WITH docs AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w
  FROM docs GROUP BY source),
levels AS (
  SELECT s.*, (SELECT sum(source_size) FROM sources) AS total,
         row_number() OVER (ORDER BY 3.0 * source_size / w, source NULLS LAST) AS k FROM sources s),
room AS (
  SELECT a.*, a.total - coalesce((SELECT sum(3 * b.source_size) FROM levels b WHERE b.k < a.k), 0) AS room,
         (SELECT sum(b.w) FROM levels b WHERE b.k >= a.k) AS open FROM levels a),
level AS (SELECT min(k) AS k FROM room WHERE room * w <= 3 * source_size * open),
targets AS (
  SELECT r.source, r.source_size, r.total,
         CASE WHEN r.k < l.k THEN CAST(3 * r.source_size AS DOUBLE)
              ELSE CAST(r.w * f.room AS DOUBLE) / CAST(f.open AS DOUBLE) END AS target
  FROM room r, level l, room f WHERE f.k = l.k),
queued AS (
  SELECT d.*, t.source_size, t.total, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id ROWS UNBOUNDED PRECEDING) AS sent
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
turns AS (
  SELECT q.*, turn, CAST(turn * source_size + sent AS DOUBLE) / target AS finish
  FROM queued q, (VALUES (0), (1), (2)) v(turn) WHERE size > 0 AND turn <= floor(target / source_size)),
placed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, h, doc_id, turn ROWS UNBOUNDED PRECEDING) AS upto FROM turns),
taken AS (
  SELECT doc_id, CAST(sum(greatest(0, least(size, total - upto + size))) AS BIGINT) AS taken FROM placed GROUP BY doc_id)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target, coalesce(t.taken, 0) AS taken
FROM queued q LEFT JOIN taken t USING (doc_id)
"""


@numbered
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.col("text").alias("name"))
    fold = held_out("session_id", 5, 0)
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("session_id"), "toxic").filter(~fold)
    score = F.col("toxic_score")
    return toxicity.session_toxicity(sessions, marks).select(F.col("session_id").alias("doc_id"), fold.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


@numbered
def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    meshes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("mesh_id"), F.col("text").alias("mesh_text"))
    return fingerprints.re_export_report(meshes).withColumnRenamed("mesh_id", "doc_id")


@numbered
def op11_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), "url", F.col("html").alias("content"))
    read = archive.read_archives(spark, archive.write_archives(files), payloads=False)
    return read.select(F.col("file_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op11_archive"] = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS f FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN f IS NOT NULL AND page_id IS DISTINCT FROM f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM f THEN f END AS refers_to
FROM q
"""


@numbered
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("log"))
    return alignment.align_logs(logs, vocabulary(), piece_model()).withColumnRenamed("job_id", "doc_id")


@numbered
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("text").alias("log"))
    targets = table(spark, sf_dir, "benchmark").select(F.col("text").alias("log"))
    drawn = resample.resample_logs(logs, targets)
    return drawn.select(F.col("job_id").alias("doc_id"), "n_features", "weight", "score", "rank")


SQL["op13_resample"] = r"""
WITH RECURSIVE bits AS (
  SELECT i AS b, i AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
steps AS (SELECT b, c FROM bits WHERE k = 8),
texts AS (
  SELECT 0 AS target, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark),
rows AS (
  SELECT row_number() OVER () AS r, target, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts),
words AS (SELECT r, target, unnest(ws) AS w FROM rows),
crc AS (
  SELECT w, 4294967295 AS c, 0 AS p, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)
  UNION ALL
  SELECT w, xor(x.c >> 8, s.c), p + 1, h
  FROM crc x JOIN steps s ON s.b = xor(x.c & 255, CAST('0x' || substr(h, 2 * p + 1, 2) AS BIGINT)) WHERE 2 * p < length(h)),
bucket AS (SELECT w, xor(c, 4294967295) % 10000 AS b FROM crc WHERE 2 * p = length(h)),
counts AS (SELECT b, count(*) FILTER (target = 0) AS s, count(*) FILTER (target = 1) AS t FROM words JOIN bucket USING (w) GROUP BY b),
sums AS (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS ss, CAST(coalesce(sum(t), 0) AS DOUBLE) AS tt FROM counts),
gains AS (
  SELECT b, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (ss + 10000) / ((CAST(s AS DOUBLE) + 1) * (tt + 10000)))) AS BIGINT) AS g FROM counts, sums),
weights AS (SELECT r, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM words JOIN bucket USING (w) JOIN gains USING (b) WHERE target = 0 GROUP BY r),
weighed AS (
  SELECT doc_id, coalesce(n, 0) AS n_features,
         CASE WHEN n IS NULL THEN 0 ELSE (g - ((g % n) + n) % n) // n END AS weight,
         CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM rows LEFT JOIN weights USING (r) WHERE target = 0),
scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM weighed),
ranked AS (
  SELECT doc_id, n_features, weight, score, n_features >= 20 AS fit,
         row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features DESC) AS place,
         count(*) OVER (PARTITION BY n_features >= 20) AS number FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 10 * number // 100 THEN place END AS rank FROM ranked
"""
