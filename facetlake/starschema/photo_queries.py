"""Queries over photos, hashes, frames and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlake.functions import pixels as px
from facetlake.operators import dedup, frames, photos
from facetlake.session import scratch_path
from facetlake.sources import photos as files
from facetlake.starschema.registry import query


def _scored(v):
    """Scores in one pass over the photo rows, without a join."""
    grid = F.col("grid")
    return v.photos.select(
        "shoot_id", "seq", "path", "width", "height",
        px.sharpness(grid).alias("blur"),
        px.share(grid, lambda g: g <= px.DARK_LEVEL).alias("dark"),
        px.share(grid, lambda g: g >= px.BRIGHT_LEVEL).alias("bright"),
    )


def _intake(v):
    """Verdicts with the duplicates of accepted photos marked."""
    judged = photos.verdicts(_scored(v))
    accepted = judged.filter("status = 'accepted'").select("shoot_id", "seq")
    marked = dedup.first_wins(photos.hashes(v.grids).join(accepted, ["shoot_id", "seq"]))
    return judged.join(marked.select("shoot_id", "seq", "duplicate_of"), ["shoot_id", "seq"], "left").withColumn(
        "status", F.when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise(F.col("status"))
    )


# Greedy first-wins in SQL: walk each shoot in seq order, carrying the kept list.
FIRST_WINS = """
  numbered AS (SELECT shoot_id, seq, row_number() OVER (PARTITION BY shoot_id ORDER BY seq) AS rn FROM {items}),
  near AS (SELECT l.shoot_id, l.seq AS later, list(e.seq ORDER BY e.seq) AS matches
           FROM {hashes} l JOIN {hashes} e ON l.shoot_id = e.shoot_id AND e.seq < l.seq
           WHERE bit_count(xor(l.h, e.h)) <= 6 AND NOT bit_count(xor(l.h, e.h_flip)) < bit_count(xor(l.h, e.h))
           GROUP BY l.shoot_id, l.seq),
  walk AS (
    SELECT n.shoot_id, n.rn, n.seq, NULL::BIGINT AS duplicate_of, [n.seq] AS kept FROM numbered n WHERE rn = 1
    UNION ALL
    SELECT w.shoot_id, n.rn, n.seq,
      list_min(list_intersect(w.kept, coalesce(near.matches, []))),
      CASE WHEN len(list_intersect(w.kept, coalesce(near.matches, []))) = 0 THEN list_append(w.kept, n.seq) ELSE w.kept END
    FROM walk w JOIN numbered n ON n.shoot_id = w.shoot_id AND n.rn = w.rn + 1
    LEFT JOIN near ON near.shoot_id = n.shoot_id AND near.later = n.seq)"""
INTAKE = (
    "WITH RECURSIVE ok_hashes AS (SELECT h.* FROM hashes h JOIN verdicts v USING (shoot_id, seq) WHERE v.status = 'accepted'),"
    + FIRST_WINS.format(items="ok_hashes", hashes="ok_hashes")
    + """,
  intake AS (SELECT v.shoot_id, v.seq, v.path, v.reasons, v.warnings, v.blur,
      CASE WHEN w.duplicate_of IS NOT NULL THEN 'duplicate' ELSE v.status END AS status, w.duplicate_of
    FROM verdicts v LEFT JOIN walk w USING (shoot_id, seq))
"""
)


@query("photo_sharpness", "B1", "SELECT shoot_id, seq, round(blur, 6) AS blur FROM photo_scores", ("photo_scores",))
def _(v):
    return photos.scores(v.grids).select("shoot_id", "seq", F.round("blur", 6).alias("blur"))


@query("photo_exposure_clipping", "B3", """SELECT shoot_id, seq, round(avg((g<=5)::INT), 6) AS dark, round(avg((g>=250)::INT), 6) AS bright
   FROM pixels GROUP BY shoot_id, seq""", ("pixels",))
def _(v):
    return photos.scores(v.grids).select("shoot_id", "seq", F.round("dark", 6).alias("dark"), F.round("bright", 6).alias("bright"))


@query("photo_verdicts", "B4", "SELECT shoot_id, seq, status, reasons, warnings FROM verdicts", ("verdicts",))
def _(v):
    return photos.verdicts(_scored(v)).select(
        "shoot_id", "seq", "status", F.array_join("reasons", "; ").alias("reasons"),
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query("working_copy_size", "B5", """SELECT shoot_id, seq,
   (CASE WHEN 900.0::DOUBLE/greatest(width,height) >= 1 THEN width ELSE round_even(width*(900.0::DOUBLE/greatest(width,height)), 0) END)::INT AS out_width,
   (CASE WHEN 900.0::DOUBLE/greatest(width,height) >= 1 THEN height ELSE round_even(height*(900.0::DOUBLE/greatest(width,height)), 0) END)::INT AS out_height
   FROM photos""", ("photos",))
def _(v):
    size = px.working_size(F.col("width"), F.col("height"), 900)
    return v.photos.select("shoot_id", "seq", size["width"].alias("out_width"), size["height"].alias("out_height"))


@query("photo_hashes", "B6 B7", "SELECT shoot_id, seq, h, h_flip FROM hashes", ("hashes",))
def _(v):
    return photos.hashes(v.grids)


@query("hash_distance_to_original", "B8 B9", """SELECT a.shoot_id, b.seq AS seq, a.seq AS original, bit_count(xor(a.h,b.h))::INT AS d,
   bit_count(xor(b.h,a.h_flip))::INT AS d_mirror,
   bit_count(xor(a.h,b.h)) <= 6 AND NOT bit_count(xor(b.h,a.h_flip)) < bit_count(xor(a.h,b.h)) AS near_duplicate
   FROM hashes a JOIN hashes b ON a.shoot_id=b.shoot_id AND a.seq//8 = b.seq//8 AND a.seq%8=0 AND b.seq%8>0""", ("hashes",))
def _(v):
    hashed = photos.hashes(v.grids).withColumn("vec", F.expr("seq div 8"))
    original = hashed.filter("seq % 8 = 0").select(
        "shoot_id", "vec", F.col("seq").alias("original"), F.col("h").alias("h0"), F.col("h_flip").alias("f0")
    )
    h, h0, f0 = F.col("h"), F.col("h0"), F.col("f0")
    return (
        hashed.filter("seq % 8 > 0")
        .join(original, ["shoot_id", "vec"])
        .select(
            "shoot_id", "seq", "original", px.hamming(h, h0).alias("d"), px.hamming(h, f0).alias("d_mirror"),
            px.is_near_duplicate(h, h0, f0, dedup.DEFAULT_THRESHOLD).alias("near_duplicate"),
        )
    )


@query("near_duplicate_pairs", "C1", "SELECT shoot_id, earlier, later, d FROM near_pairs", ("near_pairs",))
def _(v):
    return dedup.near_duplicate_pairs(photos.hashes(v.grids))


@query("near_duplicate_members", "C1", "SELECT shoot_id, seq, min(seq) OVER (PARTITION BY shoot_id, h, h_flip) AS class FROM hashes", ("hashes",))
def _(v):
    return dedup.near_duplicate_members(photos.hashes(v.grids))


@query("first_wins_duplicates", "E2 C1", "WITH RECURSIVE " + FIRST_WINS.format(items="hashes", hashes="hashes")
       + " SELECT shoot_id, seq, duplicate_of FROM walk", ("hashes",))
def _(v):
    return dedup.first_wins(photos.hashes(v.grids)).select("shoot_id", "seq", "duplicate_of")


@query("photo_intake_report", "D1 D3", INTAKE + """
   SELECT shoot_id, count(*) AS photos, count(*) FILTER (status='accepted') AS accepted, count(*) FILTER (status='duplicate') AS duplicates,
     count(*) FILTER (status='rejected') AS rejected, 0::BIGINT AS unreadable,
     CASE WHEN count(*) FILTER (status='accepted') >= 16 THEN 'orbit' WHEN count(*) FILTER (status='accepted') >= 2 THEN 'sparse_views'
          WHEN count(*) FILTER (status='accepted') = 1 THEN 'single_image' END AS regime
   FROM intake GROUP BY shoot_id""", ("hashes", "verdicts"))
def photo_intake(v):
    return photos.intake_report(_intake(v)).withColumn("regime", photos.regime(F.col("accepted")))


@query("photo_intake_fleet_totals", "D1", """SELECT coalesce(shoot_id, -1) AS shoot_id, coalesce(status, 'all') AS status, count(*) AS photos
   FROM verdicts GROUP BY ROLLUP (shoot_id, status)""", ("verdicts",))
def _(v):
    judged = photos.verdicts(_scored(v))
    return judged.rollup("shoot_id", "status").agg(F.count("*").alias("photos")).select(
        F.coalesce("shoot_id", F.lit(-1)).alias("shoot_id"), F.coalesce("status", F.lit("all")).alias("status"), "photos"
    )


@query("photo_advice", "D2", INTAKE + """,
   roll AS (SELECT shoot_id, count(*) AS n, count(*) FILTER (status='accepted') AS ok, count(*) FILTER (status='duplicate') AS dup,
      list_slice(list(regexp_extract(path, '([^/]*)$', 1) ORDER BY seq) FILTER (status='rejected' AND reasons LIKE '%blurry%'), 1, 5) AS blurry
      FROM intake GROUP BY shoot_id),
   lines AS (SELECT shoot_id, concat_ws(' | ',
      CASE WHEN ok < 12 THEN 'only ' || ok || ' usable photos; aim for 20-40' END,
      CASE WHEN len(blurry) > 0 THEN 'retake sharper: ' || array_to_string(blurry, ', ') END,
      CASE WHEN dup > greatest(3, n//4) THEN dup || ' near-duplicate shots dropped; move more between frames' END) AS l FROM roll)
   SELECT shoot_id, CASE WHEN l = '' THEN 'input set looks healthy' ELSE l END AS advice FROM lines""", ("hashes", "verdicts"))
def _(v):
    rows = _intake(v).withColumn("name", photos.file_name(F.col("path")))
    return photos.advice(rows).select("shoot_id", F.array_join("advice", " | ").alias("advice"))


@query("shoot_distinctness", "D4", """
   WITH per_pos AS (SELECT a.shoot_id, sum(abs(a.g-b.g))::DOUBLE AS d FROM pixels a JOIN pixels b
       ON a.shoot_id=b.shoot_id AND a.pos=b.pos AND a.seq<b.seq GROUP BY a.shoot_id),
     n AS (SELECT shoot_id, count(DISTINCT seq) AS n FROM pixels GROUP BY shoot_id)
   SELECT n.shoot_id, n.n AS n_photos, round(d/(64*(n.n*(n.n-1)/2))/255.0::DOUBLE, 4) AS distinctness FROM n JOIN per_pos USING (shoot_id)""", ("pixels",))
def _(v):
    return photos.distinctness(v.grids)


def _labels(v):
    """Labeller output derived from documents: viewpoint and issues by photo index."""
    d = F.col("doc_id")
    known = F.array(*[F.lit(x) for x in ("front", "rear", "left", "orbit", "top", "detail")])
    issues = F.transform(F.sequence(F.lit(1), (d % 6 + 1).cast("int")), lambda i: F.concat(F.lit("issue "), i.cast("string")))
    return v.table("documents").select(
        (d % 10).cast("int").alias("shoot_id"), (d * 8).alias("index"),
        F.get(known, (d % 6).cast("int")).alias("viewpoint"), issues.alias("issues"),
    )


NOTES = """notes AS (SELECT p.shoot_id, p.seq,
     CASE WHEN d.v IN ('front','front-left','left','rear-left','rear','rear-right','right','front-right','top','bottom','detail') THEN d.v ELSE 'unknown' END AS viewpoint,
     coalesce(d.n, 0) AS n_issues
   FROM photos p LEFT JOIN (SELECT (doc_id%10)::INT AS shoot_id, doc_id*8 AS seq, ['front','rear','left','orbit','top','detail'][(doc_id%6)::INT+1] AS v,
      least(4, doc_id%6+1)::INT AS n FROM documents) d USING (shoot_id, seq))"""


@query("photo_label_cleanup", "B11 U3", f"WITH {NOTES} SELECT * FROM notes", ("photos",))
def _(v):
    return photos.clean_labels(v.photos, _labels(v)).select("shoot_id", "seq", "viewpoint", F.size("issues").alias("n_issues"))


@query("viewpoint_coverage", "D5 H3", f"""WITH {NOTES}, seen AS (SELECT shoot_id, coalesce(list_sort(list(DISTINCT viewpoint) FILTER (viewpoint <> 'unknown')), []) AS c FROM notes GROUP BY shoot_id)
   SELECT shoot_id, array_to_string(c, ',') AS covered,
     array_to_string(list_sort(list_filter(['front','front-left','left','rear-left','rear','rear-right','right','front-right','top','bottom','detail'], lambda x: NOT list_contains(c, x))), ',') AS missing FROM seen""", ("photos",))
def _(v):
    return photos.coverage(photos.clean_labels(v.photos, _labels(v))).select(
        "shoot_id", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing")
    )


TAGS = """tags AS (SELECT *, CASE WHEN (f OR b) AND (l OR r) THEN NULL WHEN f THEN 'front' WHEN b THEN 'back' WHEN l THEN 'left' WHEN r THEN 'right' END AS tag
   FROM (SELECT *, contains(s,'front') AS f, contains(s,'rear') OR contains(s,'back') AS b, contains(s,'left') AS l, contains(s,'right') AS r
         FROM (SELECT *, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '[.][^.]*$', '')) AS s FROM photos)))"""


@query("view_tags", "B10", f"""WITH {TAGS} SELECT shoot_id, tag, arg_min(path, seq) AS path, min(seq) AS seq FROM tags WHERE tag IS NOT NULL GROUP BY shoot_id, tag""", ("photos",))
def _(v):
    return photos.view_map(v.photos)


@query("conditioning_views", "G2", f"""WITH {TAGS}, chosen AS (SELECT shoot_id, tag, min(seq) AS seq FROM tags WHERE tag IS NOT NULL GROUP BY shoot_id, tag),
   ranked AS (SELECT p.shoot_id, p.seq, p.path, row_number() OVER (PARTITION BY p.shoot_id ORDER BY
       coalesce(list_position(['front','left','back','right'], c.tag), 5), p.seq) AS slot
     FROM photos p LEFT JOIN chosen c USING (shoot_id, seq))
   SELECT shoot_id, slot, seq, path FROM ranked WHERE slot <= 4""", ("photos",))
def _(v):
    return photos.conditioning_views(v.photos)


@query("labeller_sample", "G7", """SELECT shoot_id, seq, rank FROM (SELECT shoot_id, seq, row_number() OVER (PARTITION BY shoot_id ORDER BY seq) AS rank FROM photos) WHERE rank <= 12""", ("photos",))
def _(v):
    return photos.first_n(v.photos.select("shoot_id", "seq"))


FRAMES = """sampled AS (SELECT clip_id, seq, score, ok, n, stride, seq//stride AS r, (n+stride-1)//stride AS m FROM (
     SELECT *, greatest(1, n//48) AS stride FROM (SELECT *, count(*) OVER (PARTITION BY clip_id) AS n FROM clip_frames)) WHERE seq % stride = 0),
   bucketed AS (SELECT s.*, b.i AS bucket FROM sampled s JOIN range(8) b(i) ON r >= floor(b.i*m/8.0) AND r < floor((b.i+1)*m/8.0))"""


@query("frame_stride_sample", "F1", f"WITH {FRAMES} SELECT clip_id, seq, stride FROM sampled", ("clip_frames",))
def _(v):
    return frames.candidates(v.frames, 8).select("clip_id", "seq", "stride")


@query("frame_temporal_buckets", "F2", f"WITH {FRAMES} SELECT clip_id, bucket, count(*) AS frames, min(seq) AS first_seq FROM bucketed GROUP BY clip_id, bucket", ("clip_frames",))
def _(v):
    rows = frames.with_bucket(frames.candidates(v.frames, 8), 8)
    return rows.groupBy("clip_id", "bucket").agg(F.count("*").alias("frames"), F.min("seq").alias("first_seq"))


@query("sharpest_frame_per_bucket", "F3", f"""WITH {FRAMES} SELECT clip_id, bucket, seq, score FROM (SELECT *, row_number() OVER (PARTITION BY clip_id, bucket ORDER BY score DESC, seq) AS rn
   FROM bucketed WHERE ok) WHERE rn = 1""", ("clip_frames",))
def _(v):
    return frames.pick(v.frames, 8)


@query("photo_subject_exposure", "B2 B3", """WITH RECURSIVE dk AS (SELECT shoot_id, seq, pos FROM pixels WHERE g <= 5),
   fl AS (SELECT * FROM dk WHERE pos IN (0, 7, 56, 63) UNION
     SELECT d.shoot_id, d.seq, d.pos FROM fl JOIN dk d ON d.shoot_id=fl.shoot_id AND d.seq=fl.seq AND ((d.pos = fl.pos+1 AND fl.pos%8 < 7) OR (d.pos = fl.pos-1 AND fl.pos%8 > 0) OR abs(d.pos-fl.pos) = 8)),
   sub AS (SELECT p.*, f.pos IS NOT NULL AS bg, count(f.pos) OVER (PARTITION BY p.shoot_id, p.seq) AS n FROM pixels p LEFT JOIN fl f ON f.shoot_id=p.shoot_id AND f.seq=p.seq AND f.pos=p.pos)
   SELECT shoot_id || '/' || seq AS path, round(avg((g<=5)::INT), 6) AS dark, round(avg((g>=250)::INT), 6) AS bright FROM sub WHERE NOT bg OR (64-n)/64.0 <= 0.10 GROUP BY shoot_id, seq""", ("pixels",))
def _(v):
    """Image path: exposure on the subject, black border background left out."""
    from facetlake.sources.photos import grids_to_images, score_images

    s = score_images(grids_to_images(v.grids))
    return s.select("path", F.round("dark", 6).alias("dark"), F.round("bright", 6).alias("bright"))


@query("contact_sheet_scores", "A2", """WITH s AS (SELECT shoot_id, seq // 512 AS sheet, seq, pos, g FROM pixels),
   d AS (SELECT shoot_id, sheet, count(DISTINCT seq) AS photos, avg(g) AS total FROM s GROUP BY 1, 2)
   SELECT shoot_id || '/' || sheet || '.bmp' AS path, (shoot_id + sheet) % 4 = 1 AS unreadable, CASE WHEN (shoot_id + sheet) % 4 <> 1 THEN (8*photos)::INT END AS width, CASE WHEN (shoot_id + sheet) % 4 <> 1 THEN 8 END AS height,
     CASE WHEN (shoot_id + sheet) % 4 <> 1 THEN round(total, 6) END AS mean_grey FROM d""", ("pixels",))
def _(v):
    """Contact sheets staged as image files, a quarter of them cut short, read back and decoded."""
    sheets = files.contact_sheets(v.grids)
    number = F.expr("CAST(split(path, '/')[0] AS BIGINT) + CAST(split(split(path, '/')[1], '[.]')[0] AS BIGINT)")
    root = scratch_path(v.spark, "sheets")
    files.write_files(sheets.withColumn("data", F.when(number % 4 == 1, F.substring("data", 1, 40)).otherwise(F.col("data"))), root)
    images = files.read_images(v.spark, root)
    # Three equal channels a pixel, so the mean of all bytes is the mean grey level.
    grey = F.aggregate(F.transform(F.sequence(F.lit(1), F.length("data")), lambda i: F.conv(F.hex(F.substring("data", i, F.lit(1))), 16, 10).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    seen = ~F.col("unreadable")
    return images.select(
        F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("path"), "unreadable", F.when(seen, F.col("width")).alias("width"), F.when(seen, F.col("height")).alias("height"),
        F.when(seen, F.round(grey / F.length("data"), 6)).alias("mean_grey"),
    )
