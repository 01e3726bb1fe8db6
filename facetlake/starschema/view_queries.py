"""Queries over views: projection, raster, masks, votes, merge."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlake.functions import geometry as g
from facetlake.functions.cameras import default_cameras
from facetlake.operators import mesh, views
from facetlake.session import materialize
from facetlake.starschema.duckviews import DUCK_VIEWS
from facetlake.starschema.mesh_queries import adjacency
from facetlake.starschema.registry import query

RES = 64
CAMERAS = default_cameras()
_ROWS = ", ".join(
    "(" + ", ".join([str(i), f"'{c.name}'"] + [f"{x!r}::DOUBLE" for v in (c.right, c.up, c.forward) for x in v]) + ")"
    for i, c in enumerate(CAMERAS)
)
DUCK_VIEWS["cameras"] = ((), f"SELECT * FROM (VALUES {_ROWS}) t(ord, view, rx, ry, rz, ux, uy, uz, fx, fy, fz)")
DUCK_VIEWS["projected"] = (("face_geo", "cameras"), f"""
  SELECT t.mesh_id, t.fid, view,
    (rx*(ax-ox) + ry*(ay-oy) + rz*(az-oz))*s + {RES / 2} AS au, (ux*(ax-ox) + uy*(ay-oy) + uz*(az-oz))*s + {RES / 2} AS av, -(fx*(ax-ox) + fy*(ay-oy) + fz*(az-oz)) AS ad,
    (rx*(bx-ox) + ry*(by_-oy) + rz*(bz-oz))*s + {RES / 2} AS bu, (ux*(bx-ox) + uy*(by_-oy) + uz*(bz-oz))*s + {RES / 2} AS bv, -(fx*(bx-ox) + fy*(by_-oy) + fz*(bz-oz)) AS bd,
    (rx*(cx-ox) + ry*(cy-oy) + rz*(cz-oz))*s + {RES / 2} AS cu, (ux*(cx-ox) + uy*(cy-oy) + uz*(cz-oz))*s + {RES / 2} AS cv, -(fx*(cx-ox) + fy*(cy-oy) + fz*(cz-oz)) AS cd,
    floor(40 + 215*least(1.0::DOUBLE, coalesce(abs(nx*fx + ny*fy + nz*fz)/nullif(sqrt(nx*nx+ny*ny+nz*nz), 0), 0)))::INT AS shade
  FROM face_geo t JOIN (
    SELECT o.*, {RES / 2}::DOUBLE/(max(greatest(sqrt((ax-ox)*(ax-ox)+(ay-oy)*(ay-oy)+(az-oz)*(az-oz)), sqrt((bx-ox)*(bx-ox)+(by_-oy)*(by_-oy)+(bz-oz)*(bz-oz)),
        sqrt((cx-ox)*(cx-ox)+(cy-oy)*(cy-oy)+(cz-oz)*(cz-oz))))*1.05::DOUBLE) AS s
    FROM tri JOIN (SELECT mesh_id, (min(x)+max(x))/2.0::DOUBLE AS ox, (min(y)+max(y))/2.0::DOUBLE AS oy, (min(z)+max(z))/2.0::DOUBLE AS oz FROM corners GROUP BY 1) o USING (mesh_id) GROUP BY ALL) f USING (mesh_id)
  CROSS JOIN cameras""")  # fmt: skip
DUCK_VIEWS["hits"] = (("projected",), f"""
    SELECT mesh_id, view, fid, shade, px, {RES - 1}-py AS py, w0*ad + w1*bd + (1.0 - w0 - w1)*cd AS z FROM (
      SELECT *, ((bu-(px+0.5::DOUBLE))*(cv-(py+0.5::DOUBLE)) - (bv-(py+0.5::DOUBLE))*(cu-(px+0.5::DOUBLE)))*(1.0::DOUBLE/a2) AS w0,
        ((cu-(px+0.5::DOUBLE))*(av-(py+0.5::DOUBLE)) - (cv-(py+0.5::DOUBLE))*(au-(px+0.5::DOUBLE)))*(1.0::DOUBLE/a2) AS w1 FROM (
        SELECT *, unnest(generate_series(y0, y1))::INT AS py FROM (
          SELECT *, unnest(generate_series(x0, x1))::INT AS px FROM (
            SELECT *, (bu-au)*(cv-av) - (bv-av)*(cu-au) AS a2,
              greatest(0, least({RES - 1}, floor(least(au,bu,cu))::INT)) AS x0, greatest(0, least({RES - 1}, ceil(greatest(au,bu,cu))::INT)) AS x1,
              greatest(0, least({RES - 1}, floor(least(av,bv,cv))::INT)) AS y0, greatest(0, least({RES - 1}, ceil(greatest(av,bv,cv))::INT)) AS y1
            FROM projected) WHERE abs(a2) > 1e-12)))
    WHERE w0 >= 0 AND w1 >= 0 AND 1.0 - w0 - w1 >= 0""")  # fmt: skip
DUCK_VIEWS["fragments"] = (("hits",), "SELECT mesh_id, view, px, py, arg_min(fid, (z, fid)) AS fid FROM hits GROUP BY mesh_id, view, px, py")
DUCK_VIEWS["face_masks"] = (("tri", "cameras"), """
  SELECT mesh_id, view, fid, ((fid//16 + ord) % 4 + CASE WHEN fid % 13 = ord THEN 1 ELSE 0 END)::INT AS mask FROM tri CROSS JOIN cameras WHERE (fid + ord) % 6 <> 0""")  # fmt: skip
DUCK_VIEWS["start_labels"] = (("tri",), """
  SELECT mesh_id, fid, CASE WHEN fid%16 IN (3,4,5) OR fid//16 % 17 = 0 THEN -1 ELSE fid//16 % 5 END::BIGINT AS label FROM tri""")  # fmt: skip
DUCK_VIEWS["shares"] = (("face_geo",), """
  SELECT mesh_id, fid, area / sum(area) OVER (PARTITION BY mesh_id) AS share FROM face_geo""")  # fmt: skip


def projected(v):
    return views.project(v.triangles, RES)


def shown(v):
    return views.fragments(projected(v), RES)


def face_masks(v):
    views_array = F.array(*[F.lit(c.name) for c in CAMERAS])
    rows = v.triangles.select("mesh_id", "fid", F.posexplode(views_array).alias("ord", "view"))
    noisy = F.when(F.col("fid") % 13 == F.col("ord"), 1).otherwise(0)
    return rows.filter((F.col("fid") + F.col("ord")) % 6 != 0).select(
        "mesh_id", "view", "fid", (F.expr("(fid div 16 + ord) % 4") + noisy).cast("int").alias("mask")
    )


def face_areas(v):
    return v.triangles.select("mesh_id", "fid", g.area().alias("area"))


def face_shares(v):
    areas = face_areas(v)
    total = areas.groupBy("mesh_id").agg(F.sum("area").alias("_t"))
    return areas.join(total, "mesh_id").select("mesh_id", "fid", (F.col("area") / F.col("_t")).alias("share"))


def start_labels(v):
    unknown = (F.col("fid") % 16).isin(3, 4, 5) | (F.expr("fid div 16") % 17 == 0)
    return v.triangles.select(
        "mesh_id", "fid", F.when(unknown, F.lit(-1)).otherwise(F.expr("fid div 16") % 5).cast("bigint").alias("label")
    )


@query("view_projection", "I7 I8", "SELECT mesh_id, fid, view, round(au, 6) AS au, round(bv, 6) AS bv, round(cd, 6) AS cd FROM projected", ("projected",))
def _(v):
    return projected(v).select("mesh_id", "fid", "view", *[F.round(c, 6).alias(c) for c in ("au", "bv", "cd")])


@query("view_fragments", "I9 U5", "SELECT mesh_id, view, px, py, fid FROM fragments", ("fragments",))
def _(v):
    return shown(v)


@query("view_shading", "I10", "SELECT mesh_id, view, px, py, arg_min(shade, (z, fid)) AS shade FROM hits GROUP BY mesh_id, view, px, py", ("hits",))
def _(v):
    return views.fragments(projected(v), RES, ["shade"]).drop("fid")


def pixel_hits(v):
    """Visible pixels with a mask from a label table (here: arithmetic on the pixel and box)."""
    return shown(v).withColumn("mask", (F.expr("(fid div 16 + px div 8) % 4") - 1).cast("int"))


@query("majority_masks", "D24 U2", """SELECT mesh_id, view, fid, arg_max(mask, (n, mask)) AS mask FROM (SELECT mesh_id, view, fid, ((fid//16 + px//8) % 4 - 1)::INT AS mask, count(*) AS n FROM fragments GROUP BY ALL) WHERE mask >= 0 GROUP BY ALL""", ("fragments",))
def _(v):
    return views.majority_masks(pixel_hits(v))


@query("mask_regions", "D25", """WITH seen AS (SELECT mesh_id, view, sum(area) AS s FROM face_masks JOIN face_geo USING (mesh_id, fid) GROUP BY ALL),
   r AS (SELECT mesh_id, view, mask, count(*) AS faces, sum(area) AS area FROM face_masks JOIN face_geo USING (mesh_id, fid) GROUP BY ALL)
   SELECT mesh_id, view, mask, faces, round(area, 4) AS area, round(area/s, 6) AS share FROM r JOIN seen USING (mesh_id, view) WHERE area/s BETWEEN 0.002 AND 0.95""", ("face_masks", "face_geo"))
def _(v):
    m = face_masks(v)
    r = views.mask_regions(m.select("mesh_id", "view", "fid"), m, face_areas(v))
    return r.withColumn("area", F.round("area", 4)).withColumn("share", F.round("share", 6))


@query("edge_votes", "C9", """SELECT j.mesh_id, fa, fb, coalesce(sum(CASE WHEN a.mask = b.mask THEN 1 WHEN b.mask IS NOT NULL THEN -1 END), 0)::INT AS votes FROM face_adj j
   LEFT JOIN face_masks a ON a.mesh_id=j.mesh_id AND a.fid=fa LEFT JOIN face_masks b ON b.mesh_id=j.mesh_id AND b.fid=fb AND b.view=a.view GROUP BY ALL""", ("face_adj", "face_masks"))
def _(v):
    return views.edge_votes(adjacency(v), face_masks(v))


@query("significant_regions", "D26", """SELECT mesh_id, count(*) FILTER (s >= 0.01) AS regions FROM (SELECT mesh_id, label, sum(share) AS s FROM start_labels JOIN shares USING (mesh_id, fid) GROUP BY ALL) GROUP BY mesh_id""", ("start_labels", "shares"))
def _(v):
    return views.significant_regions(start_labels(v), face_shares(v))


@query("label_views", "D27", """SELECT mesh_id, label, array_to_string(list_sort(list(DISTINCT view)), ',') AS views FROM start_labels JOIN face_masks USING (mesh_id, fid) GROUP BY ALL""", ("start_labels", "face_masks"))
def _(v):
    return views.label_views(start_labels(v), face_masks(v)).select("mesh_id", "label", F.array_join("views", ",").alias("views"))


@query("drop_slivers", "E7", """WITH l AS (SELECT mesh_id, fid, fid//16 % 60 AS label FROM tri), s AS (SELECT mesh_id, label, sum(share) AS s FROM l JOIN shares USING (mesh_id, fid) GROUP BY ALL),
   k AS (SELECT *, s >= 0.01 OR count(*) FILTER (s < 0.01) OVER (PARTITION BY mesh_id) IN (0, count(*) OVER (PARTITION BY mesh_id)) AS keep FROM s),
   n AS (SELECT mesh_id, label, row_number() OVER (PARTITION BY mesh_id ORDER BY label) - 1 AS new FROM k WHERE keep)
   SELECT mesh_id, fid, coalesce(new, -1)::BIGINT AS label FROM l LEFT JOIN n USING (mesh_id, label)""", ("shares", "tri"))
def _(v):
    labels = v.triangles.select("mesh_id", "fid", F.expr("fid div 16 % 60").alias("label"))
    return views.drop_slivers(labels, face_shares(v))


_WAVES = ["p0 AS (SELECT * FROM start_labels)"] + [
    f"""p{i} AS (SELECT p.mesh_id, p.fid, CASE WHEN p.label >= 0 THEN p.label ELSE coalesce(min(q.label) FILTER (q.label >= 0), -1) END AS label FROM p{i - 1} p
     LEFT JOIN ring ON ring.mesh_id=p.mesh_id AND ring.a=p.fid AND p.label < 0 LEFT JOIN p{i - 1} q ON q.mesh_id=p.mesh_id AND q.fid=ring.b GROUP BY p.mesh_id, p.fid, p.label)"""
    for i in range(1, 9)
]


@query("label_propagation", "E4", "WITH ring AS (SELECT mesh_id, fa AS a, fb AS b FROM face_adj UNION ALL SELECT mesh_id, fb, fa FROM face_adj), " + ", ".join(_WAVES)
       + " SELECT mesh_id, fid, greatest(label, 0) AS label FROM p8", ("start_labels", "face_adj"))
def _(v):
    return views.propagate(start_labels(v), adjacency(v))


@query("region_merge_scan", "E5 E6 U4")
def _(v):
    votes = views.dissimilarity(views.edge_votes(adjacency(v), face_masks(v)))
    return views.scan_merge(votes, face_shares(v))


@query("silhouette_labels", "P4", """WITH RECURSIVE fg AS (SELECT shoot_id, seq, pos FROM pixels WHERE g > 128),
   nb AS (SELECT a.shoot_id, a.seq, a.pos AS a, b.pos AS b FROM fg a JOIN fg b ON a.shoot_id=b.shoot_id AND a.seq=b.seq AND ((b.pos = a.pos+1 AND a.pos%8 < 7) OR (b.pos = a.pos-1 AND a.pos%8 > 0) OR abs(b.pos-a.pos) = 8)),
   w AS (SELECT shoot_id, seq, pos, pos AS root FROM fg UNION SELECT w.shoot_id, w.seq, nb.b, w.root FROM w JOIN nb ON nb.shoot_id=w.shoot_id AND nb.seq=w.seq AND nb.a=w.pos WHERE w.root < nb.b)
   SELECT shoot_id, seq, pos, min(root) AS region FROM w GROUP BY ALL""", ("pixels",))
def _(v):
    px = v.grids.select("shoot_id", "seq", F.posexplode("grid").alias("pos", "g")).filter("g > 128")
    return views.foreground_labels(
        px.select("shoot_id", "seq", (F.col("pos") % 8).alias("px"), F.expr("pos div 8").alias("py")), 8, ("shoot_id", "seq")
    )


@query("plugin_segmenter", "U1")
def _(v):
    """A user-supplied segmenter on every rendered view; this one splits by grey level."""
    p = projected(v)
    shaded = views.fragments(p, RES).join(p.select("mesh_id", "view", "fid", "shade"), ["mesh_id", "view", "fid"])

    def by_level(image):
        grey = image[:, :, 0].astype("int64")
        return (grey // 64) - (grey == 0)

    return views.segment_with(shaded, by_level, RES)
