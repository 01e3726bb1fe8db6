"""Queries over parts, budgets, smoothing, nearest joins, texels and mesh text."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlake.functions import geometry as g
from facetlake.operators import bake, budget, hull, mesh, nearest, parts, smooth, views
from facetlake.session import materialize
from facetlake.sources import meshtext
from facetlake.starschema.duckviews import DUCK_VIEWS
from facetlake.starschema.mesh_queries import CLEAN, labelled
from facetlake.starschema.registry import query
from facetlake.starschema.view_queries import pixel_hits, start_labels

DUCK_VIEWS["clean_first"] = (("face_geo",), f"WITH {CLEAN} SELECT good.* FROM good JOIN firsts USING (mesh_id, fid)")
DUCK_VIEWS["clean_edges"] = (("clean_first", "half_edges"), """
  SELECT DISTINCT mesh_id, min(fid) AS a, max(fid) AS b FROM half_edges JOIN (SELECT mesh_id, fid FROM clean_first) USING (mesh_id, fid) GROUP BY mesh_id, p, q HAVING count(*) = 2""")  # fmt: skip
DUCK_VIEWS["clean_reach"] = (("clean_first", "clean_edges"), """
  SELECT mesh_id, fid, fid AS root FROM clean_first UNION
  SELECT r.mesh_id, e.b, r.root FROM clean_reach r JOIN (SELECT mesh_id, a, b FROM clean_edges UNION ALL SELECT mesh_id, b, a FROM clean_edges) e
    ON e.mesh_id=r.mesh_id AND e.a=r.fid WHERE r.root < e.b""")  # fmt: skip
DUCK_VIEWS["clean_comps"] = (("clean_reach",), "SELECT mesh_id, fid, min(root) AS comp FROM clean_reach GROUP BY 1, 2")
DUCK_VIEWS["clean_marks"] = (("clean_comps", "face_geo"), """
  SELECT *, area >= 0.0001*sum(area) OVER (PARTITION BY mesh_id) AS keep FROM
    (SELECT mesh_id, comp, sum(area) AS area FROM clean_comps JOIN face_geo USING (mesh_id, fid) GROUP BY 1, 2)""")  # fmt: skip
DUCK_VIEWS["clean_faces"] = (("clean_first", "clean_comps", "clean_marks"), """
  SELECT f.* FROM clean_first f JOIN clean_comps USING (mesh_id, fid) JOIN clean_marks USING (mesh_id, comp) WHERE keep""")  # fmt: skip

def grid_sql(faces: str, target: str) -> str:
    """Reduction to a budget, tried out: all levels, then every possible end of the order of splits."""

    def quantised(corner: str) -> str:
        axes = [(f"{corner}{'y_' if corner == 'b' and t == 'y' else t}", t) for t in "xyz"]
        return ", ".join(f"coalesce(least(floor(({v}-l{t})/longest*1048576.0::DOUBLE), 1048575), 0)::BIGINT AS q{corner}{t}" for v, t in axes)

    def cell(corner: str, shift: str) -> str:
        return f"(((q{corner}x >> ({shift})) << 40) | ((q{corner}y >> ({shift})) << 20) | (q{corner}z >> ({shift})))"

    def place(corner: str, shift: str) -> str:
        return "((" + " + ".join(f"(q{corner}{t} >> ({shift}))*{m}" for t, m in zip("xyz", budget.SPLIT_ORDER)) + ") % 2147483648)"

    fine = "19 - level"
    return f"""bx AS (SELECT mesh_id, count(*) AS n_faces, {target} AS target_faces,
      greatest(max(greatest(ax,bx,cx))-min(least(ax,bx,cx)), max(greatest(ay,by_,cy))-min(least(ay,by_,cy)), max(greatest(az,bz,cz))-min(least(az,bz,cz))) AS longest,
      min(least(ax,bx,cx)) AS lx, min(least(ay,by_,cy)) AS ly, min(least(az,bz,cz)) AS lz FROM {faces} GROUP BY mesh_id),
   qt AS (SELECT mesh_id, target_faces, {", ".join(quantised(k) for k in "abc")} FROM {faces} JOIN bx USING (mesh_id) WHERE n_faces > target_faces),
   cel AS (SELECT mesh_id, target_faces, level, {", ".join(f"{cell(k, '20 - level')} AS {k}" for k in "abc")} FROM qt, range(21) r(level)),
   cnt AS (SELECT mesh_id, target_faces, level, count(DISTINCT list_sort([a,b,c])) FILTER (a<>b AND b<>c AND a<>c) AS n FROM cel GROUP BY ALL),
   lev AS (SELECT mesh_id, max(level)::INT AS level FROM cnt WHERE n <= target_faces GROUP BY mesh_id),
   fin AS (SELECT DISTINCT mesh_id, target_faces, level, {", ".join(f"{cell(k, fine)} AS f{k}, {cell(k, '20 - level')} AS u{k}, {place(k, fine)} AS p{k}" for k in "abc")} FROM qt JOIN lev USING (mesh_id) WHERE level < 20),
   ends AS (SELECT mesh_id, -1::BIGINT AS t FROM lev UNION SELECT mesh_id, unnest([pa, pb, pc]) FROM fin WHERE fa<>fb AND fb<>fc AND fa<>fc),
   rep AS (SELECT mesh_id, target_faces, t, {", ".join(f"CASE WHEN p{k} <= t THEN 2*f{k} + 1 ELSE 2*u{k} END AS {k}" for k in "abc")} FROM fin JOIN ends USING (mesh_id) WHERE fa<>fb AND fb<>fc AND fa<>fc),
   tried AS (SELECT mesh_id, target_faces, t, count(DISTINCT list_sort([a,b,c])) FILTER (a<>b AND b<>c AND a<>c) AS n FROM rep GROUP BY ALL),
   best AS (SELECT mesh_id, max(t) AS t, arg_max(n, t) AS n FROM tried WHERE n <= target_faces GROUP BY mesh_id),
   plan AS (SELECT mesh_id, n_faces AS faces_before, CASE WHEN level IS NULL THEN n_faces WHEN level = 20 THEN greatest(1, (SELECT n FROM cnt WHERE cnt.mesh_id = bx.mesh_id AND cnt.level = 20)) ELSE greatest(1, coalesce(n, 0)) END AS faces_after,
      target_faces, (1::BIGINT << level) AS grid, CASE WHEN level IS NOT NULL THEN coalesce(t, -1) END AS split FROM bx LEFT JOIN lev USING (mesh_id) LEFT JOIN best USING (mesh_id))"""


TARGET = "(400 + 200 * (ascii(substr(mesh_id, -1)) % 4))::BIGINT"


def budgets(v):
    target = (400 + 200 * (F.ascii(F.substring("mesh_id", -1, 1)) % 4)).cast("bigint")
    return v.triangles.select("mesh_id").distinct().withColumn("target_faces", target)


@query("face_budget_reduction", "V7", f"WITH {grid_sql('tri', TARGET)} SELECT *, faces_after = target_faces AS exact FROM plan", ("tri",))
def _(v):
    _, report = budget.reduce_to_budget(v.stored_triangles, budgets(v))
    return report


@query("reduced_face_counts", "V7 D20", f"WITH {grid_sql('tri', TARGET)} SELECT mesh_id, faces_after AS n FROM plan", ("tri",))
def _(v):
    reduced, _ = budget.reduce_to_budget(v.stored_triangles, budgets(v))
    return reduced.groupBy("mesh_id").agg(F.count("*").alias("n"))


@query("mesh_tail_report", "P6", f"""WITH {grid_sql('clean_faces', TARGET)},
   bef AS (SELECT mesh_id, count(*) AS faces_before FROM tri GROUP BY 1)
   SELECT b.mesh_id, b.faces_before, p.faces_before AS faces_clean, (SELECT count(*) FROM clean_marks k WHERE k.mesh_id=b.mesh_id AND NOT keep) AS components_removed,
     p.faces_after AS faces_final, p.target_faces, p.grid FROM bef b JOIN plan p USING (mesh_id)""", ("tri", "clean_faces", "clean_marks"))
def _(v):
    from facetlake.plans.tail import mesh_tail

    _, report = mesh_tail(v.stored_triangles, budgets(v), min_area_frac=0.0001)
    return report.select("mesh_id", "faces_before", "faces_clean", "components_removed", "faces_final", "target_faces", "grid")


# --- parts -------------------------------------------------------------------

PART_STATS = """pa AS ({labels}),
   ar AS (SELECT mesh_id, label, count(*) AS n_faces, sum(area) AS area FROM pa JOIN face_geo USING (mesh_id, fid) WHERE label >= 0 GROUP BY 1, 2),
   tot AS (SELECT mesh_id, sum(area) AS total FROM face_geo GROUP BY 1),
   pick AS (SELECT mesh_id, label, row_number() OVER (PARTITION BY mesh_id ORDER BY area DESC, label) - 1 AS part_index FROM ar JOIN tot USING (mesh_id) WHERE n_faces >= 4 AND area >= 0.01*total QUALIFY part_index < 8),
   asg AS (SELECT mesh_id, fid, part_index, '{method}' AS method FROM pa JOIN pick USING (mesh_id, label)
      UNION ALL SELECT mesh_id, fid, 0, 'whole' FROM tri WHERE mesh_id NOT IN (SELECT mesh_id FROM pick))"""
BY_COMPONENT = PART_STATS.format(labels="SELECT mesh_id, fid, comp AS label FROM components", method="connected")
BY_LABEL = PART_STATS.format(labels="SELECT * FROM start_labels", method="semantic")


def connected(v):
    return parts.split(v.stored_triangles, labelled(v), "connected")


@query("split_connected", "P1", f"WITH {BY_COMPONENT} SELECT * FROM asg", ("components", "face_geo", "tri"))
def _(v):
    return connected(v)


@query("parts_from_labels", "P2", f"WITH {BY_LABEL} SELECT * FROM asg", ("start_labels", "face_geo", "tri"))
def _(v):
    return parts.parts_from_labels(v.triangles, start_labels(v))


@query("split_auto", "P1 E8")
def _(v):
    """Single boxes as meshes: one component each, so every mesh takes the clustering branch."""
    boxes = v.triangles.withColumn("mesh_id", F.expr("CAST(fid div 16 AS STRING)"))
    from facetlake.operators import components as cc

    labels = materialize(cc.face_components(boxes, mesh.adjacency(mesh.edge_stats(boxes))), "components")
    return parts.split(boxes, labels, "auto")


@query("cluster_faces", "E8")
def _(v):
    return parts.cluster_faces(v.stored_triangles)


DESCRIBED = """w AS (SELECT mesh_id, count(*) AS wf, sum(vol6)/6.0 AS wv, min(least(ax,bx,cx)) AS lx, min(least(ay,by_,cy)) AS ly, min(least(az,bz,cz)) AS lz,
      max(greatest(ax,bx,cx)) - min(least(ax,bx,cx)) AS sx, max(greatest(ay,by_,cy)) - min(least(ay,by_,cy)) AS sy, max(greatest(az,bz,cz)) - min(least(az,bz,cz)) AS sz FROM face_geo GROUP BY 1),
   pt AS (SELECT mesh_id, part_index, method, count(*) AS n_faces, sum(area) AS area, abs(sum(vol6))/6.0 AS volume,
      sum(area*((ax+bx+cx)/3.0))/sum(area) AS cx, sum(area*((ay+by_+cy)/3.0))/sum(area) AS cy, sum(area*((az+bz+cz)/3.0))/sum(area) AS cz,
      max(greatest(ax,bx,cx)) - min(least(ax,bx,cx)) AS ex, max(greatest(ay,by_,cy)) - min(least(ay,by_,cy)) AS ey, max(greatest(az,bz,cz)) - min(least(az,bz,cz)) AS ez
      FROM asg JOIN face_geo USING (mesh_id, fid) GROUP BY 1, 2, 3),
   ds AS (SELECT pt.mesh_id, part_index, method, n_faces, volume, wv, round_even((cx-lx)/sx, 3) AS left_to_right, round_even((cy-ly)/sy, 3) AS back_to_front, round_even((cz-lz)/sz, 3) AS bottom_to_top,
      round_even(volume/wv, 4) AS volume_fraction, round_even(n_faces/wf, 4) AS face_fraction, round_even(greatest(ex,ey,ez)/least(ex,ey,ez), 2) AS elongation, round_even(least(ex,ey,ez)/greatest(ex,ey,ez), 3) AS flatness
      FROM pt JOIN w USING (mesh_id)),
   nm AS (SELECT ds.*, CASE WHEN part_index % 3 = 1 THEN 'wheel' WHEN part_index = 0 THEN 'body' ELSE
      concat_ws('-', CASE WHEN bottom_to_top > 0.66 THEN 'upper' WHEN bottom_to_top < 0.33 THEN 'lower' END, CASE WHEN back_to_front > 0.6 THEN 'front' WHEN back_to_front < 0.4 THEN 'rear' ELSE 'mid' END,
        CASE WHEN left_to_right < 0.4 THEN 'left' WHEN left_to_right > 0.6 THEN 'right' ELSE 'centre' END) END AS name, CASE WHEN part_index % 3 = 1 THEN 'labeller' ELSE 'geometry' END AS named_by FROM ds)"""


def named_parts(v):
    table = materialize(parts.part_table(v.stored_triangles, connected(v)), "parts")
    described = parts.describe(table, mesh.measures(v.stored_triangles))
    names = table.filter("part_index % 3 = 1").select("mesh_id", "part_index", F.lit(" Wheel ").alias("name"))
    return parts.named(described, names)


@query("part_descriptions", "I11", f"WITH {BY_COMPONENT}, {DESCRIBED} SELECT mesh_id, part_index, left_to_right, back_to_front, bottom_to_top, volume_fraction, face_fraction, elongation, flatness FROM ds", ("components", "face_geo", "tri"))
def _(v):
    table = parts.part_table(v.triangles, connected(v))
    return parts.describe(table, mesh.measures(v.triangles)).select(
        "mesh_id", "part_index", "left_to_right", "back_to_front", "bottom_to_top", "volume_fraction", "face_fraction", "elongation", "flatness"
    )


@query("part_names", "C7 I12", f"WITH {BY_COMPONENT}, {DESCRIBED} SELECT mesh_id, part_index, name, named_by FROM nm", ("components", "face_geo", "tri"))
def _(v):
    return named_parts(v).select("mesh_id", "part_index", "name", "named_by")


EXPORTED = """bud AS (SELECT *, 2000::BIGINT AS total_budget, count(*) OVER (PARTITION BY mesh_id) AS np, sum(n_faces) OVER (PARTITION BY mesh_id) AS tf FROM nm),
   fst AS (SELECT *, round_even(2000 * (n_faces::DOUBLE/tf), 0)::BIGINT AS f FROM bud),
   tgt AS (SELECT *, (f + CASE WHEN row_number() OVER (PARTITION BY mesh_id ORDER BY n_faces DESC, part_index) = 1 THEN 2000 - sum(f) OVER (PARTITION BY mesh_id) ELSE 0 END)::BIGINT AS target_faces,
      row_number() OVER (PARTITION BY mesh_id, name ORDER BY part_index) AS k FROM fst),
   ex AS (SELECT *, name || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS stem, least(1024, greatest(128, pow(2, round_even(log2(greatest(1024*sqrt(least(1.0, target_faces::DOUBLE/2000)), 128)), 0))))::INT AS texture,
      round(volume/wv, 4) AS volume_share FROM tgt)"""


def exported(v):
    named = materialize(named_parts(v), "named_parts")
    total = named.select("mesh_id").distinct().withColumn("total_budget", F.lit(2000).cast("bigint"))
    return parts.export_rows(named, total, mesh.measures(v.triangles))


@query("part_export_rows", "P5 F5", f"WITH {BY_COMPONENT}, {DESCRIBED}, {EXPORTED} SELECT mesh_id, part_index, stem, target_faces, texture, volume_share FROM ex", ("components", "face_geo", "tri"))
def _(v):
    return exported(v).select("mesh_id", "part_index", "stem", "target_faces", "texture", "volume_share")


@query("part_manifests", "A10 P5", f"""WITH {BY_COMPONENT}, {DESCRIBED}, {EXPORTED} SELECT mesh_id, '{{"total_budget":2000,"n_parts":' || count(*) || ',"segmentation_method":"' || min(method) || '","named":true,"parts":[' ||
   string_agg('{{"index":' || part_index || ',"name":"' || name || '","file":"' || stem || '.glb","faces":' || n_faces || ',"target_faces":' || target_faces || ',"texture":' || texture || '}}', ',' ORDER BY part_index) || ']}}' AS manifest
   FROM ex GROUP BY mesh_id""", ("components", "face_geo", "tri"))
def _(v):
    return parts.manifests(exported(v))


@query("semantic_split", "P3")
def _(v):
    from facetlake.plans.semantic import semantic_split

    return semantic_split(v.stored_triangles, pixel_hits(v))


# --- smoothing and fill ------------------------------------------------------

DUCK_VIEWS["verts"] = (("corners",), "SELECT mesh_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, min(fid*3+corner)::BIGINT AS vid FROM corners GROUP BY mesh_id, x, y, z")
DUCK_VIEWS["ring"] = (("edge_stats", "verts"), """
  SELECT e.mesh_id, a.vid, b.vid AS nb, e.n FROM (SELECT mesh_id, p, q, n FROM edge_stats UNION ALL SELECT mesh_id, q, p, n FROM edge_stats) e
  JOIN verts a ON a.mesh_id=e.mesh_id AND a.x=e.p[1] AND a.y=e.p[2] AND a.z=e.p[3] JOIN verts b ON b.mesh_id=e.mesh_id AND b.x=e.q[1] AND b.y=e.q[2] AND b.z=e.q[3]""")  # fmt: skip
SMOOTH1 = """pin AS (SELECT mesh_id, vid, bool_or(n=1) AS pinned FROM ring GROUP BY 1, 2),
   v0 AS (SELECT v.*, coalesce(pinned, false) AS pinned FROM verts v LEFT JOIN pin USING (mesh_id, vid)),
   m1 AS (SELECT r.mesh_id, r.vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ring r JOIN v0 ON v0.mesh_id=r.mesh_id AND v0.vid=r.nb GROUP BY 1, 2),
   v1 AS (SELECT v0.mesh_id, v0.vid, pinned, CASE WHEN pinned OR m1.x IS NULL THEN v0.x ELSE v0.x + 0.5*(m1.x-v0.x) END AS x, CASE WHEN pinned OR m1.x IS NULL THEN v0.y ELSE v0.y + 0.5*(m1.y-v0.y) END AS y,
      CASE WHEN pinned OR m1.x IS NULL THEN v0.z ELSE v0.z + 0.5*(m1.z-v0.z) END AS z FROM v0 LEFT JOIN m1 USING (mesh_id, vid)),
   m2 AS (SELECT r.mesh_id, r.vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ring r JOIN v1 ON v1.mesh_id=r.mesh_id AND v1.vid=r.nb GROUP BY 1, 2),
   v2 AS (SELECT v1.mesh_id, v1.vid, pinned, CASE WHEN pinned OR m2.x IS NULL THEN v1.x ELSE v1.x - 0.53*(m2.x-v1.x) END AS x, CASE WHEN pinned OR m2.x IS NULL THEN v1.y ELSE v1.y - 0.53*(m2.y-v1.y) END AS y,
      CASE WHEN pinned OR m2.x IS NULL THEN v1.z ELSE v1.z - 0.53*(m2.z-v1.z) END AS z FROM v1 LEFT JOIN m2 USING (mesh_id, vid))"""


@query("neighbour_means", "D22", "SELECT r.mesh_id, r.vid, count(*) AS valence, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(avg(z), 6) AS mz FROM ring r JOIN verts v ON v.mesh_id=r.mesh_id AND v.vid=r.nb GROUP BY 1, 2", ("ring", "verts"))
def _(v):
    vertices, ring = smooth.topology_of(v.triangles)
    m = smooth.neighbour_means(vertices, ring)
    return m.select("mesh_id", "vid", "valence", *[F.round(c, 6).alias(c) for c in ("mx", "my", "mz")])


@query("taubin_one_step", "E3", f"WITH {SMOOTH1} SELECT mesh_id, vid, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM v2", ("ring", "verts"))
def _(v):
    vertices, ring = smooth.topology_of(v.triangles)
    out = smooth.smooth_vertices(vertices, ring, 1)
    return out.select("mesh_id", "vid", *[F.round(t, 9).alias(t) for t in g.XYZ])


@query("taubin_report", "D35 E3", f"""WITH {SMOOTH1}, sh AS (SELECT a.mesh_id, sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2) AS d, a.pinned FROM v2 a JOIN v0 b USING (mesh_id, vid)),
   ct AS (SELECT c.mesh_id, fid, corner, v2.x, v2.y, v2.z FROM corners c JOIN verts v ON v.mesh_id=c.mesh_id AND v.x=c.x AND v.y=c.y AND v.z=c.z JOIN v2 ON v2.mesh_id=v.mesh_id AND v2.vid=v.vid),
   t AS (SELECT mesh_id, fid, max(x) FILTER (corner=0) AS ax, max(y) FILTER (corner=0) AS ay, max(z) FILTER (corner=0) AS az, max(x) FILTER (corner=1) AS bx, max(y) FILTER (corner=1) AS by_, max(z) FILTER (corner=1) AS bz,
      max(x) FILTER (corner=2) AS cx, max(y) FILTER (corner=2) AS cy, max(z) FILTER (corner=2) AS cz FROM ct GROUP BY 1, 2),
   va AS (SELECT mesh_id, abs(sum(ax*(by_*cz - bz*cy) + ay*(bz*cx - bx*cz) + az*(bx*cy - by_*cx)))/6.0 AS va FROM t GROUP BY 1), vb AS (SELECT mesh_id, abs(sum(vol6))/6.0 AS vb FROM face_geo GROUP BY 1)
   SELECT mesh_id, round(avg(d), 6) AS moved_mean, round(max(d), 6) AS moved_max, round(any_value((va-vb)/vb), 6) AS volume_change, count(*) FILTER (pinned) AS pinned FROM sh JOIN va USING (mesh_id) JOIN vb USING (mesh_id) GROUP BY mesh_id""", ("ring", "verts", "corners", "face_geo"))
def _(v):
    _, report = smooth.smooth(v.stored_triangles, iterations=1)
    return report.select("mesh_id", *[F.round(c, 6).alias(c) for c in ("moved_mean", "moved_max", "volume_change")], "pinned")


def smoothing_sql(rounds: int) -> str:
    """Half-steps one after the other, each over the ring of the one before."""
    steps = ["pin AS (SELECT mesh_id, vid, bool_or(n=1) AS pinned FROM ring GROUP BY 1, 2)", "s0 AS MATERIALIZED (SELECT v.*, coalesce(pinned, false) AS pinned FROM verts v LEFT JOIN pin USING (mesh_id, vid))"]
    for k in range(2 * rounds):
        factor = "0.5" if k % 2 == 0 else "-0.53"
        moved = ", ".join(f"CASE WHEN s.pinned OR m.{t} IS NULL THEN s.{t} ELSE s.{t} + {factor}*(m.{t} - s.{t}) END AS {t}" for t in "xyz")
        steps.append(f"m{k} AS (SELECT r.mesh_id, r.vid, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM ring r JOIN s{k} s ON s.mesh_id=r.mesh_id AND s.vid=r.nb GROUP BY 1, 2)")
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT s.mesh_id, s.vid, s.pinned, {moved} FROM s{k} s LEFT JOIN m{k} m USING (mesh_id, vid))")
    end = f"s{2 * rounds}"
    spots = ", ".join(f'round(max(e.{t}) FILTER (corner={i}), 6) AS "{k}{t}"' for i, k in enumerate("abc") for t in "xyz")
    return f"""WITH {", ".join(steps)} SELECT c.mesh_id, c.fid, {spots} FROM corners c JOIN verts v ON v.mesh_id=c.mesh_id AND v.x=c.x AND v.y=c.y AND v.z=c.z
      JOIN {end} e ON e.mesh_id=v.mesh_id AND e.vid=v.vid GROUP BY c.mesh_id, c.fid"""


@query("taubin_smoothing", "E3", smoothing_sql(5), ("ring", "verts", "corners"))
def _(v):
    after, _ = smooth.smooth(v.stored_triangles)
    return after.select("mesh_id", "fid", *[F.round(f"{k}{t}", 6).alias(f"{k}{t}") for k in "abc" for t in "xyz"])


@query("hull_fill_ratio", "D17 U4")
def _(v):
    return hull.fill_ratio(v.triangles)


@query("box_hull_fill", "D17", """WITH f AS (SELECT p_partkey, abs(sum(vol6))/6.0 AS volume FROM face_geo JOIN (SELECT mesh_id, fid, p_partkey FROM tri_ids) USING (mesh_id, fid) GROUP BY 1)
   SELECT p_partkey::VARCHAR AS mesh_id, round(dx*dy*dz, 4)::DOUBLE AS hull_volume, round(volume/(dx*dy*dz), 6) AS fill FROM f JOIN boxes USING (p_partkey)""", ("face_geo", "tri_ids", "boxes"))
def _(v):
    """Every box as a mesh of its own, torn and turned ones included: the hull is the whole box."""
    filled = hull.fill_ratio(v.triangles.withColumn("mesh_id", F.expr("CAST(fid div 16 AS STRING)")))
    return filled.select("mesh_id", F.round("hull_volume", 4).alias("hull_volume"), F.round("fill", 6).alias("fill"))


@query("bbox_fill_ratio", "D17", "SELECT mesh_id, round(abs(sum(vol6))/6.0 / ((max(greatest(ax,bx,cx)) - min(least(ax,bx,cx))) * (max(greatest(ay,by_,cy)) - min(least(ay,by_,cy))) * (max(greatest(az,bz,cz)) - min(least(az,bz,cz)))), 8) AS fill FROM face_geo GROUP BY 1", ("face_geo",))
def _(v):
    m = mesh.measures(v.triangles)
    return m.select("mesh_id", F.round(mesh.bbox_fill(F.col("volume"), *[F.col(f"extent_{t}") for t in g.XYZ]), 8).alias("fill"))


# --- nearest joins and texels ------------------------------------------------


def sample_points(v):
    """One point per face: its centre, pushed along a diagonal by an amount that varies by face."""
    push = (F.col("fid") % 7) * 0.75
    return v.triangles.select("mesh_id", F.col("fid").alias("pid"), *[(g.centroid(t) + push).alias(t) for t in g.XYZ])


@query("nearest_vertex", "C5", """WITH pts AS (SELECT mesh_id, fid AS pid, (ax+bx+cx)/3.0 + (fid%7)*0.75 AS x, (ay+by_+cy)/3.0 + (fid%7)*0.75 AS y, (az+bz+cz)/3.0 + (fid%7)*0.75 AS z FROM tri)
   SELECT p.mesh_id, pid, arg_min(vid, ((v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y)+(v.z-p.z)*(v.z-p.z), vid)) AS vid, round(min((v.x-p.x)*(v.x-p.x)+(v.y-p.y)*(v.y-p.y)+(v.z-p.z)*(v.z-p.z)), 6) AS d2
   FROM pts p JOIN verts v USING (mesh_id) GROUP BY 1, 2""", ("tri", "verts"))
def _(v):
    found = nearest.nearest_vertex(sample_points(v), mesh.weld(v.stored_triangles).select("mesh_id", "vid", "x", "y", "z"))
    return found.select("mesh_id", "pid", "vid", F.round("d2", 6).alias("d2"))


def face_distance_sql() -> str:
    """Every point against every face of its mesh, edge by edge."""
    names = {k: [f"{k}x", "by_" if k == "b" else f"{k}y", f"{k}z"] for k in "abc"}
    edges = (("a", "b"), ("b", "c"), ("c", "a"))

    def dot(u: list[str], v: list[str]) -> str:
        return "(" + " + ".join(f"{x}*{y}" for x, y in zip(u, v)) + ")"

    def minus(u: list[str], v: list[str]) -> list[str]:
        return [f"({x}-{y})" for x, y in zip(u, v)]

    def cross(u: list[str], v: list[str]) -> list[str]:
        return [f"({u[1]}*{v[2]} - {u[2]}*{v[1]})", f"({u[2]}*{v[0]} - {u[0]}*{v[2]})", f"({u[0]}*{v[1]} - {u[1]}*{v[0]})"]

    point, normal = ["x", "y", "z"], ["nx", "ny", "nz"]
    along, least, inside = [], [], []
    for u, v in edges:
        d, w = minus(names[v], names[u]), minus(point, names[u])
        along.append(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {dot(w, d)}/CASE WHEN {dot(d, d)} > 0 THEN {dot(d, d)} ELSE 1 END)) AS s{u}{v}")
        rest = [f"({x} - s{u}{v}*{y})" for x, y in zip(w, d)]
        least.append(dot(rest, rest))
        inside.append(f"{dot(cross(d, w), normal)} >= 0")
    above = dot(minus(point, names["a"]), normal)
    return f"""pts AS (SELECT mesh_id, fid AS pid, (ax+bx+cx)/3.0 + (fid%7)*0.75 AS x, (ay+by_+cy)/3.0 + (fid%7)*0.75 AS y, (az+bz+cz)/3.0 + (fid%7)*0.75 AS z FROM tri),
   fc AS (SELECT *, {dot(normal, normal)} AS nn FROM face_geo WHERE area > 0),
   sl AS (SELECT pid, x, y, z, fc.*, {", ".join(along)} FROM pts JOIN fc USING (mesh_id)),
   ds AS (SELECT mesh_id, pid, fid, CASE WHEN {" AND ".join(inside)} THEN {above}*{above}/nn ELSE least({", ".join(least)}) END AS d2 FROM sl),
   near_face AS (SELECT mesh_id, pid, arg_min(fid, (d2, fid)) AS fid, min(d2) AS d2 FROM ds GROUP BY 1, 2)"""


@query("nearest_face_normals", "C6", f"""WITH {face_distance_sql()}
   SELECT n.mesh_id, pid, n.fid, round(d2, 6) AS d2, {", ".join(f"floor(greatest(0.0, least(255.0, (n{t}/sqrt(nx*nx + ny*ny + nz*nz)*0.5::DOUBLE + 0.5::DOUBLE)*255.0::DOUBLE)))::INT AS {c}" for c, t in zip("rgb", "xyz"))}
   FROM near_face n JOIN fc ON fc.mesh_id = n.mesh_id AND fc.fid = n.fid""", ("tri", "face_geo"))
def _(v):
    found = nearest.nearest_normals(sample_points(v), mesh.drop_degenerate(v.stored_triangles))
    return found.withColumn("d2", F.round("d2", 6))


TEX = 128


def atlas(v):
    """Texture coordinates for every face: a right triangle in one of 256 cells of the atlas."""
    s, t = (F.col("fid") % 16) / 16.0, (F.expr("fid div 16") % 16) / 16.0
    return v.stored_triangles.withColumns(
        {"a_s": s, "a_t": t, "b_s": s + 0.0625, "b_t": t, "c_s": s, "c_t": t + 0.0625}
    )


DUCK_VIEWS["texels"] = (("tri",), f"""
  SELECT mesh_id, px, py, max(fid) AS fid, arg_max(w0*ax+w1*bx+(1-w0-w1)*cx, fid) AS x, arg_max(w0*ay+w1*by_+(1-w0-w1)*cy, fid) AS y, arg_max(w0*az+w1*bz+(1-w0-w1)*cz, fid) AS z FROM (
    SELECT *, ((bu-(px+0.5::DOUBLE))*(cv-(py+0.5::DOUBLE)) - (bv-(py+0.5::DOUBLE))*(cu-(px+0.5::DOUBLE)))/a2 AS w0,
      ((cu-(px+0.5::DOUBLE))*(av-(py+0.5::DOUBLE)) - (cv-(py+0.5::DOUBLE))*(au-(px+0.5::DOUBLE)))/a2 AS w1 FROM (
      SELECT *, unnest(generate_series(y0, y1))::INT AS py FROM (
        SELECT *, unnest(generate_series(x0, x1))::INT AS px FROM (
          SELECT *, (bu-au)*(cv-av) - (bv-av)*(cu-au) AS a2, greatest(0, least({TEX - 1}, floor(least(au,bu,cu))::INT)) AS x0, greatest(0, least({TEX - 1}, ceil(greatest(au,bu,cu))::INT)) AS x1,
            greatest(0, least({TEX - 1}, floor(least(av,bv,cv))::INT)) AS y0, greatest(0, least({TEX - 1}, ceil(greatest(av,bv,cv))::INT)) AS y1 FROM (
            SELECT *, s*{TEX} AS au, (1.0::DOUBLE-t)*{TEX} AS av, (s+0.0625::DOUBLE)*{TEX} AS bu, (1.0::DOUBLE-t)*{TEX} AS bv, s*{TEX} AS cu, (1.0::DOUBLE-(t+0.0625::DOUBLE))*{TEX} AS cv FROM (
              SELECT *, (fid%16)/16.0::DOUBLE AS s, (fid//16%16)/16.0::DOUBLE AS t FROM tri)))))) WHERE w0 >= -1e-5 AND w1 >= -1e-5 AND 1-w0-w1 >= -1e-5 GROUP BY mesh_id, px, py""")  # fmt: skip


@query("uv_texels", "I28", "SELECT mesh_id, px, py, fid, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM texels", ("texels",))
def _(v):
    t = bake.texels(atlas(v), TEX)
    return t.select("mesh_id", "px", "py", "fid", *[F.round(c, 5).alias(c) for c in g.XYZ])


def colours(v):
    t = bake.texels(atlas(v), TEX)
    return materialize(t.select("mesh_id", "px", "py", (F.col("fid") % 256).cast("int").alias("r"), (F.col("px") % 200).alias("g"), (F.col("py") * 2 % 251).alias("b")), "colours")


def _gutter(prev: str, name: str) -> str:
    return f"""{name} AS (SELECT mesh_id, px, py, r, g, b FROM {prev} UNION ALL
      SELECT c.mesh_id, c.px+dx AS px, c.py+dy AS py, floor(avg(r))::INT, floor(avg(g))::INT, floor(avg(b))::INT FROM {prev} c, (SELECT * FROM range(-1,2) a(dx), range(-1,2) b(dy) WHERE dx<>0 OR dy<>0)
      WHERE c.px+dx BETWEEN 0 AND {TEX - 1} AND c.py+dy BETWEEN 0 AND {TEX - 1} AND NOT EXISTS (SELECT 1 FROM {prev} q WHERE q.mesh_id=c.mesh_id AND q.px=c.px+dx AND q.py=c.py+dy) GROUP BY 1, 2, 3)"""


@query("normal_map_gutter", "I27", f"""WITH g0 AS (SELECT mesh_id, px, py, (fid%256)::INT AS r, px%200 AS g, py*2%251 AS b FROM texels), {_gutter('g0', 'g1')}, {_gutter('g1', 'g2')} SELECT mesh_id, px::INT AS px, py::INT AS py, r, g, b FROM g2""", ("texels",))
def _(v):
    return bake.fill_gutter(colours(v), TEX, 2)


@query("baked_normal_map", "C6 I27 I28")
def _(v):
    return bake.bake_normals(mesh.drop_degenerate(v.stored_triangles), atlas(v), 64, 2)


# --- mesh text ---------------------------------------------------------------

OBJ = """vn AS (SELECT mesh_id, vid, x, y, z, row_number() OVER (PARTITION BY mesh_id ORDER BY vid) AS n FROM verts),
   fc AS (SELECT c.mesh_id, c.fid, max(n) FILTER (corner=0) AS n0, max(n) FILTER (corner=1) AS n1, max(n) FILTER (corner=2) AS n2 FROM corners c JOIN vn ON vn.mesh_id=c.mesh_id AND vn.x=c.x AND vn.y=c.y AND vn.z=c.z GROUP BY 1, 2)"""


def text_lines(v):
    vertices = materialize(mesh.weld(v.stored_triangles), "vertices")
    return meshtext.obj_lines(vertices, mesh.indexed(v.stored_triangles, vertices))


@query("mesh_text_lines", "A9", f"""WITH {OBJ} SELECT mesh_id, 0 AS part, n-1 AS line_no, printf('v %.6f %.6f %.6f', x, y, z) AS line FROM vn
   UNION ALL SELECT mesh_id, 1, row_number() OVER (PARTITION BY mesh_id ORDER BY fid) - 1, 'f ' || n0 || ' ' || n1 || ' ' || n2 FROM fc""", ("verts", "corners"))
def _(v):
    return text_lines(v)


@query("mesh_text_parse", "A8", f"""WITH {OBJ} SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY fid) - 1 AS fid, n0-1 AS v0, n1-1 AS v1, n2-1 AS v2 FROM fc""", ("verts", "corners"))
def _(v):
    _, faces = meshtext.parse_obj(text_lines(v), ("part", "line_no"))
    return faces
