"""Queries over meshes: weld, topology, components, measures, cleanup, drawings."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlake.functions import geometry as g
from facetlake.operators import components as cc
from facetlake.operators import mesh
from facetlake.session import materialize
from facetlake.starschema.registry import query


def flat(df, *names):
    """Spread position-key structs into integer columns ``<name>x <name>y <name>z`` in model units."""
    out = df
    for n in names:
        out = out.withColumns({f"{n}{t}": F.expr(f"{n}.{t} div 1000000") for t in "xyz"})
    return out.drop(*names)


def adjacency(v):
    return mesh.adjacency(mesh.edge_stats(v.triangles))


def labelled(v):
    return materialize(cc.face_components(v.triangles, adjacency(v)), "components")


EDGE_COLS = "p[1] AS px, p[2] AS py, p[3] AS pz, q[1] AS qx, q[2] AS qy, q[3] AS qz"


@query("mesh_weld", "D6", "SELECT mesh_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, min(fid*3+corner)::BIGINT AS vid, count(*) AS copies FROM corners GROUP BY mesh_id, x, y, z", ("corners",))
def _(v):
    return mesh.weld(v.triangles).drop("key")


@query("mesh_indexed_faces", "C3", """WITH ids AS (SELECT mesh_id, x, y, z, min(fid*3+corner)::BIGINT AS vid FROM corners GROUP BY mesh_id, x, y, z)
  SELECT mesh_id, fid, max(CASE WHEN corner=0 THEN vid END) AS v0, max(CASE WHEN corner=1 THEN vid END) AS v1, max(CASE WHEN corner=2 THEN vid END) AS v2
  FROM corners JOIN ids USING (mesh_id, x, y, z) GROUP BY mesh_id, fid""", ("corners",))
def _(v):
    return mesh.indexed(v.triangles)


@query("mesh_face_gather", "C3", "SELECT mesh_id, fid, ax, ay, az, bx, by_ AS by, bz, cx, cy, cz FROM tri", ("tri",))
def _(v):
    vertices = mesh.weld(v.triangles)
    return mesh.gather(mesh.indexed(v.triangles, vertices), vertices)


@query("mesh_referenced_vertices", "C4", """WITH large AS (SELECT mesh_id, fid FROM face_geo WHERE area >= 200),
  used AS (SELECT DISTINCT mesh_id, x, y, z FROM corners JOIN large USING (mesh_id, fid)),
  ids AS (SELECT mesh_id, x, y, z, min(fid*3+corner)::BIGINT AS vid FROM corners GROUP BY mesh_id, x, y, z)
  SELECT mesh_id, vid FROM ids JOIN used USING (mesh_id, x, y, z)""", ("face_geo", "corners"))
def _(v):
    """Vertices left once the faces below an area limit are gone."""
    vertices = mesh.weld(v.triangles)
    large = v.triangles.filter(g.area() >= 200)
    return mesh.referenced(vertices, mesh.indexed(large, vertices)).select("mesh_id", "vid")


@query("mesh_edges", "D7", f"SELECT mesh_id, {EDGE_COLS}, n FROM edge_stats", ("edge_stats",))
def _(v):
    return flat(mesh.edge_stats(v.triangles).select("mesh_id", "p", "q", "n"), "p", "q")


@query("mesh_face_adjacency", "C2", "SELECT mesh_id, fa, fb FROM face_adj", ("face_adj",))
def _(v):
    return adjacency(v)


@query("mesh_holes_and_pinches", "D8 D9 D10", """SELECT mesh_id, count(*) AS n_edges, count(*) FILTER (n=1) AS holes, count(*) FILTER (n>2) AS non_manifold,
  bool_and(n=2) AS watertight, bool_and(n<>2 OR s=0) AS winding_consistent FROM edge_stats GROUP BY mesh_id""", ("edge_stats",))
def _(v):
    return mesh.topology(mesh.edge_stats(v.triangles))


@query("mesh_boundary_faces", "D12", "SELECT mesh_id, count(DISTINCT fa) AS boundary_faces FROM edge_stats WHERE n=1 GROUP BY mesh_id", ("edge_stats",))
def _(v):
    return mesh.boundary_faces(mesh.edge_stats(v.triangles))


SOLID = """solid AS (SELECT f.mesh_id, f.n_faces, p.n_vertices, e.n_edges, e.holes, e.non_manifold, e.watertight, e.winding_consistent,
     p.n_vertices - e.n_edges + f.n_faces AS euler, coalesce(b.n, 0) AS boundary_faces, e.watertight AND e.winding_consistent AS printable,
     CASE WHEN e.watertight THEN round(abs(f.v6)/6.0, 4) END AS volume
   FROM (SELECT {key} AS mesh_id, count(*) AS n_faces, sum(vol6) AS v6 FROM face_geo GROUP BY 1) f
   JOIN (SELECT {key} AS mesh_id, count(DISTINCT (x,y,z)) AS n_vertices FROM corners GROUP BY 1) p USING (mesh_id)
   JOIN (SELECT mesh_id, count(*) AS n_edges, count(*) FILTER (n=1) AS holes, count(*) FILTER (n>2) AS non_manifold, bool_and(n=2) AS watertight,
       bool_and(n<>2 OR s=0) AS winding_consistent FROM es GROUP BY 1) e USING (mesh_id)
   LEFT JOIN (SELECT mesh_id, count(DISTINCT fa) AS n FROM es WHERE n=1 GROUP BY 1) b USING (mesh_id))"""


@query("mesh_solid_report", "D11 D13", "WITH es AS (SELECT * FROM edge_stats), " + SOLID.format(key="mesh_id") + " SELECT * FROM solid", ("face_geo", "edge_stats"))
def _(v):
    return mesh.solid_report(v.triangles).withColumn("volume", F.round("volume", 4))


@query("box_solid_report", "D9 D11 D13 D16", """WITH es AS (SELECT (fid//16)::VARCHAR AS mesh_id, p, q, count(*) AS n, sum(s) AS s, min(fid) AS fa FROM half_edges GROUP BY 1, p, q), """
       + SOLID.format(key="(fid//16)::VARCHAR") + " SELECT * FROM solid", ("face_geo", "half_edges"))
def _(v):
    """The same report with every box as its own mesh: many small meshes instead of few large ones."""
    boxes = v.triangles.withColumn("mesh_id", F.expr("CAST(fid div 16 AS STRING)"))
    return mesh.solid_report(boxes).withColumn("volume", F.round("volume", 4))


@query("mesh_measures", "D14 D15 D16", """SELECT mesh_id, count(*) AS n_faces, min(least(ax,bx,cx)) AS min_x, max(greatest(az,bz,cz)) AS max_z,
   max(greatest(ax,bx,cx)) - min(least(ax,bx,cx)) AS extent_x, max(greatest(ay,by_,cy)) - min(least(ay,by_,cy)) AS extent_y,
   max(greatest(az,bz,cz)) - min(least(az,bz,cz)) AS extent_z, round(sum(area), 3) AS area, round(sum(vol6)/6.0, 3) AS volume,
   round(sum(area*(ax+bx+cx)/3.0)/sum(area), 4) AS centre_x FROM face_geo GROUP BY mesh_id""", ("face_geo",))
def _(v):
    return mesh.measures(v.triangles).select(
        "mesh_id", "n_faces", "min_x", "max_z", "extent_x", "extent_y", "extent_z", F.round("area", 3).alias("area"),
        F.round("volume", 3).alias("volume"), F.round("centre_x", 4).alias("centre_x"),
    )


@query("face_areas", "D15", "SELECT mesh_id, fid, round(area, 6) AS area FROM face_geo", ("face_geo",))
def _(v):
    return v.triangles.select("mesh_id", "fid", F.round(g.area(), 6).alias("area"))


@query("mesh_components", "E1", "SELECT mesh_id, fid, comp FROM components", ("components",))
def _(v):
    return cc.face_components(v.triangles, adjacency(v))


CLEAN = """good AS (SELECT f.* FROM face_geo f WHERE area > 0),
   firsts AS (SELECT mesh_id, min(fid) AS fid FROM (SELECT mesh_id, fid, list_sort([row(ax,ay,az), row(bx,by_,bz), row(cx,cy,cz)]) AS k FROM good) GROUP BY mesh_id, k)"""


@query("mesh_drop_bad_faces", "D20", f"WITH {CLEAN} SELECT mesh_id, fid FROM firsts", ("face_geo",))
def _(v):
    return mesh.drop_duplicates(mesh.drop_degenerate(v.stored_triangles)).select("mesh_id", "fid")


DEBRIS = """areas AS (SELECT c.mesh_id, c.comp, count(*) AS n_faces, sum(area) AS area FROM components c JOIN face_geo USING (mesh_id, fid) GROUP BY 1,2),
   marked AS (SELECT *, area >= 0.0001*sum(area) OVER (PARTITION BY mesh_id) OR
      (max(area) OVER (PARTITION BY mesh_id) < 0.0001*sum(area) OVER (PARTITION BY mesh_id) AND row_number() OVER (PARTITION BY mesh_id ORDER BY area DESC, comp) = 1) AS keep FROM areas)"""


@query("mesh_debris_filter", "D19", f"WITH {DEBRIS} SELECT mesh_id, comp, n_faces, round(area, 4) AS area, keep FROM marked", ("components", "face_geo"))
def _(v):
    return mesh.surviving_components(mesh.component_areas(v.triangles, labelled(v)), 0.0001).withColumn("area", F.round("area", 4))


@query("mesh_cleanup_report", "D21", f"""WITH RECURSIVE {CLEAN},
   ct AS (SELECT c.* FROM corners c JOIN firsts USING (mesh_id, fid)),
   he AS (SELECT a.mesh_id, a.fid, least(row(a.x,a.y,a.z), row(b.x,b.y,b.z)) AS p, greatest(row(a.x,a.y,a.z), row(b.x,b.y,b.z)) AS q
     FROM ct a JOIN ct b ON a.mesh_id=b.mesh_id AND a.fid=b.fid AND b.corner = (a.corner+1)%3),
   fa AS (SELECT DISTINCT mesh_id, min(fid) AS a, max(fid) AS b FROM he GROUP BY mesh_id, p, q HAVING count(*) = 2),
   r AS (SELECT mesh_id, fid, fid AS root FROM firsts UNION
         SELECT r.mesh_id, e.b, r.root FROM r JOIN (SELECT mesh_id, a, b FROM fa UNION ALL SELECT mesh_id, b, a FROM fa) e ON e.mesh_id=r.mesh_id AND e.a=r.fid WHERE r.root < e.b),
   comp AS (SELECT mesh_id, fid, min(root) AS comp FROM r GROUP BY 1,2),
   areas AS (SELECT mesh_id, comp, sum(area) AS area FROM comp JOIN face_geo USING (mesh_id, fid) GROUP BY 1,2),
   kept AS (SELECT *, area >= 0.0001*sum(area) OVER (PARTITION BY mesh_id) AS keep FROM areas),
   fin AS (SELECT mesh_id, fid FROM comp JOIN kept USING (mesh_id, comp) WHERE keep),
   bef AS (SELECT mesh_id, count(DISTINCT fid) AS faces_before, count(*) AS vertices_before FROM corners GROUP BY 1),
   aft AS (SELECT mesh_id, count(DISTINCT fid) AS faces_after, count(DISTINCT (x,y,z)) AS vertices_after FROM corners JOIN fin USING (mesh_id, fid) GROUP BY 1)
  SELECT mesh_id, faces_before, vertices_before, faces_after, vertices_after, (SELECT count(*) FROM kept k WHERE k.mesh_id=bef.mesh_id AND NOT keep) AS components_removed
  FROM bef JOIN aft USING (mesh_id)""", ("face_geo", "corners"))
def _(v):
    from facetlake.plans.cleanup import clean

    _, report = clean(v.stored_triangles, 0.0001)
    return report.select("mesh_id", "faces_before", "vertices_before", "faces_after", "vertices_after", "components_removed")


@query("mesh_sanity", "D18", """WITH m AS (SELECT mesh_id, max(greatest(ax,bx,cx)) - min(least(ax,bx,cx)) AS ex, max(greatest(ay,by_,cy)) - min(least(ay,by_,cy)) AS ey,
     max(greatest(az,bz,cz)) - min(least(az,bz,cz)) AS ez, sum(area) AS area, abs(sum(vol6))/6.0 AS volume FROM face_geo GROUP BY 1),
   t AS (SELECT mesh_id, count(*) FILTER (n=1) AS holes, count(*) FILTER (n>2) AS non_manifold FROM edge_stats GROUP BY 1),
   c AS (SELECT mesh_id, count(DISTINCT comp) AS n_components FROM components GROUP BY 1),
   j AS (SELECT *, greatest(ex,ey,ez) AS longest, area/(2.0*(ex*ey+ey*ez+ex*ez)) AS ratio, volume/(ex*ey*ez) AS fill FROM m JOIN t USING (mesh_id) JOIN c USING (mesh_id)),
   w AS (SELECT *, concat_ws('; ', CASE WHEN least(ex,ey,ez)/longest >= 0.95 AND (fill < 0.25 OR ratio > 2.0) THEN 'near-cubic and nearly empty' END,
       CASE WHEN ratio > 2.0 THEN 'surface area far above its bounding box' END, CASE WHEN holes > 0 THEN holes || ' open edges' END) AS warnings FROM j)
   SELECT mesh_id, warnings = '' AS ok, round(ex/longest, 6) AS aspect_x, round(ez/longest, 6) AS aspect_z, round(ratio, 6) AS area_ratio, round(fill, 6) AS fill,
     n_components, holes, non_manifold, warnings FROM w""", ("face_geo", "edge_stats", "components"))
def _(v):
    r = mesh.sanity_report(v.stored_triangles, labelled(v))
    return r.select(
        "mesh_id", "ok", *[F.round(c, 6).alias(c) for c in ("aspect_x", "aspect_z", "area_ratio", "fill")],
        "n_components", "holes", "non_manifold", F.array_join("warnings", "; ").alias("warnings"),
    )


FEATURE = """un AS (SELECT mesh_id, fid, CASE WHEN area > 0 THEN nx/(2*area) ELSE 0 END AS nx, CASE WHEN area > 0 THEN ny/(2*area) ELSE 0 END AS ny,
     CASE WHEN area > 0 THEN nz/(2*area) ELSE 0 END AS nz FROM face_geo),
   fp AS (SELECT e.mesh_id, e.p, e.q, a.nx AS nxa, a.ny AS nya, a.nz AS nza, b.nx AS nxb, b.ny AS nyb, b.nz AS nzb FROM edge_stats e
     JOIN un a ON a.mesh_id=e.mesh_id AND a.fid=e.fa JOIN un b ON b.mesh_id=e.mesh_id AND b.fid=e.fb WHERE e.n=2 AND fa < fb),
   feat AS (SELECT mesh_id, p, q FROM edge_stats WHERE n=1 UNION
     SELECT mesh_id, p, q FROM fp WHERE acos(greatest(-1, least(1, nxa*nxb+nya*nyb+nza*nzb))) > radians(25)),
   sil AS (SELECT DISTINCT mesh_id, 'front' AS view, p, q FROM fp WHERE (nya>0) <> (nyb>0) UNION SELECT mesh_id, 'side', p, q FROM fp WHERE (nxa>0) <> (nxb>0)
     UNION SELECT mesh_id, 'top', p, q FROM fp WHERE (nza>0) <> (nzb>0))"""


@query("mesh_feature_edges", "H2", f"WITH {FEATURE} SELECT mesh_id, {EDGE_COLS} FROM feat", ("face_geo", "edge_stats"))
def _(v):
    return flat(mesh.feature_edges(v.triangles), "p", "q")


@query("mesh_silhouette_edges", "I5", f"WITH {FEATURE} SELECT mesh_id, view, {EDGE_COLS} FROM sil", ("face_geo", "edge_stats"))
def _(v):
    return flat(mesh.silhouette_edges(v.triangles), "p", "q")


EXTENTS = """ext AS (SELECT mesh_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM corners GROUP BY 1),
   vw AS (SELECT mesh_id, 'front' AS view, x0 AS u0, x1 AS u1, z0 AS v0, z1 AS v1 FROM ext UNION ALL SELECT mesh_id, 'side', y0, y1, z0, z1 FROM ext
     UNION ALL SELECT mesh_id, 'top', x0, x1, y0, y1 FROM ext)"""


@query("mesh_axis_views", "I4", f"WITH {EXTENTS} SELECT mesh_id, view, u0::DOUBLE AS min_u, v0::DOUBLE AS min_v, (u1-u0)::DOUBLE AS width, (v1-v0)::DOUBLE AS height FROM vw", ("corners",))
def _(v):
    return mesh.view_extents(v.triangles).select("mesh_id", "view", "min_u", "min_v", "width", "height")


@query("mesh_drawing_lines", "H1 I6", f"""WITH {FEATURE}, {EXTENTS},
   fit AS (SELECT *, least(680.0::DOUBLE/(u1-u0), 680.0::DOUBLE/(v1-v0)) AS s FROM vw),
   ed AS (SELECT mesh_id, view, p, q FROM feat, (VALUES ('front'),('side'),('top')) t(view) UNION SELECT mesh_id, view, p, q FROM sil),
   seg AS (SELECT e.mesh_id, e.view, CASE WHEN e.view='side' THEN p[2] ELSE p[1] END AS pu, CASE WHEN e.view='top' THEN p[2] ELSE p[3] END AS pv,
       CASE WHEN e.view='side' THEN q[2] ELSE q[1] END AS qu, CASE WHEN e.view='top' THEN q[2] ELSE q[3] END AS qv FROM ed e)
   SELECT seg.mesh_id, seg.view, round(60 + (680-(u1-u0)*s)/2 + (pu-u0)*s, 4) AS x1, round(60 + (680-(v1-v0)*s)/2 + (fit.v1-pv)*s, 4) AS y1,
     round(60 + (680-(u1-u0)*s)/2 + (qu-u0)*s, 4) AS x2, round(60 + (680-(v1-v0)*s)/2 + (fit.v1-qv)*s, 4) AS y2
   FROM seg JOIN fit USING (mesh_id, view)""", ("face_geo", "edge_stats", "corners"))
def _(v):
    return mesh.drawing_lines(v.triangles).select("mesh_id", "view", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query("mesh_scaled_to_longest", "I3", """WITH e AS (SELECT mesh_id, 120.0::DOUBLE/greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z)) AS f FROM corners GROUP BY 1)
   SELECT mesh_id, fid, round(ax*f, 6) AS ax, round(by_*f, 6) AS by, round(cz*f, 6) AS cz FROM tri JOIN e USING (mesh_id)""", ("tri",))
def _(v):
    t = mesh.scaled(v.triangles, mesh.longest_edge_factor(v.triangles, 120))
    return t.select("mesh_id", "fid", *[F.round(c, 6).alias(c) for c in ("ax", "by", "cz")])


@query("mesh_seam_normals", "D23", """WITH s AS (SELECT mesh_id, x, y, z, sum(nx) AS sx, sum(ny) AS sy, sum(nz) AS sz FROM corners JOIN face_geo USING (mesh_id, fid) GROUP BY 1,2,3,4),
   u AS (SELECT *, nullif(sqrt(sx*sx+sy*sy+sz*sz), 0) AS l FROM s)
   SELECT mesh_id, fid, corner, round(coalesce(sx/l,0), 6) + 0.0 AS nx, round(coalesce(sy/l,0), 6) + 0.0 AS ny, round(coalesce(sz/l,0), 6) + 0.0 AS nz FROM corners JOIN u USING (mesh_id, x, y, z)""", ("corners", "face_geo"))
def _(v):
    n = mesh.vertex_normals(v.triangles)
    return n.select("mesh_id", "fid", "corner", *[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@query("mesh_largest_components", "F4 G1", f"""WITH {DEBRIS} SELECT mesh_id, comp, rank FROM (SELECT mesh_id, comp, row_number() OVER (PARTITION BY mesh_id ORDER BY area DESC, comp) - 1 AS rank FROM areas) WHERE rank < 8""", ("components", "face_geo"))
def _(v):
    areas = mesh.component_areas(v.triangles, labelled(v))
    return mesh.ranked_components(areas, 8).select("mesh_id", "comp", "rank")
