"""Queries over voxels: sampling, dilation, fill, exposed faces, occupancy, repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlake.operators import hull, mesh, voxels
from facetlake.session import materialize
from facetlake.starschema.duckviews import DUCK_VIEWS
from facetlake.starschema.registry import query

DIV = 64


def _samples(key: str, div: int) -> str:
    def cell(t: str, b: str) -> str:
        return f"round_even((a{t} + (b{b} - a{t})*s/n + (c{t} - a{t})*t/n)/pitch, 0)::BIGINT"

    return f"""
      SELECT DISTINCT mesh_id, {cell('x', 'x')} AS i, {cell('y', 'y_')} AS j, {cell('z', 'z')} AS k FROM (
        SELECT *, unnest(generate_series(0, n - s))::INT AS t FROM (
          SELECT *, unnest(generate_series(0, n))::INT AS s FROM (
            SELECT f.* EXCLUDE (mesh_id), f.mid AS mesh_id, pitch, greatest(1, ceil(greatest(sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz)), sqrt((bx-cx)*(bx-cx)+(by_-cy)*(by_-cy)+(bz-cz)*(bz-cz)),
              sqrt((cx-ax)*(cx-ax)+(cy-ay)*(cy-ay)+(cz-az)*(cz-az))) / (pitch*0.5::DOUBLE))::INT) AS n
            FROM (SELECT *, {key} AS mid FROM tri) f JOIN (SELECT {key} AS mid, greatest(max(greatest(ax,bx,cx))-min(least(ax,bx,cx)), max(greatest(ay,by_,cy))-min(least(ay,by_,cy)), max(greatest(az,bz,cz))-min(least(az,bz,cz)))/{div}.0::DOUBLE AS pitch
              FROM tri GROUP BY 1) USING (mid))))"""  # fmt: skip


DUCK_VIEWS["vox"] = (("tri",), _samples("mesh_id", DIV))
DUCK_VIEWS["box_vox"] = (("tri",), _samples("(fid//16)::VARCHAR", 16))
DUCK_VIEWS["dilated"] = (("vox",), """
  SELECT DISTINCT mesh_id, i+di AS i, j+dj AS j, k+dk AS k FROM vox, (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(di,dj,dk)""")  # fmt: skip
# Flood from outside, cell by cell, inside the bounding box grown by one.
DUCK_VIEWS["bounds"] = (("box_vox",), "SELECT mesh_id, min(i)-1 AS i0, max(i)+1 AS i1, min(j)-1 AS j0, max(j)+1 AS j1, min(k)-1 AS k0, max(k)+1 AS k1 FROM box_vox GROUP BY 1")
DUCK_VIEWS["outside"] = (("bounds", "box_vox"), """
  SELECT mesh_id, i0 AS i, j0 AS j, k0 AS k FROM bounds
  UNION
  SELECT o.mesh_id, o.i+di, o.j+dj, o.k+dk FROM outside o CROSS JOIN (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) d(di,dj,dk) JOIN bounds b ON b.mesh_id=o.mesh_id
  LEFT JOIN box_vox v ON v.mesh_id=o.mesh_id AND v.i=o.i+di AND v.j=o.j+dj AND v.k=o.k+dk
  WHERE v.mesh_id IS NULL AND o.i+di BETWEEN i0 AND i1 AND o.j+dj BETWEEN j0 AND j1 AND o.k+dk BETWEEN k0 AND k1""")  # fmt: skip


def shell(v):
    return voxels.voxelise(v.triangles, voxels.pitches(v.triangles, DIV))


def box_meshes(v):
    return v.triangles.withColumn("mesh_id", F.expr("CAST(fid div 16 AS STRING)"))


@query("voxel_shell", "V1 U5", "SELECT mesh_id, i, j, k FROM vox", ("vox",))
def _(v):
    return shell(v)


@query("voxel_dilation", "V2", "SELECT mesh_id, i, j, k FROM dilated", ("dilated",))
def _(v):
    return voxels.dilate(shell(v))


@query("voxel_fill", "V3", """SELECT mesh_id, (i1-i0+1)*(j1-j0+1)*(k1-k0+1) - n AS cells FROM bounds JOIN (SELECT mesh_id, count(*) AS n FROM outside GROUP BY 1) USING (mesh_id)""", ("bounds", "outside"))
def _(v):
    boxes = box_meshes(v)
    filled = voxels.fill(voxels.voxelise(boxes, voxels.pitches(boxes, 16)))
    return filled.groupBy("mesh_id").agg(F.count("*").alias("cells"))


@query("voxel_exposed_faces", "V4", """SELECT mesh_id, count(*) AS faces FROM (SELECT v.mesh_id FROM vox v CROSS JOIN (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) d(di,dj,dk)
   LEFT JOIN vox w ON w.mesh_id=v.mesh_id AND w.i=v.i+di AND w.j=v.j+dj AND w.k=v.k+dk WHERE w.mesh_id IS NULL) GROUP BY 1""", ("vox",))
def _(v):
    return voxels.exposed(shell(v)).groupBy("mesh_id").agg(F.count("*").alias("faces"))


def surface_sql() -> str:
    """Two triangles for every voxel face that has no neighbour, corner by corner."""
    rows = []
    for side, (axis, sign) in enumerate([(0, 1), (0, -1), (1, 1), (1, -1), (2, 1), (2, -1)]):
        ring = [(-1, -1), (1, -1), (1, 1), (-1, 1)]
        ring = ring if sign > 0 else ring[::-1]
        step = [sign if a == axis else 0 for a in range(3)]
        for half, picks in enumerate(((0, 1, 2), (0, 2, 3))):
            spot = []
            for pick in picks:
                at = {axis: sign, (axis + 1) % 3: ring[pick][0], (axis + 2) % 3: ring[pick][1]}
                spot += [str(at[a] / 2) for a in range(3)]
            rows.append(f"({side}, {half}, {step[0]}, {step[1]}, {step[2]}, {', '.join(spot)})")
    names = [f"{k}{t}" for k in "abc" for t in "xyz"]
    cells = [f"round((v.{n} + q.{c}::DOUBLE)*pitch, 6) AS \"{c}\"" for c, n in zip(names, "ijk" * 3)]
    return f"""WITH q(side, half, di, dj, dk, {", ".join(f'"{n}"' for n in names)}) AS (VALUES {", ".join(rows)}),
   p AS (SELECT mesh_id, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z))/{DIV}.0::DOUBLE AS pitch FROM corners GROUP BY 1)
   SELECT v.mesh_id, (((v.i + 262144)*524288 + v.j + 262144)*524288 + v.k + 262144)*12 + side*2 + half AS fid, {", ".join(cells).replace('q."', 'q."')}
   FROM vox v CROSS JOIN q JOIN p ON p.mesh_id = v.mesh_id LEFT JOIN vox w ON w.mesh_id=v.mesh_id AND w.i=v.i+di AND w.j=v.j+dj AND w.k=v.k+dk WHERE w.mesh_id IS NULL"""


@query("voxel_surface", "V4", surface_sql(), ("vox", "corners"))
def _(v):
    faces = voxels.surface(shell(v), voxels.pitches(v.triangles, DIV))
    return faces.select("mesh_id", "fid", *[F.round(f"{k}{t}", 6).alias(f"{k}{t}") for k in "abc" for t in "xyz"])


@query("voxel_erosion", "V4", """SELECT mesh_id, i, j, k FROM (SELECT mesh_id, i+di AS i, j+dj AS j, k+dk AS k, count(*) AS n FROM dilated, (VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) o(di,dj,dk) GROUP BY 1, 2, 3, 4) WHERE n = 7""", ("dilated",))
def _(v):
    return voxels.erode(voxels.dilate(shell(v)))


@query("voxel_occupancy", "V6", f"""WITH p AS (SELECT mesh_id, greatest(max(x)-min(x), max(y)-min(y), max(z)-min(z))/{DIV}.0::DOUBLE AS pitch FROM corners GROUP BY 1)
   SELECT mesh_id, count(*) AS cells, round(count(*)*any_value(pitch)**3, 3) AS volume, round(count(*)/((max(i)-min(i)+1)*(max(j)-min(j)+1)*(max(k)-min(k)+1)), 8) AS fill FROM vox JOIN p USING (mesh_id) GROUP BY 1""", ("vox", "corners"))
def _(v):
    o = voxels.occupancy(shell(v), voxels.pitches(v.triangles, DIV))
    return o.select("mesh_id", "cells", F.round("volume", 3).alias("volume"), F.round("fill", 8).alias("fill"))


@query("mesh_repair", "V5")
def _(v):
    """Repair of torn and closed single boxes: closed ones are left alone."""
    boxes = materialize(box_meshes(v), "boxes")
    topo = mesh.topology(mesh.edge_stats(boxes))
    fills = boxes.select("mesh_id").distinct().join(topo, "mesh_id", "left").select(
        "mesh_id", F.when(F.col("holes") > 0, F.lit(0.0)).otherwise(F.lit(1.0)).alias("fill")
    )
    _, report = voxels.repair(boxes, fills)
    return report


@query("mesh_repair_by_hull_fill", "V5 D17")
def _(v):
    """Repair of whole assemblies judged by their hull fill."""
    fills = hull.fill_ratio(v.stored_triangles).select("mesh_id", "fill")
    _, report = voxels.repair(v.stored_triangles, fills)
    return report
