"""The derived views again, written for DuckDB, as composable CTEs."""

from __future__ import annotations

from facetlake.starschema.boxes import BOX

_BOX_VALUES = ", ".join(f"({k},{a},{b},{c})" for k, (a, b, c) in enumerate(BOX))

# name -> (views it reads, SQL)
DUCK_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "base_px": ((), """
        SELECT vec_id*8 AS seq, label AS shoot_id, r.i AS pos,
          greatest(0, least(255, CAST(floor(128 + CAST(embedding[r.i+1] AS DOUBLE)*700) AS INT))) AS g
        FROM embeddings, range(64) r(i)"""),
    "sym_px": (("base_px",), """
        SELECT a.shoot_id, a.seq, a.pos, b.g FROM base_px a JOIN base_px b
          ON a.seq=b.seq AND b.pos = a.pos - a.pos%8 + least(a.pos%8, 7-a.pos%8)
        WHERE (a.seq//8) % 11 = 0"""),
    "pixels": (("base_px", "sym_px"), """
        SELECT shoot_id, seq, pos, g FROM base_px
        UNION ALL SELECT shoot_id, seq+1, pos, CASE WHEN pos = seq%64 THEN 255-g ELSE g END FROM base_px WHERE (seq//8)%5=0
        UNION ALL SELECT shoot_id, seq+2, pos - pos%8 + (7-pos%8), g FROM base_px WHERE (seq//8)%7=0
        UNION ALL SELECT shoot_id, seq+3, pos, CASE WHEN pos=(seq//8)%64 THEN 255-g ELSE g END FROM sym_px
        UNION ALL SELECT shoot_id, seq+4, pos - pos%8 + (7-pos%8), CASE WHEN pos=(seq//8)%64 THEN 255-g ELSE g END FROM sym_px
        UNION ALL SELECT shoot_id, seq+5, pos, 120 + CASE WHEN (seq//8)%2=0 THEN g//40 ELSE g//64 END FROM base_px WHERE (seq//8)%13=0
        UNION ALL SELECT shoot_id, seq+6, pos, g FROM base_px WHERE (seq//8)%9=0"""),
    "photo_scores": (("pixels",), """
        SELECT shoot_id, seq, (64*sum(l*l) - sum(l)*sum(l)) / 4096.0::DOUBLE AS blur,
          avg((g<=5)::INT) AS dark, avg((g>=250)::INT) AS bright
        FROM (SELECT p.shoot_id, p.seq, p.pos, p.g,
                (max(u.g)+max(d.g)+max(lf.g)+max(rt.g)-4*p.g)::BIGINT AS l
              FROM pixels p
              JOIN pixels u ON u.shoot_id=p.shoot_id AND u.seq=p.seq AND u.pos = CASE WHEN p.pos < 8 THEN p.pos+8 ELSE p.pos-8 END
              JOIN pixels d ON d.shoot_id=p.shoot_id AND d.seq=p.seq AND d.pos = CASE WHEN p.pos >= 56 THEN p.pos-8 ELSE p.pos+8 END
              JOIN pixels lf ON lf.shoot_id=p.shoot_id AND lf.seq=p.seq AND lf.pos = CASE WHEN p.pos%8=0 THEN p.pos+1 ELSE p.pos-1 END
              JOIN pixels rt ON rt.shoot_id=p.shoot_id AND rt.seq=p.seq AND rt.pos = CASE WHEN p.pos%8=7 THEN p.pos-1 ELSE p.pos+1 END
              GROUP BY p.shoot_id, p.seq, p.pos, p.g)
        GROUP BY shoot_id, seq"""),
    "photos": (("pixels",), """
        SELECT shoot_id, seq, (480 + (seq%7)*160)::INT AS width, (360 + (seq%5)*240)::INT AS height,
          'shoots/' || shoot_id || '/' ||
          ['front','left','back','rear','right','front_left','top','IMG'][((seq//8)%8)::INT + 1] || '_' || seq || '.JPG' AS path
        FROM (SELECT DISTINCT shoot_id, seq FROM pixels)"""),
    "verdicts": (("photo_scores", "photos"), """
        SELECT *, CASE WHEN reasons = '' THEN 'accepted' ELSE 'rejected' END AS status FROM (
        SELECT s.shoot_id, s.seq, path, blur, dark, bright, width, height,
          concat_ws('; ',
            CASE WHEN greatest(width,height) < 640 THEN 'resolution too low (' || width || 'x' || height || ', need long edge >= 640)' END,
            CASE WHEN blur < 40 THEN 'too blurry (score ' || round_even(blur,0)::BIGINT || ' < 40)' END,
            CASE WHEN dark > 0.30 THEN 'underexposed (' || round_even(dark*100,0)::BIGINT || '% of pixels clipped)' END,
            CASE WHEN bright > 0.30 THEN 'overexposed (' || round_even(bright*100,0)::BIGINT || '% of pixels clipped)' END) AS reasons,
          concat_ws('; ',
            CASE WHEN blur >= 40 AND blur < 100 THEN 'soft focus (score ' || round_even(blur,0)::BIGINT || ')' END,
            CASE WHEN dark <= 0.30 AND dark > 0.10 THEN 'partially underexposed (' || round_even(dark*100,0)::BIGINT || '% clipped)' END,
            CASE WHEN bright <= 0.30 AND bright > 0.10 THEN 'partially overexposed (' || round_even(bright*100,0)::BIGINT || '% clipped)' END) AS warnings
        FROM photo_scores s JOIN photos p USING (shoot_id, seq))"""),
    "hashes": (("pixels",), """
        SELECT shoot_id, seq,
          CASE WHEN h >= 9223372036854775808::HUGEINT THEN (h - 18446744073709551616::HUGEINT)::BIGINT ELSE h::BIGINT END AS h,
          CASE WHEN f >= 9223372036854775808::HUGEINT THEN (f - 18446744073709551616::HUGEINT)::BIGINT ELSE f::BIGINT END AS h_flip
        FROM (
          SELECT a.shoot_id, a.seq,
            sum(CASE WHEN b.g > a.g THEN (1::HUGEINT << (63 - a.pos)::INT) ELSE 0::HUGEINT END) AS h,
            sum(CASE WHEN b.g < a.g THEN (1::HUGEINT << (63 - (a.pos - a.pos%8 + (14 - a.pos%8) % 8))::INT) ELSE 0::HUGEINT END) AS f
          FROM pixels a JOIN pixels b ON a.shoot_id=b.shoot_id AND a.seq=b.seq AND b.pos = a.pos - a.pos%8 + (a.pos%8 + 1) % 8
          GROUP BY a.shoot_id, a.seq)"""),
    "near_pairs": (("hashes",), """
        WITH c AS (SELECT *, min(seq) OVER (PARTITION BY shoot_id, h, h_flip) AS class FROM hashes)
        SELECT DISTINCT a.shoot_id, a.class AS earlier, b.class AS later, bit_count(xor(a.h, b.h))::INT AS d
        FROM c a JOIN c b ON a.shoot_id = b.shoot_id AND a.seq < b.seq
        WHERE bit_count(xor(a.h, b.h)) <= 6 AND NOT bit_count(xor(b.h, a.h_flip)) < bit_count(xor(b.h, a.h))"""),
    "boxes": ((), f"""
        SELECT p_brand AS mesh_id, p_partkey, (p_partkey%16)*60 AS x0, ((p_partkey//16)%16)*60 AS y0, (p_partkey//256)*60 AS z0,
          p_size::BIGINT AS dx, 7*(1+p_partkey%7) AS dy, 9*(1+p_partkey%5) AS dz FROM part"""),
    "box_faces": ((), f"""SELECT * FROM (VALUES {_BOX_VALUES}) t(k,a,b,c)"""),
    "tri_ids": (("boxes", "box_faces"), """
        SELECT mesh_id, p_partkey*16 + k AS fid, p_partkey, k, x0, y0, z0, dx, dy, dz, a AS v0,
          CASE WHEN p_partkey%20=3 AND k=5 THEN c ELSE b END AS v1,
          CASE WHEN p_partkey%20=3 AND k=5 THEN b ELSE c END AS v2
        FROM boxes CROSS JOIN box_faces
        WHERE NOT (p_partkey%10=0 AND k=11) AND (k<>12 OR p_partkey%25=1) AND (k<>13 OR p_partkey%15=2)"""),
    "corners": (("tri_ids",), """
        SELECT mesh_id, fid, n AS corner, (x0 + (v&1)*dx)::BIGINT AS x, (y0 + ((v>>1)&1)*dy)::BIGINT AS y, (z0 + ((v>>2)&1)*dz)::BIGINT AS z
        FROM (SELECT *, 0 AS n, v0 AS v FROM tri_ids UNION ALL SELECT *, 1, v1 FROM tri_ids UNION ALL SELECT *, 2, v2 FROM tri_ids)"""),
    "tri": (("corners",), """
        SELECT mesh_id, fid,
          max(CASE WHEN corner=0 THEN x END)::DOUBLE AS ax, max(CASE WHEN corner=0 THEN y END)::DOUBLE AS ay, max(CASE WHEN corner=0 THEN z END)::DOUBLE AS az,
          max(CASE WHEN corner=1 THEN x END)::DOUBLE AS bx, max(CASE WHEN corner=1 THEN y END)::DOUBLE AS by_, max(CASE WHEN corner=1 THEN z END)::DOUBLE AS bz,
          max(CASE WHEN corner=2 THEN x END)::DOUBLE AS cx, max(CASE WHEN corner=2 THEN y END)::DOUBLE AS cy, max(CASE WHEN corner=2 THEN z END)::DOUBLE AS cz
        FROM corners GROUP BY mesh_id, fid"""),
    "face_geo": (("tri",), """
        SELECT *, 0.5*sqrt(nx*nx + ny*ny + nz*nz) AS area FROM (
        SELECT *, (by_-ay)*(cz-az) - (bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) AS nz,
          ax*(by_*cz - bz*cy) + ay*(bz*cx - bx*cz) + az*(bx*cy - by_*cx) AS vol6 FROM tri)"""),
    "half_edges": (("corners",), """
        SELECT a.mesh_id, a.fid,
          least(row(a.x,a.y,a.z), row(b.x,b.y,b.z)) AS p, greatest(row(a.x,a.y,a.z), row(b.x,b.y,b.z)) AS q,
          CASE WHEN row(a.x,a.y,a.z) < row(b.x,b.y,b.z) THEN 1 ELSE -1 END AS s
        FROM corners a JOIN corners b ON a.mesh_id=b.mesh_id AND a.fid=b.fid AND b.corner = (a.corner+1)%3
        WHERE NOT (a.x=b.x AND a.y=b.y AND a.z=b.z)"""),
    "edge_stats": (("half_edges",), """
        SELECT mesh_id, p, q, count(*) AS n, sum(s)::BIGINT AS s, min(fid) AS fa, max(fid) AS fb
        FROM half_edges GROUP BY mesh_id, p, q"""),
    "face_adj": (("edge_stats",), """
        SELECT DISTINCT mesh_id, fa, fb FROM edge_stats WHERE n = 2 AND fa < fb"""),
    "components": (("tri", "face_adj"), """
        SELECT mesh_id, fid, min(root) AS comp FROM reach GROUP BY mesh_id, fid"""),
    "clip_frames": ((), """
        SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
          value AS score, event_type <> 'error' AS ok FROM events"""),
    "stages": ((), """
        SELECT user_id % 200 AS job_id, event_id AS seq,
          CASE event_type WHEN 'view' THEN 'ingest' WHEN 'click' THEN 'clean' WHEN 'purchase' THEN 'decimate' WHEN 'signup' THEN 'export' ELSE 'sanity' END AS name,
          CASE WHEN event_type='error' THEN 'failed' WHEN event_id%11=0 THEN 'skipped' ELSE 'ok' END AS status,
          props AS detail, value/10 AS seconds, ts FROM events"""),
    "polls": ((), """
        SELECT DISTINCT user_id % 30 AS project, date_trunc('hour', ts) AS poll_ts, 'vm-' || user_id AS name FROM events"""),
    "teardowns": ((), """
        SELECT user_id % 30 AS project, ts AS request_ts FROM events WHERE event_type = 'signup'"""),
    "machines": ((), """
        SELECT user_id % 30 AS project, 'vm-' || user_id AS name,
          CASE WHEN user_id%6 < 5 THEN ['nvidia-tesla-t4','nvidia-l4','nvidia-tesla-v100','nvidia-tesla-p4','nvidia-unlisted'][(user_id%6)::INT + 1] END AS accelerator,
          user_id%2=0 AS spot, CASE WHEN user_id%3=0 THEN 'TERMINATED' ELSE 'RUNNING' END AS status,
          min(ts) AS created, CASE WHEN user_id%5<>0 THEN 7200*(1+user_id%30) END AS max_run_s, max(ts) AS last_ts, user_id
        FROM events GROUP BY user_id"""),
    "rates": ((), """
        SELECT * FROM (VALUES ('nvidia-tesla-t4',true,0.11::DOUBLE),('nvidia-l4',true,0.21),('nvidia-tesla-v100',true,0.74),('nvidia-tesla-p4',true,0.09),
          ('nvidia-tesla-t4',false,0.35),('nvidia-l4',false,0.70),('nvidia-tesla-v100',false,2.48),('nvidia-tesla-p4',false,0.60)) t(accelerator,spot,usd_per_hour)"""),
    "files": ((), """
        SELECT doc_id % 50 AS job_id, doc_id,
          CASE WHEN doc_id%10=0 THEN 'model.glb' WHEN doc_id%10=9 THEN 'notes-' || doc_id || '.txt' ELSE 'model-' || n_chars || '.glb' END AS name,
          n_chars AS length, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS mtime, text FROM documents"""),
}

# Recursive parts must stand beside the views that read them.
RECURSIVE: dict[str, tuple[tuple[str, ...], str]] = {
    "reach": (("tri", "face_adj"), """
        SELECT mesh_id, fid, fid AS root FROM tri
        UNION
        SELECT r.mesh_id, e.b, r.root FROM reach r JOIN
          (SELECT mesh_id, fa AS a, fb AS b FROM face_adj UNION ALL SELECT mesh_id, fb, fa FROM face_adj) e
          ON e.mesh_id = r.mesh_id AND e.a = r.fid WHERE r.root < e.b"""),
}
DUCK_VIEWS["reach"] = RECURSIVE["reach"]
DUCK_VIEWS["components"] = (("reach",), DUCK_VIEWS["components"][1])


def with_views(names: tuple[str, ...], body: str) -> str:
    """``body`` behind the CTEs of the named views and everything they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in DUCK_VIEWS[name][0]:
            visit(dep)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return body
    body = body.strip()
    ctes = ",\n".join(f"{n} AS ({DUCK_VIEWS[n][1].strip()})" for n in ordered)
    if body.upper().startswith("WITH "):
        rest = body[4:].strip()
        if rest.upper().startswith("RECURSIVE "):
            rest = rest[10:]
        return f"WITH RECURSIVE {ctes},\n{rest}"
    return f"WITH RECURSIVE {ctes}\n{body}"
