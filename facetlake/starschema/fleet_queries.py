"""Queries over jobs, stages, logs, files, machines, specifications and cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from facetlake.functions import text as tx
from facetlake.operators import fleet, photos, specs
from facetlake.session import scratch_path
from facetlake.sources import records, tables
from facetlake.starschema.photo_queries import _scored
from facetlake.starschema.registry import query

NOW = "2024-02-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- lengths, specs, budgets -------------------------------------------------

LENGTHS = """lens AS (SELECT l_orderkey, l_linenumber, l_quantity || [' mm','cm',' M','in',' ft ',' furlong',''][l_linenumber%7+1] AS text FROM lineitem)"""


def _lengths(v):
    units = F.array(*[F.lit(u) for u in (" mm", "cm", " M", "in", " ft ", " furlong", "")])
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(F.col("l_quantity").cast("string"), F.get(units, F.col("l_linenumber") % 7)).alias("text"),
    )


@query("parse_lengths", "B12", f"""WITH {LENGTHS}, p AS (SELECT *, nullif(regexp_extract(text, '^\\s*([0-9]*\\.?[0-9]+)\\s*(mm|cm|m|in|ft)\\s*$', 1, 'i'), '')::DOUBLE AS n,
     lower(regexp_extract(text, '^\\s*([0-9]*\\.?[0-9]+)\\s*(mm|cm|m|in|ft)\\s*$', 2, 'i')) AS u FROM lens)
   SELECT l_orderkey, l_linenumber, round(n * CASE u WHEN 'mm' THEN 0.001::DOUBLE WHEN 'cm' THEN 0.01 WHEN 'm' THEN 1.0 WHEN 'in' THEN 0.0254 WHEN 'ft' THEN 0.3048 END, 9) AS metres,
     CASE WHEN n IS NULL THEN 'unreadable length' END AS error FROM p""")
def _(v):
    p = tx.parse_length(F.col("text"))
    return _lengths(v).withColumn("p", p).select("l_orderkey", "l_linenumber", F.round("p.metres", 9).alias("metres"), "p.error")


def _specs(v):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return v.table("lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_partkey") * 37 - 50).alias("target_faces"),
        F.when((k + n) % 3 == 0, F.col("l_quantity") / 10).alias("length_m"),
        F.when((k + n) % 4 == 1, F.col("l_tax") * 100 - 2).alias("width_m"),
        F.when((k + n) % 5 == 2, F.col("l_discount") * 10).alias("height_m"),
        F.when(k % 11 == 0, F.lit(0.05)).alias("marker_size"),
        F.when(k % 6 == 0, F.lit("  ")).when(k % 6 == 1, F.lit("wheel")).alias("part_name"),
        (n % 2 == 0).alias("split_parts"),
    )


SPECS = """specs AS (SELECT l_orderkey, l_linenumber, l_partkey*37-50 AS target_faces, CASE WHEN (l_orderkey+l_linenumber)%3=0 THEN l_quantity/10 END AS length_m,
     CASE WHEN (l_orderkey+l_linenumber)%4=1 THEN l_tax*100-2 END AS width_m, CASE WHEN (l_orderkey+l_linenumber)%5=2 THEN l_discount*10 END AS height_m,
     CASE WHEN l_orderkey%11=0 THEN 0.05 END AS marker_size, CASE WHEN l_orderkey%6=0 THEN '  ' WHEN l_orderkey%6=1 THEN 'wheel' END AS part_name, l_linenumber%2=0 AS split_parts FROM lineitem)"""


@query("scale_source", "B13", f"""WITH {SPECS} SELECT l_orderkey, l_linenumber, CASE WHEN marker_size IS NOT NULL THEN 'marker'
   WHEN coalesce(length_m, width_m, height_m) IS NOT NULL THEN 'dimensions' ELSE 'none' END AS source FROM specs""")
def _(v):
    c = F.col
    return _specs(v).select("l_orderkey", "l_linenumber", specs.scale_source(c("marker_size"), c("length_m"), c("width_m"), c("height_m")).alias("source"))


@query("spec_violations", "B14", f"""WITH {SPECS} SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN target_faces <= 0 THEN 'budget not positive' END,
    CASE WHEN target_faces < 100 OR target_faces > 2000000 THEN 'budget out of range' END, CASE WHEN length_m <= 0 THEN 'dimension 0 not positive' END,
    CASE WHEN width_m <= 0 THEN 'dimension 1 not positive' END, CASE WHEN height_m <= 0 THEN 'dimension 2 not positive' END,
    CASE WHEN trim(part_name) = '' THEN 'part without a name' END, CASE WHEN part_name IS NOT NULL AND NOT split_parts THEN 'parts given but split is off' END) AS violations FROM specs""")
def _(v):
    c = F.col
    bad = specs.violations(c("target_faces"), [c("length_m"), c("width_m"), c("height_m")], c("part_name"), c("split_parts"))
    return _specs(v).select("l_orderkey", "l_linenumber", F.array_join(bad, "; ").alias("violations"))


@query("scale_from_dimensions", "I1", """WITH s AS (SELECT l_orderkey, l_linenumber,
     list_reverse_sort(list_filter([CASE WHEN (l_orderkey+l_linenumber)%3=0 THEN l_quantity/10 END, CASE WHEN (l_orderkey+l_linenumber)%4=1 THEN l_tax*100-2 END,
       CASE WHEN (l_orderkey+l_linenumber)%5=2 THEN l_discount*10 END], lambda x: x IS NOT NULL)) AS d,
     list_reverse_sort([(l_orderkey%7+1)::DOUBLE, (l_linenumber+1)::DOUBLE, l_quantity]) AS e FROM lineitem)
   SELECT l_orderkey, l_linenumber, round(CASE len(d) WHEN 1 THEN d[1]/e[1] WHEN 2 THEN (d[1]/e[1]+d[2]/e[2])/2 WHEN 3 THEN (d[1]/e[1]+d[2]/e[2]+d[3]/e[3])/3 END, 9) AS factor FROM s""")
def _(v):
    c = F.col
    extents = [(c("l_orderkey") % 7 + 1).cast("double"), (c("l_linenumber") + 1).cast("double"), c("l_quantity")]
    factor = specs.dimension_factor(extents, _dimension_columns())
    return v.table("lineitem").select("l_orderkey", "l_linenumber", F.round(factor, 9).alias("factor"))


def _dimension_columns():
    k = F.col("l_orderkey") + F.col("l_linenumber")
    return (
        F.when(k % 3 == 0, F.col("l_quantity") / 10),
        F.when(k % 4 == 1, F.col("l_tax") * 100 - 2),
        F.when(k % 5 == 2, F.col("l_discount") * 10),
    )


@query("scale_from_marker", "I2", """WITH d AS (SELECT (l_suppkey % 10)::INT AS shoot_id, l_quantity AS s, l_discount AS t FROM lineitem)
   SELECT shoot_id, round(avg((s + sqrt(t*t + s*s) + s + sqrt(t*t + s*s))/4.0), 6) AS measured, round(60.0/avg((s + sqrt(t*t + s*s) + s + sqrt(t*t + s*s))/4.0), 6) AS factor FROM d GROUP BY shoot_id""")
def _(v):
    s, t = F.col("l_quantity"), F.col("l_discount")
    zero = F.lit(0.0)

    def pt(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    det = v.table("lineitem").select(
        (F.col("l_suppkey") % 10).cast("int").alias("shoot_id"), F.lit(60.0).alias("true_side"),
        F.array(pt(zero, zero), pt(s, zero), pt(s + t, s), pt(t, s)).alias("corners"),
    )
    return rounded(specs.marker_factors(det), 6, "measured", "factor")


@query("slugs", "B15", """SELECT l_orderkey, l_linenumber, coalesce(nullif(trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'part') AS slug,
   coalesce(nullif(trim(trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-')[1:32], '-'), ''), 'run') AS short_slug
   FROM (SELECT *, CASE WHEN l_orderkey%9=0 THEN '##' ELSE '  ' || l_returnflag || '_' || l_shipdate::DATE || ' / Part ' || l_partkey || '  of a long label!' END AS t FROM lineitem)""")
def _(v):
    t = F.when(F.col("l_orderkey") % 9 == 0, "##").otherwise(
        F.concat(F.lit("  "), F.col("l_returnflag"), F.lit("_"), F.col("l_shipdate").cast("date").cast("string"),
                 F.lit(" / Part "), F.col("l_partkey").cast("string"), F.lit("  of a long label!"))
    )
    return v.table("lineitem").select("l_orderkey", "l_linenumber", tx.slug(t).alias("slug"), tx.slug(t, "run", 32).alias("short_slug"))


@query("node_names", "B16", """SELECT p_partkey, coalesce(nullif(trim(regexp_replace(t, '[/\\\\]+', '-', 'g'), E'- \\t\\r\\n'), ''), 'model') AS node_name
   FROM (SELECT p_partkey, CASE WHEN p_partkey%7=0 THEN '//' WHEN p_partkey%7=1 THEN NULL ELSE '/' || p_type || '//' || p_name || E'\\\\' || p_size || ' ' END AS t FROM part)""")
def _(v):
    t = F.when(F.col("p_partkey") % 7 == 0, "//").when(F.col("p_partkey") % 7 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("/"), F.col("p_type"), F.lit("//"), F.col("p_name"), F.lit("\\"), F.col("p_size").cast("string"), F.lit(" "))
    )
    return v.table("part").select("p_partkey", tx.node_name(t).alias("node_name"))


@query("nearest_resolution", "B17", """SELECT p_partkey, CASE WHEN r <= 768 THEN 512 WHEN r <= 1280 THEN 1024 ELSE 1536 END AS resolution, greatest(256, least(2048, r))::BIGINT AS clamped
   FROM (SELECT p_partkey, p_partkey*64 % 2304 AS r FROM part)""")
def _(v):
    r = F.col("p_partkey") * 64 % 2304
    return v.table("part").select("p_partkey", tx.nearest(r, (512, 1024, 1536)).alias("resolution"), tx.clamp(r, 256, 2048).alias("clamped"))


@query("unsupported_options", "C15", """WITH o AS (SELECT event_id, ['alpha','beta','gamma'][(user_id%3)::INT+1] AS backend,
     list_filter(['octree_resolution', CASE WHEN event_id%2=0 THEN 'geometry_resolution' END, CASE WHEN event_id%3=0 THEN 'steps' END, CASE WHEN event_id%5=0 THEN 'typo' END], lambda x: x IS NOT NULL) AS k FROM events),
   ig AS (SELECT *, CASE backend WHEN 'alpha' THEN list_filter(k, lambda x: NOT list_contains(['octree_resolution','steps'], x)) WHEN 'beta' THEN list_filter(k, lambda x: NOT list_contains(['geometry_resolution'], x)) ELSE [] END AS i FROM o)
   SELECT event_id, array_to_string(list_sort(CASE WHEN (list_contains(k,'octree_resolution') AND NOT list_contains(i,'octree_resolution')) OR (list_contains(k,'geometry_resolution') AND NOT list_contains(i,'geometry_resolution'))
      THEN list_filter(i, lambda x: x NOT IN ('octree_resolution','geometry_resolution')) ELSE i END), ',') AS ignored FROM ig""")
def _(v):
    e = F.col("event_id")
    options = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("octree_resolution"), F.lit("512")),
        F.when(e % 2 == 0, F.struct(F.lit("geometry_resolution"), F.lit("512"))),
        F.when(e % 3 == 0, F.struct(F.lit("steps"), F.lit("30"))),
        F.when(e % 5 == 0, F.struct(F.lit("typo"), F.lit("1"))),
    )))
    backend = F.get(F.array(F.lit("alpha"), F.lit("beta"), F.lit("gamma")), (F.col("user_id") % 3).cast("int"))
    allowed = {"alpha": ["octree_resolution", "steps"], "beta": ["geometry_resolution"]}
    found = specs.unsupported(backend, options, allowed, [("octree_resolution", "geometry_resolution")])
    return v.table("events").select("event_id", F.array_join(found, ",").alias("ignored"))


BUDGET = """parts AS (SELECT p_brand AS mesh_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS part_index, p_type, count(*)*12 AS n_faces FROM part GROUP BY p_brand, p_type),
   tot AS (SELECT *, 170 + 40 * (length(mesh_id) + ascii(substr(mesh_id, -1)) % 9)::BIGINT AS total_budget, count(*) OVER (PARTITION BY mesh_id) AS n FROM parts),
   ord AS (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY n_faces, part_index DESC) - 1 AS i FROM tot),
   cl AS (SELECT a.*, (total_budget - 32*i) * (n_faces::DOUBLE / (SELECT sum(b.n_faces) FROM ord b WHERE b.mesh_id=a.mesh_id AND b.i >= a.i)) < 32 AS c FROM ord a),
   m AS (SELECT mesh_id, coalesce(min(i) FILTER (NOT c), max(i)+1) AS k FROM cl GROUP BY mesh_id),
   al AS (SELECT cl.*, CASE WHEN i < k THEN 32 ELSE round_even((total_budget - 32*k) * (n_faces::DOUBLE / (SELECT sum(b.n_faces) FROM ord b WHERE b.mesh_id=cl.mesh_id AND b.i >= k)), 0)::BIGINT END AS f FROM cl JOIN m USING (mesh_id)),
   budgets AS (SELECT mesh_id, part_index, n_faces, total_budget, CASE WHEN total_budget >= 32*n THEN f + CASE WHEN row_number() OVER (PARTITION BY mesh_id ORDER BY n_faces DESC, part_index) = 1
      THEN total_budget - sum(f) OVER (PARTITION BY mesh_id) ELSE 0 END END::BIGINT AS target_faces FROM al)"""


def _part_budgets(v):
    types = v.table("part").groupBy(F.col("p_brand").alias("mesh_id"), "p_type").agg((F.count("*") * 12).alias("n_faces"))
    from pyspark.sql import Window

    # A brand has a handful of part types.
    index = F.row_number().over(Window.partitionBy("mesh_id").orderBy("p_type")) - 1
    total = (170 + 40 * (F.length("mesh_id") + F.ascii(F.substring("mesh_id", -1, 1)) % 9)).cast("bigint")
    return specs.water_fill(types.withColumn("part_index", index).withColumn("total_budget", total))


@query("part_budgets", "E9", f"WITH {BUDGET} SELECT * FROM budgets")
def _(v):
    return _part_budgets(v).select("mesh_id", "part_index", "n_faces", "total_budget", "target_faces")


@query("part_texture_sizes", "I13", f"""WITH {BUDGET} SELECT mesh_id, part_index, CASE WHEN target_faces <= 0 THEN 128 WHEN target_faces IS NULL THEN NULL ELSE
   least(1024, greatest(128, pow(2, round_even(log2(greatest(1024*sqrt(least(1.0, target_faces::DOUBLE/total_budget)), 128)), 0))))::INT END AS texture FROM budgets""")
def _(v):
    size = specs.texture_size(F.col("target_faces"), F.col("total_budget"))
    return _part_budgets(v).select("mesh_id", "part_index", size.alias("texture"))


# --- machines and cost -------------------------------------------------------

DEADLINES = f"""priced AS (SELECT m.*, u AS uptime_hours, CASE WHEN max_run_s IS NOT NULL THEN greatest(0, max_run_s - u*3600.0) END AS seconds_remaining, r.usd_per_hour*u AS usd
   FROM (SELECT *, greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(created))/1e6/3600.0) AS u FROM machines) m LEFT JOIN rates r USING (accelerator, spot))"""


@query("machine_deadlines", "F7 C8", f"WITH {DEADLINES} SELECT name, round(uptime_hours, 6) AS uptime_hours, round(seconds_remaining, 4) AS seconds_remaining, round(usd, 6) AS usd FROM priced", ("machines", "rates"))
def _(v):
    d = fleet.deadlines(v.machines, now()).select("name", "uptime_hours", "seconds_remaining", "usd")
    return rounded(rounded(d, 6, "uptime_hours", "usd"), 4, "seconds_remaining")


@query("machine_countdown", "I20", f"""WITH d AS (SELECT event_id, (event_id*97 % 20000)::DOUBLE AS l, 18000.0::DOUBLE AS m FROM events)
   SELECT event_id, CASE WHEN l <= 600 THEN 'critical' WHEN l <= 1800 THEN 'warn' ELSE 'ok' END AS tone, round(greatest(0, least(1, l/m)), 6) AS fraction,
     CASE WHEN l <= 0 THEN '0m' WHEN floor(l/3600) > 0 THEN floor(l/3600)::BIGINT || 'h' || CASE WHEN floor((l%3600)/60+0.5) > 0 THEN ' ' || floor((l%3600)/60+0.5)::BIGINT || 'm' ELSE '' END
          ELSE floor((l%3600)/60+0.5)::BIGINT || 'm' END AS label FROM d""")
def _(v):
    left = (F.col("event_id") * 97 % 20000).cast("double")
    cols = fleet.deadline_tone(F.col("left"), F.lit(18000.0))
    return rounded(v.table("events").select("event_id", left.alias("left")).select("event_id", *[c.alias(n) for n, c in cols.items()]), 6, "fraction")


@query("project_spend", "D30", f"""WITH {DEADLINES} SELECT project, count(*) AS machines, round(coalesce(sum(usd), 0), 4) AS usd, count(*) FILTER (usd IS NULL) AS unmeasured,
   bool_or(status='RUNNING' AND accelerator IS NOT NULL) AS gpu_running FROM priced GROUP BY project""", ("machines", "rates"))
def _(v):
    return rounded(fleet.spend(fleet.deadlines(v.machines, now()), ["project"]), 4, "usd")


BILLABLE = """res AS (
   SELECT 'instance' AS kind, m.name, NULL::DOUBLE AS size_gb, CASE WHEN status='RUNNING' THEN round(usd_per_hour*730, 2) END AS usd_per_month,
      CASE WHEN status='RUNNING' THEN 'running and billing by the hour' ELSE 'stopped: only its disk bills' END AS advice FROM machines m LEFT JOIN rates USING (accelerator, spot)
   UNION ALL SELECT 'disk', 'disk-' || s_suppkey, (s_suppkey%500)::DOUBLE, round((s_suppkey%500)*CASE s_nationkey%4 WHEN 0 THEN 0.04::DOUBLE WHEN 1 THEN 0.10 WHEN 2 THEN 0.17 ELSE 0.10 END, 2),
      CASE WHEN s_acctbal > 0 THEN 'in use by a machine' ELSE 'not attached and still billing' END FROM supplier
   UNION ALL SELECT 'machine-image', 'image-' || c_custkey, round(c_custkey*37000000/1e9, 1), round(c_custkey*37000000/1e9*0.05, 2), 'delete if fast launches are not needed' FROM customer
   UNION ALL SELECT 'bucket', 'bucket-' || n_name, NULL, NULL, 'size not measured' FROM nation)"""


def _billable(v):
    kinds = F.array(*[F.lit(k) for k in ("pd-standard", "pd-balanced", "pd-ssd", "pd-other")])
    disks = v.table("supplier").select(
        F.concat(F.lit("disk-"), F.col("s_suppkey").cast("string")).alias("name"), (F.col("s_suppkey") % 500).alias("size_gb"),
        F.get(kinds, F.col("s_nationkey") % 4).alias("disk_type"), (F.col("s_acctbal") > 0).alias("attached"),
    )
    images = v.table("customer").select(
        F.concat(F.lit("image-"), F.col("c_custkey").cast("string")).alias("name"), (F.col("c_custkey") * 37000000).alias("bytes")
    )
    buckets = v.table("nation").select(F.concat(F.lit("bucket-"), F.col("n_name")).alias("name"))
    return fleet.billable(v.machines, disks, images, buckets)


@query("billable_resources", "A7 I25 I26", f"WITH {BILLABLE} SELECT * FROM res", ("machines", "rates"))
def _(v):
    return _billable(v)


@query("billable_totals", "D31", f"""WITH {BILLABLE} SELECT coalesce(kind, 'all') AS kind, count(*) AS resources, round(coalesce(sum(usd_per_month),0), 2) AS usd_per_month,
   count(*) FILTER (usd_per_month IS NULL) AS unmeasured FROM res GROUP BY ROLLUP(kind)""", ("machines", "rates"))
def _(v):
    return fleet.inventory_totals(_billable(v))


@query("instance_listing", "A6", """SELECT name, 'zone-' || project AS zone, 'type-' || (user_id%4) AS machine_type, status,
    CASE WHEN user_id%4=0 THEN 'baked-' || (user_id%3) WHEN user_id%4=1 THEN 'vendor-' || project END AS image, accelerator, spot, date_trunc('second', created) AS created, max_run_s FROM machines""", ("machines",))
def _(v):
    u, p = F.col("user_id"), F.col("project").cast("string")
    url = F.lit("https://compute.example.com/v1/")
    text = F.to_json(F.struct(
        "name", F.concat(url, F.lit("zones/zone-"), p, F.lit("/")).alias("zone"),
        F.concat(url, F.lit("machineTypes/type-"), (u % 4).cast("string")).alias("machineType"), "status",
        F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creationTimestamp"),
        F.when(u % 4 < 2, F.concat(url, F.lit("images/vendor-"), p)).alias("sourceMachineImage"),
        F.when(F.col("accelerator").isNotNull(), F.array(F.struct(F.concat(url, F.col("accelerator")).alias("acceleratorType")))).alias("guestAccelerators"),
        F.struct(F.when(F.col("spot"), "SPOT").otherwise("STANDARD").alias("provisioningModel"),
                 F.struct(F.col("max_run_s").cast("string").alias("seconds")).alias("maxRunDuration")).alias("scheduling"),
        F.when(u % 4 == 0, F.struct(F.array(F.struct(F.lit("owner").alias("key"), F.lit("ops").alias("value")),
                                            F.struct(F.lit("worker-image").alias("key"), F.concat(F.lit("baked-"), (u % 3).cast("string")).alias("value"))).alias("items"))).alias("metadata"),
    ))
    return records.flatten_instances(v.machines.select(text.alias("text")))


PROBE = """SELECT event_id, CASE event_id%6 WHEN 0 THEN 'Card ' || user_id || ', ' || (user_id*100+event_id%7) || ' MiB, 7.5' WHEN 1 THEN '  Card X ,6144 , 6.1 ' WHEN 2 THEN 'broken' WHEN 3 THEN 'a,b,c' WHEN 4 THEN '' ELSE ', 1, 2' END AS t, user_id FROM events"""


def _probe(v):
    e, u = F.col("event_id"), F.col("user_id")
    t = (
        F.when(e % 6 == 0, F.concat(F.lit("Card "), u.cast("string"), F.lit(", "), (u * 100 + e % 7).cast("string"), F.lit(" MiB, 7.5")))
        .when(e % 6 == 1, "  Card X ,6144 , 6.1 ").when(e % 6 == 2, "broken").when(e % 6 == 3, "a,b,c").when(e % 6 == 4, "").otherwise(", 1, 2")
    )
    return v.table("events").select("event_id", "user_id", records.parse_probe(t).alias("gpu"))


@query("gpu_probe_lines", "A12", f"""SELECT event_id, CASE WHEN event_id%6=0 THEN 'Card ' || user_id WHEN event_id%6=1 THEN 'Card X' END AS name,
   CASE WHEN event_id%6=0 THEN (user_id*100+event_id%7)::INT WHEN event_id%6=1 THEN 6144 END AS vram_mb, CASE WHEN event_id%6=0 THEN 7.5::DOUBLE WHEN event_id%6=1 THEN 6.1 END AS compute_cap FROM ({PROBE})""")
def _(v):
    return _probe(v).select("event_id", "gpu.name", "gpu.vram_mb", "gpu.compute_cap")


@query("capability_reasons", "I21", f"""SELECT event_id, CASE WHEN user_id%9=0 THEN 'cannot reach ''h' || user_id || '''' WHEN event_id%6>1 THEN '''h' || user_id || ''' is reachable but reports no GPU'
   WHEN m < 8000 THEN '''h' || user_id || ''' has ' || n || ' with ' || m || ' MB VRAM; 8000 MB is needed' ELSE '' END AS reason
   FROM (SELECT event_id, user_id, CASE WHEN event_id%6=0 THEN 'Card ' || user_id ELSE 'Card X' END AS n, CASE WHEN event_id%6=0 THEN user_id*100+event_id%7 ELSE 6144 END AS m FROM ({PROBE}))""")
def _(v):
    host = F.concat(F.lit("h"), F.col("user_id").cast("string"))
    why = records.capability_reason(host, F.col("user_id") % 9 != 0, F.col("gpu"), 8000)
    return _probe(v).select("event_id", why.alias("reason"))


@query("hardware_cost_grid", "D29", """WITH o AS (SELECT * FROM (VALUES ('t4',0.11::DOUBLE,0.35::DOUBLE,0.45::DOUBLE),('l4',0.28,1.10,1.0),('a100',1.20,3.70,1.6),('h100',3.00,11.00,2.2)) t(option,s,d,r), (VALUES ('warm',0),('cold',1740)) m(mode,oh)),
   g AS (SELECT o_orderkey AS job_id, option, mode, s, d, oh, (floor(170/r) + CASE WHEN o_orderkey%2=0 THEN floor(123/r) ELSE 0 END + CASE WHEN o_orderkey%3=0 THEN floor(125/r) ELSE 0 END)::BIGINT AS gs FROM orders, o)
   SELECT job_id, option, mode, gs AS gpu_seconds, gs+oh AS total_seconds, round_even(s*(gs+oh)/3600, 3) AS usd_spot, round_even(d*(gs+oh)/3600, 3) AS usd_ondemand FROM g""")
def _(v):
    k = F.col("o_orderkey")
    configs = v.table("orders").select(k.alias("job_id"), (k % 2 == 0).alias("texture"), (k % 3 == 0).alias("semantic"))
    return fleet.hardware_grid(configs)


@query("hardware_cost_cube", "D29", """WITH o AS (SELECT * FROM (VALUES ('t4',0.45::DOUBLE),('l4',1.0),('a100',1.6),('h100',2.2)) t(option,r), (VALUES ('warm',0),('cold',1740)) m(mode,oh)),
   g AS (SELECT option, mode, (floor(170/r) + CASE WHEN o_orderkey%2=0 THEN floor(123/r) ELSE 0 END + CASE WHEN o_orderkey%3=0 THEN floor(125/r) ELSE 0 END)::BIGINT + oh AS total FROM orders, o)
   SELECT coalesce(option,'all') AS option, coalesce(mode,'all') AS mode, count(*) AS jobs, sum(total)::BIGINT AS total_seconds FROM g GROUP BY CUBE(option, mode)""")
def _(v):
    k = F.col("o_orderkey")
    configs = v.table("orders").select(k.alias("job_id"), (k % 2 == 0).alias("texture"), (k % 3 == 0).alias("semantic"))
    cube = fleet.hardware_grid(configs).cube("option", "mode").agg(F.count("*").alias("jobs"), F.sum("total_seconds").alias("total_seconds"))
    return cube.select(F.coalesce("option", F.lit("all")).alias("option"), F.coalesce("mode", F.lit("all")).alias("mode"), "jobs", "total_seconds")


@query("stage_cost_estimates", "D28", """WITH c AS (SELECT o_orderkey AS job_id, o_orderkey%4<>0 AS bake, [512,900,1024,2048][(o_orderkey%4)::INT+1] AS res, ['auto','local','host'][(o_orderkey%3)::INT+1] AS loc,
     o_orderkey%2=0 AS texture, o_orderkey%5=0 AS semantic, o_orderkey%7<4 AS host, ['t4','l4','a100','h100','none'][(o_orderkey%5)::INT+1] AS gpu FROM orders),
   d AS (SELECT *, CASE gpu WHEN 'l4' THEN 1.0 WHEN 'a100' THEN 1.6 WHEN 'h100' THEN 2.2 ELSE 0.45 END::DOUBLE AS r, host AND loc IN ('auto','host') AS oh FROM c)
   SELECT job_id, 1 + host::INT + (host AND texture)::INT + (host AND semantic)::INT + bake::INT AS n_stages,
     round(1.9 + CASE WHEN host THEN floor(170/r) + CASE WHEN texture THEN floor(123/r) ELSE 0 END + CASE WHEN semantic THEN floor(125/r) ELSE 0 END ELSE 0 END
       + CASE WHEN bake THEN CASE WHEN oh THEN CASE WHEN res=1024 THEN 45.5 ELSE 0 END ELSE CASE res WHEN 512 THEN 6.0 WHEN 2048 THEN 52.9 ELSE 13.6 END END ELSE 0 END, 1)::DOUBLE AS known_seconds,
     CASE WHEN bake AND NOT oh THEN CASE res WHEN 512 THEN 1759 WHEN 2048 THEN 4118 ELSE 3367 END ELSE 247 END AS local_peak_mb, bake AND oh AND res<>1024 AS has_unmeasured,
     CASE WHEN bake THEN CASE WHEN oh THEN 'host' ELSE 'local' END END AS bake_where FROM d""")
def _(v):
    k = F.col("o_orderkey")

    def pick(values, n):
        return F.get(F.array(*[F.lit(x) for x in values]), (k % n).cast("int"))

    configs = v.table("orders").select(
        k.alias("job_id"), (k % 4 != 0).alias("bake"), pick((512, 900, 1024, 2048), 4).alias("normal_res"),
        pick(("auto", "local", "host"), 3).alias("bake_location"), (k % 2 == 0).alias("texture"), (k % 5 == 0).alias("semantic"),
        (k % 7 < 4).alias("has_host"), pick(("t4", "l4", "a100", "h100", "none"), 5).alias("gpu_key"),
    )
    return fleet.stage_costs(configs).withColumn("n_stages", F.size("stages")).drop("stages")


# --- files and models --------------------------------------------------------


@query("job_file_totals", "A3", "SELECT job_id, count(*) AS files, sum(length)::BIGINT AS total_bytes FROM files GROUP BY job_id", ("files",))
def _(v):
    return fleet.file_totals(v.files)


@query("current_models", "C13 G4", "SELECT job_id, arg_max(name, (mtime, name)) AS model, max(mtime) AS mtime, count(*) AS models FROM files WHERE regexp_matches(name, '^model(-[0-9]+)?[.]glb$') GROUP BY job_id", ("files",))
def _(v):
    return fleet.current_models(v.files)


@query("model_list", "G5", """WITH m AS (SELECT * FROM files WHERE regexp_matches(name, '^model(-[0-9]+)?[.]glb$')), c AS (SELECT job_id, arg_max(name, (mtime, name)) AS cur FROM m GROUP BY job_id)
   SELECT job_id, name, length AS bytes, mtime, name='model.glb' AS original, name=cur AS current,
     CASE WHEN name<>'model.glb' THEN regexp_extract(name, '[0-9]+')::BIGINT WHEN job_id%3=0 THEN 20000 WHEN name=cur THEN 5000+job_id END AS face_count FROM m JOIN c USING (job_id)""", ("files",))
def _(v):
    j = F.col("job_id")
    jobs = v.files.select("job_id").distinct().select("job_id", F.when(j % 3 == 0, F.lit(20000)).cast("bigint").alias("build_faces"), (5000 + j).alias("faces"))
    return fleet.model_list(v.files, jobs)


@query("latest_file_with_prefix", "G4", "SELECT job_id, arg_max(name, (mtime, name)) AS name, max(mtime) AS mtime FROM files WHERE name LIKE 'notes-%' GROUP BY job_id", ("files",))
def _(v):
    return fleet.latest(v.files.select("job_id", "name", "mtime"), ["job_id"], "mtime", "notes-")


@query("restored_jobs", "S7 C13", """SELECT user_id AS job_id, CASE WHEN bool_or(f.job_id IS NOT NULL) THEN 'done' ELSE 'failed' END AS status FROM (SELECT DISTINCT user_id FROM events) e
   LEFT JOIN (SELECT job_id FROM files WHERE regexp_matches(name, '^model(-[0-9]+)?[.]glb$')) f ON f.job_id = e.user_id GROUP BY user_id""", ("files",))
def _(v):
    jobs = v.table("events").select(F.col("user_id").alias("job_id")).distinct()
    return fleet.restored_jobs(jobs, v.files).select("job_id", "status")


@query("reoptimise_source", "C14", """WITH m AS (SELECT doc_id%50 AS job_id, CASE WHEN doc_id%13=0 AND doc_id%50<10 THEN 'w/' || doc_id || '/dense.ply' WHEN doc_id%3=0 AND doc_id%50<40 THEN 'w/s3-generate-' || lpad(doc_id::VARCHAR, 9, '0') || '/out/mesh.glb' ELSE 'w/other' END AS path FROM documents)
   SELECT job_id, coalesce(max(path) FILTER (path LIKE '%dense.ply'), max(path) FILTER (path LIKE '%/out/mesh.glb')) AS path, count(*) FILTER (path LIKE '%dense.ply') = 0 AS generated FROM m
   WHERE path <> 'w/other' GROUP BY job_id""")
def _(v):
    d = F.col("doc_id")
    path = F.when((d % 13 == 0) & (d % 50 < 10), F.concat(F.lit("w/"), d.cast("string"), F.lit("/dense.ply"))).when(
        (d % 3 == 0) & (d % 50 < 40), F.concat(F.lit("w/s3-generate-"), F.lpad(d.cast("string"), 9, "0"), F.lit("/out/mesh.glb"))
    ).otherwise("w/other")
    return fleet.reoptimise_source(v.table("documents").select((d % 50).alias("job_id"), path.alias("path")))


@query("export_size_report", "D34", "SELECT job_id, sum(length)::BIGINT AS bytes_before, sum(length//4 + 10)::BIGINT AS bytes_after, round(sum(length//4 + 10)/sum(length), 6) AS ratio FROM files GROUP BY job_id", ("files",))
def _(v):
    return rounded(fleet.size_report(v.files, F.col("length"), F.expr("length div 4 + 10")), 6, "ratio")


@query("face_loss_checks", "D33", """SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN a < b*0.9::DOUBLE THEN 'texturing remeshed the model down' END, CASE WHEN t > 0 AND a < t*0.8::DOUBLE THEN 'rebuilt surface is short of the budget' END) AS warnings
   FROM (SELECT l_orderkey, l_linenumber, l_partkey AS b, l_partkey - l_suppkey%100 AS a, l_quantity*40 AS t FROM lineitem)""")
def _(v):
    c = F.col
    w = fleet.loss_checks(c("l_partkey"), c("l_partkey") - c("l_suppkey") % 100, c("l_quantity") * 40)
    return v.table("lineitem").select("l_orderkey", "l_linenumber", F.array_join(w, "; ").alias("warnings"))


@query("file_fingerprints", "I14", "SELECT doc_id, sha256(text)[1:16] AS fingerprint FROM files", ("files",))
def _(v):
    return v.files.select("doc_id", tx.fingerprint(F.col("text")).alias("fingerprint"))


KEYS = """keys AS (SELECT job_id, 's0-ingest-' || sha256('{"inputs": "' || sha256(count(*) || ':' || sum(('0x' || md5(f)[1:15])::BIGINT)::HUGEINT || ':' || sum(('0x' || md5(f)[17:31])::BIGINT)::HUGEINT)[1:16] || '", "params": {"dedup": 6, "long_edge": 1600}, "stage": "s0-ingest"}')[1:12] AS key
   FROM (SELECT job_id, sha256(text)[1:16] AS f FROM files) GROUP BY job_id)"""
PARAMS = '{"dedup": 6, "long_edge": 1600}'


def _keys(v):
    inputs = v.files.select("job_id", tx.fingerprint(F.col("text")).alias("fingerprint"))
    return fleet.stage_keys(inputs, "s0-ingest", PARAMS)


@query("stage_keys", "I15", f"WITH {KEYS} SELECT * FROM keys", ("files",))
def _(v):
    return _keys(v)


@query("cached_stage_lookup", "C10 H4", f"WITH {KEYS}, done AS (SELECT DISTINCT key FROM keys WHERE job_id%3=0) SELECT k.key, job_id, d.key IS NOT NULL AS cached FROM keys k LEFT JOIN done d ON d.key=k.key", ("files",))
def _(v):
    keys = _keys(v)
    return fleet.cache_split(keys, keys.filter("job_id % 3 = 0"))


@query("cached_key_sets", "H4", f"""WITH {KEYS}, a AS (SELECT key FROM keys WHERE job_id%2=0), b AS (SELECT key FROM keys WHERE job_id%3=0)
   SELECT key, 'hit' AS side FROM (SELECT key FROM a INTERSECT SELECT key FROM b) UNION ALL SELECT key, 'missing' FROM (SELECT key FROM a EXCEPT ALL SELECT key FROM b)""", ("files",))
def _(v):
    keys = _keys(v)
    asked, done = keys.filter("job_id % 2 = 0").select("key"), keys.filter("job_id % 3 = 0").select("key")
    return asked.intersect(done).withColumn("side", F.lit("hit")).union(asked.exceptAll(done).withColumn("side", F.lit("missing")))


MESH_DIGEST = """SELECT mesh_id, sha256(count(*) || ':' || sum(('0x' || md5(r)[1:15])::BIGINT)::HUGEINT || ':' || sum(('0x' || md5(r)[17:31])::BIGINT)::HUGEINT)[1:16] AS digest FROM
   (SELECT mesh_id, concat_ws(',', fid, ax::BIGINT, ay::BIGINT, az::BIGINT, bx::BIGINT, by_::BIGINT, bz::BIGINT, cx::BIGINT, cy::BIGINT, cz::BIGINT) AS r FROM tri) GROUP BY mesh_id"""


@query("mesh_content_digest", "I16", MESH_DIGEST, ("tri",))
def _(v):
    names = [f"{k}{t}" for k in "abc" for t in "xyz"]
    row = F.concat_ws(",", F.col("fid").cast("string"), *[F.col(n).cast("bigint").cast("string") for n in names])
    return fleet.multiset_digest(["mesh_id"], v.triangles, row)


# --- jobs, stages, logs ------------------------------------------------------

LOG = """lines AS (SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, seq) - 1 AS line_no,
     CASE WHEN seq%17=0 THEN 'WARNING: ' || detail ELSE '[' || upper(status) || '] ' || name || ': ' || detail || ' (' || printf('%.2f', seconds) || 's)' END AS line FROM stages)"""


@query("stage_summary_lines", "I17", "SELECT job_id, seq, '[' || upper(status) || '] ' || name || ': ' || detail || ' (' || printf('%.2f', seconds) || 's)' AS line FROM stages", ("stages",))
def _(v):
    c = F.col
    return v.stages.select("job_id", "seq", tx.summary_line(c("status"), c("name"), c("detail"), c("seconds")).alias("line"))


@query("error_last_lines", "I17", """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\r\\n|\\r|\\n'), lambda s: trim(s, ' ')), lambda s: s <> '') AS a, text FROM documents)
   SELECT doc_id, substr(coalesce(a[-1], text), 1, 160) AS last_line FROM l""")
def _(v):
    return v.table("documents").select("doc_id", tx.last_line(F.col("text")).alias("last_line"))


@query("log_severity", "I18", f"""WITH {LOG} SELECT job_id, line_no, CASE WHEN line LIKE 'WARNING:%' OR line LIKE '%[FAILED]%' THEN 'fail' WHEN line LIKE '%[SKIPPED]%' THEN 'skipped'
   WHEN line LIKE '%[OK]%' THEN 'ok' ELSE 'plain' END AS severity FROM lines""", ("stages",))
def _(v):
    return fleet.job_log(v.stages).select("job_id", "line_no", tx.severity(F.col("line")).alias("severity"))


@query("log_tail_by_cursor", "S2", f"""WITH {LOG}, t AS (SELECT job_id, count(*) AS log_total FROM lines GROUP BY job_id),
   c AS (SELECT job_id, log_total, CASE WHEN job_id%90*3-5 BETWEEN 0 AND log_total THEN job_id%90*3-5 ELSE 0 END AS start FROM t)
   SELECT job_id, line_no, line, start, log_total FROM lines JOIN c USING (job_id) WHERE line_no >= start""", ("stages",))
def _(v):
    log = fleet.job_log(v.stages)
    j = F.col("job_id")
    cursors = v.stages.select("job_id").distinct().select("job_id", (j % 90 * 3 - 5).alias("log_since"))
    return fleet.log_since(log, cursors).select("job_id", "line_no", "line", "start", "log_total")


@query("relative_ages", "I19", """WITH a AS (SELECT event_id, ts, (epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us(ts))/1e6/60 AS m FROM events)
   SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN floor(m)::BIGINT || 'm ago' WHEN m < 1440 THEN floor(m/60)::BIGINT || 'h ago' ELSE strftime(ts, '%b %-d') END AS age FROM a""")
def _(v):
    return v.table("events").select("event_id", tx.age(F.col("ts"), F.lit("2024-01-30 12:00:00").cast("timestamp")).alias("age"))


JOBS = """jobs AS (SELECT o_orderkey AS job_id, CASE o_orderkey%5 WHEN 0 THEN 'done' WHEN 1 THEN 'failed' WHEN 2 THEN 'running' WHEN 3 THEN 'queued' ELSE 'cancelled' END AS status,
   CASE WHEN o_orderkey%50<>0 THEN o_orderdate END AS created_at FROM orders)"""


def _jobs(v):
    k = F.col("o_orderkey")
    status = F.get(F.array(*[F.lit(s) for s in ("done", "failed", "running", "queued", "cancelled")]), (k % 5).cast("int"))
    return v.table("orders").select(k.alias("job_id"), status.alias("status"), F.when(k % 50 != 0, F.col("o_orderdate")).alias("created_at"))


@query("job_counts", "D32", f"""WITH {JOBS} SELECT count(*) AS all, count(*) FILTER (status NOT IN ('done','failed','cancelled')) AS active, count(*) FILTER (status='done') AS done, count(*) FILTER (status='failed') AS failed FROM jobs""")
def _(v):
    return fleet.job_counts(_jobs(v))


@query("jobs_newest_first", "G3", f"WITH {JOBS} SELECT job_id, created_at FROM jobs ORDER BY created_at DESC NULLS LAST, job_id")
def _(v):
    return _jobs(v).select("job_id", "created_at").orderBy(F.desc_nulls_last("created_at"), "job_id")


@query("stage_track", "F8", """WITH j AS (SELECT o_orderkey AS job_id, CASE WHEN o_orderkey%3=0 THEN 'failed' ELSE 'running' END AS status FROM orders),
   can AS (SELECT * FROM (VALUES (0,'ingest'),(1,'sparse'),(2,'dense'),(3,'generate'),(4,'scale'),(5,'clean'),(6,'decimate'),(7,'unwrap'),(8,'bake'),(9,'export')) t(seq,name))
   SELECT s.job_id, s.seq, s.name, s.status AS state, s.seconds FROM stages s JOIN (SELECT DISTINCT job_id FROM j) USING (job_id)
   UNION ALL SELECT j.job_id, can.seq, can.name, CASE WHEN j.status='failed' THEN 'skipped' ELSE 'pending' END, NULL FROM j, can WHERE j.job_id NOT IN (SELECT job_id FROM stages)""", ("stages",))
def _(v):
    k = F.col("o_orderkey")
    jobs = v.table("orders").select(k.alias("job_id"), F.when(k % 3 == 0, "failed").otherwise("running").alias("status"))
    return fleet.stage_track(jobs, v.stages)


@query("warnings_concat", "H5", """SELECT l_orderkey, l_linenumber, concat_ws('|', CASE WHEN l_discount > 0.05 THEN 'build: discount' END, CASE WHEN l_tax > 0.04 THEN 'build: tax' END, CASE WHEN l_quantity > 25 THEN 'finish: bulk' END) AS warnings FROM lineitem""")
def _(v):
    build = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "build: discount"), F.when(F.col("l_tax") > 0.04, "build: tax")))
    finish = F.array_compact(F.array(F.when(F.col("l_quantity") > 25, "finish: bulk")))
    return v.table("lineitem").select("l_orderkey", "l_linenumber", F.array_join(F.concat(build, finish), "|").alias("warnings"))


SETTINGS = """SELECT event_id, 'backend=' || CASE WHEN user_id%3=0 THEN '-' WHEN user_id%3=1 THEN 'alpha' ELSE 'base' END || ';max_parts=8;object_hint=' || CASE WHEN event_id%4=0 THEN '-' WHEN event_id%4=1 THEN 'car' ELSE 'old' END
   || CASE WHEN event_id%5=0 THEN ';seed=' || event_id ELSE ';seed=7' END AS settings FROM events"""


@query("settings_override", "I22", SETTINGS)
def _(v):
    e, u = F.col("event_id"), F.col("user_id")
    base = F.create_map(*[F.lit(x) for x in ("backend", "base", "object_hint", "old", "seed", "7", "max_parts", "8")])
    over = F.create_map(
        F.lit("backend"), F.when(u % 3 == 0, "auto").when(u % 3 == 1, " alpha "),
        F.lit("object_hint"), F.when(e % 4 == 0, "").when(e % 4 == 1, "car"),
    )
    return v.table("events").select("event_id", tx.map_text(tx.settings_merge(base, over, F.when(e % 5 == 0, e))).alias("settings"))


@query("session_metadata_merge", "I23", """SELECT event_id, 'faces=' || event_id || ';label=run-' || user_id || CASE WHEN event_id%2=0 THEN ';regime=orbit' ELSE ';regime=old' END AS meta FROM events""")
def _(v):
    e = F.col("event_id")
    base = F.create_map(F.lit("label"), F.concat(F.lit("run-"), F.col("user_id").cast("string")), F.lit("regime"), F.lit("old"), F.lit("faces"), F.lit("0"))
    fields = F.map_filter(F.create_map(F.lit("faces"), e.cast("string"), F.lit("regime"), F.when(e % 2 == 0, "orbit")), lambda k, x: x.isNotNull())
    return v.table("events").select("event_id", tx.map_text(F.map_concat(base, fields)).alias("meta"))


@query("worker_default_fill", "I24", """SELECT event_id, 'decimation_target=' || CASE WHEN event_id%3=0 THEN '999' WHEN event_id%2=0 THEN '-' ELSE (100+event_id)::VARCHAR END || ';steps=30' AS options FROM events""")
def _(v):
    e = F.col("event_id")
    given = F.map_filter(F.create_map(F.lit("steps"), F.lit("30"), F.lit("decimation_target"), F.when(e % 3 == 0, "999")), lambda k, x: x.isNotNull())
    defaults = F.create_map(F.lit("decimation_target"), F.when(e % 2 == 1, (100 + e).cast("string")))
    shown = tx.fill_defaults(given, defaults)
    return v.table("events").select("event_id", F.concat(
        F.lit("decimation_target="), F.coalesce(F.element_at(shown, F.lit("decimation_target")), F.lit("-")),
        F.lit(";steps="), F.element_at(shown, F.lit("steps"))).alias("options"))


HOST_JOBS = """hj AS (SELECT o_orderkey AS job_id, o_custkey%40 AS host, o_orderdate + to_seconds(o_orderkey%86400) AS start_ts, o_orderdate + to_seconds(o_orderkey%86400 + 3600*(1+o_orderkey%60)) AS end_ts FROM orders)"""


def _host_jobs(v):
    k = F.col("o_orderkey")
    start = F.timestamp_micros(F.unix_micros("o_orderdate") + (k % 86400) * 1000000)
    return v.table("orders").select(
        k.alias("job_id"), (F.col("o_custkey") % 40).alias("host"), start.alias("start_ts"),
        F.timestamp_micros(F.unix_micros(start) + 3600 * (1 + k % 60) * 1000000).alias("end_ts"),
    )


@query("busy_hosts", "C12", f"""WITH {HOST_JOBS} SELECT a.job_id, a.host, count(b.job_id) AS active, count(b.job_id) > 0 AS busy FROM hj a LEFT JOIN hj b
   ON a.host=b.host AND (b.start_ts < a.start_ts OR (b.start_ts = a.start_ts AND b.job_id < a.job_id)) AND b.end_ts > a.start_ts GROUP BY a.job_id, a.host""")
def _(v):
    return fleet.busy_hosts(_host_jobs(v))


@query("host_admission", "E10 S5", f"""WITH RECURSIVE {HOST_JOBS}, n AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY start_ts, job_id) - 1 AS pos FROM hj),
   nx AS (SELECT a.host, a.pos, min(b.pos) AS nxt FROM n a LEFT JOIN n b ON a.host=b.host AND b.start_ts >= a.end_ts GROUP BY a.host, a.pos),
   ch AS (SELECT host, 0::BIGINT AS pos FROM n WHERE pos=0 UNION ALL SELECT nx.host, nx.nxt FROM ch JOIN nx USING (host, pos) WHERE nx.nxt IS NOT NULL)
   SELECT job_id, n.host, ch.pos IS NOT NULL AS accepted FROM n LEFT JOIN ch ON ch.host=n.host AND ch.pos=n.pos""")
def _(v):
    return fleet.admitted(_host_jobs(v)).select("job_id", "host", "accepted")


@query("unique_session_names", "F5 F9", """WITH s AS (SELECT event_id, strftime(ts, '%Y%m%d-%H') || '-' || event_type AS b FROM events)
   SELECT event_id, b || CASE WHEN rn > 1 THEN '-' || rn ELSE '' END AS session_id FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY event_id) AS rn FROM s)""")
def _(v):
    rows = v.table("events").select(
        F.lit(1).alias("root"), "event_id",
        F.concat(F.date_format("ts", "yyyyMMdd-HH"), F.lit("-"), tx.slug(F.col("event_type"), "run")).alias("base"),
    )
    return fleet.unique_names(rows, ["root"], "base", ["event_id"], "session_id").select("event_id", "session_id")


@query("first_of_tag_names", "F6", """WITH u AS (SELECT doc_id%50 AS job_id, doc_id AS seq, ['front','left',' BACK ','right','top','nowhere'][(doc_id%6)::INT+1] AS tag, 'img' || doc_id AS own_stem FROM documents),
   t AS (SELECT *, CASE WHEN lower(trim(tag)) IN ('front','left','back','right','top') THEN lower(trim(tag)) END AS k FROM u)
   SELECT job_id, seq, CASE WHEN k IS NOT NULL AND row_number() OVER (PARTITION BY job_id, k ORDER BY seq) = 1 THEN k ELSE own_stem END AS stem FROM t""")
def _(v):
    d = F.col("doc_id")
    tags = F.array(*[F.lit(t) for t in ("front", "left", " BACK ", "right", "top", "nowhere")])
    rows = v.table("documents").select((d % 50).alias("job_id"), d.alias("seq"), F.get(tags, (d % 6).cast("int")).alias("tag"),
                                       F.concat(F.lit("img"), d.cast("string")).alias("own_stem"))
    return fleet.first_of_tag(rows, ("front", "left", "back", "right", "top")).select("job_id", "seq", "stem")


@query("backend_choice", "G6", """WITH c AS (SELECT user_id AS request_id, event_type AS name, min(event_id) AS registered, bool_or(value > 60) AS available FROM events GROUP BY user_id, event_type)
   SELECT request_id, arg_min(name, CASE name WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END::BIGINT * 1000000000 + registered) AS backend FROM c WHERE available AND name <> 'error' GROUP BY request_id""")
def _(v):
    c = v.table("events").groupBy(F.col("user_id").alias("request_id"), F.col("event_type").alias("name")).agg(
        F.min("event_id").alias("registered"), F.bool_or(F.col("value") > 60).alias("available")
    )
    return fleet.pick_backend(c, ["click", "purchase"], ["error"])


# --- records -----------------------------------------------------------------


@query("session_registry", "A4", """SELECT CASE WHEN event_id%4=0 THEN 'dir-' || event_id ELSE 'job-' || event_id END AS job_id, CASE event_id%3 WHEN 0 THEN 'n' || user_id WHEN 1 THEN 'l' || user_id ELSE 'dir-' || event_id END AS name,
   CASE WHEN event_id%2=0 THEN 1000+event_id END AS target_faces, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at, event_id%5 AS n_warnings FROM events WHERE event_id%7<>0""")
def _(v):
    e, u = F.col("event_id"), F.col("user_id").cast("string")
    s = e.cast("string")
    record = F.to_json(F.struct(
        F.when(e % 4 != 0, F.concat(F.lit("job-"), s)).alias("job_id"), F.when(e % 3 == 0, F.concat(F.lit("n"), u)).alias("name"),
        F.when(e % 3 == 1, F.concat(F.lit("l"), u)).alias("label"), F.when(e % 2 == 0, 1000 + e).alias("target_faces"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.transform(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < e % 5), lambda i: i.cast("string")).alias("warnings"),
    ))
    texts = v.table("events").select(F.concat(F.lit("dir-"), s).alias("dir"), F.when(e % 7 == 0, F.lit("{ not json")).otherwise(record).alias("text"))
    return records.parse_sessions(texts).select("job_id", "name", "target_faces", "created_at", F.size("warnings").cast("bigint").alias("n_warnings"))


@query("intake_report_lines", "A5", """WITH r AS (SELECT shoot_id, seq, path, reasons, status, row_number() OVER (PARTITION BY shoot_id, seq%11 ORDER BY seq) - 1 AS pos FROM verdicts)
   SELECT shoot_id*100 + seq%11 AS job_id, 0 AS part, '  rejected ' || regexp_extract(path, '([^/]*)$', 1) || ': ' || reasons AS line FROM r WHERE status='rejected'
   UNION ALL SELECT DISTINCT shoot_id*100 + seq%11, 1, '  advice: newest of shoot ' || shoot_id FROM r""", ("verdicts",))
def _(v):
    from facetlake.operators import photos as ph

    judged = ph.verdicts(_scored(v))
    job = (F.col("shoot_id") * 100 + F.col("seq") % 11).alias("job_id")
    entry = F.struct("seq", F.struct(F.col("path").alias("source"), "status", F.col("reasons").alias("reject_reasons")).alias("p"))
    reports = judged.groupBy(job, "shoot_id").agg(F.array_sort(F.collect_list(entry)).alias("l")).select(
        "job_id", F.lit("2024-01-02").cast("timestamp").alias("mtime"),
        F.to_json(F.struct(F.transform("l", lambda x: x["p"]).alias("photos"),
                           F.array(F.concat(F.lit("newest of shoot "), F.col("shoot_id").cast("string"))).alias("advice"))).alias("text"),
    )
    stale = reports.select("job_id", F.lit("2024-01-01").cast("timestamp").alias("mtime"), F.lit('{"photos": [], "advice": ["stale"]}').alias("text"))
    return records.report_lines(reports.unionByName(stale)).select("job_id", "part", "line")


@query("model_reply_json", "A13", """SELECT event_id, CASE WHEN event_id%4=3 THEN NULL ELSE event_type END AS object, CASE WHEN event_id%4=3 THEN NULL ELSE user_id END AS n,
   CASE WHEN event_id%4=3 THEN 'reply is not valid JSON' END AS error FROM events""")
def _(v):
    e = F.col("event_id")
    body = F.to_json(F.struct(F.col("event_type").alias("object"), F.col("user_id").alias("n")))
    text = (
        F.when(e % 4 == 0, body)
        .when(e % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(e % 4 == 2, F.concat(F.lit("  ```\n"), body, F.lit("```  ")))
        .otherwise(F.concat(F.lit("Sure! "), body))
    )
    return v.table("events").select("event_id", records.parse_reply(text, "object STRING, n BIGINT").alias("r")).select(
        "event_id", "r.value.object", "r.value.n", "r.error"
    )


@query("photo_listing", "A1", """SELECT doc_id%50 AS shoot_id, path, row_number() OVER (PARTITION BY doc_id%50 ORDER BY path) - 1 AS seq FROM
   (SELECT doc_id, 'p/' || lang || '/' || doc_id || ['.jpg','.JPEG','.txt','.Png','.heic','.glb','.tiff'][(doc_id%7)::INT+1] AS path FROM documents) WHERE regexp_matches(lower(path), '[.](jpg|jpeg|png|heic|webp|tif|tiff)$')""")
def _(v):
    from facetlake.sources.photos import photo_listing

    d = F.col("doc_id")
    ext = F.get(F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".txt", ".Png", ".heic", ".glb", ".tiff")]), (d % 7).cast("int"))
    files = v.table("documents").select((d % 50).alias("shoot_id"), F.concat(F.lit("p/"), F.col("lang"), F.lit("/"), d.cast("string"), ext).alias("path"))
    return photo_listing(files).select("shoot_id", "path", "seq")


@query("keyed_stage_table", "A11", """SELECT job_id, seq, name, CASE WHEN job_id%3=0 AND status='failed' THEN 'restarted' ELSE status END AS status FROM stages WHERE NOT (job_id%3=0 AND status='skipped') AND job_id BETWEEN 20 AND 59""", ("stages",))
def _(v):
    """A table keyed by job, some jobs of which are written anew, read back for a range of keys."""
    path = scratch_path(v.spark, "stage_table")
    stages = v.stages.select("job_id", "seq", "name", "status")
    tables.write_table(stages, path, ["job_id"])
    again = stages.filter("job_id % 3 = 0 AND status <> 'skipped'")
    tables.replace_keys(again.withColumn("status", F.when(F.col("status") == "failed", "restarted").otherwise(F.col("status"))), path, ["job_id"])
    schema = "seq " + stages.schema["seq"].dataType.simpleString() + ", name string, status string, job_id " + stages.schema["job_id"].dataType.simpleString()
    return tables.read_table(v.spark, path, schema).filter("job_id BETWEEN 20 AND 59").select("job_id", "seq", "name", "status")
