"""Capture-data views derived from the star schema by deterministic arithmetic."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.functions.pixels import mirrored
from facetlake.operators.ordering import positions
from facetlake.session import materialize
from facetlake.starschema.boxes import BOX

def ints(*values: int):
    return F.array(*[F.lit(v) for v in values])


class Views:
    """Lazy access to the base tables and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        # Zone-less timestamps are UTC; the session time zone is pinned to UTC as well.
        zoneless = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({n: F.col(n).cast("timestamp") for n in zoneless}) if zoneless else df

    def spread(self, name: str) -> DataFrame:
        """A table that each row of is expanded many times, spread over all cores.

        Only where it lies in fewer files than there are cores; a large table is split by its files.
        """
        df = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if len(df.inputFiles()) < cores else df

    @cached_property
    def grids(self) -> DataFrame:
        """Photos as 8x8 grey grids: originals, near copies, mirrors, exact copies and flat shots."""
        return grids_from(self.spread("embeddings"))

    @cached_property
    def photos(self) -> DataFrame:
        return self.photo_rows(self.grids)

    @staticmethod
    def photo_rows(grids: DataFrame) -> DataFrame:
        """Grids with synthetic size and path."""
        seq = F.col("seq")
        names = F.array(*[F.lit(n) for n in ("front", "left", "back", "rear", "right", "front_left", "top", "IMG")])
        return grids.withColumns(
            {
                "width": (480 + (seq % 7) * 160).cast("int"),
                "height": (360 + (seq % 5) * 240).cast("int"),
                "path": F.concat(
                    F.lit("shoots/"), F.col("shoot_id").cast("string"), F.lit("/"),
                    F.get(names, (F.expr("seq div 8") % 8).cast("int")), F.lit("_"), seq.cast("string"), F.lit(".JPG"),
                ),
            }
        )

    @cached_property
    def corners_per_part(self) -> DataFrame:
        p = F.col("p_partkey")
        return self.spread("part").select(
            F.col("p_brand").alias("mesh_id"),
            "p_partkey",
            ((p % 16) * 60).alias("x0"),
            (F.expr("(p_partkey div 16) % 16") * 60).alias("y0"),
            (F.expr("p_partkey div 256") * 60).alias("z0"),
            F.col("p_size").cast("bigint").alias("dx"),
            (7 * (1 + p % 7)).alias("dy"),
            (9 * (1 + p % 5)).alias("dz"),
        )

    @cached_property
    def triangles(self) -> DataFrame:
        """One box per part on a lattice, one assembly per brand, with defects.

        Every tenth box is torn, some carry a repeated or a collapsed triangle, some have
        one triangle wound the wrong way. Corners are not shared, as after a UV split.
        """
        faces = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(n) for n, v in zip("abc", f)])
                          for k, f in enumerate(BOX)])
        rows = self.corners_per_part.withColumn("f", F.explode(faces)).select("*", "f.*").drop("f")
        rows = rows.filter(
            "NOT (p_partkey % 10 = 0 AND k = 11) AND (k <> 12 OR p_partkey % 25 = 1) AND (k <> 13 OR p_partkey % 15 = 2)"
        )
        flip = F.expr("p_partkey % 20 = 3 AND k = 5")
        b, c = F.when(flip, F.col("c")).otherwise(F.col("b")), F.when(flip, F.col("b")).otherwise(F.col("c"))

        def corner(v, name):
            return [
                (F.col("x0") + v.bitwiseAND(1) * F.col("dx")).cast("double").alias(f"{name}x"),
                (F.col("y0") + F.shiftright(v, 1).bitwiseAND(1) * F.col("dy")).cast("double").alias(f"{name}y"),
                (F.col("z0") + F.shiftright(v, 2).bitwiseAND(1) * F.col("dz")).cast("double").alias(f"{name}z"),
            ]

        return rows.select(
            "mesh_id", (F.col("p_partkey") * 16 + F.col("k")).alias("fid"),
            *corner(F.col("a"), "a"), *corner(b, "b"), *corner(c, "c"),
        )

    @cached_property
    def stored_triangles(self) -> DataFrame:
        """The mesh view as a written table, for plans that read it many times."""
        return materialize(self.triangles, "triangles")

    @cached_property
    def frames(self) -> DataFrame:
        events = self.table("events").select(
            F.col("user_id").alias("clip_id"), "ts", "event_id", F.col("value").alias("score"),
            (F.col("event_type") != "error").alias("ok"),
        )
        return positions(events, ["clip_id"], ["ts", "event_id"], "seq").select("clip_id", "seq", "score", "ok")

    @cached_property
    def stages(self) -> DataFrame:
        """Stage outcomes of 200 jobs; ``seq`` increases in time order."""
        name = F.element_at(
            F.create_map(*[F.lit(v) for v in ("view", "ingest", "click", "clean", "purchase", "decimate",
                                              "signup", "export", "error", "sanity")]),
            F.col("event_type"),
        )
        status = (
            F.when(F.col("event_type") == "error", "failed")
            .when(F.col("event_id") % 11 == 0, "skipped")
            .otherwise("ok")
        )
        return self.table("events").select(
            (F.col("user_id") % 200).alias("job_id"), F.col("event_id").alias("seq"), name.alias("name"),
            status.alias("status"), F.col("props").alias("detail"), (F.col("value") / 10).alias("seconds"), "ts",
        )

    @cached_property
    def polls(self) -> DataFrame:
        """Hourly machine listings: a machine runs in a poll if its user has an event in that hour."""
        e = self.table("events")
        return e.select(
            (F.col("user_id") % 30).alias("project"),
            F.date_trunc("hour", "ts").alias("poll_ts"),
            F.concat(F.lit("vm-"), F.col("user_id").cast("string")).alias("name"),
        ).distinct()

    @cached_property
    def teardowns(self) -> DataFrame:
        """Teardown requests: one at each signup of a project."""
        return (
            self.table("events")
            .filter("event_type = 'signup'")
            .select((F.col("user_id") % 30).alias("project"), F.col("ts").alias("request_ts"))
        )

    @cached_property
    def machines(self) -> DataFrame:
        """One machine per user, with accelerator, price class, creation time and hard limit."""
        kinds = F.array(*[F.lit(k) for k in ("nvidia-tesla-t4", "nvidia-l4", "nvidia-tesla-v100", "nvidia-tesla-p4",
                                             "nvidia-unlisted")])
        u = F.col("user_id")
        return (
            self.table("events")
            .groupBy("user_id")
            .agg(F.min("ts").alias("created"), F.max("ts").alias("last_ts"))
            .select(
                (u % 30).alias("project"),
                F.concat(F.lit("vm-"), u.cast("string")).alias("name"),
                F.when(u % 6 < 5, F.get(kinds, (u % 6).cast("int"))).alias("accelerator"),
                (u % 2 == 0).alias("spot"),
                F.when(u % 3 == 0, "TERMINATED").otherwise("RUNNING").alias("status"),
                "created",
                F.when(u % 5 != 0, 7200 * (1 + u % 30)).alias("max_run_s"),
                "last_ts",
                u.alias("user_id"),
            )
        )

    @cached_property
    def files(self) -> DataFrame:
        """Model files of 50 jobs: name, size, modification time."""
        d = F.col("doc_id")
        return self.table("documents").select(
            (d % 50).alias("job_id"), d,
            F.when(d % 10 == 0, "model.glb").when(d % 10 == 9, F.concat(F.lit("notes-"), d.cast("string"), F.lit(".txt")))
            .otherwise(F.concat(F.lit("model-"), F.col("n_chars").cast("string"), F.lit(".glb"))).alias("name"),
            F.col("n_chars").alias("length"),
            (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(d).cast("int"))).alias("mtime"),
            "text",
        )


def grids_from(embeddings: DataFrame) -> DataFrame:
    """Embeddings (batch or stream) as grey grids; one embedding gives up to seven photos."""
    g = F.transform(
        "embedding",
        lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + e.cast("double") * 700).cast("int"))),
    )
    base = embeddings.select(F.col("label").alias("shoot_id"), (F.col("vec_id") * 8).alias("seq"), g.alias("g"))
    v = F.expr("seq div 8")
    grid = F.col("g")

    def poke(a, at):
        return F.transform(a, lambda x, i: F.when(i == at, 255 - x).otherwise(x))

    half = ints(*[r * 8 + min(c, 7 - c) for r in range(8) for c in range(8)])
    sym = F.transform(half, lambda p: F.get(grid, p))
    flat = F.when(v % 2 == 0, F.transform(grid, lambda x: 120 + F.floor(x / 40).cast("int"))).otherwise(
        F.transform(grid, lambda x: 120 + F.floor(x / 64).cast("int"))
    )
    variants = [
        (0, F.lit(True), grid),
        (1, v % 5 == 0, poke(grid, (F.col("seq") % 64).cast("int"))),
        (2, v % 7 == 0, mirrored(grid)),
        (3, v % 11 == 0, poke(sym, (v % 64).cast("int"))),
        (4, v % 11 == 0, mirrored(poke(sym, (v % 64).cast("int")))),
        (5, v % 13 == 0, flat),
        (6, v % 9 == 0, grid),
    ]
    options = F.array(
        *[F.when(cond, F.struct(F.lit(k).alias("k"), a.alias("grid"))) for k, cond, a in variants]
    )
    return (
        base.withColumn("o", F.explode(F.array_compact(options)))
        .select("shoot_id", (F.col("seq") + F.col("o.k")).alias("seq"), F.col("o.grid").alias("grid"))
    )
