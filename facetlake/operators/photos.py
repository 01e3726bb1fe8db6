"""Photo scoring, intake rollups, coverage and view selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetlake.functions import pixels as px
from facetlake.functions.numbers import round_even

# Viewpoint vocabulary, cardinal order and photo file suffixes.
VIEWPOINTS = (
    "front", "front-left", "left", "rear-left", "rear", "rear-right",
    "right", "front-right", "top", "bottom", "detail", "unknown",
)
CARDINALS = ("front", "left", "back", "right")
PHOTO_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".webp", ".tif", ".tiff")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def scores(grids: DataFrame) -> DataFrame:
    """Sharpness and exposure clipping per photo, from an 8x8 grey grid."""
    return grids.select(
        "shoot_id",
        "seq",
        px.sharpness(F.col("grid")).alias("blur"),
        px.share(F.col("grid"), lambda g: g <= px.DARK_LEVEL).alias("dark"),
        px.share(F.col("grid"), lambda g: g >= px.BRIGHT_LEVEL).alias("bright"),
    )


def verdict_columns() -> dict[str, Column]:
    """Reject reasons and warnings from ``blur dark bright width height``."""
    blur, width, height = F.col("blur"), F.col("width"), F.col("height")
    score = F.rint(blur).cast("bigint").cast("string")
    small = F.greatest(width, height) < px.MIN_LONG_EDGE
    reasons = [
        F.when(
            small,
            F.concat(F.lit("resolution too low ("), width.cast("string"), F.lit("x"), height.cast("string"),
                     F.lit(f", need long edge >= {px.MIN_LONG_EDGE})")),
        ),
        F.when(
            blur < px.BLUR_REJECT,
            F.concat(F.lit("too blurry (score "), score, F.lit(f" < {px.BLUR_REJECT:.0f})")),
        ),
    ]
    warnings = [
        F.when(
            (blur >= px.BLUR_REJECT) & (blur < px.BLUR_WARN),
            F.concat(F.lit("soft focus (score "), score, F.lit(")")),
        )
    ]
    for name, column in (("underexposed", F.col("dark")), ("overexposed", F.col("bright"))):
        percent = F.concat(F.rint(column * 100).cast("bigint").cast("string"), F.lit("%"))
        reasons.append(
            F.when(column > px.CLIP_REJECT, F.concat(F.lit(f"{name} ("), percent, F.lit(" of pixels clipped)")))
        )
        warnings.append(
            F.when(
                (column <= px.CLIP_REJECT) & (column > px.CLIP_WARN),
                F.concat(F.lit(f"partially {name} ("), percent, F.lit(" clipped)")),
            )
        )
    return {
        "reasons": F.array_compact(F.array(*reasons)),
        "warnings": F.array_compact(F.array(*warnings)),
    }


def verdicts(scored: DataFrame) -> DataFrame:
    """Accept or reject each photo. Input carries ``blur dark bright width height``."""
    return scored.withColumns(verdict_columns()).withColumn(
        "status", F.when(F.size("reasons") == 0, "accepted").otherwise("rejected")
    )


def hashes(grids: DataFrame, wrap: bool = True) -> DataFrame:
    """Difference hash of each photo and of its mirror image."""
    grid = F.col("grid")
    return grids.select(
        "shoot_id",
        "seq",
        px.gradient_hash(grid, 8, 8, wrap=wrap).alias("h"),
        px.gradient_hash(px.mirrored(grid), 8, 8, wrap=wrap).alias("h_flip"),
    )


def intake_report(verdict_rows: DataFrame) -> DataFrame:
    """Photo counts per status and shoot, one row per shoot."""
    status = F.col("status")
    return verdict_rows.groupBy("shoot_id").agg(
        F.count("*").alias("photos"),
        F.count_if(status == "accepted").alias("accepted"),
        F.count_if(status == "duplicate").alias("duplicates"),
        F.count_if(status == "rejected").alias("rejected"),
        F.count_if(status == "unreadable").alias("unreadable"),
    )


def advice(verdict_rows: DataFrame) -> DataFrame:
    """Advice lines per shoot. Input: ``shoot_id seq status reasons name``."""
    blurry = (F.col("status") == "rejected") & F.exists("reasons", lambda r: r.contains("blurry"))
    # A bounded top-5 per shoot: the row_number filter is pushed below the shuffle.
    first_five = Window.partitionBy("shoot_id").orderBy("seq")
    names = (
        verdict_rows.filter(blurry)
        .select("shoot_id", "seq", "name")
        .withColumn("_rn", F.row_number().over(first_five))
        .filter("_rn <= 5")
        .groupBy("shoot_id")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "name"))).alias("_blurry"))
    )
    n, total, dupes = F.col("accepted"), F.col("photos"), F.col("duplicates")
    lines = F.array_compact(
        F.array(
            F.when(n < 12, F.concat(F.lit("only "), n.cast("string"), F.lit(" usable photos; aim for 20-40"))),
            F.when(
                F.col("_blurry").isNotNull(),
                F.concat(F.lit("retake sharper: "), F.array_join(F.transform("_blurry", lambda s: s["name"]), ", ")),
            ),
            F.when(
                dupes > F.greatest(F.lit(3), F.expr("photos div 4")),
                F.concat(dupes.cast("string"), F.lit(" near-duplicate shots dropped; move more between frames")),
            ),
        )
    )
    return (
        intake_report(verdict_rows)
        .join(names, "shoot_id", "left")
        .select(
            "shoot_id",
            F.when(F.size(lines) == 0, F.array(F.lit("input set looks healthy"))).otherwise(lines).alias("advice"),
        )
    )


def regime(n: Column) -> Column:
    """Reconstruction regime for a number of usable photos; NULL means no usable photo."""
    return (
        F.when(n >= 16, "orbit")
        .when(n >= 2, "sparse_views")
        .when(n == 1, "single_image")
    )


def distinctness(grids: DataFrame) -> DataFrame:
    """Mean pairwise absolute difference of the photos of a shoot, scaled to 0..1.

    Pairs are never formed: per shoot and cell the photos reduce to a histogram of at most
    256 grey levels, and sums of differences follow from running counts over its bins.
    """
    bins = (
        grids.select("shoot_id", F.posexplode("grid").alias("pos", "g"))
        .groupBy("shoot_id", "pos", "g")
        .agg(F.count("*").alias("c"))
    )
    below = Window.partitionBy("shoot_id", "pos").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    diff = F.col("c") * (
        F.col("g") * F.coalesce(F.sum("c").over(below), F.lit(0))
        - F.coalesce(F.sum(F.col("c") * F.col("g")).over(below), F.lit(0))
    )
    cells = bins.withColumn("_d", diff).groupBy("shoot_id", "pos").agg(
        F.sum("_d").alias("_d"), F.sum("c").alias("n")
    )
    n = F.max("n")
    pairs = n * (n - 1) / 2
    mean = F.sum("_d") / (F.count("*") * pairs) / 255.0
    return cells.groupBy("shoot_id").agg(
        n.alias("n_photos"), F.when(n < 2, F.lit(0.0)).otherwise(round_even(mean, 4)).alias("distinctness")
    )


def view_tag(path: Column) -> Column:
    """Cardinal view named by a file name; obliques and unnamed views give NULL."""
    stem = F.lower(file_stem(path))
    front, left, right = stem.contains("front"), stem.contains("left"), stem.contains("right")
    back = stem.contains("rear") | stem.contains("back")
    return F.when(
        ~((front | back) & (left | right)),
        F.when(front, "front").when(back, "back").when(left, "left").when(right, "right"),
    )


def view_map(paths: DataFrame) -> DataFrame:
    """First photo of each cardinal view, per shoot."""
    return (
        paths.withColumn("tag", view_tag(F.col("path")))
        .filter("tag IS NOT NULL")
        .groupBy("shoot_id", "tag")
        .agg(F.min_by("path", "seq").alias("path"), F.min("seq").alias("seq"))
    )


def conditioning_views(paths: DataFrame, limit: int = 4) -> DataFrame:
    """Photos handed to a generator: one per cardinal view in fixed order, then the rest by seq."""
    order = F.array(*[F.lit(t) for t in CARDINALS])
    chosen = view_map(paths).select("shoot_id", "seq", F.array_position(order, F.col("tag")).alias("_slot"))
    priority = F.struct(F.coalesce("_slot", F.lit(len(CARDINALS) + 1)), F.col("seq"))
    ranked = paths.join(chosen, ["shoot_id", "seq"], "left").withColumn(
        "slot", F.row_number().over(Window.partitionBy("shoot_id").orderBy(priority))
    )
    return ranked.filter(F.col("slot") <= limit).select("shoot_id", "slot", "seq", "path")


def first_n(paths: DataFrame, n: int = 12) -> DataFrame:
    """The first ``n`` photos of each shoot, the sample a labeller sees."""
    w = Window.partitionBy("shoot_id").orderBy("seq")
    return paths.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def clean_labels(photos: DataFrame, labels: DataFrame) -> DataFrame:
    """Attach labeller output by photo index; unknown viewpoints and overlong issue lists are normalised.

    Labels whose index matches no photo are dropped; photos without a label stay unknown.
    """
    known = F.array(*[F.lit(v) for v in VIEWPOINTS])
    cleaned = labels.select(
        "shoot_id",
        F.col("index").alias("seq"),
        F.when(F.array_contains(known, F.col("viewpoint")), F.col("viewpoint")).otherwise("unknown").alias("_v"),
        F.slice("issues", 1, 4).alias("_i"),
    )
    return photos.join(cleaned, ["shoot_id", "seq"], "left").select(
        "shoot_id",
        "seq",
        F.coalesce("_v", F.lit("unknown")).alias("viewpoint"),
        F.coalesce("_i", F.array().cast("array<string>")).alias("issues"),
    )


def coverage(notes: DataFrame) -> DataFrame:
    """Known viewpoints seen per shoot, and those still missing. At most 11 values per shoot."""
    known = F.array(*[F.lit(v) for v in VIEWPOINTS if v != "unknown"])
    seen = F.array_sort(F.collect_set(F.when(F.col("viewpoint") != "unknown", F.col("viewpoint"))))
    return (
        notes.groupBy("shoot_id")
        .agg(seen.alias("covered"))
        .withColumn("missing", F.array_sort(F.array_except(known, "covered")))
    )
