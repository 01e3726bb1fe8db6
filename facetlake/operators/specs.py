"""Object specifications: validation, scale factors, option compatibility, face budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Service bounds of the face budget and the smallest budget of a part.
MIN_BUDGET = 100
MAX_BUDGET = 2_000_000
PART_FLOOR = 32


def scale_source(marker_size: Column, *dimensions: Column) -> Column:
    """Where metric scale comes from: a marker, else declared dimensions, else nowhere."""
    known = F.coalesce(*dimensions).isNotNull()
    return F.when(marker_size.isNotNull(), "marker").when(known, "dimensions").otherwise("none")


def violations(target_faces: Column, dimensions: Sequence[Column], part_name: Column, split_parts: Column) -> Column:
    """Names of the rules a specification breaks."""
    return F.array_compact(
        F.array(
            F.when(target_faces <= 0, "budget not positive"),
            F.when((target_faces < MIN_BUDGET) | (target_faces > MAX_BUDGET), "budget out of range"),
            *[F.when(d <= 0, F.lit(f"dimension {i} not positive")) for i, d in enumerate(dimensions)],
            F.when(F.trim(part_name) == "", "part without a name"),
            F.when(part_name.isNotNull() & ~split_parts, "parts given but split is off"),
        )
    )


def dimension_factor(extents: Sequence[Column], dimensions: Sequence[Column]) -> Column:
    """Mean ratio of declared to measured sizes, both sorted descending; NULL if undefined."""
    declared = F.sort_array(F.array_compact(F.array(*dimensions)), asc=False)
    measured = F.sort_array(F.array(*extents), asc=False)
    n = F.size(declared)
    ratios = F.zip_with(declared, F.slice(measured, 1, F.greatest(n, F.lit(0))), lambda d, e: d / e)
    usable = (n > 0) & (F.least(*extents) > 1e-9)
    return F.when(usable, F.aggregate(ratios, F.lit(0.0), lambda a, r: a + r) / n)


def marker_factors(detections: DataFrame) -> DataFrame:
    """True over measured marker side per shoot.

    ``detections``: ``shoot_id true_side corners ARRAY<STRUCT<x,y>>``; the measured side is the
    mean edge length over all detections of the shoot.
    """

    def edge(i: int) -> Column:
        p, q = F.get("corners", i), F.get("corners", (i + 1) % 4)
        return F.sqrt((p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2)

    side = (edge(0) + edge(1) + edge(2) + edge(3)) / 4.0
    return (
        detections.groupBy("shoot_id")
        .agg(F.avg(side).alias("measured"), F.max("true_side").alias("true_side"))
        .select(
            "shoot_id", "measured",
            F.when((F.col("measured") > 0) & (F.col("true_side") > 0), F.col("true_side") / F.col("measured")).alias("factor"),
        )
    )


def unsupported(backend: Column, options: Column, allowed: Mapping[str, Sequence[str]],
                pairs: Sequence[Sequence[str]] = ()) -> Column:
    """Option keys a backend does not read, sorted; an unknown backend reports nothing.

    Keys of a pair are one control sent under two names: if either is read, neither is reported.
    """
    keys = F.map_keys(options)
    out = F.array().cast("array<string>")
    for name, known in allowed.items():
        ignored = F.array_except(keys, F.array(*[F.lit(k) for k in known]))
        for pair in pairs:
            both = F.array(*[F.lit(k) for k in pair])
            read = F.arrays_overlap(F.array_except(keys, ignored), both)
            ignored = F.when(read, F.array_except(ignored, both)).otherwise(ignored)
        out = F.when(backend == name, F.array_sort(ignored)).otherwise(out)
    return out


def water_fill(parts: DataFrame, total: str = "total_budget") -> DataFrame:
    """Split each mesh's budget over its parts in proportion to faces, at least 32 each.

    Ascending by faces, the first parts are clamped while their share of what is left falls
    below the floor; the rest share proportionally and rounding drift goes to the largest.
    Parts per mesh are bounded by the part limit of the splitters, so the windows are small.
    Meshes whose budget cannot give every part the floor get NULL targets.
    """
    up = Window.partitionBy("mesh_id").orderBy("n_faces", F.desc("part_index"))
    prior = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("mesh_id")
    i = F.coalesce(F.count("*").over(prior), F.lit(0))
    n = F.count("*").over(whole)
    budget = F.col(total)
    left = budget - PART_FLOOR * i
    share = F.when(F.sum("n_faces").over(rest) > 0, left * (F.col("n_faces") / F.sum("n_faces").over(rest))).otherwise(
        left / (n - i)
    )
    marked = parts.withColumn("_clamp", share < PART_FLOOR).withColumn("_n", n)
    # The clamped parts are a prefix: a part is clamped only if every smaller one is.
    marked = marked.withColumn("_clamped", F.min(F.col("_clamp").cast("int")).over(
        up.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    clamped = F.sum(F.col("_clamped").cast("int")).over(whole)
    open_faces = F.sum(F.when(~F.col("_clamped"), F.col("n_faces")).otherwise(0)).over(whole)
    remaining = budget - PART_FLOOR * clamped
    raw = F.when(open_faces > 0, remaining * (F.col("n_faces") / open_faces)).otherwise(remaining / (F.col("_n") - clamped))
    first = marked.withColumn(
        "_first", F.when(F.col("_clamped"), F.lit(PART_FLOOR)).otherwise(F.rint(raw)).cast("bigint")
    )
    largest = F.row_number().over(Window.partitionBy("mesh_id").orderBy(F.desc("n_faces"), "part_index")) == 1
    drift = budget - F.sum("_first").over(whole)
    target = F.col("_first") + F.when(largest, drift).otherwise(0)
    return first.withColumn(
        "target_faces", F.when(budget >= PART_FLOOR * F.col("_n"), target).cast("bigint")
    ).drop("_clamp", "_n", "_clamped", "_first")


def texture_size(part_faces: Column, total_faces: Column, base: int = 1024, floor: int = 128) -> Column:
    """Texture edge of a part: square root of its face share, snapped to a power of two."""
    share = F.least(F.lit(1.0), part_faces / total_faces)
    target = F.greatest(base * F.sqrt(share), F.lit(float(floor)))
    snapped = F.pow(F.lit(2.0), F.rint(F.log2(target)))
    size = F.least(F.lit(float(base)), F.greatest(F.lit(float(floor)), snapped)).cast("int")
    return F.when((total_faces <= 0) | (part_faces <= 0), floor).otherwise(size)
