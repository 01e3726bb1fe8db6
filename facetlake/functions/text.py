"""Column functions on names, lengths, log lines and exact number formatting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetlake.functions.numbers import scaled_whole

# Length units in metres.
UNITS = {"mm": 0.001, "cm": 0.01, "m": 1.0, "in": 0.0254, "ft": 0.3048}
LENGTH = r"(?i)^\s*([0-9]*\.?[0-9]+)\s*(mm|cm|m|in|ft)\s*$"


def parse_length(text: Column) -> Column:
    """Metres from '4.5 m' or '45cm'; ``error`` says why a text gives none."""
    number = F.regexp_extract(text, LENGTH, 1).try_cast("double")
    units = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    metres = number * F.element_at(units, F.lower(F.regexp_extract(text, LENGTH, 2)))
    error = (
        F.when(text.isNull() | number.isNull(), "unreadable length")
        .when(number <= 0, "length must be positive")
    )
    return F.struct(F.when(error.isNull(), metres).alias("metres"), error.alias("error"))


def slug(text: Column, fallback: str = "part", max_len: int | None = None) -> Column:
    """Lower-case words joined by hyphens; ``fallback`` where nothing remains."""
    s = F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))
    if max_len is not None:
        s = F.btrim(F.substring(s, 1, max_len), F.lit("-"))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def node_name(text: Column) -> Column:
    """A scene node name without path separators."""
    clean = F.btrim(F.regexp_replace(text, r"[/\\]+", "-"), F.lit("- \t\r\n"))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("model"))


def nearest(value: Column, allowed: Sequence[int]) -> Column:
    """The allowed value closest to ``value``; the earlier one on a tie."""
    options = [
        F.struct(F.abs(value - a).alias("d"), F.lit(i).alias("i"), F.lit(a).alias("v")) for i, a in enumerate(allowed)
    ]
    return F.array_min(F.array(*options))["v"]


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def fixed2(x: Column) -> Column:
    """Non-negative number with two decimals, rounded from its exact binary value (ties to even)."""
    cents = scaled_whole(x, 2)
    return F.concat(
        F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0")
    )


def summary_line(status: Column, name: Column, detail: Column, seconds: Column) -> Column:
    """``[STATUS] name: detail (1.23s)``."""
    return F.concat(
        F.lit("["), F.upper(status), F.lit("] "), name, F.lit(": "), detail, F.lit(" ("), fixed2(seconds), F.lit("s)")
    )


def last_line(text: Column, width: int = 160) -> Column:
    """The last non-blank line, trimmed and cut: the actionable part of a long error."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.substring(F.coalesce(F.get(lines, F.size(lines) - 1), text), 1, width)


def severity(line: Column) -> Column:
    """Class of a log line; the first matching rule wins."""
    return (
        F.when(line.startswith("WARNING:") | line.contains("[FAILED]"), "fail")
        .when(line.contains("[SKIPPED]"), "skipped")
        .when(line.contains("[OK]"), "ok")
        .otherwise("plain")
    )


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / 1e6


def age(ts: Column, now: Column) -> Column:
    """How long ago, in words: relative within a day, a date beyond it; future is 'just now'."""
    minutes = seconds_between(ts, now) / 60.0
    return (
        F.when(ts.isNull(), "")
        .when(minutes < 1, "just now")
        .when(minutes < 60, F.concat(F.floor(minutes).cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(ts, "MMM d"))
    )


def last_segment(url: Column) -> Column:
    """Last path segment of a resource URL; '' stays ''."""
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def fingerprint(content: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(content, 256), 1, length)


def settings_merge(base: Column, overrides: Column, seed: Column) -> Column:
    """Overrides on top of stored settings: NULL keeps the stored value, '' is a value.

    'auto' or blank ``backend`` and blank ``object_hint`` become NULL; a given seed wins.
    """
    given = F.map_filter(overrides, lambda k, v: v.isNotNull())
    normal = F.transform_values(
        given,
        lambda k, v: F.when((k == "backend") & F.trim(v).isin("", "auto"), F.lit(None).cast("string"))
        .when((k == "object_hint") & (F.trim(v) == ""), F.lit(None).cast("string"))
        .when(k.isin("backend", "object_hint"), F.trim(v))
        .otherwise(v),
    )
    with_seed = F.when(
        seed.isNotNull(), F.create_map(F.lit("seed"), seed.cast("string"))
    ).otherwise(F.create_map().cast("map<string,string>"))
    return F.map_concat(base, normal, with_seed)


def fill_defaults(options: Column, defaults: Column) -> Column:
    """Explicit options win over defaults; NULL defaults are left out."""
    return F.map_concat(F.map_filter(defaults, lambda k, v: v.isNotNull()), options)


def map_text(m: Column) -> Column:
    """``k=v`` pairs in key order, NULL values shown as ``-``."""
    keys = F.array_sort(F.map_keys(m))
    return F.array_join(
        F.transform(keys, lambda k: F.concat(k, F.lit("="), F.coalesce(F.element_at(m, k), F.lit("-")))), ";"
    )
