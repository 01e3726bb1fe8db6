"""Texts that every text operator must take, and helpers of the brute-force checks."""

import re

from pyspark.sql import functions as F

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [
    None, "", " ", "\t\r\n", "one", "one two three four five", "One TWO three four five six", "é ö ñ 日本 語 한국",
    "word " * 3000, "x" * 70000, "a\x00b c\x1fd\x85e\xa0f", "same text here", "same text here", "<|endoftext|> a<|endoftext|>",
    "  line  para　wide", "🎉🎉 emoji 🎉", "'s 're don't I'll  two  spaces   end   ",
]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def with_extra(df):
    """Extra columns whose names clash with those that operators use inside."""
    names = [n for n in ("text", "hash", "n", "comp", "row_id", "_h", "_b", "_q", "finish", "sketch", "frag", "score", "spans", "target", "sha256") if n not in df.columns]
    return df.withColumns({n: F.lit(7) for n in names})


def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")
