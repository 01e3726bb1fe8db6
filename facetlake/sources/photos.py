"""Photo files: listing, decoding and scoring of full-size images."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetlake.functions.pixels import BRIGHT_LEVEL, DARK_LEVEL, SUBJECT_FLOOR
from facetlake.operators.ordering import positions
from facetlake.operators.photos import PHOTO_SUFFIXES


def photo_listing(files: DataFrame) -> DataFrame:
    """Photo files in path order. ``files``: ``shoot_id path`` (more columns are kept)."""
    suffix = F.regexp_extract(F.lower("path"), r"(\.[^./]+)$", 1)
    return positions(files.filter(suffix.isin(*PHOTO_SUFFIXES)), ["shoot_id"], ["path"], "seq")


def list_photos(spark: SparkSession, root: str) -> DataFrame:
    """Photos below ``root/<shoot>/``; file contents are not read. An empty folder is an error."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", "modificationTime")
    )
    found = photo_listing(files.withColumn("shoot_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)))
    if found.isEmpty():
        raise FileNotFoundError(f"no photos found in {root}")
    return found


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root/<job>/...`` with size and time; only file metadata is read."""
    folder = root.rstrip("/").rsplit("/", 1)[-1]
    rel = F.substring_index("path", f"/{folder}/", -1)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select(
            F.substring_index(rel, "/", 1).alias("job_id"), rel.alias("name"), "length",
            F.col("modificationTime").alias("mtime"),
        )
    )


def read_images(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images (BGR bytes). Undecodable files stay, with ``unreadable`` set.

    Decodes what the JVM decodes; camera rotation tags are not applied.
    """
    return (
        spark.read.format("image")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("image.*")
        .select(
            F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data",
            (F.col("height") < 0).alias("unreadable"),
        )
    )


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luma of a BGR(A) buffer, rounded to whole levels."""
    image = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return image[:, :, 0]
    b, g, r = (image[:, :, i].astype(np.float64) for i in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)


def image_sharpness(g: np.ndarray) -> float:
    padded = np.pad(g.astype(np.int64), 1, mode="reflect")
    lap = padded[:-2, 1:-1] + padded[2:, 1:-1] + padded[1:-1, :-2] + padded[1:-1, 2:] - 4 * padded[1:-1, 1:-1]
    return float(lap.var())


def subject_mask(g: np.ndarray) -> np.ndarray:
    """False over black background connected to a corner; whole frame if little else remains."""
    dark = g <= DARK_LEVEL
    h, w = g.shape
    reached = np.zeros_like(dark)
    for y, x in ((0, 0), (0, w - 1), (h - 1, 0), (h - 1, w - 1)):
        reached[y, x] = dark[y, x]
    size = -1
    while size != (size := int(reached.sum())):
        # One sweep carries the flood along whole rows and columns in both directions.
        for axis in (0, 1):
            for flip in (1, -1):
                a = np.swapaxes(reached, 0, axis)[::flip]
                d = np.swapaxes(dark, 0, axis)[::flip]
                for i in range(1, len(a)):
                    a[i] |= a[i - 1] & d[i]
    subject = ~reached
    return subject if subject.mean() > SUBJECT_FLOOR else np.ones_like(subject)


def area_resize(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-weighted resize, as a weighted mean of the covered source cells."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        lo, hi = edges[:-1, None], edges[1:, None]
        cell = np.arange(n)[None, :]
        overlap = np.clip(np.minimum(hi, cell + 1) - np.maximum(lo, cell), 0, None)
        return overlap / overlap.sum(axis=1, keepdims=True)

    out = weights(g.shape[0], height) @ g.astype(np.float64) @ weights(g.shape[1], width).T
    return np.floor(out + 0.5).astype(np.uint8)


def gradient_hash(g: np.ndarray) -> int:
    small = area_resize(g, 8, 9)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return int.from_bytes(np.packbits(bits).tobytes(), "big", signed=True)


def _score_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "width", "height", "blur", "dark", "bright", "h", "h_flip"]
    for pdf in batches:
        rows = []
        for r in pdf.itertuples(index=False):
            if r.height < 0:
                rows.append((r.path, None, None, None, None, None, None, None))
                continue
            g = grey(r.data, r.height, r.width, r.channels)
            lit = g[subject_mask(g)]
            rows.append(
                (r.path, r.width, r.height, image_sharpness(g), float((lit <= DARK_LEVEL).mean()),
                 float((lit >= BRIGHT_LEVEL).mean()), gradient_hash(g), gradient_hash(g[:, ::-1]))
            )
        out = pd.DataFrame(rows, columns=names)
        for c in ("width", "height", "h", "h_flip"):
            out[c] = pd.array([x[names.index(c)] for x in rows], dtype="Int64")
        yield out


def score_images(images: DataFrame) -> DataFrame:
    """Sharpness, exposure on the subject and hashes of full-size images, one row per image.

    Images are independent, so the work is split by row; unreadable ones give NULL scores.
    """
    return images.select("path", "height", "width", "channels", "data").mapInPandas(
        _score_batch,
        "path string, width int, height int, blur double, dark double, bright double, h bigint, h_flip bigint",
    )


def grids_to_images(grids: DataFrame) -> DataFrame:
    """8x8 grids as single-channel image rows, the shape ``score_images`` reads."""
    data = F.to_binary(F.array_join(F.transform("grid", lambda g: F.lpad(F.hex(g), 2, "0")), ""), F.lit("hex"))
    return grids.select(
        F.concat_ws("/", F.col("shoot_id").cast("string"), F.col("seq").cast("string")).alias("path"),
        F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), data.alias("data"),
    )


def bitmap(grey_rows: np.ndarray) -> bytes:
    """A grey image as an uncompressed 24-bit bitmap file."""
    height, width = grey_rows.shape
    stride = -(-3 * width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = np.repeat(grey_rows[::-1], 3, axis=1)
    body = rows.tobytes()
    head = struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def write_files(files: DataFrame, root: str) -> None:
    """Write ``path data`` rows as files below ``root``, from the tasks that hold them; a repeated task writes the same files."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = fs.FileSystem.from_uri(root)
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                system.create_dir(f"{base}/{r.path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{base}/{r.path}", compression=None) as out:
                    out.write(r.data)
            yield pd.DataFrame({"n": [len(pdf)]})

    files.select("path", "data").mapInPandas(put, "n long").agg(F.sum("n")).collect()


def contact_sheets(grids: DataFrame, per_sheet: int = 64) -> DataFrame:
    """Bitmaps of up to ``per_sheet`` photo grids side by side: ``path data``, named ``shoot/sheet.bmp``."""

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        tiles = np.concatenate([np.array(list(g), np.uint8).reshape(8, 8) for g in pdf["grid"]], axis=1)
        return pd.DataFrame({"path": [f"{pdf.shoot_id.iloc[0]}/{pdf.sheet.iloc[0]}.bmp"], "data": [bitmap(tiles)]})

    sheet = F.floor(F.col("seq") / (8 * per_sheet)).cast("long").alias("sheet")
    return grids.select("shoot_id", "seq", "grid", sheet).groupBy("shoot_id", "sheet").applyInPandas(draw, "path string, data binary")
