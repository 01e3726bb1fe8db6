"""Column functions on small grey grids (row-major ``ARRAY<INT>``) and 64-bit hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Quality thresholds.
BLUR_REJECT = 40.0
BLUR_WARN = 100.0
CLIP_WARN = 0.10
CLIP_REJECT = 0.30
MIN_LONG_EDGE = 640
DARK_LEVEL = 5
BRIGHT_LEVEL = 250
SUBJECT_FLOOR = 0.10


def _literal_ints(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def _neighbour_positions(width: int, height: int) -> list[list[int]]:
    """Positions of the four neighbours of every cell; the border reflects without repeating."""
    rows, cols = np.divmod(np.arange(width * height), width)

    def reflect(v: np.ndarray, n: int) -> np.ndarray:
        v = np.abs(v)
        return np.where(v >= n, 2 * (n - 1) - v, v)

    shifts = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    return [
        (reflect(rows + dr, height) * width + reflect(cols + dc, width)).tolist() for dr, dc in shifts
    ]


def laplacian(grid: Column, width: int = 8, height: int = 8) -> Column:
    """Four-neighbour Laplacian of every cell."""
    up, down, left, right = (_literal_ints(p) for p in _neighbour_positions(width, height))

    def at(position: Column) -> Column:
        return F.get(grid, position)

    return F.transform(
        grid,
        lambda g, i: at(F.get(up, i)) + at(F.get(down, i)) + at(F.get(left, i)) + at(F.get(right, i)) - 4 * g,
    )


def population_variance(values: Column) -> Column:
    """Population variance of an integer array, from exact integer moments."""
    n = F.size(values).cast("bigint")
    total = F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v)
    squares = F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, v: acc + v.cast("bigint") * v)
    return (n * squares - total * total) / (n * n).cast("double")


def sharpness(grid: Column, width: int = 8, height: int = 8) -> Column:
    """Variance of the Laplacian: low for blurred photos."""
    return population_variance(laplacian(grid, width, height))


def share(grid: Column, predicate) -> Column:
    """Share of cells satisfying ``predicate``."""
    return F.size(F.filter(grid, predicate)) / F.size(grid).cast("double")


def mirrored(grid: Column, width: int = 8, height: int = 8) -> Column:
    """The grid flipped left to right."""
    source = [r * width + (width - 1 - c) for r in range(height) for c in range(width)]
    return F.transform(_literal_ints(source), lambda p: F.get(grid, p))


def gradient_hash(grid: Column, width: int = 9, height: int = 8, wrap: bool = False) -> Column:
    """Difference hash: one bit per horizontal step, set where the right cell is brighter.

    Bits are packed row by row, most significant first, into a signed BIGINT. With
    ``wrap`` the last column is compared with the first, so an 8-wide grid gives 64 bits.
    """
    steps = width if wrap else width - 1
    left = [r * width + c for r in range(height) for c in range(steps)]
    right = [r * width + (c + 1) % width for r in range(height) for c in range(steps)]
    bits = F.zip_with(
        _literal_ints(left),
        _literal_ints(right),
        lambda a, b: (F.get(grid, b) > F.get(grid, a)).cast("bigint"),
    )
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, bit: F.shiftleft(acc, 1).bitwiseOR(bit))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits."""
    return F.bit_count(a.bitwiseXOR(b))


def is_near_duplicate(h: Column, other: Column, other_flip: Column, threshold: int) -> Column:
    """Close to the other photo, and not better explained as its mirror image."""
    distance = hamming(h, other)
    return (distance <= threshold) & ~(hamming(h, other_flip) < distance)


def working_size(width: Column, height: Column, long_edge: int = 1600) -> Column:
    """Size of the working copy: shrink to the long edge, never enlarge; halves round to even."""
    scale = F.lit(float(long_edge)) / F.greatest(width, height)

    def side(v: Column) -> Column:
        return F.when(scale >= 1.0, v).otherwise(F.rint(v * scale).cast("int"))

    return F.struct(side(width).alias("width"), side(height).alias("height"))
