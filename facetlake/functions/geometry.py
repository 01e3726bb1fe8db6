"""Column functions on triangle rows (corners ``a b c`` inline) and position keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two vertices coincide when they agree to six decimals.
WELD_DIGITS = 6

CORNERS = ("a", "b", "c")
XYZ = ("x", "y", "z")


def col(corner: str, axis: str) -> Column:
    return F.col(f"{corner}{axis}")


def normal(prefix: str = "") -> tuple[Column, Column, Column]:
    """Unnormalised face normal (b-a) x (c-a)."""

    def c(name: str) -> Column:
        return F.col(prefix + name)

    ux, uy, uz = c("bx") - c("ax"), c("by") - c("ay"), c("bz") - c("az")
    vx, vy, vz = c("cx") - c("ax"), c("cy") - c("ay"), c("cz") - c("az")
    return uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx


def norm(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def area() -> Column:
    return 0.5 * norm(*normal())


def volume6() -> Column:
    """Six times the signed volume of the tetrahedron with the origin."""
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = ([col(k, t) for t in XYZ] for k in CORNERS)
    return ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx)


def position_key(corner: str, digits: int = WELD_DIGITS) -> Column:
    """Identity of a vertex: its position rounded to ``digits`` decimals (halves to even)."""
    scale = float(10**digits)
    return F.struct(*[F.rint(col(corner, t) * scale).cast("bigint").alias(t) for t in XYZ])


def corner_struct(corner: str) -> Column:
    return F.struct(*[col(corner, t).alias(t) for t in XYZ])


def centroid(axis: str) -> Column:
    return (col("a", axis) + col("b", axis) + col("c", axis)) / 3.0


def exact_sum(x: Column, precision: str = "decimal(30,12)") -> Column:
    """Sum of doubles as decimals: the same for every partitioning, so rankings do not flip."""
    return F.sum(x.cast(precision)).cast("double")
