"""The fixed set of viewing directions and their orthonormal bases."""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# Axis views, named for where they look from.
AXIS_CAMERAS = {
    "front": (0.0, -1.0, 0.0),
    "back": (0.0, 1.0, 0.0),
    "left": (-1.0, 0.0, 0.0),
    "right": (1.0, 0.0, 0.0),
    "top": (0.0, 0.0, 1.0),
    "bottom": (0.0, 0.0, -1.0),
}


@dataclass(frozen=True)
class Camera:
    name: str
    right: tuple[float, float, float]
    up: tuple[float, float, float]
    forward: tuple[float, float, float]


def camera(name: str, look: tuple[float, float, float]) -> Camera:
    """View from ``look`` onto the origin, with z up.

    In closed form: of a unit direction with horizontal length ``h``, the right-hand vector is its horizontal part
    turned by a quarter, and the up vector is what is left. Straight down or up, y points up in the image.
    """
    length = math.hypot(*look)
    x, y, z = (c / length for c in look)
    h = math.hypot(x, y)
    if h == 0:
        return Camera(name, (z, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, z))
    rows = (-y / h, x / h, 0.0), (-x * z / h, -y * z / h, h), (x, y, z)
    return Camera(name, *[tuple(c + 0.0 for c in row) for row in rows])  # no negative zeros


def default_cameras() -> list[Camera]:
    """Six axis views and the eight corners."""
    sides = (("left", -1.0), ("right", 1.0)), (("front", -1.0), ("back", 1.0)), (("bottom", -1.0), ("top", 1.0))
    corners = {f"{tb}-{fb}-{lr}": (x, y, z) for (lr, x), (fb, y), (tb, z) in product(*sides)}
    return [camera(name, look) for name, look in (AXIS_CAMERAS | corners).items()]


def camera_array(cameras: list[Camera]) -> Column:
    """The cameras as an array literal, to be exploded beside each face."""

    def vector(v: tuple[float, float, float], prefix: str) -> list[Column]:
        return [F.lit(x).alias(f"{prefix}{t}") for x, t in zip(v, "xyz")]

    return F.array(
        *[
            F.struct(F.lit(c.name).alias("view"), *vector(c.right, "r"), *vector(c.up, "u"), *vector(c.forward, "f"))
            for c in cameras
        ]
    )


def upright(x: Column, y: Column, z: Column, up_axis: str) -> tuple[Column, Column, Column]:
    """Rotate so that ``up_axis`` points along +z, keeping handedness."""
    turned = {"z": (x, y, z), "y": (x, -z, y), "x": (-z, y, x)}
    if up_axis not in turned:
        raise ValueError(f"up_axis must be x, y or z; got {up_axis!r}")
    return turned[up_axis]
