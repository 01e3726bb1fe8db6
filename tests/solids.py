"""Meshes with known volume, area, Euler number and component count."""

from __future__ import annotations

import numpy as np

BOX_FACES = [
    (0, 3, 1), (0, 2, 3), (4, 7, 6), (4, 5, 7), (0, 5, 4), (0, 1, 5),
    (2, 7, 3), (2, 6, 7), (0, 6, 2), (0, 4, 6), (1, 7, 5), (1, 3, 7),
]


def box(at=(0, 0, 0), size=(1, 1, 1)):
    pts = [tuple(at[a] + (v >> a & 1) * size[a] for a in range(3)) for v in range(8)]
    # Corners listed in this order wind outwards.
    return [tuple(pts[i] for i in (f[0], f[1], f[2])) for f in BOX_FACES]


def tetra():
    p = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    return [(p[0], p[2], p[1]), (p[0], p[1], p[3]), (p[0], p[3], p[2]), (p[1], p[2], p[3])]


def sphere(levels=3, radius=1.0, at=(0, 0, 0)):
    x, y, z = (1, 0, 0), (0, 1, 0), (0, 0, 1)
    n = lambda v: tuple(-c for c in v)
    tris = [(x, y, z), (y, n(x), z), (n(x), n(y), z), (n(y), x, z),
            (y, x, n(z)), (n(x), y, n(z)), (n(y), n(x), n(z)), (x, n(y), n(z))]

    def unit(v):
        v = np.asarray(v, float)
        return tuple(v / np.linalg.norm(v))

    for _ in range(levels):
        out = []
        for a, b, c in tris:
            ab, bc, ca = (unit(np.add(p, q)) for p, q in ((a, b), (b, c), (c, a)))
            out += [(a, ab, ca), (ab, b, bc), (ca, bc, c), (ab, bc, ca)]
        tris = out
    return [tuple(tuple(radius * np.asarray(p) + at) for p in t) for t in tris]


def frame(spark, meshes: dict):
    rows = [
        (name, fid, *[float(c) for p in tri for c in p]) for name, tris in meshes.items() for fid, tri in enumerate(tris)
    ]
    from facetlake.schemas import TRIANGLES

    return spark.createDataFrame(rows, TRIANGLES)
