"""Voxel grids as packed columns: arrays ``[i, j, word]`` of 64 cells a word, lowest ``k`` in the lowest bit.

Steps work on whole words. A grid has an empty border, so that what leaves a word at the top or bottom of a column is lost
only where no cell can be.
"""

from __future__ import annotations

import numpy as np

BITS = 64
_ONE = np.uint64(1)
_LAST = np.uint64(BITS - 1)


def up(grid: np.ndarray) -> np.ndarray:
    """Every cell moved by one towards larger ``k``."""
    out = grid << _ONE
    out[..., 1:] |= grid[..., :-1] >> _LAST
    return out


def down(grid: np.ndarray) -> np.ndarray:
    out = grid >> _ONE
    out[..., :-1] |= grid[..., 1:] << _LAST
    return out


def wordwise(shape: tuple[int, ...]) -> np.ndarray:
    """An empty grid in which the words of one ``i`` and height lie together: steps then take long lines of words."""
    return np.moveaxis(np.zeros((shape[0], shape[2], shape[1]), np.uint64), 1, 2)


def grown(grid: np.ndarray, steps: int = 1, done: int = 0) -> np.ndarray:
    """Cells within so many steps of a cell, by faces; ``grid`` is itself grown by ``done`` steps.

    What is grown by r steps takes up to (r + 3) // 3 at a time: of a cell r + s steps away, the longest of the three
    distances is at least s then, so moving by s along one axis leaves it within r.
    """
    spare = np.empty_like(grid)
    while steps > 0:
        s = min(steps, (done + 3) // 3, BITS - 1)
        by, rest = np.uint64(s), np.uint64(BITS - s)
        out = np.left_shift(grid, by)
        out |= grid
        out |= np.right_shift(grid, by, out=spare)
        out[..., 1:] |= np.right_shift(grid[..., :-1], rest, out=spare[..., 1:])
        out[..., :-1] |= np.left_shift(grid[..., 1:], rest, out=spare[..., :-1])
        out[s:] |= grid[:-s]
        out[:-s] |= grid[s:]
        out[:, s:] |= grid[:, :-s]
        out[:, :-s] |= grid[:, s:]
        grid, steps, done = out, steps - s, done + s
    return grid


def shrunk(grid: np.ndarray, steps: int = 1) -> np.ndarray:
    """Cells from which so many steps lead to no empty cell; beyond the border all is empty."""
    empty = np.full(tuple(n + 2 for n in grid.shape), ~np.uint64(0))
    empty[1:-1, 1:-1, 1:-1] = ~grid
    return ~grown(empty, steps)[1:-1, 1:-1, 1:-1]


def _along(reach: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Reached cells spread through runs of free cells; arrays ``[word, column]``."""
    out, over = reach.copy(), None
    # Upwards a carry runs through the free cells above a reached one, and into the next word.
    for w, open_ in enumerate(free):
        line = out[w]
        if over is not None:
            line |= over & open_
        total = open_ + line
        line |= (total ^ open_) & open_
        over = (total < open_).astype(np.uint64)
    # Downwards in steps that double.
    for w in range(len(out) - 1, -1, -1):
        line, way = out[w], free[w]
        if w + 1 < len(out):
            line |= (out[w + 1] & _ONE) << _LAST & way
        step = 1
        while step < BITS:
            s = np.uint64(step)
            line |= way & (line >> s)
            way = way & (way >> s)
            step *= 2
    return out


def reached(seeds: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Free cells that a way by faces joins to a seed; seeds are free. Axes between the first two and the last stay apart."""
    reach = seeds.copy("K")
    tall, open_tall = np.moveaxis(reach, -1, 0), np.moveaxis(free, -1, 0)
    while True:
        for axis in (0, 1):
            line, open_ = (list(np.moveaxis(x, axis, 0)) for x in (reach, free))
            spare = np.empty_like(line[0])
            for ends in (range(1, len(line)), range(len(line) - 2, -1, -1)):
                step = 1 if ends.step > 0 else -1
                for i in ends:
                    np.bitwise_and(line[i - step], open_[i], out=spare)
                    np.bitwise_or(line[i], spare, out=line[i])
            # Only columns reached in part have a run to go on with.
            part = (open_tall != tall).any(axis=0) & tall.any(axis=0)
            if part.any():
                tall[:, part] = _along(tall[:, part], open_tall[:, part])
        wider = grown(reach)
        wider &= free
        if (wider == reach).all():
            return reach
        reach[...] = wider


def outside(grid: np.ndarray) -> np.ndarray:
    """Empty cells that a way by faces joins to the border."""
    free = ~grid
    seeds = np.zeros_like(grid)
    seeds[[0, -1]], seeds[:, [0, -1]] = free[[0, -1]], free[:, [0, -1]]
    return reached(seeds, free)


def places(grid: np.ndarray) -> np.ndarray:
    """Numbers of the occupied cells, counted in the order of the array."""
    flat = grid.reshape(-1)
    at = np.flatnonzero(flat)
    left, found = flat[at], []
    # The lowest bit of every word by turns; words here mostly have one or two.
    while len(at):
        low = left & (~left + _ONE)
        found.append(at * BITS + np.bitwise_count(low - _ONE))
        left = left ^ low
        more = left != 0
        at, left = at[more], left[more]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def runs(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the first and last cell of every run of a column."""
    return places(grid & ~up(grid)), places(grid & ~down(grid))


def cells(grid: np.ndarray) -> np.ndarray:
    """Whether each cell is occupied, as ``[i, j, k]``."""
    grid = np.ascontiguousarray(grid)
    return np.unpackbits(grid.view(np.uint8).reshape(*grid.shape[:2], -1), axis=-1, bitorder="little").astype(bool)


def count(grid: np.ndarray) -> int:
    return int(np.bitwise_count(grid).sum())


def spans(grid: np.ndarray) -> list[tuple[int, int]]:
    """First and last ``i``, ``j`` and ``k`` of the occupied cells; there is one."""
    across = np.bitwise_or.reduce(grid, axis=0)
    ks = np.unpackbits(np.bitwise_or.reduce(across, axis=0).view(np.uint8), bitorder="little")
    filled = (grid.any(axis=(1, 2)), across.any(axis=1), ks)
    return [(int(x[0]), int(x[-1])) for x in map(np.flatnonzero, filled)]


def box_cells(grid: np.ndarray) -> int:
    """Cells of the box around all occupied ones."""
    return int(np.prod([b - a + 1 for a, b in spans(grid)])) if grid.any() else 0


def bodies(grid: np.ndarray) -> int:
    """How many bodies the occupied cells form, by faces: runs of columns, joined where neighbours overlap."""
    if not grid.any():
        return 0
    # Mostly one body, which a way from any of its cells shows.
    seed, first = np.zeros_like(grid), np.unravel_index(np.argmax(grid != 0), grid.shape)
    seed[first] = grid[first] & (~grid[first] + _ONE)
    if (reached(seed, grid) == grid).all():
        return 1
    high = grid.shape[2] * BITS
    at_low, at_top = runs(grid)
    wide = grid.shape[1]
    column, low, top = at_low // high, at_low % high, at_top % high
    low_key, top_key = at_low, at_top
    joined = []
    for step, edge_of in ((wide, None), (1, wide - 1)):
        beside = column + step
        first = np.searchsorted(top_key, beside * high + low)
        last = np.searchsorted(low_key, beside * high + top, "right")
        if edge_of is not None:
            last = np.where(column % wide == edge_of, first, last)
        n = np.maximum(last - first, 0)
        run = np.repeat(np.arange(len(column)), n)
        joined.append(np.stack([run, np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]))
    a, b = np.concatenate(joined, axis=1)
    root = np.arange(len(column))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while ((further := root[root]) != root).any():
            root = further
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return int((root == np.arange(len(root))).sum())
