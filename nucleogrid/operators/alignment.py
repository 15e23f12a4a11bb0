"""Kernels that bring tiles and images together: numpy on one image, chunk, tile graph or pair of point sets at a time.

What a task holds is bounded by the size of a tile's slice, of a chunk or of a window of points,
never by the number of tiles; parts are spread by Spark's grouping.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..workers import on_workers


def _per_group(df: DataFrame, by: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], columns: str) -> DataFrame:
    """The rows that ``work`` makes of each group, behind the group's keys."""
    on_workers(df.sparkSession)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = work(rows)
        for at, k in enumerate(by):
            out.insert(at, k, rows[k].iloc[0])
        return out

    types = dict(df.dtypes)
    return df.groupBy(*by).applyInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in by), columns]))


def _image(rows: pd.DataFrame, height: int, width: int) -> np.ndarray:
    image = np.zeros((height, width))
    image[rows["y"].to_numpy(), rows["x"].to_numpy()] = rows["v"].to_numpy()
    return image


def phase_shift(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, ty, tx): the whole-pixel shift that brings the moving image onto the target, by phase correlation.

    pixels has (by, moving, y, x, v) with y, x >= 0; pixels without a row are 0.  Of equal peaks the
    first by row and column counts.  Shifts beyond half an image are negative ones.  An image
    without any content gives null.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows["y"].max()) + 1, int(rows["x"].max()) + 1
        moving = rows["moving"].to_numpy(bool)
        a, b = (np.fft.fft2(_image(rows[m], h, w)) for m in (~moving, moving))
        cross = a * b.conj()
        size = np.abs(cross)
        if not size.any():
            return pd.DataFrame({"ty": pd.array([None], "Int64"), "tx": pd.array([None], "Int64")})
        peak = np.fft.ifft2(cross / np.maximum(size, 100 * np.finfo(float).eps)).real
        at = np.unravel_index(np.argmax(np.round(peak, 9)), peak.shape)
        return pd.DataFrame({n: [int(s) - (e if s > e // 2 else 0)] for n, s, e in zip(("ty", "tx"), at, (h, w))})

    return _per_group(pixels, by, work, "ty long, tx long")


def low_pass(pixels: DataFrame, by: list[str], cutoff: float = 25.0) -> DataFrame:
    """(by, y, x, v): images under a Gaussian of ``cutoff`` in the frequency domain, as magnitudes; every pixel of the extent comes out."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = int(rows["y"].max()) + 1, int(rows["x"].max()) + 1
        y, x = np.arange(h) - h // 2, np.arange(w) - w // 2
        mask = np.fft.ifftshift(np.exp(-(y[:, None] ** 2 + x[None, :] ** 2) / (2 * cutoff**2)))
        v = np.abs(np.fft.ifft2(np.fft.fft2(_image(rows, h, w)) * mask))
        ys, xs = np.indices((h, w))
        return pd.DataFrame({"y": ys.ravel(), "x": xs.ravel(), "v": v.ravel()})

    return _per_group(pixels, by, work, "y long, x long, v double")


def _by_pairs(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, block: int) -> Callable:
    """The sums of an expectation step, over blocks of target points: (t, variance) to the target points' masses, the
    moving points' masses, and the sum of products of both sides' coordinates."""

    def sums(t: np.ndarray, variance: float) -> tuple[np.ndarray, np.ndarray, float]:
        place, square = y + t, lambda p: (p**2).sum(1)
        of_target, of_moving, both = np.empty(len(x)), np.zeros(len(y)), 0.0
        for at in range(0, len(x), block):
            part = x[at : at + block]
            d = square(part)[None, :] + square(place)[:, None] - 2 * place @ part.T
            p = np.exp(-np.maximum(d, 0) / (2 * variance)) * b[:, None]
            p *= a[at : at + block] / np.maximum(p.sum(0), _LEAST)
            of_target[at : at + block] = p.sum(0)
            of_moving += p.sum(1)
            both += ((p @ part) * y).sum()
        return of_target, of_moving, both

    return sums


def _by_axes(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray) -> Callable:
    """As ``_by_pairs``, without pairs: the kernel is a product over axes, so a grid of the axes' distinct values is summed one axis after the other."""
    of_x, of_y = ([np.unique(c, return_inverse=True) for c in p.T] for p in (x, y))
    at_x, at_y = (tuple(c[1].ravel() for c in of) for of in (of_x, of_y))

    def spread(of: list, at: tuple, v: np.ndarray) -> np.ndarray:
        grid = np.zeros([len(c[0]) for c in of])
        grid[at] = v
        return grid

    def along(grid: np.ndarray, axis: int, k: np.ndarray) -> np.ndarray:
        return np.moveaxis(np.tensordot(grid, k, (axis, 1)), -1, axis)

    def sums(t: np.ndarray, variance: float) -> tuple[np.ndarray, np.ndarray, float]:
        k = [np.exp(-((u[0][:, None] - v[0][None, :] - s) ** 2) / (2 * variance)) for u, v, s in zip(of_x, of_y, t)]
        grid = spread(of_y, at_y, b)
        for axis in (2, 1, 0):
            grid = along(grid, axis, k[axis])
        total = grid[at_x]
        share = a / np.maximum(total, _LEAST)
        # behind each axis the sums themselves and those times a coordinate of the target points
        parts = {None: spread(of_x, at_x, share)}
        for axis in (2, 1, 0):
            own, times = k[axis].T, k[axis].T * of_x[axis][0]
            parts = {c: along(g, axis, own) for c, g in parts.items()} | {axis: along(parts[None], axis, times)}
        return share * total, b * parts[None][at_y], sum(float(b * parts[c][at_y] @ y[:, c]) for c in range(3))

    return sums


#: What the moving points' kernels add up to at a target point, at least.
_LEAST = np.finfo(np.float32).eps


def translation(points: DataFrame, by: list[str], tolerance: float = 1e-5, steps: int = 1000, block: int = 2048) -> DataFrame:
    """(by, ty, tx): the translation in the plane that brings moving points onto target points, by coherent point drift.

    points has (by, moving, z, y, x).  Points of one place count as one with their number as its
    weight.  Expectation and maximisation run until the objective changes by less than
    ``tolerance``, or neither the translation nor the variance changes; z stays.  A step goes over
    the grid of the distinct values of each axis where that is less work, whatever the number of
    points, else over all pairs in blocks of target points (never the whole matrix of both sets),
    which grows with the product of both sides.  Groups without points on both sides give 0.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        moving = rows["moving"].to_numpy(bool)
        xyz, n = rows[["z", "y", "x"]].to_numpy(float), rows["_n"].to_numpy(float)
        # the order of arrival must not decide the last digits
        (x, a), (y, b) = ((p[o], w[o]) for p, w in ((xyz[~moving], n[~moving]), (xyz[moving], n[moving])) for o in (np.lexsort(p.T),))
        t = np.zeros(3)
        if len(x) and len(y):
            middle = a @ x / a.sum()
            x, y = x - middle, y - middle
            square = lambda p: (p**2).sum(1)
            variance = (a @ square(x) * b.sum() + b @ square(y) * a.sum() - 2 * (a @ x) @ (b @ y)) / (3 * a.sum() * b.sum())
            sides = [max(len(np.unique(p[:, c])) for p in (x, y)) for c in range(3)]
            # a pair takes about as long as 50 products along an axis
            sums = _by_axes(x, a, y, b) if np.prod(sides) * sum(sides) < 50.0 * len(x) * len(y) else _by_pairs(x, a, y, b, block)
            before = np.inf
            for _ in range(steps):
                if variance <= 0:
                    variance = tolerance / 10
                of_target, of_moving, both = sums(t, variance)
                mass = of_target.sum()
                if mass <= 0:
                    break
                to, own = of_target @ x / mass, of_moving @ y / mass
                new = np.where([False, True, True], to - own, 0.0)
                spread, agree = of_target @ square(x) - mass * to @ to, both - mass * to @ own
                now = (spread - 2 * agree + of_moving @ square(y) - mass * own @ own) / (2 * variance) + 1.5 * mass * np.log(variance)
                last, t, held, variance = t, new, variance, (spread - agree) / (3 * mass)
                still = np.abs(t - last).max() <= 1e-9 and abs(max(variance, tolerance / 10) - max(held, tolerance / 10)) <= 1e-9
                if abs(now - before) <= tolerance or still:
                    break
                before = now
        return pd.DataFrame({"ty": [t[1]], "tx": [t[2]]})

    places = points.groupBy(*by, "moving", "z", "y", "x").agg(F.count("*").alias("_n"))
    # by number, else few tasks get all groups, whose rows are few and whose work is long
    spark = points.sparkSession
    return _per_group(places.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *by), by, work, "ty double, tx double")


def tree_offsets(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, i, j, z) of each tile, placed along the tree of the best edges and moved so that the largest z is 1.

    edges has (by, i, j, down, z, quality): the offset of tile (i, j) from the one above it (down)
    or left of it.  The tree grows from the tile of the best edge, of equals by the left one and the
    first column; of equal edges the tile further left, then further up, then the one below, above,
    right and left of it.  Tiles that no edge reaches have no z.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        known = {(int(r.i), int(r.j), bool(r.down)): (float(r.z), float(r.quality)) for r in rows.itertuples() if pd.notna(r.quality) and pd.notna(r.z)}
        tiles = sorted({t for i, j, down in zip(rows["i"].astype(int), rows["j"].astype(int), rows["down"].astype(bool)) for t in ((i, j), (i - 1, j) if down else (i, j - 1))})
        z: dict[tuple[int, int], float] = {}
        if known:
            i, j, _ = min(known, key=lambda e: (-known[e][1], e[2], e[1], e[0]))
            z[i, j] = 0.0
            queue: list = []

            def reach(i: int, j: int) -> None:
                for at, (to, edge, sign) in enumerate((((i + 1, j), (i + 1, j, True), 1), ((i - 1, j), (i, j, True), -1), ((i, j + 1), (i, j + 1, False), 1), ((i, j - 1), (i, j, False), -1))):
                    if edge in known and to not in z:
                        heapq.heappush(queue, (-known[edge][1], j, i, at, to, z[i, j] + sign * known[edge][0]))

            reach(i, j)
            while queue:
                *_, to, place = heapq.heappop(queue)
                if to not in z:
                    z[to] = place
                    reach(*to)
        top = max(z.values(), default=0.0)
        return pd.DataFrame({"i": [t[0] for t in tiles], "j": [t[1] for t in tiles], "z": pd.array([z[t] - top + 1 if t in z else None for t in tiles], "Float64")})

    return _per_group(edges, by, work, "i long, j long, z double")


def point_windows(counts: DataFrame, by: list[str], step: int = 15, least: int = 100, most: int = 20_000) -> DataFrame:
    """(by, zup, zdown, moving, target, usable): the windows of slices in which points are matched, from the last slice up.

    counts has (by, z, moving, target), the points of each slice.  A window grows by ``step`` slices
    until both sides have ``least`` points, their product reaches ``most`` squared, or slice 0 is
    reached; the next one starts above.  ``usable`` says whether both sides have points and are not
    too many.  The last slice itself is not part of any window.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        start, last = int(rows["z"].min()), int(rows["z"].max())
        held = np.zeros((2, last + 2), np.int64)
        np.add.at(held[0], rows["z"].to_numpy(int) + 1, rows["moving"].to_numpy(np.int64))
        np.add.at(held[1], rows["z"].to_numpy(int) + 1, rows["target"].to_numpy(np.int64))
        until = held.cumsum(1)
        out, z, size = [], last, step
        while z > start:
            up = max(0, z - size)
            m, t = (int(u[z] - u[up]) for u in until)
            if min(m, t) < least and m * t < most**2 and up > 0:
                size += step
                continue
            out.append((up, z, m, t, m > 0 and t > 0 and m * t < most**2))
            z, size = z - size, step
        return pd.DataFrame(out, columns=["zup", "zdown", "moving", "target", "usable"])

    return _per_group(counts, by, work, "zup long, zdown long, moving long, target long, usable boolean")


def followed(flow: DataFrame, by: list[str], shape: tuple[int, int, int], steps: int = 139) -> DataFrame:
    """(by, z, y, x, pz, py, px): where each voxel of a chunk ends after ``steps`` steps along the flow.

    flow has (by, z, y, x, dz, dy, dx) with one row a voxel inside ``shape``; elsewhere it is 0.  A
    step reads the flow of the voxel that holds the point and stops at the chunk's faces; a voxel
    whose dz is at most 0.001 stays.
    """

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows[["z", "y", "x"]].to_numpy(np.int64)
        field = np.zeros((*shape, 3))
        field[tuple(at.T)] = rows[["dz", "dy", "dx"]].to_numpy(float)
        moves = np.abs(rows["dz"].to_numpy(float)) > 1e-3
        p, end = at.astype(float), np.array(shape) - 1.0
        q = p[moves]
        for _ in range(steps):
            q = np.clip(q + field[tuple(np.floor(q).astype(np.int64).T)], 0, end)
        p[moves] = q
        return pd.DataFrame(np.hstack((at, p)), columns=["z", "y", "x", "pz", "py", "px"]).astype({c: "int64" for c in "zyx"})

    return _per_group(flow, by, work, "z long, y long, x long, pz double, py double, px double")
