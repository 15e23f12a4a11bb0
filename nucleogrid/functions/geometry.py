"""Expressions on coordinates and boxes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

AXES = ("z", "y", "x")


def rescaled(z: Column, chunk_start: Column, ratio: float, trunc_offset: bool = True) -> Column:
    """A coordinate in segmentation slices, in raw slices; the chunk's own start is truncated first by default."""
    start = chunk_start * ratio
    return z * ratio + (start.cast("long") if trunc_offset else start)


def voxel_rounded(c: Column, ratio: float) -> Column:
    """Raster index: half to even, never below 0."""
    return F.rint(F.greatest(c * ratio, F.lit(0.0))).cast("long")


def voxel_truncated(c: Column, size: int) -> Column:
    """Raster index: clamped into the raster, then truncated."""
    return F.floor(F.least(F.greatest(c.cast("double"), F.lit(0.0)), F.lit(size - 0.9))).cast("long")


def hashed_uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on key and seed only: 32 bits of an md5."""
    name = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0


def voxel_stochastic(c: Column, key: Column, seed: int = 0) -> Column:
    """Raster index after adding a uniform number that depends on key and seed only."""
    return F.floor(c + hashed_uniform(key, seed)).cast("long")


def ravel(indices: list[Column], shape: list[int]) -> Column:
    """Row-major linear index."""
    out = F.lit(0).cast("long")
    for i, n in zip(indices, shape, strict=True):
        out = out * n + i
    return out.cast("long")


def unravel(index: Column, shape: list[int]) -> list[Column]:
    out, rest = [], index
    for n in reversed(shape):
        out.append(F.pmod(rest, F.lit(n)).cast("long"))
        rest = F.floor(rest / n)
    return out[::-1]


def flipped(c: Column, size: int) -> Column:
    """A 1-based coordinate counted from the other end."""
    return F.lit(size) - c + 1


def centre(low: Column, high: Column) -> Column:
    return (low + high) / 2


def box_volume(p: str = "") -> Column:
    return (F.col(f"{p}z1") - F.col(f"{p}z0")) * (F.col(f"{p}y1") - F.col(f"{p}y0")) * (F.col(f"{p}x1") - F.col(f"{p}x0"))


def box_overlap(a: str, b: str) -> Column:
    """Shared volume of two boxes with column prefixes a and b; not positive unless they overlap on each axis."""
    out = F.lit(1)
    for k in AXES:
        out = out * F.greatest(F.least(F.col(f"{a}{k}1"), F.col(f"{b}{k}1")) - F.greatest(F.col(f"{a}{k}0"), F.col(f"{b}{k}0")), F.lit(0))
    return out


def axis_ratios(lengths: Column) -> list[Column]:
    """Longest over second and over third axis; denominators of at least 0.001."""
    s = F.sort_array(lengths, asc=False)
    return [F.element_at(s, 1) / F.greatest(F.element_at(s, k), F.lit(1e-3)) for k in (2, 3)]


def tile_name(x: Column, y: Column) -> Column:
    return F.format_string("UltraII[%02d x %02d]", x.cast("int"), y.cast("int"))


def humanised(n: Column) -> Column:
    """Billions, millions or thousands with two decimals."""
    f = lambda d, u: F.format_string("%.2f" + u, n / float(d))
    return F.when(n >= 10**9, f(10**9, "B")).when(n >= 10**6, f(10**6, "M")).when(n >= 1000, f(1000, "K")).otherwise(n.cast("string"))


def window(c: Column, size: int) -> tuple[Column, Column]:
    """Half-open bounds of a patch of ``size`` around a centre."""
    return c - size // 2, c + (size + 1) // 2


def equivalent_radius(volume: Column) -> Column:
    """Radius of the ball of a volume, truncated."""
    return F.pow(volume * 0.75 / F.pi(), F.lit(1.0 / 3)).cast("long")


def box_wkt() -> Column:
    """A box (z0 ... x1) as a polygon text of two rings, its lowest and its highest slice."""
    ring = lambda z: F.concat_ws(", ", *(F.concat_ws(" ", x, y, z) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))))
    return F.concat(F.lit("POLYGON Z (("), ring("z0"), F.lit("), ("), ring("z1"), F.lit("))"))
