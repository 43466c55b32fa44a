"""Grids of interrogation windows, crops and coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def round_half_even(x: float) -> int:
    return round(x)


def nodes(length: int, size: int, overlap: float = 0.5) -> list[int]:
    """The centres of windows of ``size`` along an axis; a last one at the end if much of the image would be left out."""
    step = size - round_half_even(overlap * size)
    if step < 1:
        raise ValueError("the overlap leaves no step between windows")
    start, stop = size // 2, size // 2 + size % 2
    found = list(range(start, length - stop, step))
    if found and (length - stop) - found[-1] > step // 2.5:
        found.append(length - stop)
    return found


def vector_grid(spark: SparkSession, height: int, width: int, size: int | tuple[int, int], overlap: float = 0.5) -> DataFrame:
    """The nodes of a grid: ivec, iyvec, ixvec, row by row. A few numbers from parameters, made by the driver's plan."""
    size_y, size_x = (size, size) if isinstance(size, int) else size
    ys, xs = nodes(height, size_y, overlap), nodes(width, size_x, overlap)
    base = spark.range(1).select(F.posexplode(F.array(*[F.lit(y) for y in ys])).alias("_ky", "iyvec"))
    both = base.select("_ky", "iyvec", F.posexplode(F.array(*[F.lit(x) for x in xs])).alias("_kx", "ixvec"))
    return both.select((F.col("_ky") * len(xs) + F.col("_kx")).alias("ivec"), "iyvec", "ixvec")


def later_positions(vectors: DataFrame, height: int, width: int) -> DataFrame:
    """Where to crop both images for nodes with a rounded displacement (dx_input, dy_input): ix0, iy0, ix1, iy1, x, y.

    Half of the displacement moves the first window back. A second window outside the image stays at its node and the first
    one takes all; else, a first window outside stays and the second one takes all.
    """
    out = vectors
    for axis, length in (("x", width), ("y", height)):
        node, d = F.col(f"i{axis}vec"), F.col(f"d{axis}_input")
        first = node - F.floor(d / 2)
        second = first + d
        beyond = lambda c, n=length: (c > n) | (c < 0)
        chosen = F.when(beyond(second), node - d).when(beyond(first), node).otherwise(first)
        out = out.withColumn(f"i{axis}0", chosen.cast("int")).withColumn(f"i{axis}1", (F.col(f"i{axis}0") + d).cast("int"))
        out = out.withColumn(axis, (F.col(f"i{axis}0") + F.col(f"i{axis}1")) / 2)
    return out


def parse_crop(text: str | None) -> tuple[tuple[int | None, int | None], tuple[int | None, int | None]]:
    """``100:600, :`` as ((first row, row after the last), (the same for columns)); empty sides are open."""
    if not text:
        return (None, None), (None, None)
    parts = []
    for side in text.split(","):
        a, _, b = side.strip().partition(":")
        parts.append((int(a) if a.strip() else None, int(b) if b.strip() else None))
    return (parts[0], parts[1] if len(parts) > 1 else (None, None))


def crop(frames: DataFrame, text: str | None) -> DataFrame:
    """Frames cut to a crop mask; y0 and x0 hold the mask's corner."""
    (y0, y1), (x0, x1) = parse_crop(text)
    top, left = y0 or 0, x0 or 0
    bottom = F.col("height") if y1 is None else F.least(F.col("height"), F.lit(y1))
    right = F.col("width") if x1 is None else F.least(F.col("width"), F.lit(x1))
    rows = F.transform(F.sequence(F.lit(top), bottom - 1), lambda y: F.slice("pixels", y * F.col("width") + left + 1, right - left))
    return frames.withColumn("pixels", F.flatten(rows)).withColumn("height", (bottom - top).cast("int")).withColumn("width", (right - left).cast("int")).withColumn("y0", F.lit(top)).withColumn("x0", F.lit(left))


def to_original(axis: Column, corner: Column | int) -> Column:
    """A coordinate in the crop as one in the image."""
    return axis + corner


def to_masked(axis: Column, corner: Column | int) -> Column:
    return axis - corner


def pad(frames: DataFrame, npad: int) -> DataFrame:
    """Subtract each frame's minimum and put ``npad`` zeros on all sides."""
    from velofield.functions.images import let

    h, w = F.col("height"), F.col("width")
    side, blank = F.array_repeat(F.lit(0.0), npad), F.array_repeat(F.lit(0.0), ((w + 2 * npad) * npad).cast("int"))
    row = lambda px, low, y: F.concat(side, F.transform(F.slice(px, y * w + 1, w), lambda v: v - low), side)
    body = lambda px, low: F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda y: row(px, low, y)))
    pixels = let(F.col("pixels"), lambda px: let(F.array_min(px), lambda low: F.concat(blank, body(px, low), blank)))
    return frames.withColumn("pixels", pixels).withColumn("height", h + 2 * npad).withColumn("width", w + 2 * npad)


def displacement_limit(value: float | str | None, shape: tuple[int, int]) -> float | None:
    """A largest displacement in pixels; ``50%`` is a share of the longer side."""
    if isinstance(value, str):
        return float(value.rstrip("% ")) / 100 * max(shape)
    return None if value is None else float(value)


def crop_sizes(size: int | tuple[int, int], coeff_zoom: int | tuple[int, ...], number: int) -> list[tuple[int, int]]:
    """The window of every pass."""
    shape = (size, size) if isinstance(size, int) else tuple(size)
    zooms = (coeff_zoom,) * (number - 1) if isinstance(coeff_zoom, int) else tuple(coeff_zoom)
    if len(zooms) != number - 1:
        raise ValueError("coeff_zoom needs a number for every pass after the first")
    sizes = [shape]
    for zoom in zooms:
        sizes.append(tuple(int(s / zoom) for s in sizes[-1]))
    return sizes


def reshape(vectors: DataFrame, key: str = "key") -> DataFrame:
    """Add ix and iy, the ranks of x and y in each field, to flat vectors, whatever their order."""
    from pyspark.sql import Window as W

    return vectors.withColumn("ix", (F.dense_rank().over(W.partitionBy(key).orderBy("x")) - 1).cast("int")).withColumn("iy", (F.dense_rank().over(W.partitionBy(key).orderBy("y")) - 1).cast("int"))


def regular_step(values: list[float], tolerance: float = 1e-5) -> float | None:
    """The step of a regular axis, None for another one."""
    if len(values) < 2:
        return None
    step = values[1] - values[0]
    return step if all(math.isclose(b - a, step, rel_tol=tolerance, abs_tol=1e-8) for a, b in zip(values, values[1:], strict=False)) else None
