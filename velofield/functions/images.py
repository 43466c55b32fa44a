"""Column functions over row-major images in arrays: every one works within a row, so none shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once per row, however often f uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def whole(x: Column, n: Column | int) -> Column:
    """Integer quotient of numbers that aren't negative."""
    return F.floor(x / n).cast("int")


def reflected(k: Column, n: Column) -> Column:
    """An index mirrored into 0 ... n - 1, the border pixel twice; for any distance."""
    m = F.pmod(k, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def clamped(k: Column, n: Column) -> Column:
    """An index moved to the nearest one of 0 ... n - 1."""
    return F.least(F.greatest(k, F.lit(0)), n - 1)


def cyclic(k: Column, n: Column) -> Column:
    return F.pmod(k, n)


BORDERS: dict[str, Callable[[Column, Column], Column]] = {"reflect": reflected, "nearest": clamped, "wrap": cyclic}


def frame_offsets(size: int) -> range:
    """The places of a window of ``size`` around its pixel; an even window has one more before it than after it."""
    return range(-(size // 2), size - size // 2)


def square(height: int, width: int | None = None) -> list[tuple[int, int]]:
    """The (dy, dx) of a rectangular window."""
    return [(dy, dx) for dy in frame_offsets(height) for dx in frame_offsets(height if width is None else width)]


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def each_pixel(f: Callable[[Column, Column, Column], Column], height: Column, width: Column) -> Column:
    """The array of f(position, iy, ix) over all pixels."""
    return F.transform(F.sequence(F.lit(0), height * width - 1), lambda p: f(p, whole(p, width), p % width))


def neighbours(pixels: Column, height: Column, width: Column, iy: Column, ix: Column, offsets: list[tuple[int, int]], border: str | None = "reflect") -> Column:
    """The pixels at the offsets around one; without a border rule those outside are left out."""
    at = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    if border is None:
        inside = F.filter(at, lambda o: (iy + o["dy"]).between(F.lit(0), height - 1) & (ix + o["dx"]).between(F.lit(0), width - 1))
        return F.transform(inside, lambda o: F.element_at(pixels, (iy + o["dy"]) * width + ix + o["dx"] + 1))
    place = BORDERS[border]
    return F.transform(at, lambda o: F.element_at(pixels, (place(iy + o["dy"], height) * width + place(ix + o["dx"], width) + 1).cast("int")))


def stencil(pixels: Column, height: Column, width: Column, offsets: list[tuple[int, int]], reduce: Callable[[Column], Column], border: str | None = "reflect") -> Column:
    """Reduce the window around every pixel."""
    return each_pixel(lambda p, iy, ix: reduce(neighbours(pixels, height, width, iy, ix, offsets, border)), height, width)


def ranked(rank: int) -> Callable[[Column], Column]:
    """The value of a rank (from 0) in a window."""
    return lambda values: F.element_at(F.array_sort(values), rank + 1)


def rank_of_percentile(percentile: float, n: int) -> int:
    return n - 1 if percentile >= 100 else int(n * percentile / 100)


def weighted(pixels: Column, height: Column, width: Column, weights: list[float], border: str = "reflect") -> Column:
    """A separable weighted sum: down the columns, then along the rows."""
    half = len(weights) // 2
    place = BORDERS[border]
    table = F.array(*[F.struct(F.lit(k - half).alias("k"), F.lit(float(w)).alias("w")) for k, w in enumerate(weights)])
    spot = lambda px, row, column: F.element_at(px, (row * width + column + 1).cast("int"))
    down = lambda px: each_pixel(lambda p, iy, ix: total(F.transform(table, lambda o: o["w"] * spot(px, place(iy + o["k"], height), ix))), height, width)
    along = lambda px: each_pixel(lambda p, iy, ix: total(F.transform(table, lambda o: o["w"] * spot(px, iy, place(ix + o["k"], width)))), height, width)
    return let(pixels, lambda px: let(down(px), along))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised samples of a Gaussian out to ``truncate`` standard deviations."""
    import math

    half = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)
