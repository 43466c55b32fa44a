"""Correlation maps, their peaks and sub-pixel positions as column functions over small windows held in arrays.

A map of a window of n0 x n1 pixels has the displacement (dx, dy) = (n1 // 2 - 1 - ix, n0 // 2 - 1 - iy) at (iy, ix).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from velofield.functions.images import let, total
from velofield.functions.kernels import correlate_fft


def window(pixels: Column, width: Column | int, y0: Column, x0: Column, height: int, across: int) -> Column:
    """A window cut out of an image."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(height - 1)), lambda y: F.slice(pixels, (y0 + y) * width + x0 + 1, across)))


def centred(a: Column) -> Column:
    return let(a, lambda x: let(total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean)))


def energy(a: Column) -> Column:
    return total(F.transform(a, lambda v: v * v))


def _normalised(a: Column, b: Column, raw, share: int, digits: int) -> Column:
    """raw(a, b), an array, by the windows' norms; 0 where a window is constant. Each window is computed once."""
    both = F.struct(a.alias("a"), b.alias("b"))
    norm = lambda s: F.sqrt(energy(s["a"]) * energy(s["b"])) / share
    return let(both, lambda s: let(norm(s), lambda n: F.transform(raw(s["a"], s["b"]), lambda c: F.when(n > 0, F.round(c / n, digits) + 0.0).otherwise(0.0))))


def circular(a: Column, b: Column, height: int, width: int, digits: int = 6) -> Column:
    """Normalised circular cross-correlation of two centred windows; 0 where a window is constant."""
    places = F.sequence(F.lit(0), F.lit(height * width - 1))

    def at(a: Column, b: Column, k: Column) -> Column:
        dy, dx = height // 2 - 1 - F.floor(k / width), width // 2 - 1 - k % width
        moved = lambda p: (F.pmod(F.floor(p / width) + dy, F.lit(height)) * width + F.pmod(p % width + dx, F.lit(width)) + 1).cast("int")
        return total(F.transform(places, lambda p: F.element_at(a, p + 1) * F.element_at(b, moved(p))))

    return _normalised(a, b, lambda x, y: F.transform(places, lambda k: at(x, y, k)), 1, digits)


def with_circular(rows: DataFrame, a: str, b: str, height: int, width: int, name: str = "corr", digits: int = 6) -> DataFrame:
    """Add the map that ``circular`` gives for windows in columns ``a`` and ``b``, centred or not, instead of these.

    All windows of an Arrow batch go through one Fourier transform; column functions cost the square of a window's pixels.
    Null where a window is null or of another size; values that aren't numbers are null in the map.
    """
    kept = [f for f in rows.schema if f.name not in (a, b)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in parts:
            out = pd.Series([None] * len(t), dtype=object, index=t.index)
            whole = [k for k, (p, q) in enumerate(zip(t[a], t[b], strict=True)) if p is not None and q is not None and len(p) == len(q) == height * width]
            if whole:
                p, q = (np.stack([t[c].iloc[k] for k in whole]).astype(float).reshape(-1, height, width) for c in (a, b))
                for k, c in zip(whole, np.round(correlate_fft(p, q).reshape(len(whole), -1), digits) + 0.0, strict=True):
                    out.iloc[k] = [None if v != v else v for v in c.tolist()]
            yield t[[f.name for f in kept]].assign(**{name: out})

    return rows.mapInPandas(run, StructType([*kept, StructField(name, ArrayType(DoubleType()))]))


def direct(a: Column, b: Column, height: int, width: int, disp_max: int, digits: int = 6) -> Column:
    """Mean product over the overlap for displacements up to ``disp_max``, by the geometric mean of the mean squares."""
    side = 2 * disp_max + 1

    def at(a: Column, b: Column, k: Column) -> Column:
        dy, dx = disp_max - F.floor(k / side), disp_max - k % side
        cells = F.filter(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda p: (F.floor(p / width) + dy).between(F.lit(0), F.lit(height - 1)) & (p % width + dx).between(F.lit(0), F.lit(width - 1)))
        mean = lambda c: total(F.transform(c, lambda p: F.element_at(a, p + 1) * F.element_at(b, (p + dy * width + dx + 1).cast("int")))) / F.size(c)
        return let(cells, mean)

    return _normalised(a, b, lambda x, y: F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: at(x, y, k)), height * width, digits)


def peak(corr: Column, height: int, width: int, displacement_max: float | None = None, blanked: list[Column] | None = None, radius: int = 3) -> Column:
    """The highest point (c, pos), the last of equal ones; points beyond the limit or near earlier peaks are left out."""
    points = F.transform(corr, lambda c, k: F.struct(c.alias("c"), k.alias("pos")))
    if displacement_max is not None:
        dx, dy = lambda p: width // 2 - 1 - p["pos"] % width, lambda p: height // 2 - 1 - F.floor(p["pos"] / width)
        points = F.filter(points, lambda p: dx(p) * dx(p) + dy(p) * dy(p) <= displacement_max * displacement_max)
    for other in blanked or []:
        points = F.filter(points, _away_from(other, width, radius))
    return F.array_max(F.filter(points, lambda p: p["c"].isNotNull()))


def _away_from(other: Column, width: int, radius: int):
    """Whether a point is further than ``radius`` from another one, along rows or columns."""
    return lambda p: (F.abs(p["pos"] % width - other["pos"] % width) > radius) | (F.abs(F.floor(p["pos"] / width) - F.floor(other["pos"] / width)) > radius)


def on_border(pos: Column, height: int, width: int) -> Column:
    iy, ix = F.floor(pos / width), pos % width
    return (iy == 0) | (iy == height - 1) | (ix == 0) | (ix == width - 1)


def displacement_of(pos: Column, height: int, width: int) -> tuple[Column, Column]:
    return width // 2 - 1 - pos % width, height // 2 - 1 - F.floor(pos / width)


def position_of(dx: Column, dy: Column, height: int, width: int) -> Column:
    return (height // 2 - 1 - dy) * width + width // 2 - 1 - dx


def around(corr: Column, pos: Column, width: int, n: int = 1) -> Column:
    """The (2n + 1)^2 values around a point that isn't near the border."""
    side = 2 * n + 1
    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.element_at(corr, (pos + (F.floor(k / side) - n) * width + k % side - n + 1).cast("int")))


def _moment(values: Column, weights: list[float]) -> Column:
    return total(F.zip_with(values, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w))


def centroid(near: Column, n: int = 1) -> Column:
    """(x, y) of the centre of mass of the values around a peak."""
    r = range(-n, n + 1)
    return F.struct(F.try_divide(_moment(near, [x for _ in r for x in r]), total(near)).alias("x"), F.try_divide(_moment(near, [y for y in r for _ in r]), total(near)).alias("y"))


def gaussian_closed(near: Column) -> Column:
    """(x, y) of a Gaussian through 3 x 3 values, from moments of their logarithms.

    The least value is taken off and the rest divided by the largest; zeros become 1e-8.
    """
    cells = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1)]
    terms = {
        "c10": [x / 6 for y, x in cells], "c01": [y / 6 for y, x in cells], "c11": [x * y / 4 for y, x in cells],
        "c20": [(3 * x * x - 2) / 6 for y, x in cells], "c02": [(3 * y * y - 2) / 6 for y, x in cells],
    }
    bounds = lambda v: F.struct(F.array_min(v).alias("low"), (F.array_max(v) - F.array_min(v)).alias("high"))
    unit = lambda x, b: F.try_divide(x - b["low"], b["high"])
    logs = lambda v: let(bounds(v), lambda b: F.transform(v, lambda x: F.ln(F.when(unit(x, b) == 0, 1e-8).otherwise(unit(x, b)))))
    moments = lambda g: F.struct(*[_moment(g, w).alias(n) for n, w in terms.items()])

    def place(m: Column) -> Column:
        down = 4 * m["c20"] * m["c02"] - m["c11"] * m["c11"]
        return F.struct(F.try_divide(m["c11"] * m["c01"] - 2 * m["c10"] * m["c02"], down).alias("x"), F.try_divide(m["c11"] * m["c10"] - 2 * m["c01"] * m["c20"], down).alias("y"))

    return let(near, lambda v: let(let(logs(v), moments), place))


def gaussian_fit(near: Column, n: int = 1) -> Column:
    """(x, y) of a Gaussian fitted to the logarithms by least squares; null where the fit has no maximum."""
    r = np.arange(-n, n + 1.0)
    x, y = (v.ravel() for v in np.meshgrid(r, r))
    fit = np.linalg.pinv(np.stack([x * x, y * y, x, y, np.ones(len(x))], 1))
    logs = F.transform(near, lambda v: F.ln(F.greatest(v, F.lit(1e-6))))
    a, b, c, d = (_moment(logs, [float(w) for w in fit[k]]) for k in range(4))
    bent = (a < 0) & (b < 0)
    return F.struct(F.when(bent, F.try_divide(c, -2 * a)).alias("x"), F.when(bent, F.try_divide(d, -2 * b)).alias("y"))


def subpixel(corr: Column, pos: Column, height: int, width: int, method: str = "2d_gaussian2", n: int = 1) -> Column:
    """(x, y) to add to a peak's place in the map; a result too far away falls back to the centroid, and then to null."""
    iy, ix = F.floor(pos / width), pos % width
    inside = (iy >= n) & (iy + n < height) & (ix >= n) & (ix + n < width)
    if method == "no_subpix":
        return F.when(inside, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    near = around(corr, pos, width, n)
    middle = lambda: centroid(near, n)
    first = {"2d_gaussian2": lambda: gaussian_closed(around(corr, pos, width, 1)), "2d_gaussian": lambda: gaussian_fit(near, n), "centroid": middle}[method]
    fits = lambda s: s["x"].isNotNull() & s["y"].isNotNull() & (s["x"] * s["x"] + s["y"] * s["y"] <= 2 * (0.5 + n) ** 2)
    return F.when(inside, let(first(), lambda s: F.when(fits(s), s).otherwise(let(middle(), lambda m: F.when(fits(m), m)))))
