"""Preprocessing tools over frames: spatial ones work within a row, temporal ones gather each frame's few neighbours."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velofield.functions import images as I

_H, _W = "height", "width"


def _changed(frames: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """Frames with f(pixels); pixels are computed once per row, also where tools follow each other."""
    return frames.withColumn("pixels", I.let(F.col("pixels"), f))


def _minus(frames: DataFrame, background: Callable[[Column], Column], weight: float) -> DataFrame:
    """Subtract a background; below zero is zero."""
    return _changed(frames, lambda px: F.zip_with(px, background(px), lambda v, b: F.greatest(v - weight * b, F.lit(0.0))))


def _window(offsets: list, reduce: Callable, border: str) -> Callable[[Column], Column]:
    return lambda px: I.stencil(px, F.col(_H), F.col(_W), offsets, reduce, border)


def sliding_median(frames: DataFrame, weight: float = 1.0, window_size: int = 30, border: str = "reflect") -> DataFrame:
    """Subtract the (upper) median of the window; below zero is zero."""
    offsets = I.square(window_size)
    return _minus(frames, _window(offsets, I.ranked(len(offsets) // 2), border), weight)


def sliding_percentile(frames: DataFrame, percentile: float = 10.0, weight: float = 1.0, window_size: int = 30, border: str = "reflect") -> DataFrame:
    """Subtract a percentile of the window; below zero is zero."""
    offsets = I.square(window_size)
    return _minus(frames, _window(offsets, I.ranked(I.rank_of_percentile(percentile, len(offsets))), border), weight)


def sliding_minima(frames: DataFrame, weight: float = 1.0, window_size: int = 30, border: str = "reflect") -> DataFrame:
    """Subtract the window's minimum; below zero is zero."""
    return _minus(frames, _window(I.square(window_size), F.array_min, border), weight)


def window_shape(window: int | tuple[int, ...] | None, n_frames: int) -> tuple[int, int, int]:
    """(frames, rows, columns) of a temporal window; one of a single frame raises."""
    if window is None:
        shape = (n_frames, 1, 1)
    elif isinstance(window, int):
        shape = (window, 1, 1)
    else:
        shape = (n_frames, *window) if len(window) == 2 else tuple(window)
    if shape[0] <= 1:
        raise ValueError("a temporal filter needs a window of several frames")
    return shape


def _temporal(frames: DataFrame, shape: tuple[int, int, int], reduce: Callable) -> DataFrame:
    """Each frame with the reduction of its window over time and space, reflected at all borders.

    A frame is sent to the few frames whose windows hold it: the work is in the number of frames times the window's length,
    and no task gathers a series.
    """
    n_t, n_y, n_x = shape
    bounds = frames.groupBy("series_id").agg(F.min("i").alias("_lo"), F.max("i").alias("_hi"))
    known = frames.join(F.broadcast(bounds), "series_id")
    n = F.col("_hi") - F.col("_lo") + 1
    at = F.explode(F.array(*[F.lit(d) for d in I.frame_offsets(n_t)])).alias("_d")
    centres = known.select("series_id", F.col("i").alias("_c"), "_lo", "_hi", at)
    wanted = centres.select("series_id", "_c", "_d", (F.col("_lo") + I.reflected(F.col("_c") + F.col("_d") - F.col("_lo"), n)).alias("i"))
    stacks = wanted.join(frames.select("series_id", "i", "pixels"), ["series_id", "i"]).groupBy("series_id", "_c").agg(F.collect_list("pixels").alias("_stack"))  # n_t frames
    joined = frames.join(stacks.withColumnRenamed("_c", "i"), ["series_id", "i"])
    offsets = I.square(n_y, n_x)
    spot = lambda stack: I.each_pixel(lambda p, iy, ix: reduce(F.flatten(F.transform(stack, lambda s: I.neighbours(s, F.col(_H), F.col(_W), iy, ix, offsets)))), F.col(_H), F.col(_W))
    return joined.withColumn("_b", I.let(F.col("_stack"), spot)).drop("_stack")


def _temporal_minus(frames: DataFrame, shape: tuple[int, int, int], reduce: Callable, weight: float) -> DataFrame:
    found = _temporal(frames, shape, reduce)
    return found.withColumn("pixels", F.zip_with("pixels", "_b", lambda v, b: v - weight * b)).drop("_b")


def temporal_median(frames: DataFrame, weight: float = 1.0, window: int | tuple = 3) -> DataFrame:
    """Subtract the (upper) median over a window in time; not clipped."""
    shape = window_shape(window, 0)
    return _temporal_minus(frames, shape, I.ranked(shape[0] * shape[1] * shape[2] // 2), weight)


def temporal_percentile(frames: DataFrame, percentile: float = 10.0, weight: float = 1.0, window: int | tuple = 3) -> DataFrame:
    """Subtract a percentile over a window in time; not clipped."""
    shape = window_shape(window, 0)
    return _temporal_minus(frames, shape, I.ranked(I.rank_of_percentile(percentile, shape[0] * shape[1] * shape[2])), weight)


def temporal_minima(frames: DataFrame, weight: float = 1.0, window: int | tuple = 3) -> DataFrame:
    """Subtract the minimum over a window in time; not clipped."""
    return _temporal_minus(frames, window_shape(window, 0), F.array_min, weight)


def global_threshold(frames: DataFrame, minima: float = 0.0, maxima: float | None = None) -> DataFrame:
    """Move pixels into minima ... maxima; without a maximum, that of the frame's type."""
    high = F.lit(float(maxima)) if maxima is not None else F.when(F.col("dtype") == "uint8", 255.0).when(F.col("dtype") == "uint16", 65535.0).otherwise(F.lit(float("inf")))
    return _changed(frames, lambda px: F.transform(px, lambda v: F.least(F.greatest(v, F.lit(float(minima))), high)))


def threshold_to_zero(frames: DataFrame, minima: float = 0.0, maxima: float = 65535.0) -> DataFrame:
    """Cut pixels at the maximum; those at or below the minimum are zero."""
    cut = lambda v: F.least(v, F.lit(float(maxima)))
    return _changed(frames, lambda px: F.transform(px, lambda v: F.when(cut(v) > minima, cut(v)).otherwise(0.0)))


def _bounds(px: Column) -> Column:
    return F.struct(F.array_min(px).alias("low"), F.array_max(px).alias("high"))


def rescale_intensity(frames: DataFrame, minima: float = 0.0, maxima: float = 4096.0) -> DataFrame:
    """Stretch each frame's range to minima ... maxima; a constant frame becomes the minimum."""
    stretch = lambda v, b: F.when(b["high"] > b["low"], (v - b["low"]) / (b["high"] - b["low"]) * (maxima - minima) + minima).otherwise(float(minima))
    return _changed(frames, lambda px: I.let(_bounds(px), lambda b: F.transform(px, lambda v: stretch(v, b))))


def rescale_intensity_tanh(frames: DataFrame, threshold: float | None = None) -> DataFrame:
    """Compress by tanh (by default twice the root mean square is the scale), stretched to the frame's maximum, whole numbers.

    Quotients are rounded to nine digits before they are cut, so a whole number isn't missed by the last bit.
    """
    scale = lambda px: F.lit(float(threshold)) if threshold is not None else 2 * F.sqrt(I.mean(F.transform(px, lambda v: v * v)))
    bent = lambda px: I.let(scale(px), lambda s: F.transform(px, lambda v: F.tanh(v / s)))
    ratio = lambda px, t: F.array_max(px) / F.array_max(t)
    return _changed(frames, lambda px: I.let(bent(px), lambda t: I.let(ratio(px, t), lambda r: F.transform(t, lambda x: F.floor(F.round(r * x, 9)).cast("double")))))


def gamma_correction(frames: DataFrame, gamma: float = 1.0, gain: float = 1.0, scale: float = 1.0) -> DataFrame:
    """gain * scale * (v / scale) ** gamma, scale the range of the frame's type."""
    return _changed(frames, lambda px: F.transform(px, lambda v: F.pow(v / scale, F.lit(float(gamma))) * scale * gain))


def to_byte(frames: DataFrame) -> DataFrame:
    """Stretch each frame to 255 and round half to even."""
    return _changed(frames, lambda px: I.let(F.array_max(px), lambda m: F.transform(px, lambda v: F.rint(v * 255 / m))))


def equalize_global(frames: DataFrame, bins: int = 256) -> DataFrame:
    """Replace pixels by the cumulative distribution of the frame's histogram, linear between bin centres; a constant frame becomes 1."""
    step = lambda b: (b["high"] - b["low"]) / bins
    bin_of = lambda v, b: F.least(F.floor((v - b["low"]) / step(b)), F.lit(bins - 1)).cast("int")
    shares = lambda codes: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.size(F.filter(codes, lambda c: c <= k)) / F.size(codes))
    place = lambda v, b: F.least(F.greatest((v - b["low"]) / step(b) - 0.5, F.lit(0.0)), F.lit(bins - 1.0))
    under = lambda p: F.least(F.floor(p), F.lit(bins - 2)).cast("int")
    value = lambda p, cdf: F.element_at(cdf, under(p) + 1) + (p - under(p)) * (F.element_at(cdf, under(p) + 2) - F.element_at(cdf, under(p) + 1))

    def equalised(px: Column, b: Column) -> Column:
        cdf = I.let(F.transform(px, lambda v: bin_of(v, b)), shares)
        return I.let(cdf, lambda c: F.transform(px, lambda v: value(place(v, b), c)))

    return _changed(frames, lambda px: I.let(_bounds(px), lambda b: F.when(b["high"] > b["low"], equalised(px, b)).otherwise(F.transform(px, lambda v: F.lit(1.0)))))


def equalize_local(frames: DataFrame, radius: int = 10) -> DataFrame:
    """The share of a disk's pixels, inside the image, that aren't above the pixel."""
    offsets = I.disk(radius)
    share = lambda near, own: F.size(F.filter(near, lambda v: v <= own)) / F.size(near)
    spot = lambda px: I.each_pixel(lambda p, iy, ix: I.let(I.neighbours(px, F.col(_H), F.col(_W), iy, ix, offsets, None), lambda near: share(near, F.element_at(px, p + 1))), F.col(_H), F.col(_W))
    return _changed(frames, spot)


def equalize_adaptive(frames: DataFrame, tiles: int = 4, clip: float = 0.01, bins: int = 64) -> DataFrame:
    """Contrast-limited equalisation: each tile's clipped, redistributed histogram maps values; maps are blended between tile centres.

    Values are scaled to 0 ... 1 by the frame's range and back. NumPy per row, in batches.
    """
    import numpy as np

    def equalise(image: np.ndarray) -> np.ndarray:
        low, high = image.min(), image.max()
        if high <= low:
            return image
        unit = (image - low) / (high - low)
        code = np.minimum((unit * bins).astype(int), bins - 1)
        rows, columns = (np.linspace(0, n, tiles + 1).astype(int) for n in image.shape)
        maps = np.zeros((tiles, tiles, bins))
        for a in range(tiles):
            for b in range(tiles):
                part = code[rows[a] : max(rows[a + 1], rows[a] + 1), columns[b] : max(columns[b + 1], columns[b] + 1)]
                count = np.bincount(part.ravel(), minlength=bins).astype(float)
                most = max(1.0, clip * part.size)
                extra = np.maximum(count - most, 0).sum()
                maps[a, b] = np.cumsum(np.minimum(count, most) + extra / bins) / part.size
        y, x = (np.clip((np.arange(n) + 0.5) / n * tiles - 0.5, 0, tiles - 1) for n in image.shape)
        y0, x0 = np.minimum(y.astype(int), tiles - 2 if tiles > 1 else 0), np.minimum(x.astype(int), tiles - 2 if tiles > 1 else 0)
        y1, x1 = np.minimum(y0 + 1, tiles - 1), np.minimum(x0 + 1, tiles - 1)
        fy, fx = (y - y0)[:, None], (x - x0)[None, :]
        pick = lambda a, b: maps[a[:, None], b[None, :], code]
        out = (1 - fy) * ((1 - fx) * pick(y0, x0) + fx * pick(y0, x1)) + fy * ((1 - fx) * pick(y1, x0) + fx * pick(y1, x1))
        return out * (high - low) + low

    def run(parts):
        for part in parts:
            part["pixels"] = [equalise(np.asarray(v).reshape(h, w)).ravel() for v, h, w in zip(part["pixels"], part["height"], part["width"], strict=True)]
            yield part

    return frames.mapInPandas(run, frames.schema)


def _blur(sigma: float, truncate: float = 4.0, border: str = "reflect") -> Callable[[Column], Column]:
    return lambda px: I.weighted(px, F.col(_H), F.col(_W), I.gaussian_weights(sigma, truncate), border)


def gaussian_filter(frames: DataFrame, sigma: float, truncate: float = 4.0, border: str = "reflect") -> DataFrame:
    """A Gaussian blur, along the columns and then the rows."""
    return _changed(frames, _blur(sigma, truncate, border))


def sharpen(frames: DataFrame, sigma1: float = 3.0, sigma2: float = 1.0, alpha: float = 30.0) -> DataFrame:
    """Blur by sigma1, then add alpha times what a second blur by sigma2 takes away."""
    return _changed(frames, lambda px: I.let(_blur(sigma1)(px), lambda once: F.zip_with(once, _blur(sigma2)(once), lambda b, g: b + alpha * (b - g))))


def adaptive_threshold(frames: DataFrame, window_size: int = 5, offset: float = 0.0, binary: bool = False, maximum: float = 255.0) -> DataFrame:
    """The local Gaussian mean minus an offset or, ``binary``, the maximum where a pixel is above it and else zero."""
    local = _blur((window_size - 1) / 6.0)
    if binary:
        return _changed(frames, lambda px: F.zip_with(px, local(px), lambda v, t: F.when(v > t - offset, maximum).otherwise(0.0)))
    return _changed(frames, lambda px: F.transform(local(px), lambda t: t - offset))


#: The tools by name, with the defaults of their signatures.
TOOLS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f for f in (sliding_median, sliding_percentile, sliding_minima, temporal_median, temporal_percentile, temporal_minima, global_threshold, threshold_to_zero, rescale_intensity, rescale_intensity_tanh, gamma_correction, to_byte, equalize_global, equalize_local, equalize_adaptive, gaussian_filter, sharpen, adaptive_threshold)
}


def default_params(tool: str) -> dict:
    """A tool's parameters and their defaults."""
    return {n: p.default for n, p in inspect.signature(TOOLS[tool]).parameters.items() if n != "frames"}


def preprocess(frames: DataFrame, tools: list[tuple[str, dict]]) -> DataFrame:
    """Apply tools in their order; unknown names raise."""
    for name, params in tools:
        if name not in TOOLS:
            raise AttributeError(f"no tool {name}")
        frames = TOOLS[name](frames, **params)
    return frames
