"""Surface tracking: phases of fringe images in time and their heights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def normalise(frames: DataFrame) -> DataFrame:
    """Divide each row of a frame by its mean, then take the frame's mean off; rows of mean zero become zero."""
    from velofield.functions.images import each_pixel, let, mean

    h, w = F.col("height"), F.col("width")
    means = lambda px: F.transform(F.sequence(F.lit(0), h - 1), lambda y: mean(F.slice(px, y * w + 1, w)))
    ratio = lambda px, m: each_pixel(lambda p, iy, ix: F.coalesce(F.try_divide(F.element_at(px, p + 1), F.element_at(m, iy + 1)), F.lit(0.0)), h, w)
    level = lambda r: let(mean(r), lambda g: F.transform(r, lambda v: v - g))
    return frames.withColumn("pixels", let(F.col("pixels"), lambda px: let(let(means(px), lambda m: ratio(px, m)), level)))


def turns(jump: Column) -> Column:
    """Whole turns to add after a jump of more than half a turn."""
    return F.when(F.abs(jump) > math.pi, -F.signum(jump) * F.ceil((F.abs(jump) - math.pi) / (2 * math.pi))).otherwise(0.0)


def continuous(phases: DataFrame, by: str | None = None, order: str = "t", phase: str = "phase") -> DataFrame:
    """Add ``corrected``: the phase without jumps from one time to the next, by a running sum of turns.

    One value per time (the reference pixel's); a series' values are summed in order, as the chain is sequential.
    """
    window = W.partitionBy(by) if by else W.partitionBy(F.lit(0))
    steps = phases.withColumn("_k", turns(F.col(phase) - F.lag(phase).over(window.orderBy(order))))
    return steps.withColumn("corrected", F.col(phase) + 2 * math.pi * F.coalesce(F.sum("_k").over(window.orderBy(order).rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))).drop("_k")


def continuous_frames(frames: DataFrame, row: int, column: int) -> DataFrame:
    """Frames of phases moved by whole turns, so that a reference pixel has no jumps in time; only its values are chained."""
    at = F.element_at("pixels", (F.lit(row) * F.col("width") + column + 1).cast("int"))
    chain = continuous(frames.select("series_id", "i", at.alias("phase")), "series_id", "i").select("series_id", "i", (F.col("corrected") - F.col("phase")).alias("_shift"))
    return frames.join(chain, ["series_id", "i"]).withColumn("pixels", F.transform("pixels", lambda v: v + F.col("_shift"))).drop("_shift")


def height_of(phase: Column, distance: float, distance_pc: float, wave_length: float) -> Column:
    """Height from a phase by the projection's geometry; null where it has none."""
    return F.try_divide(phase * distance, phase - 2 * math.pi / wave_length * distance_pc)


def borders(frames: DataFrame, threshold: float) -> DataFrame:
    """Medians over rows of the first and last pixel above a threshold: i, left, right, and the first and last such rows."""
    w = F.col("width")
    long = frames.select("i", "width", F.posexplode("pixels").alias("p", "v")).where(F.col("v") > threshold)
    rows = long.groupBy("i", F.floor(F.col("p") / w).alias("iy")).agg(F.min(F.col("p") % w).alias("a"), F.max(F.col("p") % w).alias("b"))
    return rows.groupBy("i").agg(F.median("a").alias("left"), F.median("b").alias("right"), F.min("iy").alias("top"), F.max("iy").alias("bottom"))


def merge(frames: DataFrame, reference: DataFrame, threshold: float) -> DataFrame:
    """Frames with the reference's pixels where they aren't above a threshold; the reference isn't changed."""
    one = reference.limit(1).select(F.col("pixels").alias("_ref"))  # one frame for every task
    return frames.crossJoin(F.broadcast(one)).withColumn("pixels", F.zip_with("pixels", "_ref", lambda v, r: F.when(v > threshold, v).otherwise(r))).drop("_ref")


def unwrapped(values: Column) -> Column:
    """A line of phases without jumps of more than half a turn."""
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("add"))

    def step(s: Column, v: Column) -> Column:
        add = s["add"] + F.coalesce(turns(v - s["last"]), F.lit(0.0)) * 2 * math.pi
        return F.struct(F.array_append(s["out"], v + add).alias("out"), v.alias("last"), add.alias("add"))

    return F.aggregate(values, start, step, lambda s: s["out"])


def wave_vector(reference: np.ndarray, sur: int) -> float:
    """Wave number across the fringes of a mean reference: the strongest column of a zero-padded transform."""
    height, width = reference.shape
    power = np.abs(np.fft.fftshift(np.fft.fft2(reference, (height * sur, width * sur)))).max(axis=0)
    return float(abs((np.arange(width * sur) - width * sur / 2)[power.argmax()] / sur))


def demodulation(shape: tuple[int, int], k_x: float, slicer: float) -> tuple[np.ndarray, np.ndarray]:
    """(carrier, filter) that move the fringes' wave number to zero and keep what is near it, without the mean and the mirror image."""
    height, width = shape
    carrier = np.exp(-2j * np.pi * k_x / width * np.arange(width))[None, :] * np.ones((height, 1))
    kx, ky = np.meshgrid(np.fft.fftfreq(width, 1 / width), np.fft.fftfreq(height, 1 / height))
    reach = max(k_x / slicer, 1.0)
    near = lambda at: np.exp(-((kx - at) ** 2 + ky**2) / (2 * reach**2))
    return carrier, near(0.0) * (1 - near(-k_x)) * (1 - near(-2 * k_x))


def process_frames(frames: DataFrame, k_x: float, slicer: float = 4, red_factor: int = 1) -> DataFrame:
    """Phases of fringe images: normalise, demodulate, take the angle and unwrap it along rows, then columns."""
    from velofield.schema import FRAMES

    def phase(image: np.ndarray) -> np.ndarray:
        means = image.mean(axis=1, keepdims=True)
        image = np.divide(image, means, out=np.zeros_like(image), where=means != 0)
        carrier, keep = demodulation(image.shape, k_x, slicer)
        angle = np.angle(np.fft.ifft2(np.fft.fft2((image - image.mean()) * carrier) * keep))[::red_factor, ::red_factor]
        return np.unwrap(np.unwrap(angle, axis=1), axis=0)

    def run(parts):
        for part in parts:
            made = [phase(np.asarray(v, float).reshape(h, w)) if v is not None else None for v, h, w in zip(part["pixels"], part["height"], part["width"], strict=True)]
            part["pixels"] = [None if m is None else m.ravel() for m in made]
            part["height"] = [None if m is None else m.shape[0] for m in made]
            part["width"] = [None if m is None else m.shape[1] for m in made]
            part["dtype"] = "float64"
            yield part

    names = [c.split()[0] for c in FRAMES.split(", ")]
    return frames.select(*names).mapInPandas(run, FRAMES)


def reset_borders(frames: DataFrame, border: int) -> DataFrame:
    """Zero the outer pixels."""
    from velofield.functions.images import each_pixel

    h, w = F.col("height"), F.col("width")
    inside = lambda iy, ix: (iy >= border) & (iy < h - border) & (ix >= border) & (ix < w - border)
    return frames.withColumn("pixels", each_pixel(lambda p, iy, ix: F.when(inside(iy, ix), F.element_at("pixels", p + 1)).otherwise(0.0), h, w))
