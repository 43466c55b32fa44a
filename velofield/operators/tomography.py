"""Voxels and their reconstruction from several cameras by multiplied lines of sight."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def voxel_grid(spark: SparkSession, x: tuple[float, float, int], y: tuple[float, float, int], z: tuple[float, float, int]) -> DataFrame:
    """Voxels of (first, last, number) per axis: ivox, x, y, z; x runs fastest. Made in parallel from the voxels' numbers."""
    n = x[2] * y[2] * z[2]
    step = lambda axis: (axis[1] - axis[0]) / (axis[2] - 1) if axis[2] > 1 else 0.0
    rows = spark.range(n).withColumnRenamed("id", "ivox")
    at = lambda axis, k: F.lit(float(axis[0])) + k * step(axis)
    return rows.select("ivox", at(x, F.col("ivox") % x[2]).alias("x"), at(y, F.floor(F.col("ivox") / x[2]) % y[2]).alias("y"), at(z, F.floor(F.col("ivox") / (x[2] * y[2]))).alias("z"))


def reset(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("intensity", F.lit(1.0))


def sample_nearest(points: DataFrame, pixels: DataFrame, radius: int = 0) -> DataFrame:
    """The value of the pixel nearest to (px, py): an equi-join on rounded places; with a radius, the nearest non-zero pixel within it.

    ``pixels`` has iy, ix, v. A point without any gets 0.
    """
    around = [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]
    spots = points.select("ivox", "px", "py", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around])).alias("_o"))
    spots = spots.select("ivox", "px", "py", (F.rint("py") + F.col("_o.a")).cast("int").alias("iy"), (F.rint("px") + F.col("_o.b")).cast("int").alias("ix"))
    lit = pixels.where("v <> 0") if radius else pixels
    found = spots.join(lit.select("iy", "ix", "v"), ["iy", "ix"])
    d2 = F.pow(F.col("ix") - F.col("px"), 2) + F.pow(F.col("iy") - F.col("py"), 2)
    best = found.groupBy("ivox").agg(F.min_by("v", F.struct(d2.alias("d2"), F.col("iy"), F.col("ix"))).alias("v"))
    return points.join(best, "ivox", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def mlos(voxels: DataFrame, views: list[DataFrame], threshold: float | None = None) -> DataFrame:
    """Intensity as the geometric mean of what each camera sees along its line to the voxel (views: ivox, v)."""
    n = len(views)
    seen = views[0].select("ivox", "v")
    for other in views[1:]:
        seen = seen.union(other.select("ivox", "v"))
    logs = seen.groupBy("ivox").agg(F.sum(F.when(F.col("v") > 0, F.ln("v"))).alias("_s"), F.sum((F.col("v") > 0).cast("int")).alias("_n"))
    value = F.when(F.col("_n") == n, F.exp(F.col("_s") / n)).otherwise(0.0)
    out = voxels.join(logs, "ivox").withColumn("intensity", value).drop("_s", "_n")
    return out if threshold is None else out.where(F.col("intensity") > threshold)


def rbf_interpolator(points: np.ndarray, values: np.ndarray, scale: float):
    """A function through scattered values, as a sum of Gaussians; for few points, the system is dense."""
    square = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    weights = np.linalg.solve(np.exp(-square / scale**2) + 1e-10 * np.eye(len(points)), values)
    return lambda wanted: np.exp(-((wanted[:, None] - points[None]) ** 2).sum(axis=2) / scale**2) @ weights


def blobs(image: np.ndarray, threshold: float, least: int = 4, most: int = 100_000) -> np.ndarray:
    """Centres (x, y) of the connected bright spots of at least ``least`` pixels, row by row."""
    bright = image > threshold
    label = np.where(bright, np.arange(image.size).reshape(image.shape), -1)
    while True:
        padded = np.pad(label, 1, constant_values=-1)
        high = np.max([padded[i : i + label.shape[0], j : j + label.shape[1]] for i in range(3) for j in range(3)], axis=0)
        new = np.where(bright, high, -1)
        if (new == label).all():
            break
        label = new
    found = []
    for k in np.unique(label[bright]):
        ys, xs = np.nonzero(label == k)
        if least <= len(ys) <= most:
            found.append((xs.mean(), ys.mean()))
    return np.array(sorted(found, key=lambda p: (round(p[1]), p[0]))).reshape(-1, 2)


def calibrate_camera(points: np.ndarray, pixels: np.ndarray) -> np.ndarray:
    """The 3 x 4 projection matrix of a camera from points in space and their pixels, by direct linear transformation."""
    n = len(points)
    full = np.hstack([points, np.ones((n, 1))])
    zero = np.zeros((n, 4))
    system = np.vstack([np.hstack([full, zero, -pixels[:, :1] * full]), np.hstack([zero, full, -pixels[:, 1:] * full])])
    matrix = np.linalg.svd(system)[2][-1].reshape(3, 4)
    return matrix / matrix[2, 3]
