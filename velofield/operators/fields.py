"""Vector fields on grids: field_id, iy, ix, x, y, vx, vy."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

NODE = ["iy", "ix"]


def fields_from_vectors(vectors: DataFrame, height: int = 4, width: int = 8, dx: float = 1.0, dy: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors of 2 * height * width components as fields: first all vx, then all vy, row by row."""
    n = height * width
    rows = vectors.where(F.size(vector_col) == 2 * n).select(F.col(id_col).cast("long").alias("field_id"), F.posexplode(F.arrays_zip(F.slice(vector_col, 1, n).cast("array<double>").alias("vx"), F.slice(vector_col, n + 1, n).cast("array<double>").alias("vy"))).alias("pos", "v"))
    iy, ix = F.floor(F.col("pos") / width).cast("int"), (F.col("pos") % width).cast("int")
    return rows.select("field_id", iy.alias("iy"), ix.alias("ix"), (ix * dx).alias("x"), (iy * dy).alias("y"), F.col("v.vx").alias("vx"), F.col("v.vy").alias("vy"))


def combine(a: DataFrame, b: DataFrame | float, op: Callable, key: str | None = "field_id") -> DataFrame:
    """Node by node: a op b for two fields (of one key) or a field and a number."""
    if isinstance(b, int | float):
        return a.withColumn("vx", op(F.col("vx"), F.lit(float(b)))).withColumn("vy", op(F.col("vy"), F.lit(float(b))))
    on = [*([key] if key else []), *NODE]
    other = b.select(*on, F.col("vx").alias("_x"), F.col("vy").alias("_y"))
    return a.join(other, on).withColumn("vx", op(F.col("vx"), F.col("_x"))).withColumn("vy", op(F.col("vy"), F.col("_y"))).select(*a.columns)


def add(a, b):
    return combine(a, b, lambda p, q: p + q)


def subtract(a, b):
    return combine(a, b, lambda p, q: p - q)


def multiply(a, b):
    return combine(a, b, lambda p, q: p * q)


def divide(a, b):
    """Null where the divisor is zero."""
    return combine(a, b, lambda p, q: F.try_divide(p, q))


def norm(fields: DataFrame) -> DataFrame:
    return fields.withColumn("norm", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))


def kinetic_energy(fields: DataFrame) -> DataFrame:
    return fields.withColumn("energy", (F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")) / 2)


def time_average(fields: DataFrame) -> DataFrame:
    return fields.groupBy("iy", "ix").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.avg("vx").alias("vx"), F.avg("vy").alias("vy"))


def spatial_average(fields: DataFrame) -> DataFrame:
    return fields.groupBy("field_id").agg(F.avg("vx").alias("vx"), F.avg("vy").alias("vy"))


def gradient(column: str, along: str, across: str, step: float):
    """Second-order derivative: central inside, three points at both ends."""
    order = W.partitionBy("field_id", across).orderBy(along)
    v = F.col(column)
    at = lambda k: F.lead(column, k).over(order) if k > 0 else F.lag(column, -k).over(order)
    inside = (at(1) - at(-1)) / (2 * step)
    first = (-3 * v + 4 * at(1) - at(2)) / (2 * step)
    last = (3 * v - 4 * at(-1) + at(-2)) / (2 * step)
    return F.when(at(-1).isNull(), first).when(at(1).isNull(), last).otherwise(inside)


def curl(fields: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """rotz = dvy/dx - dvx/dy; a window never holds more than a row or a column of one field."""
    return fields.withColumn("_a", gradient("vy", "ix", "iy", dx)).withColumn("_b", gradient("vx", "iy", "ix", dy)).withColumn("rotz", F.col("_a") - F.col("_b")).drop("_a", "_b")


def divergence(fields: DataFrame, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    return fields.withColumn("_a", gradient("vx", "ix", "iy", dx)).withColumn("_b", gradient("vy", "iy", "ix", dy)).withColumn("divh", F.col("_a") + F.col("_b")).drop("_a", "_b")


def extract(fields: DataFrame, start0: float, stop0: float, start1: float, stop1: float, phys: bool = False) -> DataFrame:
    """A part of the field by rows and columns (stop left out) or by y and x (stop included); indices start anew."""
    if phys:
        part = fields.where(F.col("y").between(start0, stop0) & F.col("x").between(start1, stop1))
        low = part.groupBy("field_id").agg(F.min("iy").alias("_y"), F.min("ix").alias("_x"))
        return part.join(low, "field_id").withColumn("iy", F.col("iy") - F.col("_y")).withColumn("ix", F.col("ix") - F.col("_x")).select(*fields.columns)
    part = fields.where((F.col("iy") >= start0) & (F.col("iy") < stop0) & (F.col("ix") >= start1) & (F.col("ix") < stop1))
    return part.withColumn("iy", (F.col("iy") - int(start0)).cast("int")).withColumn("ix", (F.col("ix") - int(start1)).cast("int"))


def truncate(fields: DataFrame, height: int, width: int, cut: int = 1) -> DataFrame:
    return extract(fields, cut, height - cut, cut, width - cut)


def extract_square(fields: DataFrame, height: int, width: int, cut: int = 0, force_even: bool = True) -> DataFrame:
    """A centred square, even if asked for, without ``cut`` rows and columns at its sides."""
    n = min(height, width) - 2 * cut
    n -= n % 2 if force_even else 0
    a, b = (height - n) // 2, (width - n) // 2
    return extract(fields, a, a + n, b, b + n)


def regularize(fields: DataFrame) -> DataFrame:
    """Drop the last column or row where only its step differs from the others."""
    out = fields
    for axis, index in (("x", "ix"), ("y", "iy")):
        line = out.select("field_id", index, axis).distinct()
        order = W.partitionBy("field_id").orderBy(index)
        steps = line.withColumn("_s", F.lead(axis).over(order) - F.col(axis)).where("_s is not null")
        stats = steps.groupBy("field_id").agg(F.max_by("_s", index).alias("_last"), F.min_by("_s", index).alias("_first"), F.max(index).alias("_n"))
        odd = stats.where(F.abs(F.col("_last") - F.col("_first")) > 1e-8 + 1e-5 * F.abs("_first")).select("field_id", (F.col("_n") + 1).alias(index))
        out = out.join(odd, ["field_id", index], "left_anti").select(*fields.columns)
    return out


def median_filter(fields: DataFrame, size: int, height: int, width: int, niter: int = 1, valid: bool = True) -> DataFrame:
    """The (upper) median of the window around each node, reflected at the borders; ``valid`` cuts the border off after."""
    from velofield.functions import images as I

    h, w = F.lit(height), F.lit(width)
    offsets = I.square(size)
    rows = packed(fields)
    for _ in range(niter):
        for c in ("vx", "vy"):
            rows = rows.withColumn(c, I.let(F.col(c), lambda v: I.stencil(v, h, w, offsets, I.ranked(len(offsets) // 2))))
    out = unpacked(rows, width)
    return truncate(out, height, width, size // 2) if valid else out


def gaussian_filter(fields: DataFrame, sigma: float, height: int, width: int, niter: int = 1, truncate_: float = 3.0, valid: bool = True) -> DataFrame:
    """A Gaussian blur of both components, reflected at the borders; ``valid`` cuts the border off after."""
    from velofield.functions import images as I

    h, w = F.lit(height), F.lit(width)
    weights = I.gaussian_weights(sigma, truncate_)
    rows = packed(fields)
    for _ in range(niter):
        for c in ("vx", "vy"):
            rows = rows.withColumn(c, I.weighted(F.col(c), h, w, weights))
    out = unpacked(rows, width)
    return truncate(out, height, width, len(weights) // 2) if valid else out


def packed(fields: DataFrame) -> DataFrame:
    """One row per field: vx and vy as row-major arrays, with the axes."""
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("iy", "ix", c))), lambda s: s[c])
    return fields.groupBy("field_id").agg(order("vx").alias("vx"), order("vy").alias("vy"), order("x").alias("x"), order("y").alias("y"))  # one field's nodes


def unpacked(rows: DataFrame, width: int) -> DataFrame:
    long = rows.select("field_id", F.posexplode(F.arrays_zip("x", "y", "vx", "vy")).alias("_p", "_v"))
    return long.select("field_id", F.floor(F.col("_p") / width).cast("int").alias("iy"), (F.col("_p") % width).cast("int").alias("ix"), "_v.x", "_v.y", "_v.vx", "_v.vy")


def append(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def with_times(fields: DataFrame, timestep: float) -> DataFrame:
    """Add t: the place of the field in the order of ids, times the step."""
    return fields.join(numbered(fields).select("field_id", (F.col("n") * timestep).alias("t")), "field_id")


def numbered(fields: DataFrame) -> DataFrame:
    """(field_id, n): each field's place, from 0, in the order of ids; ranges of ids are sorted and counted where they are."""
    ids = fields.select("field_id").distinct().orderBy("field_id")
    return ids.rdd.zipWithIndex().map(lambda x: (x[0][0], x[1])).toDF(ids.schema.add("n", "long"))  # an id per field


def slice_series(fields: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    """Every ``step``-th field of the places ``start`` to ``stop`` (left out) in the order of ids."""
    chosen = numbered(fields).where((F.col("n") >= start) & (F.col("n") < stop) & ((F.col("n") - start) % step == 0))
    return fields.join(chosen.select("field_id"), "field_id", "left_semi")


def delete(fields: DataFrame, places: list[int]) -> DataFrame:
    """The fields without those at some places in the order of ids."""
    return fields.join(numbered(fields).where(F.col("n").isin(places)).select("field_id"), "field_id", "left_anti")


def grid_of(fields: DataFrame, key: str = "field_id") -> DataFrame:
    """A row per field: its positions along both axes, ascending."""
    return fields.groupBy(key).agg(F.array_sort(F.collect_set("x")).alias("xs"), F.array_sort(F.collect_set("y")).alias("ys"))  # one field's axes


def save(fields: DataFrame, path: str, about: dict[str, str], how: str = "new_dir") -> None:
    """Write fields, or voxels, as Parquet, with what is known about them (names and texts) beside them."""
    from velofield.sources.sinks import mode_of

    fields.write.mode(mode_of(how)).parquet(f"{path}/nodes")
    rows = sorted((str(k), str(v)) for k, v in about.items())
    fields.sparkSession.createDataFrame(rows, "name string, value string").coalesce(1).write.mode(mode_of(how)).parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """What ``save`` has written: the nodes, read when they are used, and what is known about them."""
    return spark.read.parquet(f"{path}/nodes"), {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/about").collect()}  # a few names


def flip_axes(fields: DataFrame) -> DataFrame:
    """Number rows and columns anew so that x and y ascend."""
    return fields.withColumn("ix", (F.dense_rank().over(W.partitionBy("field_id").orderBy("x")) - 1).cast("int")).withColumn("iy", (F.dense_rank().over(W.partitionBy("field_id").orderBy("y")) - 1).cast("int"))


def spectrum_1d(rows: DataFrame, value: str, dx: float = 1.0) -> DataFrame:
    """Power spectral density of arrays of n samples: rows' columns, k, omega, re, im, psd.

    The transform is divided by n, frequencies run from -n // 2, and the sum of psd times the step of omega is half the mean square.
    """
    dk = 2 * math.pi / (F.size(value) * dx)
    made = rows.withColumn("_w", _transformed(1)(F.col(value)))
    out = made.select(*rows.columns, F.size(value).alias("_n"), F.posexplode("_w").alias("_k", "_c"))
    out = out.select(*rows.columns, (F.col("_k") - F.floor(F.col("_n") / 2)).cast("int").alias("k"), F.col("_c.re").alias("re"), F.col("_c.im").alias("im"))
    return out.withColumn("omega", F.col("k") * dk).withColumn("psd", 0.5 / dk * (F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def _transformed(height: int):
    """A column function: the Fourier transform of row-major arrays of ``height`` rows, over their size, from the least
    frequencies up; null for null, empty and cut arrays. The arrays of an Arrow batch with one size go through one transform.
    """

    @F.pandas_udf("array<struct<re:double,im:double>>")
    def run(values: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(values), dtype=object)
        sizes = np.array([0 if v is None else len(v) for v in values])
        for n in np.unique(sizes[(sizes > 0) & (sizes % height == 0)]):
            own = np.flatnonzero(sizes == n)
            cube = np.stack([values.iloc[k] for k in own]).astype(float).reshape(len(own), height, -1)
            waves = np.fft.fftshift(np.fft.fft2(cube), axes=(1, 2)).reshape(len(own), -1) / n
            for k, w in zip(own, waves, strict=True):
                out.iloc[k] = [{"re": float(c.real), "im": float(c.imag)} for c in w]
        return out

    return run


def spectrum_2d(rows: DataFrame, value: str, height: int, width: int, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Power spectral density of row-major arrays in two dimensions: ky, kx, re, im, psd."""
    dkx, dky = 2 * math.pi / (width * dx), 2 * math.pi / (height * dy)
    made = rows.withColumn("_w", _transformed(height)(F.col(value))).select(*rows.columns, F.posexplode("_w").alias("_k", "_c"))
    ky, kx = (F.floor(F.col("_k") / width) - height // 2).cast("int"), (F.col("_k") % width - width // 2).cast("int")
    out = made.select(*rows.columns, ky.alias("ky"), kx.alias("kx"), F.col("_c.re").alias("re"), F.col("_c.im").alias("im"))
    return out.withColumn("psd", 0.5 / (dkx * dky) * (F.col("re") * F.col("re") + F.col("im") * F.col("im")))


def temporal_spectrum(fields: DataFrame, component: str, series: str, dt: float = 1.0) -> DataFrame:
    """The spectrum in time at every node of each series of fields, in the order of ids."""
    values = fields.groupBy(series, "iy", "ix").agg(F.transform(F.array_sort(F.collect_list(F.struct("field_id", component))), lambda s: s[component]).alias("_v"))  # one value per time
    return spectrum_1d(values, "_v", dt).drop("_v")


def apply_to_cube(fields: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A user's function on each series' whole (t, y, x) cube of both components, as a table in and out."""
    return fields.groupBy("series").applyInPandas(lambda t: function(t), schema)
