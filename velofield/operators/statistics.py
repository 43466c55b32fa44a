"""Aggregates over frames, fields and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from velofield.functions.images import let, mean
from velofield.sources.frames import pixels_of


def mean_image(frames: DataFrame, *by: str) -> DataFrame:
    """The mean of all frames, pixel by pixel: n, total and mean of each position, and the truncated mean as of whole numbers.

    Partial sums are made where the frames are; one row per pixel and task is shuffled.
    """
    long = frames.select(*by, F.posexplode("pixels").alias("pos", "v"))
    return long.groupBy(*by, "pos").agg(F.count("v").alias("n"), F.sum("v").alias("total")).withColumn("mean", F.col("total") / F.col("n")).withColumn("truncated", F.col("mean").cast("long"))


def as_image(means: DataFrame, height: int, width: int) -> DataFrame:
    """Positions and means as one frame of pixels."""
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda x: x["mean"]).alias("pixels")).select(F.lit(height).alias("height"), F.lit(width).alias("width"), "pixels")  # one image


def frame_statistics(frames: DataFrame) -> DataFrame:
    """i, minimum, maximum, mean, upper median and population standard deviation of each frame, within its row."""
    spread = lambda v, m: F.sqrt(mean(F.transform(v, lambda x: (x - m) * (x - m))))
    middle = lambda v: F.element_at(F.array_sort(v), F.floor(F.size(v) / 2).cast("int") + 1)
    row = let(F.col("pixels"), lambda v: let(mean(v), lambda m: F.struct(F.array_min(v).alias("low"), F.array_max(v).alias("high"), m.alias("mean"), middle(v).alias("median"), spread(v, m).alias("std"))))
    return frames.select("i", "name", row.alias("_s")).select("i", "name", "_s.*")


def histogram(frames: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """Counts of pixels in equal bins from ``low`` to ``high`` (its last value in the last bin); others are left out."""
    long = pixels_of(frames).where(F.col("v").between(low, high))
    bin_ = F.least(F.floor((F.col("v") - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return long.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def describe(values: DataFrame, column: str) -> DataFrame:
    """One row: n, low, high, mean, std (population), median."""
    c = F.col(column)
    middle = exact_median(values, column)
    return values.agg(F.count(c).alias("n"), F.min(c).alias("low"), F.max(c).alias("high"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).withColumn("median", F.lit(middle).cast("double"))


def exact_median(values: DataFrame, column: str, bins: int = 4096) -> float | None:
    """The median of all values, the mean of the middle two; nulls don't count, and without values there is none.

    Values are counted in bins between the least and the largest; the bin of the middle is then looked at in the same way,
    until it holds one value. So no task holds or sorts more than its bins' counts.
    """
    rows = values.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    all_ = rows.agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).first()

    def at(place: int) -> float:
        low, high = all_["low"], all_["high"]
        while low < high:
            width = (high - low) / bins
            bin_ = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)) if width > 0 else F.col("v")
            counts = rows.where(F.col("v").between(low, high)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
            for r in sorted(counts.collect(), key=lambda r: r["b"]):  # a row per bin
                if place < r["n"]:
                    low, high = r["low"], r["high"]
                    break
                place -= r["n"]
        return low

    return (at((all_["n"] - 1) // 2) + at(all_["n"] // 2)) / 2 if all_["n"] else None


def log_durations(starts: DataFrame, ends: DataFrame) -> DataFrame:
    """Starts (name, key, t) with their end and duration; a work that never ended has nulls."""
    done = ends.groupBy("name", "key").agg(F.min("t").alias("t_end"))
    return starts.join(done, ["name", "key"], "left").select("name", "key", F.col("t").alias("t_start"), "t_end", (F.col("t_end") - F.col("t")).alias("duration"))


def active_workers(durations: DataFrame) -> DataFrame:
    """How many works of each name run after each start and end."""
    steps = durations.select("name", F.col("t_start").alias("t"), F.lit(1).alias("step")).union(durations.where("t_end is not null").select("name", "t_end", F.lit(-1)))
    steps = steps.groupBy("name", "t").agg(F.sum("step").alias("step"))
    return steps.select("name", "t", F.sum("step").over(W.partitionBy("name").orderBy("t")).alias("n"))


def run_summary(durations: DataFrame) -> DataFrame:
    """Number of works, of those ended, and their mean duration, by name."""
    return durations.groupBy("name").agg(F.count("*").alias("n"), F.count("t_end").alias("ended"), F.avg("duration").alias("mean_duration"))
