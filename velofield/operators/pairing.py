"""Pairs and subsets of frames, references, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def make_couples(frames: DataFrame, step: int = 1) -> DataFrame:
    """Each frame with the one ``step`` numbers later; failures of either frame go on in ``error``.

    One equi-join on the frame number: no window over the whole series, so no single task sorts it.
    """
    later = frames.select((F.col("i") - step).alias("_i"), F.col("series_id").alias("_s"), F.col("name").alias("name1"), F.col("height").alias("_h"), F.col("width").alias("_w"), F.col("pixels").alias("px1"), F.col("error").alias("_e1"))
    joined = frames.join(later, (F.col("i") == F.col("_i")) & (F.col("series_id") == F.col("_s")))
    shapes = F.when((F.col("height") != F.col("_h")) | (F.col("width") != F.col("_w")), "the two images differ in shape")
    return joined.select(F.col("i").alias("key"), F.col("name").alias("name0"), "name1", "height", "width", F.col("pixels").alias("px0"), "px1", F.coalesce("error", "_e1", shapes).alias("error"))


def make_groups(groups: DataFrame, frames: DataFrame) -> DataFrame:
    """Subsets (key, slot, i, j) joined to their frames: key, names, height, width, stack (pixels by slot), error."""
    named = groups.select("key", "slot", F.col("i").alias("_i"), F.col("j").alias("_j"))
    joined = named.join(frames, (F.col("_i") == F.col("i")) & F.col("_j").eqNullSafe(F.col("j"))).select("key", "slot", "name", "height", "width", "pixels", "error")
    rows = joined.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("slot", "name", "pixels"))).alias("_f"), F.max("height").alias("height"), F.max("width").alias("width"), F.max("error").alias("error"))  # a subset has a fixed number of frames
    return rows.select("key", F.col("_f.name").alias("names"), "height", "width", F.col("_f.pixels").alias("stack"), "error")


def with_reference(frames: DataFrame, reference: DataFrame) -> DataFrame:
    """Every frame but the reference paired with it: one frame goes to every task, whatever the series' length."""
    one = reference.limit(1).select(F.col("name").alias("name0"), F.col("pixels").alias("px0"), F.col("height").alias("_h"), F.col("width").alias("_w"))
    joined = frames.join(F.broadcast(one), F.col("name") != F.col("name0"))
    shapes = F.when((F.col("height") != F.col("_h")) | (F.col("width") != F.col("_w")), "the two images differ in shape")
    return joined.select(F.col("i").alias("key"), "name0", F.col("name").alias("name1"), "height", "width", "px0", F.col("pixels").alias("px1"), F.coalesce("error", shapes).alias("error"))


def reference_by_rank(frames: DataFrame, k: int) -> DataFrame:
    """The k-th frame (from 0) in the order of names."""
    return frames.orderBy("name").offset(k).limit(1)


def saved_slots(names, is_first: bool, is_last: bool):
    """The slots of a subset whose result is kept: all of a lone subset, the head of the first, the tail of the last, else the middle."""
    n = F.size(names)
    start, end = F.floor(n / 2) - F.when(n % 2 == 0, 1).otherwise(0), F.ceil(n / 2)
    low = F.lit(0) if is_first else start
    high = n if is_last else end
    return F.filter(F.sequence(F.lit(0), n - 1), lambda s: (s >= low) & (s < high))


def middle_name(names):
    """The name that a subset's result gets."""
    n = F.size(names)
    return F.element_at(names, (F.floor(n / 2) - F.when(n % 2 == 0, 1).otherwise(0) + 1).cast("int"))


def split_ranges(n_parts: int, start: int, stop: int, step: int = 1) -> list[tuple[int, int, int]]:
    """A range as ``n_parts`` nearly equal ranges, longer ones first."""
    n = len(range(start, stop, step))
    sizes = [n // n_parts + (k < n % n_parts) for k in range(n_parts)]
    edges = [start]
    for size in sizes:
        edges.append(edges[-1] + size * step)
    return [(a, b, step) for a, b in zip(edges, edges[1:], strict=False)]


def split_list(values: list, n_parts: int) -> list[list]:
    """A list as at most ``n_parts`` nearly equal, contiguous lists; an empty list as empty ones."""
    if not values:
        return [[] for _ in range(n_parts)]
    return [values[a:b] for a, b, _ in split_ranges(min(n_parts, len(values)), 0, len(values))]
