"""Displacement vectors from pairs, as Catalyst expressions; for small windows. Large ones go through the NumPy kernels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velofield.functions import correlation as C
from velofield.functions.images import let
from velofield.operators.grids import nodes
from velofield.operators.velocimetry_codes import CODES


def correlate(pairs: DataFrame, size: int, overlap: float = 0.5, height: int = 8, width: int = 8, disp_max: int | None = None) -> DataFrame:
    """A correlation map for each window of the grid: key, ivec, iyvec, ixvec, corr. A pair's windows come from its row alone."""
    ys, xs = nodes(height, size, overlap), nodes(width, size, overlap)
    half = size // 2
    grid = F.array(*[F.struct(F.lit(k * len(xs) + m).alias("ivec"), F.lit(y).alias("iyvec"), F.lit(x).alias("ixvec")) for k, y in enumerate(ys) for m, x in enumerate(xs)])
    rows = pairs.select("key", "height", "width", "px0", "px1", "error", F.explode(grid).alias("g")).select("key", "width", "px0", "px1", "error", "g.*")
    cut = lambda px: C.window(F.col(px), F.col("width"), F.col("iyvec") - half, F.col("ixvec") - half, size, size)
    known = lambda px: F.when(F.col("error").isNull(), cut(px))
    if disp_max is None:
        return C.with_circular(rows.select("key", "ivec", "iyvec", "ixvec", "error", known("px0").alias("a"), known("px1").alias("b")), "a", "b", size, size)
    rows = rows.select("key", "ivec", "iyvec", "ixvec", "error", C.centred(known("px0")).alias("a"), C.centred(known("px1")).alias("b"))
    return rows.select("key", "ivec", "iyvec", "ixvec", "error", C.direct(F.col("a"), F.col("b"), size, size, disp_max).alias("corr"))


def locate(maps: DataFrame, size: int, method: str = "2d_gaussian2", displacement_max: float | None = None, radius: int = 1, sub: bool = True) -> DataFrame:
    """Vectors from maps: dx, dy, correl_max, errors.

    A peak on the map's border gets a second chance: the next peak away from it; if that fails too, the first one is kept
    with its error.
    """
    side = size

    def chosen(c: Column, first: Column) -> Column:
        other = C.peak(c, side, side, displacement_max, [first], radius)
        second = let(other, lambda q: F.when(q.isNotNull() & ~C.on_border(q["pos"], side, side), q).otherwise(first))
        return F.when(C.on_border(first["pos"], side, side), second).otherwise(first)

    best = let(F.col("corr"), lambda c: let(C.peak(c, side, side, displacement_max), lambda p: chosen(c, p)))
    found = maps.withColumn("_at", best)
    border = C.on_border(F.col("_at.pos"), side, side)
    dx, dy = C.displacement_of(F.col("_at.pos"), side, side)
    found = found.withColumn("_s", F.when(~border, C.subpixel(F.col("corr"), F.col("_at.pos"), side, side, method)) if sub else F.lit(None).cast("struct<x:double,y:double>"))
    wrong = F.lit(sub) & ~border & F.col("_s").isNull()
    errors = F.when(F.col("error").isNotNull(), F.col("error")).when(border, "Correlation peak touching boundary.").when(wrong, "wrong subpix")
    return found.select("key", "ivec", "iyvec", "ixvec", (dx - F.coalesce("_s.x", F.lit(0.0))).alias("dx"), (dy - F.coalesce("_s.y", F.lit(0.0))).alias("dy"), F.col("_at.c").alias("correl_max"), errors.alias("errors"))


def secondary_peaks(corr: Column, size: int, k: int, radius: int = 3) -> Column:
    """An array of the highest point and up to ``k - 1`` others, each away from all before it; each is computed once."""

    def grown(c: Column, found: list[Column]) -> Column:
        if len(found) == k:
            return F.array(*found)
        return let(C.peak(c, size, size, None, found, radius), lambda p: grown(c, [*found, p]))

    return let(corr, lambda c: grown(c, []))


def neighbour_mean(vectors: DataFrame, key: str = "key") -> DataFrame:
    """Add mean_dx and mean_dy: the means over the up to eight neighbours on the grid that have a vector.

    Nothing for a node without a vector, or without neighbours that have one. Each vector goes to its neighbours' nodes,
    which are found by an equi-join on the node, so the work is in the number of vectors.
    """
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])).alias("_o")
    # no filter here: pushed down, it would compute the vectors once more for each test
    valid = lambda c: F.when(F.col("dx").isNotNull() & F.col("dy").isNotNull(), F.col(c)).alias(c)
    sent = vectors.select(key, "iy", "ix", valid("dx"), valid("dy"), steps)
    sums = sent.groupBy(key, (F.col("iy") + F.col("_o.a")).alias("iy"), (F.col("ix") + F.col("_o.b")).alias("ix")).agg(F.avg("dx").alias("_mx"), F.avg("dy").alias("_my"))
    there = F.col("dx").isNotNull() & F.col("dy").isNotNull()
    joined = vectors.join(sums, [key, "iy", "ix"], "left")
    return joined.select(*vectors.columns, F.when(there, F.col("_mx")).alias("mean_dx"), F.when(there, F.col("_my")).alias("mean_dy"))


def error_code(errors: Column) -> Column:
    """1 ... 4 by what an error text starts with, 255 for others."""
    code = F.when(errors.isNull(), F.lit(None).cast("int"))
    for text, number in CODES:
        code = code.when(errors.startswith(text), number)
    return code.otherwise(255)


def _add(errors: Column, text: Column) -> Column:
    return F.when(errors.isNull(), text).otherwise(F.concat(errors, F.lit(" + "), text))


def fix(vectors: DataFrame, correl_min: float = 0.2, threshold: float | None = 10.0, displacement_max: float | None = None) -> DataFrame:
    """Take out false vectors: those with errors, with a low correlation, too long, or too far from their neighbours' mean.

    The neighbours' mean is that of what the first three rules leave. A vector taken out is in dx_wrong and dy_wrong, with
    the reasons in ``errors`` and a number in ``error_code``; dx and dy are null.
    """
    length2 = F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")
    marked = vectors.withColumn("_x", F.col("dx")).withColumn("_y", F.col("dy"))
    marked = marked.withColumn("errors", F.when(F.col("correl_max") < correl_min, _add(F.col("errors"), F.lit("correl < correl_min"))).otherwise(F.col("errors")))
    if displacement_max is not None:
        marked = marked.withColumn("errors", F.when(length2 > displacement_max**2, _add(F.col("errors"), F.lit("delta2 < displacement_max2"))).otherwise(F.col("errors")))
    clean = F.col("errors").isNull()
    marked = marked.withColumn("dx", F.when(clean, F.col("_x"))).withColumn("dy", F.when(clean, F.col("_y")))
    if threshold is not None:
        marked = neighbour_mean(marked)
        far = F.sqrt(F.pow(F.col("dx") - F.col("mean_dx"), 2) + F.pow(F.col("dy") - F.col("mean_dy"), 2))
        text = F.concat(F.lit("diff neighbour too large (diff = "), F.format_string("%.2f", far), F.lit(")"))
        marked = marked.withColumn("errors", F.when(far > threshold, _add(F.col("errors"), text)).otherwise(F.col("errors"))).drop("mean_dx", "mean_dy")
    clean = F.col("errors").isNull()
    marked = marked.withColumn("dx", F.when(clean, F.col("dx"))).withColumn("dy", F.when(clean, F.col("dy")))
    return marked.withColumn("dx_wrong", F.when(~clean, F.col("_x"))).withColumn("dy_wrong", F.when(~clean, F.col("_y"))).withColumn("error_code", error_code(F.col("errors"))).drop("_x", "_y")


def first_pass(pairs: DataFrame, size: int, overlap: float = 0.5, height: int = 8, width: int = 8, **rules) -> DataFrame:
    """Correlate, locate and fix: one row per vector."""
    found = locate(correlate(pairs, size, overlap, height, width), size)
    across = len(nodes(width, size, overlap))
    found = found.withColumn("iy", F.floor(F.col("ivec") / across).cast("int")).withColumn("ix", (F.col("ivec") % across).cast("int"))
    return fix(found, **rules)


def nearest_values(known: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """Fill positions (key, x, y) from the nearest vector of their key that has values; the smallest ivec of equally near ones."""
    have = known.where("dx is not null and dy is not null").select(key, F.col("x").alias("_x"), F.col("y").alias("_y"), F.col("ivec").alias("_ivec"), "dx", "dy")
    joined = wanted.join(have, key)
    d2 = F.pow(F.col("x") - F.col("_x"), 2) + F.pow(F.col("y") - F.col("_y"), 2)
    best = joined.groupBy(key, "x", "y").agg(F.min_by(F.struct("dx", "dy"), F.struct(d2.alias("d2"), F.col("_ivec"))).alias("v"))
    return best.select(key, "x", "y", "v.dx", "v.dy")


def civ_columns(vectors: DataFrame) -> DataFrame:
    """The layout of an exported pass: zero where there is no vector, and a flag that says so."""
    gone = F.col("dx").isNull() | F.col("dy").isNull()
    return vectors.select("key", "ivec", F.col("ixvec").alias("civ_x"), F.col("iyvec").alias("civ_y"), F.when(gone, 0.0).otherwise(F.col("dx")).alias("civ_u"), F.when(gone, 0.0).otherwise(F.col("dy")).alias("civ_v"), F.coalesce("correl_max", F.lit(0.0)).alias("civ_c"), gone.cast("int").alias("civ_ff"))


def light(vectors: DataFrame) -> DataFrame:
    """Only the final grid and displacements."""
    return vectors.select("key", "ixvec", "iyvec", F.col("dx").alias("dx_final"), F.col("dy").alias("dy_final"))
