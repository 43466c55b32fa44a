"""Where results go: names, folders and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_name(indices0: Column, letter0: Column, indices1: Column, letter1: Column, prefix: str = "piv", digits: int = 2) -> Column:
    """``piv_01-02``, or ``piv_060ab`` for two letters of one number."""
    number = lambda n: F.lpad(n.cast("string"), digits, "0")
    same = letter0.isNotNull() & (indices0 == indices1)
    return F.concat(F.lit(prefix + "_"), F.when(same, F.concat(number(indices0), letter0, letter1)).otherwise(F.concat(number(indices0), F.lit("-"), number(indices1))))


def reference_name(name: Column, base: str) -> Column:
    """``bos`` and what follows the base name, without the extension."""
    return F.concat(F.lit("bos"), F.regexp_replace(F.substring(name, len(base) + 1, 10_000), r"\.[^.]*$", ""))


def couple_name(name0: Column, name1: Column) -> Column:
    return F.concat_ws("-", name0, name1)


def write_frames(frames: DataFrame, path: str, how: str = "new_dir") -> None:
    frames.write.mode(mode_of(how)).partitionBy("series_id").parquet(path)


def write_vectors(vectors: DataFrame, path: str, how: str = "new_dir") -> None:
    """Vectors by pass, in single precision; partitioned by pass, so a reader of the last pass reads that alone."""
    small = [F.col(c).cast("float").alias(c) if t == "double" else F.col(c) for c, t in vectors.dtypes]
    vectors.select(*small).write.mode(mode_of(how)).partitionBy("pass").parquet(path)


def read_pass(vectors: DataFrame, index: int | None = None) -> DataFrame:
    """One pass, by default the last."""
    if index is not None:
        return vectors.where(F.col("pass") == index)
    last = vectors.agg(F.max("pass").alias("_last"))
    return vectors.join(F.broadcast(last), F.col("pass") == F.col("_last")).drop("_last")


def mode_of(how: str) -> str:
    """The write mode for a policy: ``new_dir`` must not exist, ``complete`` adds, ``recompute`` replaces."""
    modes = {"new_dir": "errorifexists", "complete": "append", "from_path_indices": "append", "recompute": "overwrite"}
    if how not in modes:
        raise ValueError(f"how is one of {', '.join(modes)}")
    return modes[how]


def failures(table: DataFrame, operator: str, key: str = "key") -> DataFrame:
    """The failed rows of a table: operator, key, message."""
    return table.where("error is not null").select(F.lit(operator).alias("operator"), F.col(key).cast("string").alias("key"), F.col("error").alias("message"))


def save_images(frames: DataFrame, folder: str, kind: str = "png") -> DataFrame:
    """Encode frames as image files by name: name, content; write them with any sink that takes binary rows."""
    import numpy as np
    import pandas as pd

    from velofield.sources.frames import encode_pgm, encode_png

    encode = {"png": encode_png, "pgm": encode_pgm}[kind]

    def run(parts):
        for part in parts:
            part = part[part["pixels"].notna()]
            made = [encode(np.rint(np.clip(np.asarray(v), 0, 65535)).astype(int).reshape(h, w)) for v, h, w in zip(part["pixels"], part["height"], part["width"], strict=True)]
            if made:
                yield pd.DataFrame({"name": [f"{folder}/{str(n).rsplit('.', 1)[0]}.{kind}" for n in part["name"]], "content": made})

    return frames.select("name", "height", "width", "pixels").mapInPandas(run, "name string, content binary")
