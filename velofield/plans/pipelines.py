"""Pipelines from frames to results. Each is one lazy plan; writing it is the only action."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from importlib import import_module

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velofield.operators import filters, pairing, statistics, surface
from velofield.params import Flow, Piv, Surface
from velofield.schema import FRAMES, VECTORS
from velofield.sources import frames as sources
from velofield.sources import sinks

_VECTOR_NAMES = [c.split()[0] for c in VECTORS.replace("array<struct<dx:double,dy:double,correl:double>>", "array").split(", ")]


def vectors_of(pairs: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], list[dict]], stop_if_error: bool = False) -> DataFrame:
    """Run a kernel on each pair; a failure becomes one row with its message in ``errors``, unless it is to stop the run."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows: list[dict] = []
            for p in part.itertuples(index=False):
                blank = {"key": p.key, "errors": p.error, "error_code": 255}
                if isinstance(p.error, str):
                    rows.append(blank)
                    continue
                try:
                    shape = (int(p.height), int(p.width))
                    rows += [r | {"key": p.key} for r in kernel(np.asarray(p.px0, float).reshape(shape), np.asarray(p.px1, float).reshape(shape))]
                except Exception as error:  # noqa: BLE001  a failure is a value that goes on
                    if stop_if_error:
                        raise
                    rows.append(blank | {"errors": f"{type(error).__name__}: {error}"})
            out = pd.DataFrame(rows, columns=_VECTOR_NAMES)
            for c in ("pass", "ivec", "ixvec", "iyvec", "dx_input", "dy_input", "error_code"):
                out[c] = out[c].astype("Int32")
            out["secondary_peaks"] = [v if isinstance(v, list) else None for v in out["secondary_peaks"]]
            out["errors"] = [v if isinstance(v, str) else None for v in out["errors"]]
            yield out

    # a pair may be large: few rows to a batch come from the session's Arrow settings, one pair's work from its row alone
    return pairs.select("key", "height", "width", "px0", "px1", "error").mapInPandas(run, VECTORS)


def piv(pairs: DataFrame, params: Piv = Piv(), stop_if_error: bool = False) -> DataFrame:
    """Multipass velocimetry of pairs."""
    from velofield.functions.kernels import velocimetry

    return vectors_of(pairs, lambda a, b: velocimetry(a, b, params), stop_if_error)


def optical_flow(pairs: DataFrame, params: Flow = Flow()) -> DataFrame:
    """Optical flow of pairs, as vectors without a correlation."""
    from velofield.functions.kernels import optical_flow as flow

    return vectors_of(pairs, lambda a, b: [r | {"pass": 0} for r in flow(a, b, params)])


def piv_of_series(frames: DataFrame, params: Piv = Piv(), done: DataFrame | None = None) -> DataFrame:
    """The pairs of a series, without those that are done, and their vectors."""
    groups = sources.subsets(frames, params.series.str_subset, step=params.series.ind_step)
    made = pairing.make_groups(groups if done is None else groups.join(done.select("key").distinct(), "key", "left_anti"), frames)
    pairs = made.select("key", F.col("names")[0].alias("name0"), F.col("names")[1].alias("name1"), "height", "width", F.col("stack")[0].alias("px0"), F.col("stack")[1].alias("px1"), "error")
    return piv(pairs, params)


def bos(frames: DataFrame, reference: DataFrame, params: Piv = Piv()) -> DataFrame:
    """Velocimetry of every frame against one reference."""
    return piv(pairing.with_reference(frames, reference), params)


def process_series(frames: DataFrame, first: int | None = None, last: int | None = None, params: Piv = Piv()) -> DataFrame:
    """Velocimetry of the pairs of a part of a series, by frame numbers (both included)."""
    part = frames.where(F.col("i").between(first if first is not None else -(1 << 62), last if last is not None else 1 << 62))
    return piv_of_series(part, params)


def process_arrays(spark: SparkSession, image0: np.ndarray, image1: np.ndarray, params: Piv = Piv()) -> DataFrame:
    """Velocimetry of one pair of images given as arrays; the pair has the key 0."""
    if image0.shape != image1.shape or image0.ndim != 2:
        raise ValueError("both images must have two dimensions and one shape")
    row = (0, *image0.shape, image0.ravel().astype(float).tolist(), image1.ravel().astype(float).tolist(), None)
    return piv(spark.createDataFrame([row], "key long, height int, width int, px0 array<double>, px1 array<double>, error string"), params)


def process_image(frames: DataFrame, name: str, function: str | Callable, args: tuple = ()) -> DataFrame:
    """A user's function on the frame of one name."""
    return image_to_image(frames.where(F.col("name") == name), function, args)


def preprocess(frames: DataFrame, tools: list[tuple[str, dict]]) -> DataFrame:
    return filters.preprocess(frames, tools)


def mean_image(frames: DataFrame, height: int, width: int) -> DataFrame:
    return statistics.as_image(statistics.mean_image(frames), height, width)


def load_function(path: str, args: tuple = ()) -> Callable:
    """A user's function by its dotted path; of a class, made with ``args``, the method ``calcul`` of (key, image)."""
    module, _, name = path.rpartition(".")
    found = getattr(import_module(module), name)
    if isinstance(found, type):
        made = found(*args)
        return lambda key, image: made.calcul((key, image))[1]
    return lambda key, image: found(image)


def image_to_image(frames: DataFrame, function: str | Callable, args: tuple = ()) -> DataFrame:
    """Apply a user's function to every frame; made once per task. A failure goes on in ``error``."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = load_function(function, args) if isinstance(function, str) else lambda key, image: function(image)
        for part in parts:
            pixels, errors = [], []
            for v, h, w, key, error in zip(part["pixels"], part["height"], part["width"], part["name"], part["error"], strict=True):
                if isinstance(error, str):
                    pixels.append(None)
                    errors.append(error)
                    continue
                try:
                    pixels.append(np.asarray(apply(key, np.asarray(v, float).reshape(int(h), int(w))), float).ravel())
                    errors.append(None)
                except Exception as wrong:  # noqa: BLE001
                    pixels.append(None)
                    errors.append(f"{type(wrong).__name__}: {wrong}")
            part["pixels"], part["error"] = pixels, errors
            yield part

    names = [c.split()[0] for c in FRAMES.split(", ")]
    return frames.select(*names).mapInPandas(run, FRAMES)


def surface_tracking(frames: DataFrame, reference: DataFrame, params: Surface = Surface(), wave_length: float | None = None) -> DataFrame:
    """Heights of a surface: phases of fringe images, made continuous in time, and turned into heights."""
    phases = surface.process_frames(frames, params.k_x, params.slicer, params.red_factor)
    row = reference.select("height", "width").first()
    joined = surface.continuous_frames(phases, row["height"] // 20 // params.red_factor, row["width"] // 2 // params.red_factor)
    length = wave_length or params.pix_size * row["width"] / params.k_x
    height = lambda v: surface.height_of(v, params.distance_object, params.distance_lens, length) - params.offset
    return surface.reset_borders(joined.withColumn("pixels", F.transform("pixels", height)), params.borders)


def steps(table: DataFrame, operators: list[tuple[str, Callable]], column: str = "value") -> DataFrame:
    """Run column functions one after another; a row that fails keeps the first message and skips the rest.

    An operator is (name, function of the column giving (value, error or null)).
    """
    out = table if "error" in table.columns else table.withColumn("error", F.lit(None).cast("string"))
    for name, f in operators:
        value, wrong = f(F.col(column))
        failed = F.when(F.col("error").isNull() & wrong.isNotNull(), F.concat(F.lit(f"{name}: "), wrong))
        out = out.withColumn("_e", F.coalesce("error", failed)).withColumn(column, F.when(F.col("_e").isNull(), value)).withColumn("error", F.col("_e")).drop("_e")
    return out


class Pipeline:
    """Named steps from a table to a table; ``describe`` gives their graph in dot."""

    def __init__(self, name: str):
        self.name, self.steps = name, []

    def add(self, name: str, f: Callable[[DataFrame], DataFrame]) -> Pipeline:
        self.steps.append((name, f))
        return self

    def run(self, table: DataFrame) -> DataFrame:
        for _, f in self.steps:
            table = table.transform(f)
        return table

    def describe(self) -> str:
        names = ["input", *(n for n, _ in self.steps)]
        return f"digraph {self.name} {{\n" + "".join(f'  "{a}" -> "{b}";\n' for a, b in zip(names, names[1:], strict=False)) + "}\n"


def save(vectors: DataFrame, path: str, how: str = "new_dir") -> None:
    sinks.write_vectors(vectors, path, how)
