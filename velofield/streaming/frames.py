"""Structured Streaming over frames and events."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream over the files of a Parquet table, a folder, one file or a pattern; how many files are taken at once bounds
    what waits downstream.
    """
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target) and files.getFileStatus(target).isFile():
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes a folder or a pattern, not a file: a pattern that only the file fits
    return source.parquet(path)


def working_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share, ``spark.checkpoint.dir``; on one machine, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(shared or tempfile.mkdtemp(prefix='velofield-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def finished(stream: DataFrame, folder: str | None = None, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there and return its result table.

    The result is Parquet in ``folder`` (see ``working_folder``), beside the stream's checkpoint; nothing passes the driver.
    In complete mode each batch writes the whole result to a folder of its own, and the last one counts; a batch that runs
    again after a failure replaces its own folder only.
    """
    spark, folder = stream.sparkSession, folder or working_folder(stream.sparkSession)
    out, last = f"{folder}/result", []
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "complete":

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/{number}")
            last[:] = [number]

        writer.foreachBatch(keep).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{out}/{last[0]}") if last else spark.createDataFrame([], stream.schema)
    writer.format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def running_mean(frames: DataFrame) -> DataFrame:
    """The mean of each pixel over all frames so far, ``total / n``: of ``frames`` that have the pixel, ``n`` have a value in it."""
    return frames.select(F.posexplode("pixels").alias("pos", "v")).groupBy("pos").agg(F.count("v").alias("n"), F.sum("v").alias("total"), F.count("*").alias("frames"))


def couples(frames: DataFrame) -> DataFrame:
    """Pairs of neighbouring frames as soon as both have arrived, by state per pair; a pair's state goes when it is complete."""

    def meet(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (None, None)
        first, second = held
        for part in parts:
            for r in part.itertuples(index=False):
                if r.slot == 0:
                    first = list(map(float, r.pixels))
                else:
                    second = list(map(float, r.pixels))
        if first is not None and second is not None:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "product": [sum(a * b for a, b in zip(first, second, strict=True))]})
        else:
            state.update((first, second))

    sent = frames.select(F.explode(F.array(F.struct(F.col("i").alias("key"), F.lit(0).alias("slot")), F.struct((F.col("i") - 1).alias("key"), F.lit(1).alias("slot")))).alias("k"), "pixels").select("k.key", "k.slot", "pixels")
    return sent.groupBy("key").applyInPandasWithState(meet, "key long, product double", "first array<double>, second array<double>", "append", GroupStateTimeout.NoTimeout)


def continuous_phase(phases: DataFrame) -> DataFrame:
    """Phases (series, t, phase) that arrive in order, without jumps: the state is each series' last corrected phase."""

    def chain(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for part in parts:
            part = part.sort_values("t")
            out = []
            for v in part["phase"]:
                if last is not None:
                    v = v - 2 * math.pi * math.ceil((abs(v - last) - math.pi) / (2 * math.pi)) * math.copysign(1, v - last) if abs(v - last) > math.pi else v
                last = v
                out.append(v)
            yield pd.DataFrame({"series": key[0], "t": part["t"], "corrected": out})
        state.update((last,))

    return phases.groupBy("series").applyInPandasWithState(chain, "series string, t long, corrected double", "last double", "append", GroupStateTimeout.NoTimeout)


def windowed_events(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; what is later than the watermark is left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
