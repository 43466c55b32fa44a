"""Run logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line of our logs: time, work, key, event (start or end).
LINE = r"^(\d+(?:\.\d+)?)\s+(\S+)\s+(\S+)\s+(start|end)\s*$"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Events of log files: t, name, key, event; other lines are left out."""
    lines = spark.read.text(path).where(F.col("value").rlike(LINE))
    part = lambda k: F.regexp_extract("value", LINE, k)
    return lines.select(part(1).cast("double").alias("t"), part(2).alias("name"), part(3).alias("key"), part(4).alias("event"))


def newest(paths: DataFrame, column: str = "path") -> DataFrame:
    """The last path in the order of names."""
    return paths.agg(F.max(column).alias(column))


def number_of(text: str):
    """A word as a number, null for others."""
    return F.expr(f"try_cast({text} AS DOUBLE)")


def duration_text(seconds):
    """``25.50 s`` under a minute, else ``HH:MM:SS``."""
    whole = F.floor(seconds)
    return F.when(seconds < 60, F.format_string("%.2f s", seconds)).otherwise(F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60))
