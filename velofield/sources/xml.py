"""Calibrations and instructions in XML."""

from __future__ import annotations

import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velofield.operators.calibration import Tsai


def numbers(column) -> F.Column:
    """The numbers of a text separated by white space."""
    return F.transform(F.split(F.trim(column), r"\s+"), lambda x: x.cast("double"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Calibration points of XML files (``PointCoord`` elements: X Y Z in centimetres, x y in pixels): path, i, X, Y, Z, x, y, in metres."""
    texts = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("text"))
    cells = texts.select("path", F.posexplode(F.regexp_extract_all("text", F.lit(r"<PointCoord[^>]*>([^<]*)</PointCoord"), F.lit(1))).alias("i", "_p"))
    values = cells.withColumn("_v", numbers(F.col("_p")))
    return values.select("path", "i", *[(F.col("_v")[k] / 100).alias(n) for k, n in enumerate("XYZ")], F.col("_v")[3].alias("x"), F.col("_v")[4].alias("y"))


def read_tsai(text: str) -> Tsai:
    """A camera from an XML text with fx_fy, Cx__Cy, kc, Tx_Ty_Tz, R and slices."""
    root = ElementTree.fromstring(text)
    values = lambda tag: [float(x) for e in root.iter() if _plain(e.tag) == tag for x in (e.text or "").split()]
    rows = lambda tag: tuple(tuple(float(x) for x in (e.text or "").split()) for e in root.iter() if _plain(e.tag) == tag)
    interface = values("InterfaceCoord")
    angles = rows("SliceAngle")
    return Tsai(
        f=tuple(values("fx_fy")) or (1.0, 1.0), c=tuple(values("Cx__Cy")) or (0.0, 0.0), kc=(values("kc") or [0.0])[0], t=tuple(values("Tx_Ty_Tz")) or (0.0, 0.0, 1.0), r=tuple(values("R")),
        slices=rows("SliceCoord"), angles=angles or None, interface=interface[2] if interface else None, index=(values("RefractionIndex") or [1.0])[0],
    )


def _plain(tag: str) -> str:
    return re.sub(r"_\d+$", "", tag)


def read_instructions(text: str) -> dict:
    """The series and parameters that an instruction file asks for."""
    root = ElementTree.fromstring(text)

    def first(tag: str, default: str | None = None) -> str | None:
        return next((e.text.strip() for e in root.iter() if e.tag == tag and e.text), default)

    folder, *rest = [x.strip() for x in (first("InputTable") or "").split("&")]
    found = {"path_dir": "/".join([folder, *[x for x in rest[:1] if x]]), "path_file": "".join(rest[1:]), "first_i": first("first_i"), "last_i": first("last_i"), "incr_i": first("incr_i", "1"), "pair_indices": first("PairIndices"), "subset": pair_subset(first("PairIndices"))}
    box = [int(float(x)) for x in (first("CorrBoxSize") or "").split()]
    found["crop"] = tuple(b + b % 2 for b in box[1::-1]) or None
    found["passes"] = 2 if first("CheckCiv2") == "1" else 1
    return found


def pair_subset(text: str | None) -> str:
    """How frames are paired: steps in the first index, in the second one, or two letters."""
    if not text:
        return "pairs"
    if m := re.match(r"Di=\s*(-?\d+)\|(-?\d+)", text):
        return f"i+{m[1]}:i+{int(m[2]) + 1}:{max(1, int(m[2]) - int(m[1]))}"
    if m := re.match(r"Dj=\s*(-?\d+)\|(-?\d+)", text):
        return f"i,{m[1]}:{int(m[2]) + 1}"
    if m := re.match(r"j=\s*(\w)-(\w)", text):
        return f"i,{ord(m[1]) - 97 if m[1].isalpha() else int(m[1]) - 1}:{ord(m[2]) - 96 if m[2].isalpha() else int(m[2])}"
    return "pairs"
