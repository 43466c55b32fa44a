"""Frames from image files, from vectors and from particles; series, subsets and what is still to be computed."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velofield.schema import FRAMES


def frames_from_vectors(vectors: DataFrame, height: int = 8, width: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Vectors read as frames: the id is the frame number, the components are row-major pixels."""
    return vectors.where(F.size(vector_col) == height * width).select(
        F.lit("vectors").alias("series_id"), F.col(id_col).cast("long").alias("i"), F.lit(None).cast("string").alias("j"),
        F.format_string("im%06d", F.col(id_col)).alias("name"), F.lit(None).cast("string").alias("path"),
        F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit("float32").alias("dtype"),
        F.col(vector_col).cast("array<double>").alias("pixels"), F.lit(None).cast("string").alias("error"),
    )


def pixels_of(frames: DataFrame) -> DataFrame:
    """Long form: i, pos, iy, ix, v."""
    return frames.select("i", "width", F.posexplode("pixels").alias("pos", "v")).select("i", "pos", F.floor(F.col("pos") / F.col("width")).cast("int").alias("iy"), (F.col("pos") % F.col("width")).alias("ix"), "v")


# --- image files ------------------------------------------------------------------------------------------------------


def decode(data: bytes) -> np.ndarray:
    """A gray image from PGM (binary or text), PNG (not interlaced) or BMP (8, 24 or 32 bits, not compressed)."""
    if data[:2] in (b"P5", b"P2"):
        return _pgm(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] == b"BM":
        return _bmp(data)
    raise ValueError("unknown image format")


def _pgm(data: bytes) -> np.ndarray:
    head = re.match(rb"P([25])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
    if not head:
        raise ValueError("bad PGM header")
    width, height, most = (int(x) for x in head.groups()[1:])
    kind = ">u2" if most > 255 else np.uint8
    if head[1] == b"2":
        values = np.array(data[head.end() :].split(), int)
    else:
        values = np.frombuffer(data, kind, height * width, head.end())
    return values.reshape(height, width).astype(np.uint16 if most > 255 else np.uint8)


def _png(data: bytes) -> np.ndarray:
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    planes = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if planes is None or depth not in (8, 16) or interlaced:
        raise ValueError("PNG kind not read")
    step = planes * depth // 8
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        out[y] = above = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, step)
    image = out.view(">u2") if depth == 16 else out
    image = image.reshape(height, width, planes)
    return _gray(image[..., :3] if planes >= 3 else image[..., :1], np.uint16 if depth == 16 else np.uint8)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """Undo a PNG line filter."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:
        return np.add.accumulate(line.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
    out = np.zeros(len(line) + step, np.int64)
    up = np.concatenate([np.zeros(step, np.int64), above.astype(np.int64)])
    for k in range(step, len(out)):
        a, b, c = out[k - step], up[k], up[k - step]
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[k] = (int(line[k - step]) + guess) & 255
    return out[step:].astype(np.uint8)


def _bmp(data: bytes) -> np.ndarray:
    start, _, width, height, _, bits, packed = struct.unpack("<IIiiHHI", data[10:34])
    if packed not in (0, 3) or bits not in (8, 24, 32):
        raise ValueError("BMP kind not read")
    line = (width * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        colours = np.frombuffer(data, np.uint8, -1, 14 + struct.unpack("<I", data[14:18])[0])
        palette = colours[: 4 * ((start - 14 - struct.unpack("<I", data[14:18])[0]) // 4)].reshape(-1, 4)
        return _gray(palette[rows][..., 2::-1], np.uint8) if len(palette) else rows
    return _gray(rows.reshape(abs(height), width, bits // 8)[..., 2::-1], np.uint8)


def _gray(planes: np.ndarray, kind: type) -> np.ndarray:
    if planes.shape[-1] == 1 or (planes[..., 0] == planes[..., -1]).all():
        return planes[..., 0].astype(kind)
    return np.rint(planes @ np.array([0.299, 0.587, 0.114])).astype(kind)


def encode_pgm(image: np.ndarray) -> bytes:
    most = 65535 if image.max(initial=0) > 255 else 255
    return b"P5\n%d %d\n%d\n" % (image.shape[1], image.shape[0], most) + image.astype(">u2" if most > 255 else np.uint8).tobytes()


def encode_png(image: np.ndarray) -> bytes:
    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    deep = image.max(initial=0) > 255
    lines = image.astype(">u2" if deep else np.uint8)
    body = b"".join(b"\0" + line.tobytes() for line in lines)
    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16 if deep else 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(body)) + part(b"IEND", b"")


def list_series(spark: SparkSession, path: str) -> DataFrame:
    """The files of a glob: series_id, i, j, name, path, from the last number in a name and a letter after it."""
    return with_indices(spark.read.format("binaryFile").load(path).select("path"))


def with_indices(files: DataFrame) -> DataFrame:
    """Add series_id, i, j and name to a table of paths."""
    stem = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1)
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.select(F.regexp_replace(stem, r"\d+[a-z]?$", "").alias("series_id"), F.regexp_extract(stem, r"(\d+)[a-z]?$", 1).cast("long").alias("i"), F.nullif(F.regexp_extract(stem, r"\d+([a-z])$", 1), F.lit("")).alias("j"), "name", *files.columns)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Frames from the files of a glob; a file that can't be read has its message in ``error`` and no pixels."""
    files = with_indices(spark.read.format("binaryFile").load(path).select("path", "content"))

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples(index=False):
                try:
                    image = decode(bytes(r.content))
                    rows.append((r.series_id, r.i, r.j, r.name, r.path, *image.shape, str(image.dtype), image.ravel().astype(float), None))
                except Exception as error:  # noqa: BLE001  a failure is a value of the row
                    rows.append((r.series_id, r.i, r.j, r.name, r.path, None, None, None, None, f"{r.path}: {error}"))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FRAMES.split(", ")])

    return files.mapInPandas(read, FRAMES)


# --- series and subsets -----------------------------------------------------------------------------------------------


def subsets(series: DataFrame, str_subset: str = "pairs", start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """The groups of frames that are processed together: key, slot, i, j.

    ``pairs``: neighbouring frames, or frames a and b of each number where the series has letters; ``all1by1``: each frame;
    ``i:i+n`` with an optional ``:s``: n frames from i on, every s-th; ``i+a:i+b``: frames i + a ... i + b - 1; a second
    index after a comma chooses letters by number (``0:2``, ``1``). Groups that miss a frame are left out.
    """
    chosen = series.select("i", "j").distinct()
    if str_subset == "pairs":
        lettered = chosen.where("j is not null").limit(1).count() > 0
        str_subset = "i,0:2" if lettered else "i:i+2"
    if str_subset == "all1by1":
        str_subset = "i"
    first, _, second = (x.strip() for x in str_subset.partition(","))
    spread = _spread(first)
    keys = chosen.select(F.col("i").alias("key")).distinct()
    low = start if isinstance(start, int) else None
    if low is None:
        keys = keys.crossJoin(F.broadcast(keys.agg(F.min("key").alias("_low"))))
        keys = keys.where((F.col("key") - F.col("_low")) % step == 0).drop("_low")
    else:
        keys = keys.where((F.col("key") >= low) & ((F.col("key") - low) % step == 0))
    keys = keys if stop is None else keys.where(F.col("key") < stop)
    letters = _letters(second)
    wanted = keys.select("key", F.posexplode(F.array(*[F.struct((F.col("key") + d).alias("i"), F.lit(x).cast("string").alias("j")) for d in spread for x in letters])).alias("slot", "_f")).select("key", "slot", "_f.i", "_f.j")
    there = chosen.select(F.col("i").alias("_i"), F.col("j").alias("_j"))
    found = wanted.join(there, (F.col("i") == F.col("_i")) & (F.col("j").eqNullSafe(F.col("_j")) | F.col("j").isNull()), "left")
    full = found.groupBy("key").agg(F.count("_i").alias("n")).where(F.col("n") == len(spread) * len(letters)).select("key")
    return found.join(full, "key").select("key", "slot", "i", F.col("_j").alias("j"))


def _spread(text: str) -> list[int]:
    """Offsets from the group's number."""
    parts = [p.strip() for p in text.split(":")]
    value = lambda p: 0 if p == "i" else int(p[1:].replace("+", "") or 0) if p.startswith("i") else int(p)
    if len(parts) == 1:
        return [value(parts[0])]
    return list(range(value(parts[0]), value(parts[1]), int(parts[2]) if len(parts) > 2 else 1))


def _letters(text: str) -> list[str | None]:
    if not text:
        return [None]
    parts = [p.strip() for p in text.split(":")]
    numbers = [int(parts[0])] if len(parts) == 1 else range(int(parts[0] or 0), int(parts[1]), int(parts[2]) if len(parts) > 2 else 1)
    return [chr(97 + n) for n in numbers]


def distinct_paths(groups: DataFrame, files: DataFrame) -> DataFrame:
    """Each file that some group needs, once."""
    needed = groups.select(F.col("i").alias("_i"), F.col("j").alias("_j")).distinct()
    return files.join(needed, (F.col("i") == F.col("_i")) & F.col("j").eqNullSafe(F.col("_j")), "left_semi").select("name", "path").distinct()


def previous_couples(series: DataFrame) -> DataFrame:
    """Each frame with the one before it; the first frame with itself."""
    from pyspark.sql import Window as W

    order = W.partitionBy("series_id").orderBy("i")
    return series.select("series_id", "i", F.lag("name").over(order).alias("_before"), "name").select("series_id", "i", F.coalesce("_before", "name").alias("name0"), F.col("name").alias("name1"))


def missing(expected: DataFrame, done: DataFrame, key: str = "name") -> DataFrame:
    """What is expected and not there yet."""
    return expected.join(done.select(key).distinct(), key, "left_anti")


def only_listed(expected: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """What is expected and in an index file."""
    return expected.join(listed.select(key).distinct(), key, "left_semi")


def index_of_line(line: Column) -> Column:
    """``(1, 0)`` as an array of integers."""
    return F.from_json(F.translate(line, "()", "[]"), "array<int>")


# --- synthetic frames -------------------------------------------------------------------------------------------------


def particle_pair(displacement: tuple[float, float], particles: int, shape: tuple[int, int], shape1: tuple[int, int] | None = None, size: float = 2**0.5, noise: float = 0.0, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two images of Gaussian particles, the second moved by (dx, dy); images of other shapes share their centre."""
    random = np.random.default_rng(seed)
    shape1 = shape if shape1 is None else shape1
    dx, dy = displacement
    margin = int(np.ceil(max(abs(dx), abs(dy)) + 4 * size))
    height, width = shape
    scale = (height + 2 * margin) * (width + 2 * margin) / (height * width)
    n = int(round(particles * scale))
    y, x = random.uniform(-margin, height + margin, n), random.uniform(-margin, width + margin, n)

    def draw(moved: tuple[float, float]) -> np.ndarray:
        rows = np.exp(-(((np.arange(height)[:, None] - y - moved[1]) / size) ** 2))
        columns = np.exp(-(((np.arange(width)[:, None] - x - moved[0]) / size) ** 2))
        return rows @ columns.T

    im0, im1 = draw((0, 0)), draw((dx, dy))
    if noise:
        im0, im1 = (im + random.uniform(0, noise, im.shape) for im in (im0, im1))
    a, b = (height - shape1[0]) // 2, (width - shape1[1]) // 2
    return im0, im1[a : a + shape1[0], b : b + shape1[1]]


def synthetic_pairs(spark: SparkSession, n: int, displacement: tuple[float, float] = (3.3, 5.8), shape: tuple[int, int] = (128, 128), particles: int | None = None) -> DataFrame:
    """A table of ``n`` synthetic pairs, each seeded by its key."""
    count = particles or shape[0] * shape[1] // 16

    def make(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key in part["id"]:
                a, b = particle_pair(displacement, count, shape, seed=int(key))
                rows.append((key, f"im{key:05d}a", f"im{key:05d}b", *shape, a.ravel(), b.ravel(), None))
            yield pd.DataFrame(rows, columns=["key", "name0", "name1", "height", "width", "px0", "px1", "error"])

    from velofield.schema import PAIRS

    return spark.range(n, numPartitions=max(1, min(n, spark.sparkContext.defaultParallelism))).mapInPandas(make, PAIRS)
