"""What the operators of this subpackage share: the shared folder, UTF-8 columns as arrays, hashing, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task turns into arrays at once; a longer text is handled alone.
CHUNK_BYTES = 1 << 20

U64 = np.uint64


#: Bytes of input files that make a hash bucket of documents or keys, which one task holds whole.
BUCKET_BYTES = 32 << 20


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the least number of key ranges or hash buckets that operators use."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(df: DataFrame, text: str, bucket: int = BUCKET_BYTES) -> int:
    """Hash buckets for the rows of a table: one for each ``bucket`` bytes of its files, the session's partitions at least.

    Where the plan doesn't know the size of its files, the bytes of the ``text`` column are counted.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    weight = sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))
    if weight >= 1 << 60:
        weight = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    return max(partitions(df.sparkSession), -(-weight // bucket))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset a session on one machine, as in tests, gets a folder of its own; on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if not found and not context.master.startswith("local"):
        found = context.getCheckpointDir()
        if not found:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = getattr(context, "_velofield_dir", None)
        if not found:
            found = context._velofield_dir = tempfile.mkdtemp(prefix="velofield-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; Spark removes the files once the frame is no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/velofield-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _later_removed(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _later_removed(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext

    def remove() -> None:
        if context._jsc is not None:
            try:
                target = context._jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
            except Exception:  # noqa: BLE001  the session may be gone already
                pass

    atexit.register(remove)


# --- text columns as arrays -------------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each value starts in them (one more entry than values); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


def chunks(batches: Iterator[pa.RecordBatch], text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``limit`` bytes together."""
    for batch in batches:
        _, starts = utf8(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(starts, starts[at] + limit, side="right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def binaries(data: bytes | np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column from one buffer and the start of each value."""
    buffer = pa.py_buffer(data if isinstance(data, bytes) else np.ascontiguousarray(data).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32).tobytes()), buffer])


def nullable(kind: pa.DataType) -> pa.DataType:
    """The type with fields that may all be null, as the types that Spark's functions declare."""
    if pa.types.is_struct(kind):
        return pa.struct([pa.field(f.name, nullable(f.type)) for f in kind])
    if pa.types.is_map(kind):
        return pa.map_(nullable(kind.key_type), nullable(kind.item_type))
    if pa.types.is_list(kind):
        return pa.list_(nullable(kind.value_type))
    return kind


# --- hashing ----------------------------------------------------------------------------------------------------------

_ODD = U64(0x9E3779B97F4A7C15)
_BASE = U64(0xD6E8FEB86659FD93)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def mix_int(x: int) -> int:
    """``mix`` of one number, as a Python int."""
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], U64))[0])


def table(size: int, seed: int) -> np.ndarray:
    """Random 64-bit numbers, the same in every process."""
    return mix((np.arange(size, dtype=U64) + U64(1)) * _ODD + U64(seed))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the rolling base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            full = np.full(size, base, U64)
            full[0] = 1
            _powers[k] = np.multiply.accumulate(full)
    return _powers[0], _powers[1]


class Prefixes:
    """Hashes of any stretches of a sequence of 64-bit values, from one pass of prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end]
        h -= self.sums[start]
        h *= self.down[start]
        h += (end - start).astype(U64) * _ODD
        return mix(h)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 ... of every stretch, one stretch after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


def pieces(size: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours whose sizes are about ``most`` together; what is larger is alone."""
    upto, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield slice(at, to)
        at = to


def equal_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which stretches of ``size`` bytes, at ``a`` and at ``b``, have the same bytes; no size is 0."""
    same = np.zeros(len(size), bool)
    for part in pieces(size, 1 << 20):
        n = size[part]
        same[part] = np.logical_and.reduceat(data[ranges(a[part], n)] == data[ranges(b[part], n)], np.cumsum(n) - n)
    return same


# --- packed arrays between steps -------------------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def cells(t: pa.Table, name: str, kind: str) -> np.ndarray:
    """All values of a column of packed arrays, one row after another."""
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in t.column(name)] or [np.zeros(0, kind)])


def split_by(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(key, that key's part of each array) in the order of the keys."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    cut = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    parts = [np.split(a[order], cut[1:]) for a in arrays]
    for n, at in enumerate(cut):
        yield int(sorted_[at]), [p[n] for p in parts]


def hash_partition(label: np.ndarray, n: int) -> np.ndarray:
    """The partition of ``n`` that Spark's hash partitioning deals an integer to (Murmur3 with seed 42)."""
    turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    k = turn(label.astype(np.int32).view(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
    h ^= h >> np.uint32(16)
    return h.view(np.int32).astype(np.int64) % n


def even_labels(n: int, most: int = 4096) -> np.ndarray:
    """A label for each of ``n`` buckets, such that hash partitioning of the labels puts one bucket into each partition.

    Beyond ``most`` buckets labels are just numbers: with so many partitions uneven ones don't matter.
    """
    if n > most:
        return np.arange(n, dtype=np.int32)
    found, at = np.full(n, -1, np.int32), 0
    while (found < 0).any():
        label = np.arange(at, at + 16 * n, dtype=np.int32)
        part, first = np.unique(hash_partition(label, n), return_index=True)
        new = found[part] < 0
        found[part[new]] = label[first[new]]
        at += 16 * n
    return found


def bucket_label(column, labels: np.ndarray):
    """The label of the bucket of a key, as a column."""
    bucket = F.pmod(F.xxhash64(column), F.lit(len(labels))).cast("int")
    if len(labels) > 1 and labels[1] == 1 and labels[0] == 0 and labels[-1] == len(labels) - 1:
        return bucket
    return F.element_at(F.array(*[F.lit(int(x)) for x in labels]), bucket + 1)


def small(n: int) -> str:
    """The smallest unsigned type for numbers below ``n``."""
    return "<u1" if n <= 1 << 8 else "<u2" if n <= 1 << 16 else "<u4"


# --- connected components ---------------------------------------------------------------------------------------------


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node, component), component the smallest node reachable.

    ``edges`` has two columns of one ordered type. Loops and edges with a null end link nothing; repeated edges count
    once; nodes without edges are not in the result; an empty table gives an empty table. Star contraction by
    DataFrame operations: in each round every node sends its larger, then its smaller neighbours to its smallest one, so a
    path shortens by a factor each round; a hub's links are spread by the join, which Spark splits where it is skewed.
    Each round is checkpointed in the shared folder.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"), F.col(a).eqNullSafe(F.col(b)).alias("same"), (F.col(a).isNull() | F.col(b).isNull()).alias("open"))
    links = checkpointed(pairs.where(~F.col("same") & ~F.col("open")).select("a", "b").distinct())
    seen = _digest(links)
    for _ in range(rounds):
        if seen[0] == 0:
            break
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lows.select("a", F.col("m").alias("b")))
        links = checkpointed(small.distinct())
        now = _digest(links)
        if now == seen:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select("b", "b").distinct())
        seen = now
    if seen[0]:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _digest(links: DataFrame) -> tuple:
    """Number of links and a checksum that doesn't depend on their order."""
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def ranked(df: DataFrame, *keys: str, name: str = "rank") -> DataFrame:
    """Add each row's place (from 0) in the order of ``keys`` over all rows; checkpointed.

    Ranges are sorted where they lie; only the number of rows of each range goes to the driver.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = checkpointed(placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))))
    before, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in placed.groupBy("_part").agg(F.count("*").alias("n")).collect()):
        before.append((part, total))
        total += n
    shift = F.broadcast(spark.createDataFrame(before, "_part long, _before long"))  # a row per range
    return placed.join(shift, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")
