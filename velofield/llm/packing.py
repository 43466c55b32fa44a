"""Packing along a space-filling curve (operator 1)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velofield.llm.shared import U64, checkpointed, chunks, partitions, utf8, written
from velofield.llm.tokens import Encoder, Words

DIMENSIONS, BITS = 3, 11


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n x d), each coordinate below 2**bits."""
    x = points.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the curve's turns, from the coarsest cells to the finest
        low = q - 1
        for i in range(d):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[d - 1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def project(words: Words) -> np.ndarray:
    """Each document's hashed word vector, projected to a few dimensions and put on the curve's grid.

    A word's hash gives its random weight in every dimension, so the sum over a document's words is a random projection of
    its hashed count vector. Words of any script count; the grid holds every mean of weights. Texts without words are at 0.
    """
    points = _means(words)
    if words.hard.any():
        points[words.hard] = _means(words.of_hard())
    return points


def _means(words: Words) -> np.ndarray:
    n = len(words.per_doc) - 1
    count = np.maximum(np.diff(words.per_doc), 1)
    points = np.zeros((n, DIMENSIONS), np.int64)
    for k in range(DIMENSIONS):
        weight = ((words.hash >> U64(16 * k)) & U64(0xFF)).astype(np.int64)
        upto = np.zeros(len(weight) + 1, np.int64)
        np.cumsum(weight, out=upto[1:])
        mean = np.diff(upto[words.per_doc]) / count - 127.5
        points[:, k] = (mean / 128 + 1) * (1 << (BITS - 1))
    points[np.diff(words.per_doc) == 0] = 0
    return points


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, key, n, ids): ids as little-endian unsigned numbers of 16 bits, or 32 for vocabularies beyond."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        kind = "<u4" if encoder.wide or end_id >= 1 << 16 else "<u2"
        for batch in chunks(batches, 2):
            raw, starts = utf8(batch.column(2))
            ids, first, words = encoder.encode(raw, starts)
            n = np.diff(first) + 1
            out = np.insert(ids, first[1:], end_id).astype(kind)
            edges = np.concatenate([[0], np.cumsum(n)]) * out.itemsize
            column = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hilbert_key(project(words))), pa.array(n), column.cast(pa.binary())], names=["doc_id", "row", "key", "n", "ids"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return written(source.mapInArrow(encode, "doc_id long, row long, key long, n long, ids binary"), "tokens")


def cuts(total: int, size: int) -> tuple[int, list[tuple[int, int]]]:
    """Where the last, incomplete sequence starts, and the (start, length) of the power-of-two sequences it is cut into."""
    start = at = total - total % size
    tail = []
    for bit in range(size.bit_length(), -1, -1):
        if (total - start) & (1 << bit):
            tail.append((at, 1 << bit))
            at += 1 << bit
    return start, tail


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack the token ids of all documents into sequences, documents that are near on a Hilbert curve side by side.

    A document's ids are the tokenizer's, then ``end_id``. Documents are range-sorted by the Hilbert key of their projected
    hashed word vectors (ties, as of exact copies, by id, so a large group of copies spreads over many ranges); their ids
    form one stream that is cut every ``size`` ids. The rest is cut into sequences of powers of two, so nothing is padded
    when ``size`` is a power of two itself. Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, ``with_ids``, the piece's ids.

    Null and empty texts have ``end_id`` alone; texts of any length are cut where sequences end; repeated rows, also with
    one id, are packed each; a null id stays null; an empty table gives no pieces; other columns are not looked at.
    """
    spark = docs.sparkSession
    tokens = tokenised(docs, tokenizer, end_id, id_col, text_col)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n), batch.column(1)], names=["row", "part", "local", "n"])
            at = int(upto[-1]) if len(n) else at

    ranged = tokens.select("key", "doc_id", "row", "n").repartitionByRange(partitions(spark), "key", "doc_id", "row").sortWithinPartitions("key", "doc_id", "row")
    placed = checkpointed(ranged.select("row", "n").mapInArrow(place, "row long, part int, local long, n long"))
    totals = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row per range
    before, total = [], 0
    for part, n in totals:
        before.append((part, total))
        total += n
    shift = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    starts = placed.join(shift, "part").select("row", (F.col("before") + F.col("local")).alias("at"))
    last, tail = cuts(total, size)
    tail_starts = np.array([a for a, _ in tail], np.int64)
    wide = ["ids binary"] if with_ids else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, at, n, ids in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                data = np.frombuffer(ids.as_buffer(), np.uint8)
                own = data.view("<u2" if len(data) == 2 * n else "<u4")
                edges = [at, *range(at - at % size + size, min(at + n, last) + (at + n > last), size)] if at < last else [at]
                edges += [int(x) for x in tail_starts if at < x < at + n and x > edges[-1]]
                for a, b in zip(edges, [*edges[1:], at + n], strict=True):
                    k = int(np.searchsorted(tail_starts, a, side="right")) - 1
                    sequence, offset = (a // size, a % size) if a < last else (last // size + k, a - int(tail_starts[k]))
                    piece = own[a - at : b - at].astype("<u4").tobytes()
                    rows.append((doc, a - at, b - a, zlib.crc32(piece), n, sequence, offset, *([piece] if with_ids else [])))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "ids" else pa.int64()) for c, x in zip(columns, names, strict=True)], names=names)

    joined = tokens.select("doc_id", "row", "n", "ids").join(starts, "row").select("doc_id", "at", "n", "ids")
    return joined.mapInArrow(cut, ", ".join(["doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long", *wide]))
