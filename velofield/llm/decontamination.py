"""Benchmark decontamination with one Aho-Corasick automaton (operator 5)."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velofield.llm.shared import written

WINDOW = 10
#: Bytes of benchmark text for one automaton, which has up to ten times as many nodes; a larger benchmark is dealt into parts
#: of about this size, and texts are scanned once for each part.
PART_BYTES = 1 << 20
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    """A-Z lower-cased, then the stretches of ASCII letters, digits and characters beyond ASCII."""
    return _WORD.findall(text.translate(_LOWER)) if text else []


def windows_of(words: list[str], size: int = WINDOW) -> list[str]:
    """All windows of ``size`` consecutive words; the whole item where it has fewer; none for an item without words."""
    if not words:
        return []
    return [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]


def automaton(items: list[tuple[int, str | None]], size: int = WINDOW):
    """An automaton over the windows of all items; each has its number of words and the items it comes from."""
    import ahocorasick

    found: dict[str, set[int]] = {}
    for item, text in items:
        if item is not None:
            for window in windows_of(words_of(text), size):
                found.setdefault(f" {window} ", set()).add(item)
    machine = ahocorasick.Automaton()
    for window, owners in found.items():
        machine.add_word(window, (window.count(" ") - 1, len(window), tuple(owners)))
    machine.make_automaton()
    return machine if found else None


_made: dict[str, object] = {}


def _automaton_of(shared, size: int):
    """The automaton of a broadcast part of the benchmark; a Python process makes it once and holds one at a time."""
    name, items = shared.value
    if (key := f"{name} {size}") not in _made:
        _made.clear()
        _made[key] = automaton(items, size)
    return _made[key]


def hits(machine, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
    """(maximal runs of words that windows cover, from and to; items found)."""
    items: set[int] = set()
    runs: list[tuple[int, int]] = []
    if machine is None or not words:
        return runs, items
    line = f" {' '.join(words)} "
    at = word = 0
    for end, (count, _, owners) in machine.iter(line):
        word += line.count(" ", at, end)  # spaces before the window's last one: the words up to its end
        at = end
        runs.append((word - count, word))
        items.update(owners)
    return merged(runs), items


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(machine, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
    """(words, runs of words that are hit, items found)."""
    words = words_of(text)
    return len(words), *hits(machine, words)


def spans_of(text: str | None, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Characters of the original text that runs of words cover."""
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUNS_SQL = "array<struct<start:long,end:long>>"


def _pairs(runs: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": b} for a, b in runs]


def _found(rows: DataFrame, shared, size: int) -> DataFrame:
    """(row, runs, items) of the texts (row, text) that hold a window of the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton_of(shared, size)
        for batch in batches:
            found = [(row, *scan(machine, text.as_py())[1:]) for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            found = [(row, _pairs(runs), sorted(map(str, items))) for row, runs, items in found if items]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], kind) for c, kind in enumerate((pa.int64(), _RUNS, pa.list_(pa.string())))], names=["row", "runs", "items"])

    return rows.select("row", "text").mapInArrow(run, f"row long, runs {_RUNS_SQL}, items array<string>")


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, with_clean: bool = False, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Words of documents that lie in a window of ``size`` consecutive words of a benchmark item.

    One automaton over the normalised windows of all items scans each normalised text once; hits are mapped back to the
    original's characters. The benchmark's size is measured first: a part of ``part_bytes`` of text goes to every task, and
    a larger benchmark is dealt by a hash of the item into such parts, for each of which texts are scanned once; what a
    text's scans have found is put together by row. Returns doc_id, n_words, n_hit, items (sorted as strings), spans (start
    and end character of each maximal run of hit words) and, ``with_clean``, the text without these runs.

    Null and empty texts have no words and no hits; an item without words or id finds nothing; an item shorter than a window
    is one window; repeated items and rows count each; empty tables give no rows, or no hits; other columns are not looked at.
    """
    parts = _parts(docs, benchmark, item_col, item_text, part_bytes)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    one = parts[0] if len(parts) == 1 else None
    if one is None:
        rows = written(source.withColumn("row", F.monotonically_increasing_id()), "texts")
        found = [written(_found(rows, part, size), "leaks") for part in parts]
        every = reduce(DataFrame.union, found).groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        source = rows.join(every, "row", "left").select("doc_id", "text", "runs", "items")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = None if one is None else _automaton_of(one, size)
        for batch in batches:
            out: list[list] = [[] for _ in range(4 + with_clean)]
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                words = words_of(text)
                if one is None:
                    runs = merged([(x["start"], x["end"]) for x in batch.column(2)[k].as_py() or ()])
                    items = batch.column(3)[k].as_py() or []
                else:
                    runs, items = hits(machine, words)
                spans = spans_of(text, runs)
                for cell, value in zip(out, (len(words), sum(b - a for a, b in runs), sorted(map(str, items)), _pairs(spans), without(text, spans) if with_clean else None), strict=False):
                    cell.append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), _RUNS, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in zip(out, kinds, strict=False))], names=["doc_id", "n_words", "n_hit", "items", "spans", *(["clean"] if with_clean else [])])

    return source.mapInArrow(find, f"doc_id long, n_words long, n_hit long, items array<string>, spans {_RUNS_SQL}" + ", clean string" * with_clean)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents, all columns, without those that hold a window of a benchmark item.

    A null, empty or wordless text holds none and stays, whatever its other columns; repeated rows go or stay together; an
    empty benchmark takes nothing out, and an empty table stays empty. Parts of a large benchmark are scanned for one after
    another, in what the parts before have left.
    """
    at = docs.columns.index(text_col)

    def left(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = _automaton_of(shared, size)
            for batch in batches:
                yield batch.filter(pa.array([not scan(machine, x.as_py())[2] for x in batch.column(at)], pa.bool_()))

        return rows.mapInArrow(run, docs.schema)

    parts = _parts(docs, benchmark, item_col, item_text, part_bytes)
    for part in parts[:-1]:
        docs = written(left(docs, part), "clean")
    return left(docs, parts[-1])


def _parts(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, part_bytes: int) -> list:
    """The benchmark's items for every task, in broadcast parts of about ``part_bytes`` of text; one at least."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    weight = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-weight // part_bytes))
    found = []
    for k in range(n):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else items
        found.append(docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r["item"], r["text"]) for r in own.collect()])))
    return found


def without(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the spans."""
    if not spans:
        return text
    at, parts = 0, []
    for a, b in spans:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]])


def digest_of_items(items) -> F.Column:
    """Lower-case hex SHA-256 of the items, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


def items_sha256(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
