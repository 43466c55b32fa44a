"""Deduplication of content-defined chunks of lines (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velofield.llm.shared import U64, Prefixes, bucket_label, buckets, cells, chunks, equal_bytes, even_labels, mix, nullable, pack, ranges, small, split_by, table, utf8

#: Lines whose rolling hash decides on a boundary, and one in how many lines is one.
WINDOW, SPACING = 2, 3
_BYTES, _OTHER_BYTES = table(256, 37), table(256, 41)


class LineChunks:
    """The chunks of lines of many texts: where each starts and ends in the bytes, its text, its number there, its hashes.

    A line ends with its line feed. Of the lines that aren't blank, a boundary follows one whose rolling hash, over the last
    ``window`` lines, is the least among its neighbours, ``spacing`` lines with itself; so lines put in or taken out move the
    boundaries near them only. Between boundaries a chunk ends after every two lines, as long as two are left. So each chunk
    has two or three lines that aren't blank, but for texts with fewer.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, window: int, spacing: int):
        n = len(raw)
        ends = np.unique(np.concatenate([np.flatnonzero(raw == 10) + 1, starts[1:]]))
        ends = ends[ends > 0] if n else np.zeros(0, np.int64)
        begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        doc = np.searchsorted(starts, begins, side="right") - 1
        prefixes = Prefixes(_BYTES[raw])
        line = prefixes.of(begins, ends)
        full = self._words(raw, begins, ends)
        stop = np.zeros(len(line), bool)
        stop[self._stops(line, doc, np.flatnonzero(full), window, spacing)] = True
        last = np.ones(len(line), bool)
        last[:-1] = doc[1:] != doc[:-1]
        close = np.flatnonzero(stop | last)
        first = np.concatenate([[0], close[:-1] + 1]) if len(close) else close
        blank = np.concatenate([[0], np.cumsum(full)])
        self.start, self.end, self.doc = begins[first], ends[close], doc[first]
        self.lines = close - first + 1
        self.full_lines = blank[close + 1] - blank[first]
        head = np.concatenate([[True], self.doc[1:] != self.doc[:-1]]) if len(close) else np.zeros(0, bool)
        order = np.arange(len(close))
        self.number = order - np.maximum.accumulate(np.where(head, order, 0)) if len(close) else order
        self.several = self.full_lines > 1
        self.hash = prefixes.of(self.start, self.end)
        self.other = np.zeros(0, U64)
        self._raw = raw

    @staticmethod
    def _stops(line: np.ndarray, doc: np.ndarray, at: np.ndarray, window: int, spacing: int) -> np.ndarray:
        """The lines that close a chunk before its text's end, of the lines ``at``, which have more than white space."""
        n = len(at)
        if n < 2:
            return at[:0]
        doc, value = doc[at], line[at]
        near = lambda k: doc[k:] == doc[: n - k]  # noqa: E731  lines k apart that are in one text
        rolling = np.zeros(n, U64)
        for back in range(window):  # the same weights wherever the window is; nothing precedes a text
            before = np.zeros(n, U64)
            if back < n:
                before[back:] = np.where(near(back), value[: n - back], U64(0))
            rolling = mix(rolling + before * U64(2 * back + 3))
        head, tail = np.ones(n, bool), np.ones(n, bool)
        head[1:], tail[:-1] = ~near(1), ~near(1)
        inner = ~head & ~tail & ~np.append(tail[1:], True)  # leaves two lines on both sides
        for k in range(1, min(max(1, spacing // 2), n - 1) + 1):
            inner[k:] &= ~near(k) | (rolling[k:] < rolling[:-k])
            inner[:-k] &= ~near(k) | (rolling[:-k] <= rolling[k:])
        order, close = np.arange(n), inner | tail
        begin = np.maximum.accumulate(np.where(np.append(True, close[:-1]), order, 0))
        end = np.minimum.accumulate(np.where(close, order, n)[::-1])[::-1]
        upto, after = order - begin + 1, end - order
        from_end = head[begin] & inner[end]  # what precedes a text's first boundary is counted back from it
        pairs = (after >= 2) & np.where(from_end, (after % 2 == 0) & (upto >= 2), upto % 2 == 0)
        return at[inner | pairs]

    @staticmethod
    def _words(raw: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which lines have more than white space."""
        upto = np.concatenate([[0], np.cumsum(raw > 32)])
        return upto[ends] > upto[begins]

    def second(self, which: np.ndarray) -> np.ndarray:
        """An independent hash of the chosen chunks."""
        return Prefixes(_OTHER_BYTES[self._raw]).of(self.start[which], self.end[which])


class Steps:
    """The steps of the operator on bounded parts of the corpus."""

    def __init__(self, labels: np.ndarray, window: int, spacing: int):
        self.labels, self.buckets, self.window, self.spacing = labels, len(labels), window, spacing
        self.kind = small(self.buckets)
        self.number = {int(x): k for k, x in enumerate(labels)}

    def announce(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket of hashes: the chunk's hash, the bucket of documents that has it, and how often, up to 255."""
        found, held = [], 0

        def out() -> pa.RecordBatch:
            hash_, home = (np.concatenate([f[c] for f in found]) for c in range(2))
            order = np.lexsort((home, hash_))
            hash_, home = hash_[order], home[order]
            at = np.flatnonzero(np.concatenate([[True], (hash_[1:] != hash_[:-1]) | (home[1:] != home[:-1])])) if len(hash_) else order
            count = np.minimum(np.diff(np.append(at, len(hash_))), 255).astype(np.uint8)
            rows = [(int(self.labels[k]), *pack(*x)) for k, x in split_by((hash_[at] % U64(self.buckets)).astype(np.int64), hash_[at], home[at].astype(self.kind), count)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 4))], names=["k", "hash", "home", "count"])

        for batch in chunks(batches, 2):
            raw, starts = utf8(batch.column(2))
            own = LineChunks(raw, starts, self.window, self.spacing)
            found.append((own.hash[own.several], np.array([self.number[x] for x in batch.column(0).to_pylist()], np.int32)[own.doc[own.several]]))
            held += len(found[-1][0])
            if held > 1 << 20:
                yield out()
                found, held = [], 0
        if held:
            yield out()

    ANNOUNCED = "k int, hash binary, home binary, count binary"

    def answer(self, t: pa.Table) -> pa.Table:
        """For each bucket of documents: its hashes that occur several times."""
        hash_, home, count = cells(t, "hash", "<u8"), cells(t, "home", self.kind).astype(np.int64), cells(t, "count", np.uint8).astype(np.int64)
        order = np.argsort(hash_, kind="stable")
        hash_, home, count = hash_[order], home[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], hash_[1:] != hash_[:-1]]))
        several = np.repeat(np.add.reduceat(count, at), np.diff(np.append(at, len(hash_)))) > 1
        rows = [(int(self.labels[b]), *pack(h)) for b, (h,) in split_by(home[several], hash_[several])]
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["home", "hash"])

    ANSWERED = "home int, hash binary"

    def _candidates(self, docs: pa.Table, known: np.ndarray) -> Iterator[tuple]:
        known = np.unique(known)
        for batch in chunks(iter(docs.drop_columns(["home"]).combine_chunks().to_batches()), 1):
            raw, starts = utf8(batch.column(1))
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            own = LineChunks(raw, starts, self.window, self.spacing)
            which = np.flatnonzero(own.several & ~null[own.doc] & np.isin(own.hash, known))
            yield batch, raw, starts, ids, null, own, which, own.second(which) if len(which) else np.zeros(0, U64)

    def send(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """A bucket's distinct chunks that may repeat, each with its bytes and its first place."""
        import zstandard

        parts = []
        for _, raw, _, ids, _, own, which, second in self._candidates(docs, cells(answers, "hash", "<u8")):
            size = own.end[which] - own.start[which]
            parts.append((own.hash[which], second, ids[own.doc[which]], own.number[which], size, raw[ranges(own.start[which], size)]))
        rows = []
        if parts and sum(len(p[0]) for p in parts):
            hash_, second, ids, number, size, data = (np.concatenate([p[c] for p in parts]) for c in range(6))
            begin = np.cumsum(size) - size
            order = np.lexsort((number, ids, second, hash_))
            one = order[np.concatenate([[True], (hash_[order][1:] != hash_[order][:-1]) | (second[order][1:] != second[order][:-1])])]
            home = docs.column("home")[0].as_py()
            squeeze = zstandard.ZstdCompressor(level=1).compress
            for k, (w,) in split_by((hash_[one] % U64(self.buckets)).astype(np.int64), one):
                rows.append((int(self.labels[k]), home, *pack(hash_[w], second[w], ids[w], number[w], size[w]), squeeze(data[ranges(begin[w], size[w])].tobytes())))
        names = ["k", "home", "hash", "second", "doc", "number", "size", "bytes"]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c < 2 else pa.binary()) for c in range(8)], names=names)

    SENT = "k int, home int, hash binary, second binary, doc binary, number binary, size binary, bytes binary"

    def compare(self, t: pa.Table) -> pa.Table:
        """For each sender: the first place of its chunks, where their bytes equal those of the first one."""
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        hash_, second, doc, number, size = (cells(t, n, k) for n, k in (("hash", "<u8"), ("second", "<u8"), ("doc", "<i8"), ("number", "<i8"), ("size", "<i8")))
        data = np.concatenate([np.frombuffer(unpack(x.as_py()), np.uint8) for x in t.column("bytes")])
        sender = np.repeat(np.array(t.column("home").to_pylist(), np.int64), [len(x.as_buffer()) // 8 for x in t.column("hash")])
        begin = np.cumsum(size) - size
        order = np.lexsort((number, doc, second, hash_))
        new = np.concatenate([[True], (hash_[order][1:] != hash_[order][:-1]) | (second[order][1:] != second[order][:-1])])
        first = order[np.flatnonzero(new)][np.cumsum(new) - 1]  # of each in the order, the chunk it is held against
        equal = size[order] == size[first]
        for at in np.flatnonzero(equal & ~new):
            a, b, n = begin[order[at]], begin[first[at]], size[order[at]]
            equal[at] = np.array_equal(data[a : a + n], data[b : b + n])
        order, first = order[equal], first[equal]
        rows = [(h, *pack(hash_[x], second[x], doc[y], number[y])) for h, (x, y) in split_by(sender[order], order, first)]
        names = ["home", "hash", "second", "doc", "number"]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], pa.binary() if c else pa.int32()) for c in range(5)], names=names)

    COMPARED = "home int, hash binary, second binary, doc binary, number binary"

    @staticmethod
    def _equal(parts: list[tuple], mine: list[np.ndarray], known: np.ndarray, doc: np.ndarray, number: np.ndarray) -> list[np.ndarray]:
        """By part: the chunks to remove, those with a first place elsewhere and, byte for byte, the text that was sent for it.

        ``mine`` are the candidates' keys, ``known`` the sorted keys of chunks with their first places. What was sent is the
        bucket's smallest of a key, so all others of the bucket are held against that one.
        """
        if not len(known) or not sum(map(len, mine)):
            return [np.zeros(0, np.int64) for _ in parts]
        key = np.concatenate(mine)
        place = np.minimum(np.searchsorted(known, key), len(known) - 1)
        hit = known[place] == key
        which = np.concatenate([w for *_, w, _ in parts])
        at = np.concatenate([np.full(len(m), k) for k, m in enumerate(mine)])
        ids = np.concatenate([i[own.doc[w]] for _, _, _, i, _, own, w, _ in parts])
        count = np.concatenate([own.number[w] for *_, own, w, _ in parts])
        size = np.concatenate([own.end[w] - own.start[w] for *_, own, w, _ in parts])
        begin = np.concatenate([own.start[w] for *_, own, w, _ in parts]) + np.cumsum([0, *(len(raw) for _, raw, *_ in parts)])[at]
        raw = np.concatenate([r for _, r, *_ in parts])
        order = np.lexsort((count, ids, key))
        head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        sent = np.empty(len(key), np.int64)
        sent[order] = order[np.flatnonzero(head)][np.cumsum(head) - 1]
        other = np.flatnonzero(hit & (size == size[sent]) & ((doc[place] != ids) | (number[place] != count)))
        other = other[equal_bytes(raw, begin[other], begin[sent[other]], size[other])]
        return [which[other[at[other] == k]] for k in range(len(parts))]

    def remove(self, docs: pa.Table, found: pa.Table) -> pa.Table:
        """The texts without the chunks whose first place is elsewhere."""
        hash_, second, doc, number = (cells(found, n, k) for n, k in (("hash", "<u8"), ("second", "<u8"), ("doc", "<i8"), ("number", "<i8")))
        both = mix(hash_ ^ mix(second))
        by = np.argsort(both)
        both, doc, number = both[by], doc[by], number[by]
        rest: list[pa.Array] = []
        out: dict[str, list] = {n: [] for n in ("doc_id", "text", "n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")}
        parts = list(self._candidates(docs, hash_))
        mine = [mix(own.hash[which] ^ mix(other)) for _, _, _, _, _, own, which, other in parts]
        for (batch, raw, starts, ids, null, own, _, _), equal in zip(parts, self._equal(parts, mine, both, doc, number), strict=True):
            gone = np.zeros(len(own.start), bool)
            gone[equal] = True
            upto = np.searchsorted(own.doc, np.arange(len(ids) + 1))
            lines, removed, chunks_gone = (np.concatenate([[0], np.cumsum(x)]) for x in (own.lines, own.lines * gone, gone))
            for k in range(len(ids)):
                a, b = upto[k], upto[k + 1]
                text = batch.column(1)[k].as_py()
                if chunks_gone[b] > chunks_gone[a]:
                    stay = np.flatnonzero(~gone[a:b]) + a
                    text = raw[ranges(own.start[stay], own.end[stay] - own.start[stay])].tobytes().decode("utf-8", "replace")
                for name, value in zip(out, (None if null[k] else int(ids[k]), text, int(lines[b] - lines[a]), int(b - a), int(chunks_gone[b] - chunks_gone[a]), int(removed[b] - removed[a])), strict=True):
                    out[name].append(value)
            rest += [batch.column(2).cast(nullable(batch.column(2).type))] if batch.num_columns > 2 else []
        table_ = pa.Table.from_arrays([pa.array(v, pa.string() if n == "text" else pa.int64()) for n, v in out.items()], names=list(out))
        return table_.append_column("rest", pa.chunked_array(rest)) if rest else table_


def dedup_lines(docs: DataFrame, window: int = WINDOW, spacing: int = SPACING, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove chunks of several lines that repeat anywhere: doc_id, text (what is left), n_lines, n_chunks, n_removed_chunks, n_removed_lines.

    Rolling hashes over line hashes cut each text into chunks. A chunk with at least two lines that aren't blank, and whose
    bytes occur more than once, stays only where it is first: in the smallest document, at the first place. Hashes choose
    the candidates, which are counted over all documents; then bytes are compared: those of a bucket's documents with the one
    chunk of them that the bucket sends, and what buckets send with each other. A chunk whose hashes, but not its bytes, are
    another's stays.

    Null texts stay null and empty ones empty; a text without line feeds is one line and never loses it; a text of one line
    always stays; rows with the same id and the same text count as one document and keep the same chunks; rows with a null
    id stay whole and remove nothing; an empty table gives an empty one; other columns are not looked at, but those named in
    ``carry`` come back in the struct ``rest``.
    """
    rest = [F.struct(*(docs[c] for c in carry)).alias("rest")] if carry else []
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *rest)
    n = buckets(source, "text")
    labels = even_labels(n)
    steps = Steps(labels, window, spacing)
    source = source.select(bucket_label("doc_id", labels).alias("home"), *source.columns)
    announced = source.select("home", "doc_id", "text").where("doc_id is not null").mapInArrow(steps.announce, steps.ANNOUNCED)
    answers = announced.groupBy("k").applyInArrow(lambda t: steps.answer(t), steps.ANSWERED)
    at_home = source.repartition(n, "home")
    schema = "doc_id long, text string, n_lines long, n_chunks long, n_removed_chunks long, n_removed_lines long"
    schema += f", rest {source.schema['rest'].dataType.simpleString()}" if carry else ""
    sent = at_home.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(lambda d, a: steps.send(d, a), steps.SENT)
    compared = sent.groupBy("k").applyInArrow(lambda t: steps.compare(t), steps.COMPARED)
    return at_home.groupBy("home").cogroup(compared.groupBy("home")).applyInArrow(lambda d, f: steps.remove(d, f), schema)


def chunks_of(text: str, window: int = WINDOW, spacing: int = SPACING) -> list[str]:
    """The chunks of one text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    own = LineChunks(raw, np.array([0, len(raw)]), window, spacing)
    return [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(own.start, own.end, strict=True)]
