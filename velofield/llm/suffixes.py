"""Exact substring deduplication by two-stage suffix sorting (operator 2)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velofield.llm.shared import U64, Prefixes, bucket_label, buckets, cells, chunks, equal_bytes, even_labels, pack, ranges, small, split_by, table, utf8

#: Bytes of a repeated string, and of the grams whose smallest hash in such a string decides where it is compared.
LENGTH, GRAM = 50, 20
#: Smallest hashes that more documents than this have are compared window by window, so that none gathers in one task.
HOT_DOCUMENTS = 2_000
#: Windows of a stretch, at most; longer ones (of blanks, say) are cut, so a size or a place in one fits a small type.
STRETCH = 1 << 15
#: Bytes that one suffix array is built of, about.
BLOCK_BYTES = 2 << 20
_BYTES = table(256, 23)
_TOP = U64(0xFFFFFFFFFFFFFFFF)
_LOW48 = U64((1 << 48) - 1)


# --- two-stage suffix sorting -----------------------------------------------------------------------------------------


def _words(s: np.ndarray, spare: int) -> np.ndarray:
    """The eight bytes from each place as one number that sorts as they do; zeros follow the end."""
    w = np.concatenate([s, np.zeros(spare + 8, np.uint8)]).astype(U64)
    for shift in (1, 2, 4):
        w = (w[: len(w) - shift] << U64(8 * shift)) | w[shift:]
    return w


def _sorted_to(at: np.ndarray, w: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, eight at a time; only ties are sorted further."""
    at = at[np.argsort(w[at], kind="stable")]
    key = w[at]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if len(at) else np.zeros(0, np.int64)
    for more in range(8, depth, 8):
        tied = np.zeros(len(at), bool)
        if len(at) > 1:
            equal = group[1:] == group[:-1]
            tied[1:] |= equal
            tied[:-1] |= equal
        where = np.flatnonzero(tied)
        if not len(where):
            break
        key = w[at[where] + more]
        order = np.lexsort((key, group[where]))
        at[where] = at[where][order]
        key, g = key[order], group[where][order]
        new = np.concatenate([[True], (g[1:] != g[:-1])])
        split = np.concatenate([[False], (key[1:] != key[:-1])]) & ~new
        step = np.zeros(len(at), np.int64)
        step[where[split]] = 1
        group = group + np.cumsum(step)
    return at


def suffix_array(s: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes of a byte string in the order of (at least) their first ``depth`` bytes.

    Only suffixes smaller than their successors are sorted directly. The others follow from one scan over the buckets of
    first bytes: a suffix that is larger than its successor comes, in its bucket, in the order of these successors. Suffixes
    with equal first ``depth`` bytes may stand in any order.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    w = _words(s, depth + 8)
    equal = s[:-1] == s[1:]
    change = np.where(equal, n - 1, np.arange(n - 1))
    change = np.minimum.accumulate(change[::-1])[::-1]
    small = np.zeros(n, bool)
    rises = np.concatenate([s[:-1] < s[1:], [False]])
    small[: n - 1] = rises[change]
    direct = _sorted_to(np.flatnonzero(small), w, depth)
    edges = np.searchsorted(s[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[s[n - 1]].append(np.array([n - 1]))  # larger than the empty suffix that follows it
    done: list[np.ndarray] = []

    def induce(part: np.ndarray, c: int) -> np.ndarray:
        """Hand the predecessors of sorted suffixes on to their buckets; return those of this bucket."""
        before = part[part > 0] - 1
        before = before[~small[before]]
        first = s[before]
        own = before[first == c]
        first, before = first[first != c], before[first != c]
        if len(before):
            order = np.argsort(first, kind="stable")
            first, before = first[order], before[order]
            cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
            for d, piece in zip(first[cut], np.split(before, cut[1:]), strict=True):
                waiting[d].append(piece)
        return own

    for c in range(256):
        part = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        waiting[c] = []
        while len(part):
            done.append(part)
            part = induce(part, c)
        part = direct[edges[c] : edges[c + 1]]
        if len(part):
            done.append(part)
            induce(part, c)
    return np.concatenate(done)


def common_prefixes(s: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, ``most`` at most; 0 for the first."""
    w = _words(s, most + 8)
    found = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    for at in range(0, most, 8):
        if not len(live):
            break
        x = w[order[live] + at] ^ w[order[live - 1] + at]
        size = np.zeros(len(live), np.int64)
        for k in range(8):
            size += x < (U64(1) << U64(8 * (7 - k)))
        found[live] += size
        live = live[size == 8]
    return np.minimum(found, most)


# --- where equal strings must be compared -----------------------------------------------------------------------------


class Stretches:
    """Stretches of neighbouring windows with one smallest gram hash, over the texts of a chunk: maximal ones, but cut after
    each STRETCH windows.

    Equal windows have equal smallest hashes, so it suffices to compare stretches that share it. ``first`` and ``last`` are
    window starts, ``key`` the hash's low 48 bits, ``doc`` the text's number.
    """

    def __init__(self, raw: np.ndarray, starts: np.ndarray, length: int, gram: int):
        n = len(raw)
        self.gram, self.grams = gram, None
        empty = np.zeros(0, np.int64)
        self.first, self.last, self.doc, self.key = empty, empty, empty, np.zeros(0, U64)
        if n < length:
            return
        at = np.arange(n - gram + 1)
        least = Prefixes(_BYTES[raw]).of(at, at + gram)
        self.grams = Prefixes(least)
        width = length - gram + 1
        step = 1
        while 2 * step <= width:
            least = np.minimum(least[: len(least) - step], least[step:])
            step *= 2
        if step < width:
            rest = width - step
            least = np.minimum(least[: len(least) - rest], least[rest:])
        inside = np.zeros(len(least) + 1, np.int32)  # windows that lie in one text
        sizes = np.diff(starts)
        fits = np.flatnonzero(sizes >= length)
        np.add.at(inside, starts[fits], 1)
        np.add.at(inside, starts[fits + 1] - length + 1, -1)
        inside = np.cumsum(inside)[:-1] > 0
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        new[starts[:-1][starts[:-1] < len(least)]] = True
        self.first = np.flatnonzero(inside & new)
        ends = inside.copy()
        ends[:-1] &= new[1:] | ~inside[1:]
        self.last = np.flatnonzero(ends)
        parts = (self.last - self.first) // STRETCH + 1
        if (parts > 1).any():
            whole_last = np.repeat(self.last, parts)
            self.first = np.repeat(self.first, parts) + STRETCH * ranges(np.zeros(len(parts), np.int64), parts)
            self.last = np.minimum(self.first + STRETCH - 1, whole_last)
        self.doc = np.searchsorted(starts, self.first, side="right") - 1
        self.key = least[self.first] & _LOW48

    def texts(self, raw: np.ndarray, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the chosen stretches one after another, and the size of each."""
        size = self.last[which] - self.first[which] + length
        return raw[ranges(self.first[which], size)], size

    def contents(self, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
        """A hash of the bytes of each stretch from window ``first`` to ``last``.

        It rolls over the hashes of grams, not over bytes: texts made to collide under one polynomial don't under this.
        """
        return self.grams.of(first, last + length - self.gram + 1) if self.grams else np.zeros(0, U64)


def _halves(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit numbers as 32 and 16 bits."""
    return (key & U64(0xFFFFFFFF)).astype("<u4"), (key >> U64(32)).astype("<u2")


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(U64) | (high.astype(U64) << U64(32))


class Repeats:
    """The steps of the operator; each runs on a bounded part of the corpus, and packed arrays travel between them.

    Documents and hashes are dealt to buckets; ``labels`` names them in rows, so that each bucket is a partition of its own.
    """

    def __init__(self, labels: np.ndarray, length: int, gram: int, hot: int):
        self.labels, self.buckets, self.length, self.gram, self.hot = labels, len(labels), length, gram, hot
        self.kind = small(self.buckets)
        self.place = small(STRETCH + length)  # of sizes of stretches and of places in them
        self.number = {int(x): k for k, x in enumerate(labels)}

    # 1: which smallest hashes do several documents have?

    def announce(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each bucket of hashes: the hash, the bucket of documents that has it, and how many of these it has seen."""
        key, doc, home, seen, held = [], [], [], 0, 0
        for batch in chunks(batches, 2):
            raw, starts = utf8(batch.column(2))
            found = Stretches(raw, starts, self.length, self.gram)
            key.append(found.key)
            doc.append(found.doc + seen)
            numbers = np.array([self.number[x] for x in batch.column(0).to_pylist()], np.int32)
            home.append(numbers[found.doc])
            seen += batch.num_rows
            held += len(found.key)
            if held > 1 << 20:
                yield from self._announced(np.concatenate(key), np.concatenate(doc), np.concatenate(home))
                key, doc, home, held = [], [], [], 0
        if held:
            yield from self._announced(np.concatenate(key), np.concatenate(doc), np.concatenate(home))

    def _announced(self, key: np.ndarray, doc: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((doc, home, key))
        key, doc, home = key[order], doc[order], home[order]
        other = np.concatenate([[True], (key[1:] != key[:-1]) | (home[1:] != home[:-1])])
        fresh = other | np.concatenate([[True], doc[1:] != doc[:-1]])
        at = np.flatnonzero(other)
        count = np.minimum(np.add.reduceat(fresh.astype(np.int64), at), 255).astype(np.uint8)
        key, home = key[at], home[at].astype(self.kind)
        rows = [(int(self.labels[k]), *pack(*_halves(h), b, n)) for k, (h, b, n) in split_by((key % U64(self.buckets)).astype(np.int64), key, home, count)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 5))], names=["k", "low", "high", "home", "count"])

    ANNOUNCED = "k int, low binary, high binary, home binary, count binary"

    def answer(self, t: pa.Table) -> pa.Table:
        """For each bucket of documents: its hashes that several documents have, and whether very many have them."""
        key = _whole(cells(t, "low", "<u4"), cells(t, "high", "<u2"))
        home, count = cells(t, "home", self.kind).astype(np.int64), cells(t, "count", np.uint8).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, home, count = key[order], home[order], count[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        total = np.repeat(np.add.reduceat(count, at) if len(at) else count, np.diff(np.append(at, len(key))))
        several = total > 1
        rows = [(int(self.labels[b]), *pack(*_halves(h), f)) for b, (h, f) in split_by(home[several], key[several], (total[several] > self.hot).astype(np.uint8))]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], pa.binary() if c else pa.int32()) for c in range(4)], names=["home", "low", "high", "hot"])

    ANSWERED = "home int, low binary, high binary, hot binary"

    # 2: send the stretches with such a hash to where all that share it are sorted

    def _stretches(self, docs: pa.Table, known: np.ndarray | None, hot: np.ndarray) -> Iterator[tuple]:
        """By chunk: texts, their starts, ids, and the stretches to compare as (window start, last, text number, content, key, hot)."""
        rows = docs.select(["doc_id", "text"]).combine_chunks().to_batches()
        for batch in chunks(iter(rows), 1):
            raw, starts = utf8(batch.column(1))
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            linked = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)
            found = Stretches(raw, starts, self.length, self.gram)
            hit, is_hot = linked[found.doc], np.zeros(len(found.key), bool)
            if known is None:  # all, with the hot hashes themselves
                is_hot = hit & np.isin(found.key, hot)
            elif len(known):
                place = np.minimum(np.searchsorted(known, found.key), len(known) - 1)
                hit &= known[place] == found.key
                is_hot[hit] = hot[place[hit]]
            else:
                hit[:] = False
            first, last, doc, key = found.first[hit & ~is_hot], found.last[hit & ~is_hot], found.doc[hit & ~is_hot], found.key[hit & ~is_hot]
            size = found.last[is_hot] - found.first[is_hot] + 1
            single = ranges(found.first[is_hot], size)  # each window on its own
            first, last, doc = np.concatenate([first, single]), np.concatenate([last, single]), np.concatenate([doc, np.repeat(found.doc[is_hot], size)])
            key, flag = np.concatenate([key, np.repeat(found.key[is_hot], size)]), np.arange(len(first)) >= len(first) - len(single)
            yield raw, starts, ids, linked, first, last, doc, found.contents(first, last, self.length), key, flag

    def send(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        """The distinct stretches of a bucket of documents, each with the smallest and largest document that has it."""
        import zstandard

        known, hot = _whole(cells(answers, "low", "<u4"), cells(answers, "high", "<u2")), cells(answers, "hot", np.uint8) > 0
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        parts = []
        home = docs.column("home")[0].as_py() if docs.num_rows else 0
        for raw, _, ids, _, first, last, doc, content, key, flag in self._stretches(docs, known, hot):
            size = last - first + self.length
            parts.append((content, key, flag, ids[doc], size, raw[ranges(first, size)]))
        if not parts or not sum(len(p[0]) for p in parts):
            return pa.Table.from_arrays([pa.array([], pa.int32() if c < 2 else pa.binary()) for c in range(9)], names=self.NAMES)
        content, key, flag, ids, size, data = (np.concatenate([p[c] for p in parts]) for c in range(6))
        order = np.lexsort((ids, content))
        content = content[order]
        at = np.flatnonzero(np.concatenate([[True], content[1:] != content[:-1]]))
        low, high = ids[order[at]], ids[order[np.append(at[1:], len(order)) - 1]]
        begin = np.cumsum(size) - size
        which, content = order[at], content[at]
        # a hash that very many have goes, by window, to the bucket of the window's own hash
        tag = np.where(flag[which], content, key[which])
        bucket = (tag % U64(self.buckets)).astype(np.int64)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        rows = []
        for k, (c, g, a, b, w) in split_by(bucket, content, tag, low, high, which):
            hot_keys = np.unique(key[w[flag[w]]])
            spread = (g >> U64(20)).astype(np.uint16)  # chooses the block that a stretch is sorted in
            rows.append((int(self.labels[k]), home, *pack(c), *(squeeze(x) for x in pack(spread, a, b - a, size[w].astype(self.place), data[ranges(begin[w], size[w])], hot_keys))))
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], pa.int32() if c < 2 else pa.binary()) for c in range(9)], names=self.NAMES)

    NAMES = ["k", "home", "content", "spread", "low", "more", "size", "bytes", "hot"]
    SENT = "k int, home int, content binary, spread binary, low binary, more binary, size binary, bytes binary, hot binary"

    # 3: sort, and answer with the smallest document of each window

    def compare(self, t: pa.Table) -> pa.Table:
        """For each sender: runs of windows of a stretch whose string is also in a document smaller than its largest one."""
        import zstandard

        unpack, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        opened = lambda name, kind: np.concatenate([np.frombuffer(unpack(x.as_py()), kind) for x in t.column(name)])
        content = cells(t, "content", "<u8")
        sender = np.repeat(np.array(t.column("home").to_pylist(), np.int64), [len(x.as_buffer()) // 8 for x in t.column("content")])
        spread, low, size = opened("spread", "<u2"), opened("low", "<i8"), opened("size", self.place).astype(np.int64)
        high = low + opened("more", "<i8")
        data = opened("bytes", np.uint8)
        begin = np.cumsum(size) - size
        order = np.lexsort((size, content))
        new = np.concatenate([[True], (content[order][1:] != content[order][:-1]) | (size[order][1:] != size[order][:-1])])
        later = np.flatnonzero(~new)
        new[later] = ~equal_bytes(data, begin[order[later]], begin[order[later - 1]], size[order[later]])
        at = np.flatnonzero(new)
        group = np.empty(len(order), np.int64)
        group[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(order))))
        least, one = np.minimum.reduceat(low[order], at), order[at]
        # whole hashes to a block: equal windows have equal hashes (or, by window, equal contents)
        blocks = max(1, int(size[one].sum()) // BLOCK_BYTES)
        block = spread[one].astype(np.int64) % blocks
        runs = []
        for _, (own,) in split_by(block, np.arange(len(one))):
            runs.append(self._runs(data, begin[one[own]], size[one[own]], least[own], own))
        stretch, a, b, smallest = (np.concatenate([r[c] for r in runs]) for c in range(4))
        # every sender of the stretch whose largest document is beyond the smallest one hears of the run
        by = np.argsort(stretch, kind="stable")
        stretch, a, b, smallest = stretch[by], a[by], b[by], smallest[by]
        lo, hi = np.searchsorted(stretch, group), np.searchsorted(stretch, group, side="right")
        copy = np.repeat(np.arange(len(group)), hi - lo)
        run = ranges(lo, hi - lo)
        told = smallest[run] < high[copy]
        copy, run = copy[told], run[told]
        hot = {h: unpack(x.as_py()) for h, x in zip(t.column("home").to_pylist(), t.column("hot"), strict=True)}
        answers = {h: x for h, x in split_by(sender[copy], content[copy], a[run].astype(self.place), (b - a)[run].astype(self.place), smallest[run])}
        rows = [(h, *pack(x[0]), *(squeeze(y) for y in pack(*x[1:])), hot[h]) for h, x in answers.items()]
        return pa.Table.from_arrays([pa.array([r[c] for r in rows], pa.binary() if c else pa.int32()) for c in range(6)], names=["home", "content", "start", "count", "smallest", "hot"])

    COMPARED = "home int, content binary, start binary, count binary, smallest binary, hot binary"

    def _runs(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray, least: np.ndarray, name: np.ndarray) -> tuple:
        """(stretch, first window, last window + 1, smallest document) of the maximal runs of windows with one smallest document."""
        start = np.cumsum(size + 1) - size - 1
        s = np.zeros(int((size + 1).sum()), np.uint8)
        s[ranges(start, size)] = data[ranges(begin, size)]
        windows = size - self.length + 1
        place = ranges(start, windows)
        owner = np.repeat(np.arange(len(size)), windows)
        number = np.full(len(s), -1, np.int64)
        number[place] = np.arange(len(place))
        order = suffix_array(s, self.length)
        order = order[number[order] >= 0]
        common = common_prefixes(s, order, self.length)
        at = np.flatnonzero(common < self.length)
        window = number[order]
        smallest = np.empty(len(place), np.int64)
        smallest[window] = np.repeat(np.minimum.reduceat(least[owner[window]], at), np.diff(np.append(at, len(order))))
        cut = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (smallest[1:] != smallest[:-1])]))
        end = np.append(cut[1:], len(place))
        a = place[cut] - start[owner[cut]]
        return name[owner[cut]], a, a + end - cut, smallest[cut]

    # 4: remove

    def remove(self, docs: pa.Table, found: pa.Table, with_kept: bool) -> pa.Table:
        """Digests of what is left of each document."""
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        opened = lambda name, kind: np.concatenate([np.frombuffer(unpack(x.as_py()), kind) for x in found.column(name)] or [np.zeros(0, kind)]).astype(np.int64)
        content, hot = cells(found, "content", "<u8"), np.unique(cells(found, "hot", "<u8"))
        start, stop, smallest = opened("start", self.place), opened("count", self.place), opened("smallest", "<i8")
        order = np.argsort(content, kind="stable")
        content, start, stop, smallest = content[order], start[order], (start + stop)[order], smallest[order]
        out: dict[str, list] = {n: [] for n in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
        for raw, starts, ids, linked, first, _, doc, own, _, _ in self._stretches(docs, None, hot):
            lo, hi = np.searchsorted(content, own), np.searchsorted(content, own, side="right")
            at = np.repeat(np.arange(len(own)), hi - lo)
            run = ranges(lo, hi - lo)
            late = smallest[run] < ids[doc[at]]
            at, run = at[late], run[late]
            edge = np.zeros(len(raw) + 1, np.int32)
            np.add.at(edge, first[at] + start[run], 1)
            np.add.at(edge, first[at] + stop[run] - 1 + self.length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            upto = np.concatenate([[0], np.cumsum(gone)])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            inner = starts[1:-1][starts[1:-1] < len(raw)]
            opens[inner] = gone[inner]
            spans = np.concatenate([[0], np.cumsum(opens)])
            for k in range(len(ids)):
                a, b = starts[k], starts[k + 1]
                n = int(upto[b] - upto[a])
                left = raw[a:b] if n == 0 else raw[a:b][~gone[a:b]]
                out["doc_id"].append(int(ids[k]) if linked[k] else None)
                out["n_bytes"].append(int(b - a))
                out["n_removed"].append(n)
                out["n_spans"].append(int(spans[b] - spans[a]))
                out["kept_sha256"].append(hashlib.sha256(left.tobytes()).hexdigest())
                if with_kept:
                    out["kept"].append(left.tobytes())
        if not with_kept:
            del out["kept"]
        kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
        return pa.Table.from_arrays([pa.array(v, kinds.get(n, pa.int64())) for n, v in out.items()], names=list(out))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT_DOCUMENTS, with_kept: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document with a smaller id.

    Texts are their UTF-8 bytes; strings are judged on the input. The corpus is dealt twice by hashes: documents by their id,
    and windows of ``length`` bytes by the smallest hash of the grams in them, so equal windows meet. Hashes that only one
    document has are dropped first; the bytes of the others are suffix-sorted in two stages, block by block, and adjacent
    common prefixes of ``length`` give the windows that are equal and the smallest document of each. A hash that more than
    ``hot`` documents have is dealt window by window instead, so no group gathers in a task; copies within a bucket are sent
    once. Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, ``with_kept``, the bytes that are left.

    Null and empty texts have no bytes; texts shorter than ``length`` are kept whole; rows with one id don't remove each
    other's strings; rows with a null id are kept whole and remove nothing; an empty table gives an empty one; other
    columns are not looked at.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = buckets(source, "text")
    labels = even_labels(n)
    steps = Repeats(labels, length, gram, hot)
    source = source.select(bucket_label("doc_id", labels).alias("home"), "doc_id", "text")
    announced = source.where("doc_id is not null").mapInArrow(steps.announce, steps.ANNOUNCED)
    answers = announced.groupBy("k").applyInArrow(lambda t: steps.answer(t), steps.ANSWERED)
    at_home = source.repartition(n, "home")
    sent = at_home.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(lambda d, a: steps.send(d, a), steps.SENT)
    compared = sent.groupBy("k").applyInArrow(lambda t: steps.compare(t), steps.COMPARED)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    return at_home.groupBy("home").cogroup(compared.groupBy("home")).applyInArrow(lambda d, f: steps.remove(d, f, with_kept), schema)
