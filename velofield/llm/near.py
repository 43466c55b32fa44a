"""Near-duplicate documents by SuperMinHash (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velofield.llm.shared import U64, Prefixes, binaries, checkpointed, chunks, connected_components, mix, partitions, pieces, ranges, table, utf8, written

#: A signature has BANDS x ROWS registers; a similar pair shares all registers of some band but for 2 in 100,000 at 0.8.
BANDS, ROWS = 28, 5
REGISTERS = BANDS * ROWS
#: Standard deviations that a signature may miss the similarity by before a pair is not compared in full.
DEVIATIONS = 5
#: Ids that are sent to every task, at most; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Members of a bucket, and bytes of their sets, that make a block; each pair of blocks of a large bucket is compared alone.
SIDE, SIDE_BYTES = 1024, 16 << 20

_LOWER = np.arange(256, dtype=np.int64)
_LOWER[65:91] += 32
_BYTES = table(256, 53)[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingles(raw: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of ``width`` words, one text after another in ascending order; where each text's start).

    Words are what white space separates, with A-Z in lower case. A text with fewer words, but some, has its whole sequence.
    """
    blank = _SPACE[raw]
    n, docs = len(raw), len(starts) - 1
    first, last = ~blank, ~blank
    if n:
        border = np.zeros(n, bool)
        border[starts[:-1][starts[:-1] < n]] = True
        first = ~blank & (border | np.concatenate([[True], blank[:-1]]))
        last = ~blank & np.concatenate([border[1:] | blank[1:], [True]])
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    word = Prefixes(_BYTES[raw]).of(begin, end)
    upto = np.searchsorted(begin, starts)
    words = np.diff(upto)
    count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    at = ranges(upto[:-1], count)
    doc = np.repeat(np.arange(docs), count)
    value = Prefixes(word).of(at, np.minimum(at + width, upto[doc + 1]))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(docs + 1))


def signatures(values: np.ndarray, starts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """SuperMinHash signatures (texts x registers): in round j each element puts rank j plus a random fraction into the
    j-th register of its own random permutation, and a register keeps the least. A text is done as soon as no register
    can get less: when all are below the round's number. Registers never reached (of empty sets) stay at the maximum.
    """
    docs = len(starts) - 1
    size = np.diff(starts)
    least = np.full(docs * registers, np.iinfo(np.uint64).max, U64)
    doc = np.repeat(np.arange(docs), size)
    element, place = values, None
    for j in range(registers):
        if not len(element):
            break
        fraction = mix(element + U64((2 * j + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) >> U64(11)
        k = j + (mix(element + U64((2 * j + 2) * 0xE7037ED1A0B428DB & 0xFFFFFFFFFFFFFFFF)) % U64(registers - j)).astype(np.int64)
        if place is None:
            target = k
        else:
            rows = np.arange(len(element))
            target = place[rows, k].astype(np.int64)
            place[rows, k] = place[:, j]
            place[:, j] = target
        np.minimum.at(least, doc * registers + target, (U64(j) << U64(53)) | fraction)
        done = least.reshape(docs, registers).max(axis=1) < (U64(j + 1) << U64(53))
        stay = ~done[doc]
        if place is None:
            element, doc, k = element[stay], doc[stay], k[stay]
            place = np.tile(np.arange(registers, dtype=np.uint16), (len(element), 1))  # each one's permutation so far
            place[np.arange(len(element)), k] = 0
            place[:, 0] = k
        elif not stay.all():
            element, doc, place = element[stay], doc[stay], place[stay]
    return least.reshape(docs, registers)


def sketches(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, f1, f2, sig): the number of distinct shingles, a fingerprint of their set, one byte of each register."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1, 1 << 19):
            raw, starts = utf8(batch.column(1))
            value, first = shingles(raw, starts, width)
            n = np.diff(first)
            sums = []
            for seed in (3, 5):
                upto = np.zeros(len(value) + 1, U64)
                np.cumsum(mix(value + U64(seed)), out=upto[1:])
                sums.append(mix(upto[first[1:]] - upto[first[:-1]] + n.astype(U64)).view(np.int64))
            byte = (mix(signatures(value, first)) >> U64(32)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), binaries(byte, np.arange(len(n) + 1) * REGISTERS)], names=["doc_id", "n", "f1", "f2", "sig"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(source.mapInArrow(sketch, "doc_id long, n long, f1 long, f2 long, sig binary"), "sketches")


def least_estimate(percent: int) -> float:
    """Share of equal signature bytes below which a pair can't have the similarity."""
    t = percent / 100
    return t - DEVIATIONS * (t * (1 - t) / REGISTERS) ** 0.5


class Tile:
    """A bucket's members, or two blocks of a large bucket's, in the order of their numbers of shingles.

    ``component`` is what earlier steps have linked each to, ``side`` its block: of two blocks only pairs across them are
    looked at. ``own`` is the bucket's band: a pair that meets in an earlier band too is left to that one.
    """

    def __init__(self, rep: np.ndarray, n: np.ndarray, component: np.ndarray, side: np.ndarray, sig: np.ndarray, percent: int, own: int = 0):
        self.order = np.argsort(n, kind="stable")
        self.rep, self.n, self.side = rep[self.order], n[self.order], side[self.order]
        self.sig = np.ascontiguousarray(sig[self.order])
        _, self.label, count = np.unique(component[self.order], return_inverse=True, return_counts=True)
        self.most = int(count.argmax())  # each pair across components has a member outside the largest one
        self.percent, self.own, self.cross = percent, own, len(np.unique(side)) > 1
        self.enough = int(np.flatnonzero(np.arange(REGISTERS + 1) / REGISTERS >= least_estimate(percent))[0])
        self.low = np.searchsorted(100 * self.n, percent * self.n)  # sizes too far apart can't be similar
        self.high = np.searchsorted(percent * self.n, 100 * self.n, side="right")

    def partners(self, i: int, few: np.ndarray) -> np.ndarray:
        """The members that may be similar to member ``i`` and are in another component now; each pair is asked for once."""
        at = np.arange(self.low[i], self.high[i])
        open_ = (self.label[at] != self.label[i]) & (~few[at] | (at > i))
        if self.cross:
            open_ &= self.side[at] != self.side[i]
        at = at[open_]
        if len(at):
            equal = self.sig[at] == self.sig[i]
            alike = np.count_nonzero(equal, axis=1) >= self.enough
            if self.own and alike.any():
                alike &= ~equal[:, : self.own * ROWS].reshape(len(at), self.own, ROWS).all(axis=2).any(axis=1)
            at = at[alike]
        return at

    def active(self) -> np.ndarray:
        """The places, in the order given, of the members that have a partner at all."""
        few = self.label != self.most
        found = np.zeros(len(few), bool)
        for i in np.flatnonzero(few):
            at = self.partners(i, few)
            found[at] = True
            found[i] |= len(at) > 0
        return self.order[found]

    def links(self, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        """Links that join the components of similar members, one for each joining; ``sets`` are in the order given.

        Full sets decide. Members that a link has joined aren't compared again, so a bucket of n similar members costs n.
        """
        few = self.label != self.most
        sets = [sets[k] for k in self.order]
        size = np.array([len(x) for x in sets], np.int64)
        upto = np.cumsum(size) - size
        _, word = np.unique(np.concatenate(sets), return_inverse=True)
        mark, found = np.zeros(int(word.max()) + 1, bool), []
        for i in np.flatnonzero(few):
            at = self.partners(i, few)
            mine = word[upto[i] : upto[i] + size[i]]
            mark[mine] = True
            for piece in pieces(size[at], 1 << 22):
                part = at[piece]
                part = part[self.label[part] != self.label[i]]
                if not len(part):
                    continue
                common = np.add.reduceat(mark[word[ranges(upto[part], size[part])]], np.cumsum(size[part]) - size[part], dtype=np.int64)
                similar = part[100 * common >= self.percent * (size[part] + size[i] - common)]
                for j in similar[np.unique(self.label[similar], return_index=True)[1]]:
                    found.append((int(self.rep[i]), int(self.rep[j])))
                    self.label[self.label == self.label[j]] = self.label[i]
            mark[mine] = False
        return found


def _tiles(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each tile: of neighbouring rows with one value in the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(new).tolist()
        for a, b in zip([0, *cut], [*cut, batch.num_rows], strict=True):
            name = tuple(int(c[a]) for c in columns)
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            last = name
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _tile(t: pa.Table, percent: int) -> Tile:
    rep, n, component, side = (t.column(c).to_numpy() for c in ("rep", "n", "component", "side"))
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, REGISTERS)
    return Tile(rep, n, component, side, sig, percent, t.column("band")[0].as_py())


#: What names a tile, and what its members bring along.
_NAME, _MEMBER = ["band", "key", "p", "q"], ["rep", "n", "component", "side"]


def cross_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the components of each bucket's members, as few as join those that similar members join.

    ``members`` has band, key, rep, n, component, sig. A bucket with more members than SIDE, or with larger sets than
    SIDE_BYTES, is dealt out: its members go to blocks by a hash, and each pair of blocks is a tile. Signatures are compared
    first, and only members that may have a partner in another component bring their sets. A tile joins what it finds at
    once (union-find) and returns no more links than it has components.
    """
    spark = members.sparkSession
    size = F.count("*").alias("_members"), F.sum("n").alias("_shingles")
    mixed = members.groupBy("band", "key").agg(F.min("component").alias("_low"), F.max("component").alias("_high"), *size).where("_low <> _high")
    blocks = F.greatest(F.ceil(F.col("_members") / SIDE), F.ceil(F.col("_shingles") * 8 / SIDE_BYTES)).cast("long")
    inside = members.join(mixed.select("band", "key", blocks.alias("_blocks")), ["band", "key"])
    inside = inside.withColumn("side", F.pmod(F.xxhash64("rep"), F.col("_blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    inside = inside.select("band", "key", F.least("side", "_other").alias("p"), F.greatest("side", "_other").alias("q"), *_MEMBER, "sig")
    dealt = lambda df: df.repartition(partitions(spark), *_NAME).sortWithinPartitions(*_NAME)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches, len(_NAME)):
            yield from t.take(pa.array(_tile(t, percent).active())).to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _tiles(batches, len(_NAME)):
            found = _tile(t, percent).links([np.frombuffer(x.as_buffer(), "<u8") for x in t.column("items")])
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(2)], names=["a", "b"])

    active = dealt(inside).mapInArrow(choose, inside.schema)
    brought = active.join(sets.select(F.col("doc_id").alias("rep"), "n", "items"), ["rep", "n"]).select(*inside.columns, "items")
    return dealt(brought).mapInArrow(link, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Sets are joined to pairs, b's last: where very many pairs have one b, the join's partition can be split.
    """

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep[k] = 100 * common >= percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    own = sets.select("doc_id", "items")
    return pairs.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(intersect, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents linked by the similarity of their word shingles: doc_id, n_shingles, component_id, kept.

    Documents with equal sets form a class, whose smallest id stands for it. Bands of SuperMinHash signatures give buckets;
    in each bucket a leader, another one in each band, is compared with all members, on full sets. Components of the links
    found are formed, and then the members of a bucket that are in different components are compared too, all with all, and
    joined by union-find (see ``cross_links``); so large buckets of similar documents cost little, and no list of pairs is
    made. Signatures and sizes only rule out pairs. What is missed: a similar pair that shares no band (2 in 100,000 at a
    similarity of 0.8, fewer above), or whose signature is DEVIATIONS standard deviations off.

    Null and empty texts, and texts of white space, have empty sets and are linked with nothing; rows with one id count as
    one document with each of its texts; rows with a null id link nothing and keep a null component; an empty table gives
    an empty one; other columns are not looked at.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = sketches(source, width)
    classes = rows.where("n > 0 and doc_id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "sig")).alias("one"))
    classes = checkpointed(classes.select("f1", "f2", "n", F.col("one.doc_id").alias("rep"), F.col("one.sig").alias("sig")))
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * ROWS + 1, F.lit(ROWS))))
    bands = classes.select("rep", "n", F.posexplode(keys).alias("band", "key"))
    leaders = bands.groupBy("band", "key").agg(F.min_by(F.struct("rep", "n"), F.xxhash64("rep", "key")).alias("leader"), F.count("*").alias("members")).where("members > 1")
    shared = checkpointed(bands.join(leaders, ["band", "key"]).select("band", "key", "rep", "n", "leader"))
    near = (F.least("n", "leader.n") * 100 >= F.greatest("n", "leader.n") * percent) & (F.col("rep") != F.col("leader.rep"))
    star = shared.where(near).select("rep", "leader.rep").toDF("a", "b")
    star = star.groupBy(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(F.min("b").alias("b")).select((F.col("low") + F.col("high") - F.col("b")).alias("a"), "b")  # b leads
    sig = classes.select("rep", "n", "sig")
    least = least_estimate(percent)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= least))

    star = star.join(sig.select("rep", "sig").toDF("a", "x"), "a").join(sig.select("rep", "sig").toDF("b", "y"), "b").select("a", "b", "x", "y")
    star = checkpointed(star.mapInArrow(likely, "a long, b long").distinct())
    wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
    few = wanted.count() <= BROADCAST_IDS

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 1):
            value, first = shingles(*utf8(batch.column(1)), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), binaries(value.astype("<u8"), first * 8)], names=["doc_id", "n", "items"])

    # every id that is in a pair has its sets here
    sets = written(source.join(F.broadcast(wanted) if few else wanted, "doc_id").mapInArrow(full, "doc_id long, n long, items binary").where("n > 0"), "sets")
    if not sets.groupBy("doc_id", "n").count().where("count > 1").isEmpty():  # ids that rows repeat
        sets = written(sets.distinct(), "sets")
    parts = connected_components(checkpointed(verified(star, sets, percent)))
    placed = shared.join(parts.toDF("rep", "component"), "rep", "left").select("band", "key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    rest = checkpointed(cross_links(placed.join(sig, ["rep", "n"]), sets, percent))
    if not rest.isEmpty():
        # links between components join these; only the components are nodes of the second graph
        for end in ("a", "b"):
            rest = rest.join(parts.toDF(end, f"c{end}"), end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
        joined = connected_components(rest.select("a", "b"))
        first = parts.toDF("node", "c").join(joined.toDF("c", "d"), "c", "left").select("node", F.coalesce("d", "c").alias("component"))
        parts = first.union(joined.join(parts.select("node"), "node", "left_anti"))
    named = classes.select("f1", "f2", "n", "rep").join(parts.toDF("rep", "component"), "rep", "left").select("f1", "f2", "n", F.coalesce("component", "rep").alias("component"))
    result = rows.select("doc_id", "n", "f1", "f2").join(named, ["f1", "f2", "n"], "left")
    result = result.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that a smaller one of their group stands for.

    Null and empty texts and rows with a null id are in no group and stay; of rows with one id all stay or all go; other
    columns are kept as they are; an empty table stays empty.
    """
    found = near_duplicates(docs, width, percent, id_col, text_col)
    gone = checkpointed(found.where("not kept").select(F.col("doc_id").alias(id_col)).distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, id_col, "left_anti").select(*docs.columns)
