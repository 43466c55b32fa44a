"""Each operator against a plain version, and its defined results on odd tables."""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from velofield.llm import counts, decontamination, labels, lines, near, packing, quality, queries, shared, suffixes, tokens, toxicity, urls, vectors

SCHEMA = "doc_id long, text string, home string, key string, k int"
LONG = "ab cd " * 3000
ODD = [(1, None), (2, ""), (3, "one"), (4, "x " * 40 + "shared words of a passage that is long enough to be seen twice\n"), (5, "y " * 40 + "shared words of a passage that is long enough to be seen twice\n"), (5, "y " * 40 + "shared words of a passage that is long enough to be seen twice\n"), (None, "x " * 40), (6, LONG), (7, LONG), (8, "日本 ﬁne İ's <|endoftext|> don't\x00\x1c end"), (9, "  \n\t ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(a, b, "h", None, a) for a, b in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return sorted((r["doc_id"], r["text"] or "") for r in docs.collect())


def reference_ids(text: str) -> list[int]:
    return tokens.Encoder.of(queries.tokenizer_path()).whole(text or "")


# --- shared -----------------------------------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=4, deadline=None)
def test_components_equal_union_find(spark, pairs):
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    found = shared.connected_components(spark.createDataFrame(pairs, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {a: root(a) for a in parent if any(a in p and p[0] != p[1] for p in pairs)}


def test_components_of_a_path(spark):
    found = shared.connected_components(spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert {r["component"] for r in found.collect()} == {0}


def test_labels_deal_buckets_evenly(spark):
    rows = spark.range(500).select(F.col("id").cast("int").alias("i"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(13)).alias("p")).toPandas()
    assert (shared.hash_partition(rows["i"].to_numpy(), 13) == rows["p"]).all()
    assert sorted(shared.hash_partition(shared.even_labels(51), 51)) == list(range(51))


# --- 1 packing --------------------------------------------------------------------------------------------------------


def check_packed(rows, ids_by_doc, size=4096):
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for doc, ids in ids_by_doc.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    total, by_sequence = 0, defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size and at & (at - 1) == 0
        total += at
    assert total == sum(map(len, ids_by_doc.values()))


def test_packing(docs, texts):
    check_packed(packing.pack(docs, queries.tokenizer_path()).collect(), {k: [*reference_ids(t), 2] for k, t in texts})


def test_packing_of_odd_rows(odd):
    rows = packing.pack(odd.dropDuplicates(["doc_id"]), queries.tokenizer_path(), size=64, with_ids=True).collect()
    check_packed(rows, {k: [*reference_ids(t), 2] for k, t in dict(ODD).items()}, 64)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack(odd, queries.tokenizer_path()).groupBy().sum("length").first()[0] == sum(len(reference_ids(t)) + 1 for _, t in ODD)
    assert packing.pack(odd.limit(0), queries.tokenizer_path()).count() == 0


def project(*texts):
    return packing.project(tokens.Words(*shared.utf8(pa.array(texts))))


def test_texts_of_any_script_are_projected():
    russian, greek, japanese = "Поле скоростей, снимок № 7", "Πεδίο ταχυτήτων", "速度場。粒子の画像。"
    points = project(russian, greek, japanese, "plain words", None, " \n\t", "don\u2019t", "a\x00b", "see <|endoftext|>")
    assert (points[[4, 5]] == 0).all()
    assert (points[[0, 1, 2, 3, 6, 7, 8]] > 0).all()
    assert len({tuple(p) for p in points.tolist()}) == 8
    assert (project(russian.upper() + "\n", unicodedata.normalize("NFD", greek)) == points[:2]).all()
    alone = project(russian + " don't stop", greek)
    assert (alone[1] == points[1]).all() and (alone[0] != points[0]).any()


def test_words_weigh_the_same_beside_characters_of_other_scripts():
    plain = "It's the 12th field, don't we'll say été " * 30
    words = tokens.Words(*shared.utf8(pa.array([plain, plain + "\u2026", plain.upper() + "速度"])))
    rest = words.of_hard()
    own = words.hash[: words.per_doc[1]].tolist()
    assert words.hard.tolist() == [False, True, True]
    assert [rest.hash[a : a + len(own)].tolist() for a in rest.per_doc[:2]] == [own, own] and np.diff(rest.per_doc).tolist() == [len(own) + 1] * 2
    points = packing.project(words)
    assert np.abs(points - points[0]).max() <= 4


@given(st.text(alphabet="aB'sİéßretvmlld ²9½.,!\n\t\xa0ÀŠ<|日本ﬁйΣ\u0301\u2019\u2028\x00\x1c\x85", max_size=60))
@settings(max_examples=150, deadline=None)
def test_words_of_hard_texts_equal_the_tokenizer(text):
    tokenizer = tokens.Encoder.of(queries.tokenizer_path()).tokenizer
    raw = np.frombuffer((text + "日").encode(), np.uint8)
    low = tokenizer.normalizer.normalize_str(text + "日")
    found = tokens.Words(raw, np.array([0, len(raw)])).of_hard()
    assert [found.text(k) for k in range(len(found.start))] == [low[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(low)]


def test_projection_clips_no_text():
    points = project(*(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(600)))
    for k in range(packing.DIMENSIONS):
        values, counts = np.unique(points[:, k], return_counts=True)
        assert values.min() > 0 and values.max() < (1 << packing.BITS) - 1 and counts.max() < 15 and len(values) > 200


def test_hilbert_neighbours_touch():
    n = 3
    points = np.array([(x, y, z) for x in range(1 << n) for y in range(1 << n) for z in range(1 << n)])
    key = packing.hilbert_key(points, n)
    assert sorted(key) == list(range(1 << 3 * n))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@given(st.text(alphabet="aB'sİéßretvmlld ²9½.,!\n\t\xa0ÀŠ<|", max_size=60))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_library(text):
    encoder = tokens.Encoder.of(queries.tokenizer_path())
    raw = np.frombuffer(text.encode(), np.uint8)
    assert encoder.encode(raw, np.array([0, len(raw)]))[0].tolist() == reference_ids(text)


# --- 2 suffixes -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("letters", [1, 2, 4, 30])
def test_suffix_array(letters):
    s = np.random.default_rng(letters).integers(97, 97 + letters, 700).astype(np.uint8)
    s[350:] = s[:350]
    order, text = suffixes.suffix_array(s, 50), s.tobytes()
    assert sorted(order) == list(range(700))
    key = [text[k : k + 50] for k in order]
    assert all(a <= b for a, b in zip(key, key[1:], strict=False))
    common = suffixes.common_prefixes(s, order, 50)
    for k in range(1, 700):
        a, b = text[order[k] :].ljust(60, b"\0"), text[order[k - 1] :].ljust(60, b"\0")
        assert common[k] == min(50, next((n for n in range(60) if a[n] != b[n]), 60))


def plain_repeats(rows, length):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data = (text or "").encode()
        for k in range(len(data) - length + 1):
            first.setdefault(data[k : k + length], doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - length + 1) if doc is not None else ():
            if first[data[k : k + length]] < doc:
                gone[k : k + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeats(spark, docs, texts, odd, hot):
    for table, rows in ((docs, texts), (odd, ODD)):
        got = suffixes.remove_repeats(table, hot=hot).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_repeats(rows, 50)
    assert suffixes.remove_repeats(odd.limit(0)).count() == 0


@given(st.lists(st.text(alphabet="ab", max_size=40), min_size=1, max_size=6))
@settings(max_examples=4, deadline=None)
def test_repeats_of_short_strings(spark, values):
    rows = list(enumerate(values))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=8, gram=3, hot=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_repeats(rows, 8)


def test_repeats_beside_long_periodic_runs(spark):
    """Runs of one smallest hash that 16 bits can't count, and other repeats that are compared beside them."""
    words = [f"word {k * 7919 % 1009} of a passage that both texts have, " for k in range(40)]
    rows = [(1, " " * 60 + "".join(words)), (2, "".join(words[20:]) + " " * 70_000 + "x" + "".join(words[:20])), (3, "ab cd " * 12_000), (4, "start" + "ab cd " * 23_000 + "end"), (5, "=" * 66_000), (6, "=" * 140_000 + "tail")]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_repeats(rows, 50)


# --- 3 lines ----------------------------------------------------------------------------------------------------------


def plain_lines(rows):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for n, c in enumerate(lines.chunks_of(text or "")):
            if sum(1 for x in c.split("\n") if x.strip()) > 1:
                first.setdefault(c, (doc, n))
    return [(doc, text if text is None else "".join(c for n, c in enumerate(lines.chunks_of(text)) if doc is None or first.get(c, (doc, n)) == (doc, n))) for doc, text in rows]


def test_line_chunks(docs, texts, odd):
    for table, rows in ((docs, texts), (odd, ODD)):
        got = lines.dedup_lines(table).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(plain_lines(rows), key=str)
    assert lines.dedup_lines(odd.limit(0)).count() == 0


def plain_chunks(text, window=lines.WINDOW, spacing=lines.SPACING):
    """The rule of boundaries, line by line; only the hash of a line is the operator's."""
    every = [x for x in re.split(r"(?<=\n)", text) if x]
    raw = np.frombuffer(text.encode(), np.uint8)
    ends = np.cumsum([len(x.encode()) for x in every])
    value = [int(h) for h in shared.Prefixes(lines._BYTES[raw]).of(np.concatenate([[0], ends[:-1]]), ends)] if every else []
    full = [k for k, x in enumerate(every) if any(b > 32 for b in x.encode())]
    rolling = []
    for k in range(len(full)):
        h = 0
        for back in range(window):
            h = shared.mix_int(h + (value[full[k - back]] if k >= back else 0) * (2 * back + 3))
        rolling.append(h)
    inner = []
    for k in range(1, len(full) - 2):
        before, after = rolling[max(0, k - spacing // 2) : k], rolling[k + 1 : k + 1 + spacing // 2]
        if all(rolling[k] < x for x in before) and all(rolling[k] <= x for x in after):
            inner.append(k)
    stops, edges = set(inner), [-1, *inner, len(full) - 1]
    for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        if n == 0 and inner:  # counted back from the first boundary
            stops.update(k for k in range(b - 2, a + 1, -2) if k - a >= 2)
        else:
            stops.update(k for k in range(a + 2, b - 1, 2))
    out, held = [], ""
    last = {full[k] for k in stops}
    for k, x in enumerate(every):
        held += x
        if k in last:
            out.append(held)
            held = ""
    return [*out, held] if held else out


def test_chunks_equal_a_plain_rule(texts):
    for _, text in [*texts, *((0, t) for _, t in ODD)]:
        assert lines.chunks_of(text or "") == plain_chunks(text or "")


def test_chunks_with_equal_hashes_stay(spark, monkeypatch):
    """Hashes that all collide choose wrong candidates; bytes decide."""
    rows = [(1, "aa\nbb\n"), (2, "cc\ndd\n"), (3, "aa\nbb\n"), (4, "eeee\nff\n")]
    steps = lines.Steps(np.zeros(1, np.int32), 2, 3)
    docs = pa.table({"home": pa.array([0] * 4, pa.int32()), "doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    monkeypatch.setattr(lines.Prefixes, "of", lambda self, a, b: np.full(len(a), 7, np.uint64))
    answers = pa.table({"home": pa.array([0], pa.int32()), "hash": pa.array([np.array([7], "<u8").tobytes()])})
    got = steps.remove(docs, steps.compare(steps.send(docs, answers)))
    assert got.column("text").to_pylist() == ["aa\nbb\n", "cc\ndd\n", "", "eeee\nff\n"]


def test_chunks_resist_shifts():
    r = np.random.default_rng(0)
    body = [f"line {r.integers(1 << 30)}\n" for _ in range(200)]
    a, b = (lines.chunks_of("".join(x)) for x in (body, ["new one\n", "new two\n", *body]))
    assert len(set(a) & set(b)) > 0.9 * len(a)


def test_chunks_have_two_lines(texts):
    """No chunk but that of a text with fewer has under two lines; repeated passages lose most of their lines."""
    for _, text in texts:
        sizes = [sum(1 for x in c.split("\n") if x.strip()) for c in lines.chunks_of(text)]
        assert len(sizes) < 2 or min(sizes) >= 2
        assert "".join(lines.chunks_of(text)) == text
    r = np.random.default_rng(0)
    new = lambda n: [f"line {r.integers(1 << 40)}\n" for _ in range(n)]
    left = missed = 0
    for _ in range(300):
        body = new(8)
        first = set(lines.chunks_of("".join([*new(6), *body, *new(6)])))
        gone = sum(c.count("\n") for c in lines.chunks_of("".join([*new(5), *body, *new(7)])) if c in first and c.count("\n") > 1)
        left, missed = left + 8 - gone, missed + (gone == 0)
    assert left < 0.45 * 300 * 8 and missed < 0.1 * 300


# --- 4 near-duplicates ------------------------------------------------------------------------------------------------


def plain_near(rows, width, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets, owners = {}, defaultdict(list)
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[doc] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    for doc, s in sets.items():
        for x in s if doc is not None else ():
            owners[x].append(doc)
    common = defaultdict(int)
    for have in owners.values():
        for a in range(len(have)):
            for b in range(a):
                common[(min(have[a], have[b]), max(have[a], have[b]))] += 1
    parent = {d: d for d in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, width, percent):
    want = plain_near(texts, width, percent)
    for r in near.near_duplicates(docs, width, percent).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])


def test_near_duplicates_of_odd_rows(odd):
    want = plain_near(ODD, 5, 80)
    got = near.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert near.near_duplicates(odd.limit(0)).count() == 0
    assert near.keep_one(odd).columns == odd.columns


def test_chain_of_near_copies(spark):
    """Neighbours are linked, far ends aren't; one component all the same."""
    words = [f"w{k}" for k in range(400)]
    rows = [(n, " ".join(words[8 * n : 8 * n + 200])) for n in range(20)] + [(100 + n, " ".join(words[:150] + [f"z{n}"])) for n in range(40)]
    want = plain_near(rows, 3, 85)
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {d: c for d, (_, c) in want.items()}


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for n in (40, 500, 3000):
        base = r.integers(0, 1 << 62, n + n // 5).astype(np.uint64)
        a, b = np.unique(base[:n]), np.unique(base[n // 5 :])
        s = near.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - share) < 0.15


def joined(pairs, label):
    """Each member's component once the pairs' components are joined."""
    label = np.array(label)
    for a, b in pairs:
        label[label == max(label[a], label[b])] = min(label[a], label[b])
    return label.tolist()


@pytest.mark.parametrize("own", [0, 3])
def test_tiles_join_what_full_sets_join(own):
    """A bucket of some that are similar, many that miss it by little, and signatures that rule some pairs out."""
    r = np.random.default_rng(own)
    base = np.sort(r.integers(0, 1 << 62, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[r.random(120) < r.choice([0.99, 0.93, 0.5])], r.integers(0, 1 << 62, int(r.integers(0, 12))).astype(np.uint64)])) for _ in range(400)]
    n, rep, component, side = np.array([len(x) for x in sets]), r.permutation(400), r.integers(0, 90, 400) * (r.random(400) < 0.7), r.integers(0, 2, 400)
    sig = (near.mix(near.signatures(np.concatenate(sets), np.concatenate([[0], np.cumsum(n)]))) >> np.uint64(32)).astype(np.uint8)
    place, enough = np.argsort(rep), near.least_estimate(80) * near.REGISTERS
    for sides in (np.zeros(400, int), side):
        want = []
        for a in range(400):
            for b in range(a):
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                met = own and (sig[a, : own * near.ROWS] == sig[b, : own * near.ROWS]).reshape(own, near.ROWS).all(axis=1).any()
                if 100 * common >= 80 * (n[a] + n[b] - common) and (sig[a] == sig[b]).sum() >= enough and not met and (sides is not side or side[a] != side[b]):
                    want.append((a, b))
        tile = lambda: near.Tile(rep, n, component, sides, sig, 80, own)  # noqa: B023, E731
        found = [(int(place[a]), int(place[b])) for a, b in tile().links(sets)]
        assert len(found) < len(set(component)) < len(want)
        assert joined(found, component) == joined(want, component)
        active = set(tile().active().tolist())
        assert {k for a, b in want for k in (a, b) if component[a] != component[b]} <= active < set(range(400))


def test_large_groups_that_are_not_links(spark):
    """5,000 near copies, hardly any two similar enough, and a few that are; blocks are smaller than the buckets."""
    r = np.random.default_rng(3)
    has = np.ones((5000, 60), np.float32)  # which of 60 words that all share each text has; its other words are its own
    for k in range(5000):
        has[k, r.choice(60, 2 if k % 50 else 1, replace=False)] = 0
    rows = [(k, " ".join(f"w{at}" if x else f"x{k}y{at}" for at, x in enumerate(own))) for k, own in enumerate(has)]
    common = has @ has.T
    want = joined(np.argwhere(np.triu(100 * common >= 95 * (120 - common), 1)), np.arange(5000))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = {}
    for side, part in ((near.SIDE, docs), (150, docs.where("doc_id < 1000"))):
        old, near.SIDE = near.SIDE, side
        try:
            made[side] = [r["component_id"] for r in near.near_duplicates(part, 1, 95).orderBy("doc_id").collect()]
        finally:
            near.SIDE = old
    assert made[near.SIDE] == want and 1000 < len(set(want)) < 5000
    few = common[:1000, :1000]
    assert made[150] == joined(np.argwhere(np.triu(100 * few >= 95 * (120 - few), 1)), np.arange(1000))


def test_an_id_with_two_texts(spark):
    """Each text of an id links it."""
    a, b = " ".join(f"a{k}" for k in range(90)), " ".join(f"b{k}" for k in range(90))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (3, b + " end"), (4, "other words here that no text has")]
    got = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4} and len(got) == len(rows)


# --- 5 decontamination ------------------------------------------------------------------------------------------------


def test_leaks_equal_sql(spark, sf, duck):
    assert_same(queries.op5_decontamination(spark, sf), duck, queries.OP5_SQL)


def test_leaks_on_odd_rows(spark, odd):
    items = spark.createDataFrame([(7, "Shared words, of a PASSAGE"), (8, None), (9, ""), (10, "one"), (10, "one")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find_leaks(odd, items, with_clean=True).collect()}
    assert got[4]["items"] == ["7"] and got[4]["n_hit"] == 5 and got[3]["items"] == ["10"] and got[1]["n_words"] == 0
    assert "passage" not in got[4]["clean"] and got[4]["spans"][0]["end"] - got[4]["spans"][0]["start"] == len("shared words of a passage")
    assert decontamination.find_leaks(odd, items.limit(0)).where("n_hit > 0").count() == 0
    assert sorted(r["doc_id"] or 0 for r in decontamination.drop_leaks(odd, items).collect()) == [0, 1, 2, 6, 7, 8, 9]


def test_leaks_in_parts(spark, sf, docs, odd):
    """A benchmark larger than a part gives what one automaton gives."""
    items = spark.read.parquet(f"{sf}/benchmark.parquet").union(spark.createDataFrame([(7, "Shared words, of a PASSAGE"), (8, None), (None, "one")], "item_id long, text string"))
    for table in (docs, odd):
        found = [sorted(map(str, decontamination.find_leaks(table, items, with_clean=True, part_bytes=n).collect())) for n in (1 << 30, 3000)]
        kept = [sorted(map(str, decontamination.drop_leaks(table, items, part_bytes=n).collect())) for n in (1 << 30, 3000)]
        assert found[0] == found[1] and kept[0] == kept[1] and len(kept[0]) < len(found[0])


# --- 6 counts ---------------------------------------------------------------------------------------------------------


@given(st.text(alphabet="ab 'sÉ.\n1", max_size=80), st.lists(st.tuples(st.integers(-3, 90), st.integers(0, 12), st.text(alphabet="cd '\n9", max_size=8)), max_size=6))
@settings(max_examples=120, deadline=None)
def test_edited_counts_equal_full_encoding(text, edits):
    encoder = tokens.Encoder.of(queries.tokenizer_path())
    pieces = counts.cut(text, 8)
    assert "".join(pieces) == text
    tree = counts.CountTree(pieces, [counts.count_tokens(p, encoder) for p in pieces], lambda t: counts.count_tokens(t, encoder))
    for at, size, new in edits:
        tree.edit(at, at + size, new)
        a = min(max(at, 0), len(text))
        b = min(max(at + size, a), len(text))
        text = text[:a] + new + text[b:]
        assert tree.text() == text and tree.total == len(reference_ids(text)) and tree.length == len(text)


def edited(pieces, edits):
    """(total, text) of a tree after edits, and the text by plain replacement."""
    count = lambda t: len(reference_ids(t))
    tree, text = counts.CountTree(list(pieces), [count(p) for p in pieces], count), "".join(pieces)
    for at, end, new in edits:
        tree.edit(at, end, new)
        a = min(max(at, 0), len(text))
        text = text[:a] + new + text[min(max(end, a), len(text)) :]
    assert tree.text() == text and tree.length == len(text)
    return tree.total, len(reference_ids(text))


@pytest.mark.parametrize(
    ("pieces", "edits"),
    [
        (["the ", "other"], [(3, 4, ""), (8, 8, "wise")]),
        (["foo bar ", "baz"], [(7, 11, ""), (7, 7, "x")]),
        (["un ", "believ ", "able"], [(2, 3, ""), (8, 9, ""), (2, 2, "do"), (0, 0, "a ")]),
        (["a ", "b ", "c ", "d"], [(1, 6, ""), (1, 1, "x"), (2, 2, "y"), (0, 1, "")]),
        (["one ", "two\x1cthree"], [(8, 8, "x"), (3, 4, "\x1c")]),
        ([""], [(0, 5, "new"), (3, 3, "er")]),
    ],
)
def test_edits_across_leaves(pieces, edits):
    got, want = edited(pieces, edits)
    assert got == want


def test_many_random_edits():
    r = np.random.default_rng(11)
    letters = np.array(list("ab 'sÉ.\n1cde  "))
    word = lambda n: "".join(r.choice(letters, int(r.integers(0, n))))
    for _ in range(5000):
        pieces = counts.cut(word(60), int(r.integers(2, 10)))
        got, want = edited(pieces, [(int(a), int(a + b), word(6)) for a, b in zip(r.integers(-2, 60, 5), r.integers(0, 14, 5), strict=True)])
        assert got == want


def test_edits_encode_little():
    count = lambda t: len(reference_ids(t))
    pieces = counts.cut("some words of a text " * 400)
    seen = []
    tree = counts.CountTree(list(pieces), [count(p) for p in pieces], lambda t: seen.append(t) or count(t))
    tree.edit(4003, 4005, "x")
    assert len(pieces) > 10 and sum(map(len, seen)) < 60


def test_counts_over_tables(docs, texts, odd):
    edits = lambda t: t.select("doc_id", "text", counts.sample_edits(F.col("text")).alias("edits"))
    for table, rows in ((docs, texts), (odd, ODD)):
        got = counts.count_edited(edits(table), queries.tokenizer_path(), with_text=True).collect()
        assert sorted(((r["doc_id"], r["n_tokens_before"]) for r in got), key=str) == sorted(((k, len(reference_ids(t))) for k, t in rows), key=str)
        assert all(r["n_tokens"] == len(reference_ids(r["text"])) and r["n_edits"] == 4 for r in got)
        later = counts.apply_edits(counts.trees(table, queries.tokenizer_path()).withColumn("edits", counts.sample_edits(F.col("text"))), queries.tokenizer_path(), with_text=True).collect()
        assert sorted(later, key=str) == sorted(got, key=str)
    none = odd.select("doc_id", "text", F.lit(None).cast("array<struct<start:long,end:long,text:string>>").alias("edits"))
    assert counts.count_edited(none, queries.tokenizer_path()).where("n_tokens <> n_tokens_before or n_edits > 0").count() == 0


# --- 7 embeddings -----------------------------------------------------------------------------------------------------


def test_embeddings_equal_sql(spark, sf, duck):
    assert_same(queries.op7_embeddings(spark, sf), duck, queries.OP7_SQL)


def test_embeddings_near_the_threshold(spark):
    r = np.random.default_rng(0)
    rows = []
    for k in range(40):
        a, b = np.linalg.qr(r.standard_normal((16, 2)))[0].T
        for m, angle in enumerate((0, 0.30, 0.316, 0.3175604, 0.3175605, 0.33, 0.64)):
            rows.append((10 * k + m, [float(x) for x in (np.cos(angle) * a + np.sin(angle) * b) * (1 + k)]))
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, rows[0][1]), (1005, [1.0, 2.0]), (1006, [2.0, 4.0]), (None, [1.0, 2.0]), (1007, []), (1008, [float("inf")] * 16)]
    t = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<double>, rep string")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(t, tile=64).collect()}
    assert len(got) == len(rows)
    usable = {a: np.array(b) for a, b in rows if a is not None and b and None not in b and np.isfinite(b).all() and np.any(b)}
    links = defaultdict(set)
    for a, x in usable.items():
        for b, y in usable.items():
            if a < b and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.95:
                links[a].add(b)
                links[b].add(a)
    for a in got:
        assert got[a]["n_links"] == len(links[a])
        seen, todo = {a}, [a]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[a]["component_id"] == min(seen, key=lambda v: (v is None, v))
    assert vectors.near_duplicates(t.limit(0)).count() == 0


def test_tiles_leave_few_pairs_open():
    """A group whose pairs are all near the threshold: finer codes decide nearly all of them, and rightly."""
    r = np.random.default_rng(4)
    centre, noise = np.eye(48)[0], r.standard_normal((400, 48))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    angle = np.arccos(np.sqrt(0.95))
    x = np.cos(angle) * centre + np.sin(angle) * noise
    i, j, oi, oj = vectors.tile_links(vectors.encode(x), vectors.encode(x), 0.95, True)
    cosine = x @ x.T
    near_ = (np.abs(cosine - 0.95) < 0.02).sum()
    linked = np.zeros((400, 400), bool)
    linked[i, j] = True
    settled = ~np.eye(400, dtype=bool)
    settled[oi, oj] = False
    assert (linked[settled] == (cosine >= 0.95)[settled]).all() and len(oi) < 0.01 * near_ and near_ > 50_000


def test_embeddings_in_many_blocks(spark, monkeypatch):
    """Groups of blocks that are far apart are skipped; nothing is lost."""
    monkeypatch.setattr(vectors, "SUPER", 2)
    r = np.random.default_rng(5)
    centres = r.standard_normal((12, 6))
    x = centres[r.integers(0, 12, 500)] + 0.12 * r.standard_normal((500, 6))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    got = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tile=16).orderBy("vec_id").collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = np.argwhere(np.triu(unit @ unit.T >= 0.95, 1))
    assert [q["n_links"] for q in got] == np.bincount(links.ravel(), minlength=500).tolist()
    assert [q["component_id"] for q in got] == joined(links, np.arange(500))


def test_quantisation_bounds_hold():
    r = np.random.default_rng(2)
    x = r.standard_normal((300, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, s, e = vectors.quantise(x)
    error = np.abs(x @ x.T - (q.astype(float) @ q.T.astype(float)) * s[:, None] * s)
    assert (error <= e[:, None] * (1 + e) + e * (1 + e[:, None]) + e[:, None] * e).all()


# --- 8 toxicity, 10 quality -------------------------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("An 1d10t, m0r0n and Ѕсum! $5 in 2024 the$$$") == " an idiot moron and scum in the "
    assert toxicity.fold(None) == " "


def test_exception_phrases_and_length():
    lexicon = toxicity.Lexicon({" clown ": 5.0, " idio": 4.0}, (" clown fish ",), (-4.0, 4.0, 1.0))
    machine = lexicon.automaton()
    assert lexicon.hits(machine, toxicity.fold("a clown fish swims")) == {}
    assert len(lexicon.hits(machine, toxicity.fold("the clown and idiots"))) == 2
    assert lexicon.score(machine, toxicity.fold("clown"))[0] > lexicon.score(machine, toxicity.fold("clown " + "fine " * 500))[0] > lexicon.score(machine, toxicity.fold("fine"))[0]


def plain_hits(lexicon, line):
    """The heaviest entry at each place, found entry by entry."""
    find = lambda p: {k for k in range(len(line)) if line.startswith(p, k)}
    covered = {k for p in lexicon.exceptions for a in find(p) for k in range(a, a + len(p) - 1)}  # its last space is the next word's
    found = {}
    for p, w in lexicon.weights.items():
        for k in find(p) - covered:
            found[k] = max(w, found.get(k, 0.0))
    return found


@given(st.lists(st.sampled_from(["clown", "fish", "Ѕcum", "1diot", "idiocy", "a", "m0r0n", "moronic!", "2024", ""]), max_size=12))
@settings(max_examples=200, deadline=None)
def test_hits_equal_a_plain_search(words):
    lexicon = toxicity.Lexicon({" clown ": 5.0, " idio": 4.0, " idiot ": 6.0, " moron": 3.0, " scum ": 2.0}, (" clown fish ", " a idiot "))
    line = toxicity.fold(" ".join(words))
    assert lexicon.hits(lexicon.automaton(), line) == plain_hits(lexicon, line)


def rows_with_labels(spark, sf, label):
    rows = labels.training_rows(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), label)
    return rows, [(r["text"], r["y"], r["part"]) for r in rows.collect()]


def test_lexicon_equals_a_plain_count(spark):
    rows, known = rows_with_labels(spark, "/root/testdata/sf0.01", "toxic")
    lexicon = toxicity.learn(rows)
    own = [(toxicity.fold(t), y) for t, y, _ in known]
    counts_, total = {0: defaultdict(int), 1: defaultdict(int)}, {y: sum(1 for _, z in own if z == y) for y in (0, 1)}
    for line, y in own:
        for p in toxicity.patterns_of(set(line.split())):
            counts_[y][p] += 1
    weight = {p: np.log((n + 0.5) / (total[1] + 1)) - np.log((counts_[0][p] + 0.5) / (total[0] + 1)) for p, n in counts_[1].items() if n >= toxicity.LEAST_ROWS}
    kept = {}
    for p in sorted((p for p, w in weight.items() if w >= toxicity.LEAST_WEIGHT), key=lambda p: (len(p), p)):
        if not any(kept.get(f" {p.strip()[:k]}", -9.0) >= weight[p] - 1 for k in toxicity.STEMS if k <= len(p.strip())):
            kept[p] = weight[p]
    assert lexicon.weights.keys() == kept.keys() and len(kept) > 5
    assert all(abs(lexicon.weights[p] - w) < 1e-9 for p, w in kept.items())
    near_ = {0: defaultdict(int), 1: defaultdict(int)}
    for line, y in own:
        for p in toxicity.phrases_of(line, plain_hits(toxicity.Lexicon(kept), line)):
            near_[y][p] += 1
    assert set(lexicon.exceptions) == {p for p, n in near_[0].items() if n >= toxicity.LEAST_CLEAN and not near_[1][p]}


def test_model_equals_a_plain_fit(spark):
    """Ratios and scores from plain counts; the weights meet the conditions of the hinge loss's dual."""
    rows, known = rows_with_labels(spark, "/root/testdata/sf0.01", "quality")
    model = quality.learn(rows)
    own = [(quality.grams_of(t), y) for t, y, part in known if part]
    found = {0: defaultdict(int), 1: defaultdict(int)}
    for grams, y in own:
        for g in grams:
            found[y][g] += 1
    least = max(quality.LEAST_ROWS, len(own) * quality.LEAST_SHARE)
    grams = {g for y in (0, 1) for g in found[y] if found[0][g] + found[1][g] >= least}
    total = {y: sum(found[y][g] + 1 for g in grams) for y in (0, 1)}
    ratio = {g: np.log((found[1][g] + 1) / total[1]) - np.log((found[0][g] + 1) / total[0]) for g in grams}
    assert model.weights.keys() == grams and all(abs(model.weights[g][1] - r**2) < 1e-9 for g, r in ratio.items())
    for text, _, _ in known[:200]:
        have = quality.grams_of(text) & grams
        norm = np.sqrt(sum(ratio[g] ** 2 for g in have)) or 1.0
        margin = sum(model.weights[g][0] for g in have) / norm + model.bias
        assert abs(model.score(text) - 1 / (1 + np.exp(-np.clip(model.curve[0] * margin + model.curve[1], -30, 30)))) < 1e-9


def test_dual_descent_is_optimal():
    """The primal loss of the weights equals the dual's value: no weights are better."""
    r = np.random.default_rng(1)
    rows = [np.unique(r.integers(0, 12, 6)) for _ in range(120)]
    values = [r.standard_normal(len(x)) for x in rows]
    y = np.where(r.random(120) < 0.5, 1.0, -1.0)
    w = quality.descend(rows, values, y, 12, rounds=3000, tolerance=1e-9)
    x = np.zeros((120, 13))
    x[:, 12] = 1
    for k, (at, v) in enumerate(zip(rows, values, strict=True)):
        x[k, at] = v
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()
    assert all(loss(w) <= loss(w + 10.0 ** -float(r.integers(1, 5)) * r.standard_normal(13)) + 1e-6 for _ in range(2000))


def test_training_rows_are_bounded(spark, sf):
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    every = labels.training_rows(docs, marks, "toxic")
    n, weight = every.count(), every.agg(F.sum(F.octet_length("text"))).first()[0]
    assert 0.4 * n < labels.training_rows(docs, marks, "toxic", most_bytes=weight // 2).count() < 0.6 * n


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    for name, label in (("op8_toxicity", "toxic"), ("op10_quality", "quality")):
        rows = queries.queries()[name](spark, sf)
        assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
        seen = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
        assert ((seen["predicted"] == 1) == (seen[label] == 1)).mean() > 0.93
        assert seen["score"].between(0, 1).all()
        assert (seen["held_out"] == seen["doc_id"].map(lambda k: zlib.crc32(str(k).encode()) % 3 == 1)).all()


def test_classifiers_on_odd_rows(spark, odd):
    marks = spark.createDataFrame([(k, k % 2, None) for k in range(1, 10)] + [(3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for made in (toxicity.toxicity(odd, marks), quality.quality(odd, marks), toxicity.toxicity(odd, marks.limit(0)), quality.quality(odd, marks.limit(0))):
        rows = made.collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert labels.training_rows(odd, marks, "quality").where(labels.held_out("doc_id")).count() == 0
    assert toxicity.drop_toxic(odd, toxicity.Lexicon({" one ": 9.0})).count() == len(ODD) - 1


def test_dual_descent_separates():
    r = np.random.default_rng(0)
    rows, values, y = [], [], []
    for k in range(200):
        good = k % 2
        rows.append(np.array(sorted({int(v) for v in r.integers(0, 20, 5)} | {20 + good})))
        values.append(np.ones(len(rows[-1])))
        y.append(1.0 if good else -1.0)
    w = quality.descend(rows, values, np.array(y), 22)
    assert all(t * (w[i].sum() + w[-1]) > 0 for i, t in zip(rows, y, strict=True))


# --- 9 urls -----------------------------------------------------------------------------------------------------------


def test_urls_equal_sql(spark, sf, duck):
    assert_same(queries.op9_urls(spark, sf), duck, queries.OP9_SQL)


LINKED = [
    ("http://a.com/x/y?q=1", '<link rel="canonical" href="//bad.net/z">', "block"),  # no scheme
    ("http://b.com/x/y", "<LINK HREF='../bad/./t.html' REL='nofollow Canonical'>", "block"),  # relative, up
    ("http://b.com/bad/t.html", '<meta content="0; URL=http://c.net/?a=1&amp;b=2" http-equiv="Refresh">', "block"),
    ("http://d.com/1?a=1&b=2", '<link rel=canonical href=page.html><link rel="canonical" href="http://bad.net/two">', "block"),  # the second one
    ("http://d.com/page.html", None, "block"),
    ("http://f.com/q?old", "<meta http-equiv='refresh' content='5;url=?new'>", "block"),  # only a query
    ("http://f.com/q?new", '<link href="http://g.net/&#x2F;" rel="alternate canonical">', "block"),
    ("http://h.com/1", '<link rel="not-canonical" href="http://bad.net/"><a rel="canonical" href="http://bad.net/">', "allow"),
    ("http://i.com/1", '<link rel="canonical" href="mailto:x@bad.net"><link rel="canonical" href="#top"><link rel="canonical" href="">', "allow"),
    ("http://j.com/1", '<meta name="refresh" content="0;url=http://bad.net/"><meta http-equiv="refresh" content="300">', "allow"),
    ("http://k.com", '<link title="a > b" rel="canonical" href="sub/x">', "allow"),
    ("http://k.com/sub/x", '<link rel="canonical" href="/../../de/..">', "allow"),
    ("http://k.com/", '<link rel="canonical" href="HTTP://WWW.Example.ORG/fr/a"><link rel="canonical" href="http://bad.net/k">', "allow"),  # allow goes first
    ("no scheme", '<link rel="canonical" href="http://bad.net/">', "allow"),
    (None, '<link rel="canonical" href="http://bad.net/">', "allow"),
    ("http://l.com/1", '<link rel="canonical" href="http://bad.net/1', "allow"),  # never closed
]


def test_links_of_all_forms(spark):
    import duckdb

    rows = [(k, url, html) for k, (url, html, _) in enumerate(LINKED)]
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), rules)
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {k: x[2] for k, x in enumerate(LINKED)}
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    assert_same(got, con, queries.OP9_SQL)


def test_redirects_pass_decisions_on(spark):
    link = '<html><link href="http://bad.net/x" rel="canonical"></html>'
    rows = [
        (1, "http://a.example.com/en/1", link), (2, "https://A.example.com/en/1#top", None), (3, "http://bad.net/x", ""), (4, "http://c.example.com/2", '<meta http-equiv="refresh" content="0; url=http://a.example.com/en/1">'),
        (5, "http://d.example.com/3", '<link rel=canonical href="http://www.example.net/en/ok"><meta http-equiv=refresh content="1;url=http://bad.net/y">'), (6, None, link), (7, "no scheme", link), (8, "http://e.example.com", None), (9, "http://x.net?q=/", None), (8, "http://e.example.com", None),
    ]
    pages = spark.createDataFrame([(*r, "n") for r in rows], "page_id long, url string, html string, node string")
    rules = spark.createDataFrame(queries.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, rules).collect()}
    assert got[1] == ("a.example.com", "/en/1", None, "block") and got[2][3] == "block" and got[3][2:] == ("net/", "block") and got[4][3] == "block"
    assert got[5][3] == "allow" and got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8][3] == "allow" and got[9] == ("x.net", "", None, "allow")
    moved = urls.judge(pages, rules, spark.createDataFrame([("http://e.example.com", "http://bad.net/z")], "a string, b string"))
    assert {r["verdict"] for r in moved.where("page_id = 8").collect()} == {"block"} and moved.count() == len(rows)
    assert urls.judge(pages.limit(0), rules).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_equals_a_plain_version(spark, sf, texts):
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.learn(labels.training_rows(spark.read.parquet(f"{sf}/documents.parquet"), marks, "toxic"))
    machine = lexicon.automaton()
    rows = [(k, t) for k, t in texts if lexicon.score(machine, toxicity.fold(t))[0] < 0.7]
    rows = plain_lines(rows)
    groups = plain_near(rows, 5, 80)
    rows = [(k, t) for k, t in rows if groups[k][1] == k]
    items = decontamination.automaton([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    rows = [(k, t) for k, t in rows if not decontamination.scan(items, t)[2]]
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in got} == {k for k, _ in rows}
    check_packed(got, {k: [*reference_ids(t), 2] for k, t in rows})


def test_pipeline_stages_on_odd_rows(spark, sf, odd):
    rows = odd.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table in (rows, rows.limit(0)):
            made = stage(spark, table, sf)
            assert made.count() >= 0
            assert k == 4 or made.columns == corpus_pipeline.COLUMNS
