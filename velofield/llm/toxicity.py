"""Toxicity by a weighted lexicon (operator 8)."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velofield.llm.labels import TRAINING_ROWS, held_out, training_rows

THRESHOLD = 0.7
#: An entry must be in so many toxic rows, and by this log ratio more often there than in clean rows; an exception phrase
#: must be in so many clean rows, and in no toxic one.
LEAST_ROWS, LEAST_WEIGHT, LEAST_CLEAN = 5, 3.0, 3
STEMS = range(4, 8)

# Letters of other scripts that look like Latin letters.
_HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ӏ": "l", "ո": "n",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
# Digits and signs that stand for letters inside a word.
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_FOLD = str.maketrans(_HOMOGLYPHS | {chr(0xFF41 + k): chr(97 + k) for k in range(26)} | {"­": None, "​": None, "‌": None, "‍": None, "﻿": None})
_SUBSTITUTED = re.compile(r"(?:(?<=[^\W\d_])|(?<!\S))[0134578@$!]+(?=[^\W\d_])")
_LETTERS = re.compile(r"[\W\d_]+")
_DIGIT_TABLE = str.maketrans(_DIGITS)


def fold(text: str | None) -> str:
    """Words of the text in lower case, with look-alike letters and substituted digits folded, each between single spaces."""
    if not text:
        return " "
    low = text.lower()
    if not low.isascii():
        low = low.translate(_FOLD)
    low = _SUBSTITUTED.sub(lambda m: m.group().translate(_DIGIT_TABLE), low)
    return f" {_LETTERS.sub(' ', low).strip()} "


def patterns_of(words: set[str]) -> set[str]:
    """Whole words (between spaces) and word beginnings (after a space)."""
    found = {f" {w} " for w in words if len(w) > 2}
    for w in words:
        found.update(f" {w[:k]}" for k in STEMS if k <= len(w))
    return found


@dataclass
class Lexicon:
    """Weights of words (" word ") and word beginnings (" word"), exception phrases, and the score's coefficients."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, float, float] = (-4.0, 4.0, 1.0)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for p, w in self.weights.items():
            machine.add_word(p, (len(p), w))
        for p in self.exceptions:
            machine.add_word(p, (len(p), -1.0))
        if len(machine):
            machine.make_automaton()
        return machine

    def hits(self, machine, line: str) -> dict[int, float]:
        """Weight of the heaviest entry at each word start, without those that an exception phrase covers."""
        found: dict[int, float] = {}
        covered: list[tuple[int, int]] = []
        if len(machine):
            for end, (size, weight) in machine.iter(line):
                start = end - size + 1
                if weight < 0:
                    covered.append((start, end))
                elif weight > found.get(start, 0.0):
                    found[start] = weight
        if covered:
            found = {s: w for s, w in found.items() if not any(a <= s < b for a, b in covered)}
        return found

    def features(self, machine, line: str) -> tuple[float, float, int]:
        """(1 if anything is hit, weight by the square root of the length, hits)."""
        found = self.hits(machine, line)
        words = line.count(" ") - 1
        return float(bool(found)), sum(found.values()) / math.sqrt(words + 20.0), len(found)

    def score(self, machine, line: str) -> tuple[float, int]:
        any_, density, n = self.features(machine, line)
        a, b, c = self.coefficients
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * any_ + c * density)))), n


def _counted(rows: DataFrame, count, key: str = "p") -> DataFrame:
    """Sums by key of what ``count(text, y)`` finds in each row: (key, toxic, clean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            keys = [*(found[0].keys() | found[1].keys())]
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())], names=[key, "toxic", "clean"])
            found[0].clear()
            found[1].clear()
            return batch

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y > 0].update(count(text, y))
                if len(found[0]) + len(found[1]) > 200_000:
                    yield out()
        yield out()

    return rows.select("text", "y").mapInArrow(run, f"{key} string, toxic long, clean long").groupBy(key).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def entries(rows: DataFrame) -> Lexicon:
    """The entries and exception phrases that labelled rows (text, y) give; none without rows of both classes.

    Entries are words and word beginnings of toxic rows; their weight is the log ratio of the shares of toxic and of clean
    rows that have them. Phrases of a hit and a neighbouring word that clean rows have and toxic ones don't become
    exceptions. All that LEAST_ROWS, LEAST_WEIGHT and LEAST_CLEAN let in are kept, so the training rows bound the lexicon.
    """
    sizes = {r["y"] > 0: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Lexicon()
    toxic = _counted(rows.where("y > 0"), lambda text, y: patterns_of(set(fold(text).split())))
    shared = rows.sparkSession.sparkContext.broadcast(set(toxic.where(F.col("toxic") >= LEAST_ROWS).select("p").toPandas()["p"]))
    counts = _counted(rows, lambda text, y: patterns_of(set(fold(text).split())) & shared.value)
    weights = counts.withColumn("w", F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))).where(F.col("w") >= LEAST_WEIGHT)
    kept: dict[str, float] = {}
    for p, w in sorted(((r["p"], r["w"]) for r in weights.select("p", "w").collect()), key=lambda x: (len(x[0]), x[0])):
        word = p.strip()
        if not any(kept.get(f" {word[:k]}", -9.0) >= w - 1.0 for k in STEMS if k <= len(word)):
            kept[p] = w
    plain = Lexicon(kept)

    def phrases(text: str, y: int) -> set[str]:
        line = fold(text)
        return phrases_of(line, plain.hits(_machine(plain), line))

    return Lexicon(kept, tuple(sorted(r["p"] for r in _counted(rows, phrases).where((F.col("clean") >= LEAST_CLEAN) & (F.col("toxic") == 0)).collect())))


def learn(rows: DataFrame) -> Lexicon:
    """A lexicon from labelled rows (text, y): their entries, and coefficients of the score.

    The coefficients are a logistic fit on the same rows. Fitted on a fifth of them that the entries don't see, they miss
    more held-out toxic rows (5 of 718, against none, of 0.1 GB of documents), as new words weigh less there.
    """
    lexicon = entries(rows)
    if not lexicon.weights:
        return lexicon

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.features(_machine(lexicon), fold(x)) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64()), batch.column(1)], names=["a", "d", "y"])

    table = rows.select("text", "y").mapInArrow(features, "a double, d double, y int").groupBy("a", F.round("d", 3).alias("d"), "y").agg(F.count("*").alias("n")).collect()  # of bounded training rows
    lexicon.coefficients = _logistic(np.array([[1.0, r["a"], r["d"]] for r in table]), np.array([r["y"] > 0 for r in table], float), np.array([r["n"] for r in table], float))
    return lexicon


def phrases_of(line: str, hits: dict[int, float]) -> set[str]:
    """Each hit word with the word before it, and with the one after it."""
    found = set()
    for at in hits:
        end = line.index(" ", at + 1)
        if at:
            found.add(line[line.rindex(" ", 0, at) : end + 1])
        if end + 1 < len(line):
            found.add(line[at : line.index(" ", end + 1) + 1])
    return found


_machines: dict[str, object] = {}


def _machine(lexicon: Lexicon):
    """The automaton of a lexicon, made once per process."""
    if lexicon.name not in _machines:
        if len(_machines) > 2:
            _machines.clear()
        _machines[lexicon.name] = lexicon.automaton()
    return _machines[lexicon.name]


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, float, float]:
    """Newton's method for a weighted logistic fit with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (n * (y - p)) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in b)


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, n_hits): how likely each text is toxic by the lexicon.

    One automaton over all entries and exception phrases scans each folded text once; the weight found is divided by the
    square root of the number of words. Null and empty texts get the score of a text without hits; repeated rows are
    scored each; a null id stays null; an empty table gives an empty one; other columns are not looked at.
    """

    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the training rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        machine = _machine(own)
        for batch in batches:
            found = [own.score(machine, fold(x.as_py())) for x in batch.column(1)]
            score = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32()), pa.array([x[1] for x in found], pa.int64())], names=["doc_id", "score", "predicted", "n_hits"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, n_hits long")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, most: int = TRAINING_ROWS) -> DataFrame:
    """Learn a lexicon from at most ``most`` labelled rows that aren't held out, and score every text: adds ``held_out``."""
    lexicon = learn(training_rows(docs, labels, label, most))
    return score_toxicity(docs, lexicon, threshold).withColumn("held_out", held_out("doc_id"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents, all columns, without those that the lexicon scores at the threshold or above.

    Null and empty texts are scored as texts without hits; repeated rows go or stay together; other columns are kept as they
    are, whatever their names; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        machine = _machine(own)
        for batch in batches:
            yield batch.filter(pa.array([own.score(machine, fold(x.as_py()))[0] < threshold for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
