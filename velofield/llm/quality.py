"""Quality by naive-Bayes-scaled n-grams and a linear support vector machine (operator 10)."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velofield.llm.labels import TRAINING_ROWS, held_out, training_rows

THRESHOLD = 0.5
#: Rows that an n-gram of the model must be in: so many, and this share of them; so the model has a thousand times the n-grams
#: of a mean row at most.
LEAST_ROWS, LEAST_SHARE = 4, 0.001


class _Shapes(dict):
    """Characters by kind: a for lower case and letters without case, A for upper case, 0 for digits, others themselves."""

    def __missing__(self, c: int) -> str:
        x = chr(c)
        self[c] = kind = "A" if x.isupper() else "a" if x.isalpha() else "0" if x.isdigit() else " " if x.isspace() else x
        return kind


_SHAPES = _Shapes()
_RUNS = re.compile(r"([aA0])\1+")
_LONG = re.compile(r"([^aA0\s])\1{3,}")


def grams_of(text: str | None) -> set[str]:
    """The n-grams that a text has: words, shapes of one to three neighbouring words, and its length's magnitude."""
    if not text:
        return {"\x02"}
    found = set(text.lower().split())
    shapes = _LONG.sub(r"\1\1\1", _RUNS.sub(r"\1", text.translate(_SHAPES))).split()
    found.update(f"\x01{a}" for a in set(shapes))
    found.update(f"\x01{a} {b}" for a, b in set(zip(shapes, shapes[1:], strict=False)))
    found.update(f"\x01{a} {b} {c}" for a, b, c in set(zip(shapes, shapes[1:], shapes[2:], strict=False)))
    found.add(f"\x02{int(2 * math.log2(1 + len(shapes)))}")
    return found


@dataclass
class Model:
    """A weight per n-gram (its log-count ratio is multiplied in), and the logistic curve over margins."""

    weights: dict[str, tuple[float, float]]  # weight times ratio, square of the ratio
    bias: float = 0.0
    curve: tuple[float, float] = (0.0, 0.0)

    def margin(self, grams: set[str]) -> float:
        total = norm = 0.0
        for w in map(self.weights.get, grams):
            if w is not None:
                total += w[0]
                norm += w[1]
        return total / math.sqrt(norm or 1.0) + self.bias

    def score(self, text: str | None) -> float:
        a, b = self.curve
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a * self.margin(grams_of(text)) + b))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int, cost: float = 1.0, rounds: int = 30, tolerance: float = 1e-3, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for the linear hinge loss; the last of the ``n + 1`` weights is the bias."""
    w, alpha = np.zeros(n + 1), np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in random.permutation(len(rows)):
            at, v, sign = rows[i], values[i], y[i]
            g = sign * (float(w[at] @ v) + w[n]) - 1.0
            if (alpha[i] <= 0.0 and g >= 0.0) or (alpha[i] >= cost and g <= 0.0):
                continue
            worst = max(worst, abs(g))
            new = min(max(alpha[i] - g / square[i], 0.0), cost)
            step = (new - alpha[i]) * sign
            alpha[i] = new
            if step:
                w[at] += step * v
                w[n] += step
        if worst < tolerance:
            break
    return w


def learn(rows: DataFrame) -> Model:
    """Fit on labelled rows (doc_id, text, y, part): those of part 0, a fifth, set the logistic curve."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())

        def out():
            keys = [*(found[0].keys() | found[1].keys())]
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([found[1][k] for k in keys], pa.int64()), pa.array([found[0][k] for k in keys], pa.int64())], names=["g", "good", "bad"])
            found[0].clear()
            found[1].clear()
            return batch

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found[y > 0].update(grams_of(text))
                if len(found[0]) + len(found[1]) > 200_000:
                    yield out()
        yield out()

    fit = rows.where("part > 0")
    least = max(LEAST_ROWS, math.ceil(LEAST_SHARE * fit.count()))
    sums = fit.select("text", "y").mapInArrow(count, "g string, good long, bad long").groupBy("g").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    sums = sums.where(F.col("good") + F.col("bad") >= least).toPandas().sort_values("g")
    if not len(sums):
        return Model({})
    good, bad = sums["good"].to_numpy(float) + 1, sums["bad"].to_numpy(float) + 1
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    place = {g: k for k, g in enumerate(sums["g"])}
    shared = rows.sparkSession.sparkContext.broadcast(place)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [sorted(k for k in map(shared.value.get, grams_of(x)) if k is not None) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([np.array(x, "<i4").tobytes() for x in at], pa.binary()), batch.column(1), batch.column(2)], names=["at", "y", "part"])

    coded = rows.select("text", "y", F.col("part").cast("int").alias("part")).mapInArrow(encode, "at binary, y int, part int").toPandas()  # of bounded training rows
    where = [np.frombuffer(x, "<i4") for x in coded["at"]]
    values = [ratio[x] / (float(np.sqrt(ratio[x] @ ratio[x])) or 1.0) for x in where]
    y, fits = np.where(coded["y"] > 0, 1.0, -1.0), coded["part"].to_numpy() > 0
    if len(set(y[fits])) < 2:
        return Model({}, 0.0, (0.0, 30.0 if len(y) and y[0] > 0 else -30.0))
    own = np.flatnonzero(fits)
    w = descend([where[i] for i in own], [values[i] for i in own], y[own], len(ratio))
    rest = np.flatnonzero(~fits) if len(set(y[~fits])) == 2 else own
    margins = np.array([float(w[where[i]] @ values[i]) + w[-1] for i in rest])
    return Model({g: (float(w[k] * ratio[k]), float(ratio[k] ** 2)) for g, k in place.items()}, float(w[-1]), _curve(margins, y[rest] > 0))


def _curve(margin: np.ndarray, good: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Logistic curve over margins by Newton's method, with a small ridge that keeps separable rows finite."""
    x, b = np.stack([margin, np.ones_like(margin)], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2), x.T @ (good - p) - 0.05 * b)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return float(b[0]), float(b[1])


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted): how likely each text is good.

    Null and empty texts have one n-gram of their own and so a score; repeated rows are scored each; a null id stays null;
    an empty table gives an empty one; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # see LEAST_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            score = [own.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array([int(s >= threshold) for s in score], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, most: int = TRAINING_ROWS) -> DataFrame:
    """Fit on at most ``most`` labelled rows that aren't held out, and score every text: adds ``held_out``."""
    return score_quality(docs, learn(training_rows(docs, labels, label, most)), threshold).withColumn("held_out", held_out("doc_id"))
