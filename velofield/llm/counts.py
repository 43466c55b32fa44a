"""Edit-aware token counts (operator 6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velofield.llm.shared import chunks, utf8
from velofield.llm.tokens import Encoder

#: Pre-tokens of a leaf, about; a leaf that edits make this many times longer is cut anew.
LEAF, GROWN = 64, 8
#: White space for Python and tokenizers alike; words are what is between.
_SPACES = " \t\n\r"


def count_tokens(text: str, encoder: Encoder) -> int:
    """Tokens of a short text."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return len(encoder.encode(raw, np.array([0, len(raw)]))[0])


class CountTree:
    """A document's pre-tokens in leaves, with a binary tree of sums over the leaves' tokens and characters.

    Leaves are cut before a word. A pre-token never contains white space and a token never spans pre-tokens; so the count of
    a text is the sum over its words, and an edit changes the count of the words it touches only. Edits may leave empty
    leaves, and words that go on in the next leaf; so the words touched are looked for over leaves, on both sides.
    """

    def __init__(self, leaves: list[str], tokens: list[int], count: Callable[[str], int]):
        self.count, self.encoded = count, 0
        self._build(leaves, tokens)

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = leaves or [""]
        size = 1
        while size < len(self.leaves):
            size *= 2
        self.size = size
        fill = [0] * (size - len(self.leaves))
        self.tokens = [0] * size + (tokens or [0]) + fill
        self.chars = [0] * size + [len(x) for x in self.leaves] + fill
        for k in range(size - 1, 0, -1):
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, place in it) of a character; the end of the text is in the last leaf that isn't empty."""
        if at >= self.chars[1]:
            leaf = len(self.leaves) - 1
            while leaf and not self.leaves[leaf]:
                leaf -= 1
            return leaf, len(self.leaves[leaf]) + at - self.chars[1]
        k = 1
        while k < self.size:
            k *= 2
            if at >= self.chars[k]:
                at -= self.chars[k]
                k += 1
        return k - self.size, at

    def _set(self, leaf: int, text: str, tokens: int) -> None:
        self.leaves[leaf] = text
        k = leaf + self.size
        step, shift = tokens - self.tokens[k], len(text) - self.chars[k]
        while k:
            self.tokens[k] += step
            self.chars[k] += shift
            k //= 2

    def edit(self, start: int, end: int, text: str) -> int:
        """Replace characters start to end by a text; returns the new total.

        The places are cut to the document. Only the words that the edit touches, out to white space on both sides, are
        encoded: as they were and as they are now.
        """
        start = min(max(start, 0), self.length)
        end = min(max(end, start), self.length)
        i, a = self.find(start)
        j, b = self.find(end)
        old = "".join(self.leaves[i : j + 1])
        b += sum(len(x) for x in self.leaves[i:j])
        left = a
        while True:
            while left > 0 and old[left - 1] not in _SPACES:
                left -= 1
            if left or not i or self.leaves[i - 1][-1:] in tuple(_SPACES):
                break
            i -= 1  # empty, or its last word goes on here
            step = len(self.leaves[i])
            old, a, b, left = self.leaves[i] + old, a + step, b + step, step
        right = b
        while True:
            while right < len(old) and old[right] not in _SPACES:
                right += 1
            if right < len(old) or j + 1 >= len(self.leaves):
                break
            j += 1  # the word goes on in the next leaf if the white space between was edited away
            old += self.leaves[j]
        before, after = old[left:right], old[left:a] + text + old[b:right]
        self.encoded += len(before) + len(after)
        tokens = sum(self.tokens[self.size + i : self.size + j + 1]) - self.count(before) + self.count(after)
        self._set(i, old[:left] + after + old[right:], tokens)
        for k in range(i + 1, j + 1):
            self._set(k, "", 0)
        if len(self.leaves[i]) > GROWN * 8 * LEAF:
            self._cut(i)
        return self.total

    def _cut(self, leaf: int) -> None:
        """Cut a grown leaf before words; other leaves keep their counts."""
        pieces = cut(self.leaves[leaf])
        if len(pieces) > 1:
            self.encoded += len(self.leaves[leaf])
            counts = [self.count(x) for x in pieces]
            tokens = self.tokens[self.size : self.size + len(self.leaves)]
            self._build(self.leaves[:leaf] + pieces + self.leaves[leaf + 1 :], tokens[:leaf] + counts + tokens[leaf + 1 :])


def cut(text: str, size: int = 8 * LEAF) -> list[str]:
    """Pieces of about ``size`` characters, each but the first starting with a word after white space."""
    pieces, at = [], 0
    while len(text) - at > size:
        gap = at + size
        while gap < len(text) and not (text[gap - 1] in _SPACES and text[gap] not in _SPACES):
            gap += 1
        pieces.append(text[at:gap])
        at = gap
    return [*pieces, text[at:]] if at < len(text) or not pieces else pieces


def _leaves(batch: pa.RecordBatch, encoder: Encoder) -> Iterator[tuple[list[int], list[int]]]:
    """By text of the batch's second column: each leaf's last character + 1, and its tokens."""
    raw, starts = utf8(batch.column(1))
    ids, first, words = encoder.encode(raw, starts)
    known = encoder.known.count[encoder.entries(words)]
    upto = np.concatenate([[0], np.cumsum(known)])
    gap = words.start > 0
    gap[gap] = words.end[np.flatnonzero(gap) - 1] < words.start[gap]
    for k in range(batch.num_rows):
        a, b = words.per_doc[k], words.per_doc[k + 1]
        size = int(words.doc[k + 1] - words.doc[k])
        if words.hard[k]:
            yield [size], [int(first[k + 1] - first[k])]
            continue
        heads = np.flatnonzero(gap[a + 1 : b]) + a + 1  # words after white space, but for the first
        heads = heads[np.concatenate([[True], heads[1:] // LEAF != heads[:-1] // LEAF])] if len(heads) else heads
        heads = heads[heads - a >= LEAF // 2]
        edges = np.concatenate([[a], heads, [b]])
        yield [*(words.start[heads] - words.doc[k]).tolist(), size], np.diff(upto[edges]).tolist()


EDITS = "array<struct<start:long,end:long,text:string>>"


def trees(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The trees of all documents, for edits to come: doc_id, text, ends (each leaf's last character + 1), tokens (each leaf's).

    Null and empty texts have one empty leaf.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in chunks(batches, 1):
            found = list(_leaves(batch, encoder))
            columns = [pa.array([x[c] for x in found], pa.list_(pa.int64())) for c in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text", "ends", "tokens"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(build, "doc_id long, text string, ends array<long>, tokens array<long>")


def _counter(encoder: Encoder) -> Callable[[str], int]:
    known: dict[str, int] = {}

    def count(text: str) -> int:
        if text not in known:
            if len(known) > 100_000:
                known.clear()
            known[text] = count_tokens(text, encoder)
        return known[text]

    return count


def _edited(doc: int | None, text: str | None, ends: list[int], tokens: list[int], edits: list | None, count: Callable[[str], int], with_text: bool) -> tuple:
    text = text or ""
    tree = CountTree([text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], tokens, count)
    before, n = tree.total, 0
    for e in edits or []:
        if e is not None:
            tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
            n += 1
    return (doc, before, tree.total, n, tree.encoded, *([tree.text()] if with_text else []))


def _result(rows: list[tuple], with_text: bool) -> pa.RecordBatch:
    names = ["doc_id", "n_tokens_before", "n_tokens", "n_edits", "n_encoded_chars", *(["text"] if with_text else [])]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.string() if x == "text" else pa.int64()) for c, x in enumerate(names)], names=names)


_COUNTED = "doc_id long, n_tokens_before long, n_tokens long, n_edits long, n_encoded_chars long"


def apply_edits(built: DataFrame, tokenizer: str, with_text: bool = False) -> DataFrame:
    """Apply each row's ``edits`` in their order to its tree: doc_id, n_tokens_before, n_tokens, n_edits, n_encoded_chars.

    An edit replaces the characters start to end of the text, as the edits before it left it, by its text; places outside
    are cut to the text, null places and texts are 0 and empty, and null edits are none. Only regions that edits touch are
    encoded again, out to white space, and the sums above them updated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(Encoder.of(tokenizer))
        for batch in batches:
            yield _result([_edited(*row, count, with_text) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)], with_text)

    return built.select("doc_id", "text", "ends", "tokens", F.col("edits").cast(EDITS)).mapInArrow(run, _COUNTED + ", text string" * with_text)


def count_edited(docs: DataFrame, tokenizer: str, edits_col: str = "edits", with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of all documents before and after their edits, trees and edits in one pass (see ``apply_edits``).

    Null and empty texts have no tokens; texts of any length and repeated rows are counted each; a null id stays null; an
    empty table gives an empty one; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        count = _counter(encoder)
        for batch in chunks(batches, 1):
            rows = zip(*(c.to_pylist() for c in batch.columns), _leaves(batch, encoder), strict=True)
            yield _result([_edited(doc, text, *leaves, edits, count, with_text) for doc, text, edits, leaves in rows], with_text)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(edits_col).cast(EDITS).alias("edits"))
    return source.mapInArrow(run, _COUNTED + ", text string" * with_text)


def sample_edits(text: F.Column) -> F.Column:
    """A title put first, ten characters replaced at a third of the text, twenty taken out at two thirds, and a last word."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    third = F.floor(n / 3).cast("long")
    edit = lambda a, b, t: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(t).alias("text"))
    return F.array(edit(F.lit(0), F.lit(0), "Revised: "), edit(third + 9, third + 19, "an other"), edit(2 * third, 2 * third + 20, ""), edit(n + 64, n + 64, " end"))
