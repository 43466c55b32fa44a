"""Token ids of whole texts with a lower-casing word BPE of the ``tokenizers`` library.

The library encodes each distinct pre-token once per Python process; texts are split, and known pre-tokens looked up, with
array operations. A text with a character outside the plain Latin range, a control character or a special token goes
through the library as a whole, so ids always equal the library's.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache

import numpy as np

from velofield.llm.shared import U64, Prefixes, ranges, table

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_PLAIN = 0x180
_SPACE, _LETTER, _NUMBER, _OTHER, _HARD = 0, 1, 2, 3, 4
_SPACES = "\t\n\x0b\x0c\r \xa0"


def _classes() -> tuple[np.ndarray, np.ndarray]:
    kind, lower = np.full(_PLAIN + 1, _HARD, np.uint8), np.zeros(_PLAIN + 1, np.uint32)
    for c in range(_PLAIN):
        x = chr(c)
        low = x.lower()
        category = unicodedata.category(x)
        if x in _SPACES:
            kind[c] = _SPACE
        elif category == "Cc" or len(low) != 1 or ord(low) >= _PLAIN:
            continue
        else:
            kind[c] = {"L": _LETTER, "N": _NUMBER}.get(category[0], _OTHER)
        lower[c] = ord(low)
    return kind, lower


_KIND, _LOWER = _classes()
_CODES = table(_PLAIN + 1, 11)


@cache
def _all_characters() -> tuple[np.ndarray, np.ndarray]:
    """The class and the number of every character; those of the plain Latin range as above, but none is hard."""
    kinds = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}
    kind = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    kind[[ord(c) for c in _SPACES + "\x85"]] = _SPACE
    return kind, table(0x110000, 11)


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins for bytes that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Token ids by the hash of a pre-token: an open-addressing table in arrays, emptied when it holds ``most`` entries."""

    def __init__(self, most: int = 1 << 21):
        self.most = most
        self.clear()

    def clear(self, bits: int = 16) -> None:
        self.bits, self.size = bits, 0
        self.keys, self.values = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)
        self.first, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return (h >> U64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, -1 where there is none."""
        slot = self._slots(h)
        key = self.keys[slot]
        hit = key == h
        found = np.where(hit, self.values[slot], -1)
        open_ = np.flatnonzero(~hit & (key != 0))
        last = len(self.keys) - 1
        while len(open_):
            slot[open_] = (slot[open_] + 1) & last
            key = self.keys[slot[open_]]
            hit = key == h[open_]
            found[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
        return found

    def _place(self, h: np.ndarray, value: np.ndarray) -> None:
        slot, open_, last = self._slots(h), np.arange(len(h)), len(self.keys) - 1
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            self.keys[slot[free]] = h[free]
            won = free[self.keys[slot[free]] == h[free]]
            self.values[slot[won]] = value[won]
            open_ = open_[self.keys[slot[open_]] != h[open_]]
            slot[open_] = (slot[open_] + 1) & last

    def add(self, h: np.ndarray, ids: list[list[int]]) -> None:
        """New, distinct hashes with their ids."""
        if self.size and self.size + len(h) > self.most:
            self.clear()
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for y in ids for x in y), np.uint32, int(count.sum()))
        n, used = self.size + len(h), self.used + len(flat)
        if n > len(self.first):
            grow = max(n, 2 * len(self.first))
            self.first, self.count = (np.resize(x, grow) for x in (self.first, self.count))
        if used > len(self.pool):
            self.pool = np.resize(self.pool, max(used, 2 * len(self.pool)))
        self.pool[self.used : used] = flat
        self.first[self.size : n] = self.used + np.cumsum(count) - count
        self.count[self.size : n] = count
        value = np.arange(self.size, n, dtype=np.int32)
        self.size, self.used = n, used
        if 2 * n > len(self.keys):
            old, kept = self.keys, self.values
            self.bits = max(self.bits + 1, (2 * n).bit_length())
            self.keys, self.values = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32)
            full = old != 0
            self._place(old[full], kept[full])
        self._place(h, value)

    def ids(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries, one entry after another, and how many each has."""
        count = self.count[entry]
        return self.pool[ranges(self.first[entry], count)], count


class Words:
    """Pre-tokens of many texts: where each starts and ends among the lower-cased characters, its hash, its text."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, whole: np.ndarray | None = None):
        codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        lead = (raw & 0xC0) != 0x80
        place = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(lead, out=place[1:])
        self.doc = place[starts]
        codes = np.minimum(codes, _PLAIN)
        kind = _KIND[codes]
        n = len(codes)
        hard = np.flatnonzero(kind == _HARD)
        special = np.flatnonzero((codes[:-1] == ord("<")) & (codes[1:] == ord("|"))) if n else hard
        docs = len(starts) - 1
        self.hard = np.zeros(docs, bool)
        for at in (hard, special):
            self.hard[np.searchsorted(self.doc, at, side="right") - 1] = True
        if self.hard.any():
            kind[ranges(self.doc[:-1][self.hard], np.diff(self.doc)[self.hard])] = _SPACE
        self.codes = _LOWER[codes]
        self.raw, self.starts = raw, starts
        self._cut(kind, _CODES)

    def _cut(self, kind: np.ndarray, numbers: np.ndarray) -> None:
        n = len(kind)
        before = np.zeros(n, np.uint8)
        before[1:] = kind[:-1]
        first = (kind != before) | (kind == _NUMBER)
        first[self.doc[:-1][self.doc[:-1] < n]] = True
        self._contractions(kind, before, first, n)
        first &= kind != _SPACE
        self.start = np.flatnonzero(first)
        last = kind != _SPACE
        if n:
            last[:-1] &= first[1:] | (kind[1:] == _SPACE)
        self.end = np.flatnonzero(last) + 1
        self.hash = Prefixes(numbers[self.codes]).of(self.start, self.end)
        self.per_doc = np.searchsorted(self.start, self.doc)

    def of_hard(self) -> Words:
        """The pre-tokens of the hard texts alone, by the same rules for all characters; special tokens are cut as others are.

        A pre-token has the same hash here and in a plain text.
        """
        texts = [self.raw[self.starts[k] : self.starts[k + 1]].tobytes().decode("utf-8", "replace") for k in np.flatnonzero(self.hard)]
        found = Words.__new__(Words)
        parts = [np.frombuffer(unicodedata.normalize("NFC", x).replace("Σ", "σ").lower().encode("utf-32-le"), np.uint32) for x in texts]
        found.hard = np.zeros(len(texts), bool)
        found.doc = np.cumsum([0, *map(len, parts)])
        found.codes = np.concatenate([np.zeros(0, np.uint32), *parts])
        kind, numbers = _all_characters()
        found._cut(kind[found.codes], numbers)
        return found

    def _contractions(self, kind: np.ndarray, before: np.ndarray, first: np.ndarray, n: int) -> None:
        """'s 't 're 've 'm 'll 'd at the start of a match are pre-tokens of their own."""
        quote = np.flatnonzero((self.codes == ord("'")) & (kind == _OTHER) & first)
        if not len(quote):
            return
        ends = self.doc[np.searchsorted(self.doc, quote, side="right")]
        text = np.concatenate([self.codes, np.zeros(2, np.uint32)])
        one = np.where(quote + 1 < ends, text[quote + 1], 0)
        two = np.where(quote + 2 < ends, text[quote + 2], 0)
        is_ = lambda x, c: x == ord(c)
        short = is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")
        long_ = (is_(one, "r") & is_(two, "e")) | (is_(one, "v") & is_(two, "e")) | (is_(one, "l") & is_(two, "l"))
        for at, size in ((quote[short], 2), (quote[long_], 3)):
            for k in range(1, size):
                first[at + k] = False
            after = at + size
            first[after[after < n]] = True

    def text(self, k: int) -> str:
        return self.codes[self.start[k] : self.end[k]].tobytes().decode("utf-32-le")


class Encoder:
    """Encodes the texts of a chunk; one per Python process and tokenizer file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.known = WordIds()
        self.wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def word(self, text: str) -> list[int]:
        return [x.id for x in self.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def entries(self, words: Words) -> np.ndarray:
        """The entry of each pre-token; unknown ones are encoded first."""
        found = self.known.find(words.hash)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, at = np.unique(words.hash[missing], return_index=True)
            size = self.known.size
            self.known.add(new, [self.word(words.text(k)) for k in missing[at]])
            if self.known.size < size + len(new):  # emptied meanwhile
                return self.entries(words)
            found[missing] = self.known.find(words.hash[missing])
        return found

    def encode(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
        """The ids of all texts one after another, and where each text's ids start (one entry more than texts)."""
        words = Words(raw, starts)
        ids, count = self.known.ids(self.entries(words))
        upto = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=upto[1:])
        first = upto[words.per_doc]
        if not words.hard.any():
            return ids, first, words
        parts, sizes = [], np.diff(first)
        for k in range(len(starts) - 1):
            if words.hard[k]:
                parts.append(np.array(self.whole(raw[starts[k] : starts[k + 1]].tobytes().decode("utf-8", "replace")), np.uint32))
                sizes[k] = len(parts[-1])
            else:
                parts.append(ids[first[k] : first[k + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)]), words
