"""Words of many texts at once, as numpy arrays over one buffer of bytes.

A word is a run of letters, digits and marks, in lower case; a character of a script that writes no spaces (Chinese,
Japanese, Thai and others), and a non-ASCII symbol, is a word by itself. Spaces and punctuation are in no word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text per step: numpy needs some 60 times that. A longer text is a step of its own.
STEP = 1 << 20
#: Texts per step, so that their numbers fit in 16 bits.
TEXTS = 1 << 15

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
#: Blocks of scripts without spaces: Thai and Lao, Tibetan, Burmese, Khmer, Chinese and Japanese.
_UNSPACED = (
    (0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x3005, 0x3007), (0x3021, 0x312F), (0x31A0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF),
)
_SPACE, _INSIDE, _ALONE = 0, 1, 2
_kinds: list[np.ndarray] = []
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base of the rolling hash, and of its inverse."""
    if _powers[0].size <= n:
        size = max(n + 1, STEP + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _kind() -> np.ndarray:
    """By code point: whether it is in no word, in one, or one by itself."""
    if not _kinds:
        found = np.full(0x110000, _INSIDE, np.uint8)
        for k in range(128, 0x20000):
            if (c := unicodedata.category(chr(k))[0]) in "ZPS":
                found[k] = _ALONE if c == "S" else _SPACE
        found[[*range(128, 160), 0x200B, 0xFE0E, 0xFE0F, 0xFEFF]] = _SPACE
        for first, last in _UNSPACED:
            found[first : last + 1][found[first : last + 1] == _INSIDE] = _ALONE
        _kinds.append(found)
    return _kinds[0]


def _split(data: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Takes the non-ASCII characters of no word out of inside; gives the places before and after characters that are words."""
    lead = np.flatnonzero(data >= 0xC0)
    if not lead.size:
        return lead
    size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
    point = data[lead].astype(np.int64) & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << 6 | data[lead[more] + k] & 0x3F
    kind = _kind()[point]
    none = kind == _SPACE
    for k in range(4):
        inside[lead[none & (size > k)] + k] = False
    alone = kind == _ALONE
    return np.concatenate([lead[alone], lead[alone] + size[alone]])


@dataclass
class Step:
    """Some texts: first is the number of the first; ends and words are counted within the step."""

    first: int
    n: int
    data: np.ndarray  # bytes, in lower case
    edges: np.ndarray  # n + 1 offsets of the texts in data
    starts: np.ndarray  # of the words, in data
    ends: np.ndarray
    doc: np.ndarray  # of the words
    _sums: np.ndarray

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the stretches of data from starts to ends."""
        return mixed((self._sums[ends] - self._sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))

    def letters(self) -> np.ndarray:
        """Characters of each word."""
        seen = np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])
        return seen[self.ends] - seen[self.starts]


def grams(words: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of n words each, and the places where they start; none crosses texts."""
    if words.size < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = words.size - n + 1
    total = np.zeros(last, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD1342543DE82EF95) + words[k : k + last]
    at = np.flatnonzero(doc[:last] == doc[n - 1 :])
    return mixed(total[at]), at


def steps(texts: pa.Array | pa.ChunkedArray, lower: bool = True) -> Iterator[Step]:
    """texts in order, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.utf8_lower(texts) if lower else texts
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        upto = min(max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, "right")) - 1), first + TEXTS)
        part = data[offsets[first] : offsets[upto]]
        edges = offsets[first : upto + 1] - offsets[first]
        powers, _ = _grown(part.size)
        sums = np.zeros(part.size + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers[: part.size], out=sums[1:])
        inside = _IN_WORD[part]
        apart = _split(part, inside)
        before, after = np.zeros(part.size + 1, bool), np.zeros(part.size + 1, bool)
        before[1:], after[: part.size] = inside, inside
        before[edges] = before[apart] = False
        opens = inside & ~before[:-1]
        tail = after[1:].copy()
        tail[edges[1:][edges[1:] > 0] - 1] = tail[apart[apart > 0] - 1] = False
        closes = inside & ~tail
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        yield Step(first, upto - first, part, edges, starts, ends, np.searchsorted(edges, starts, "right") - 1, sums)
        first = upto
