"""Words, lines and shingles of Arrow text columns as NumPy arrays.

The helpers work on the UTF-8 bytes of many texts at once, so no Python object is made for a word. A text of null
counts as empty. Words are hashed to 64 bits; two different words or shingles share a hash with probability 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Texts are taken together up to this many bytes; one longer text is taken alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE = np.uint64(0xD6E8FEB86659FD93)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: Fixed: bytes that separate words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mixed((total[end] - total[start]) * down[start])


@dataclass
class Texts:
    """A run of rows: their bytes, and where each text starts and ends."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """How many marked bytes each text has."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(marks, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


@dataclass
class Words:
    """Spans of words in the order of the texts; ``text`` is the row within the run."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each text: its first word; one more for the end

    def __len__(self) -> int:
        return len(self.start)


def runs(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of an Arrow column in runs of about ``most`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield Texts(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def spans(texts: Texts, inside: np.ndarray) -> Words:
    """Longest spans of bytes marked ``inside`` that do not cross texts."""
    n = len(texts.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(len(texts) + 1, np.int64))
    border = np.zeros(n + 1, bool)
    border[texts.offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | border[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | border[1:])) + 1
    first = np.searchsorted(start, texts.offsets, "left")
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(text, start, end, first)


def words_of(texts: Texts) -> Words:
    """Runs of anything but ASCII white space."""
    return spans(texts, ~SPACE[texts.data])


def windows(words: Words, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``n`` words in a row within one text, and the position of the first of them."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    size = len(words) - n + 1
    value = np.zeros(size, np.uint64)
    for i in range(n):
        value = value * _SHINGLE + hashes[i : i + size]
    at = np.flatnonzero(words.text[:size] == words.text[n - 1 :])
    return mixed(value[at]), at


def shingle_sets(texts: Texts, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text in lower case (A-Z), in ascending order, and where each text's set starts.

    A text with fewer words has its whole sequence as one shingle, one without words none.
    """
    low = LOWER[texts.data]
    words = words_of(texts)
    hashes = span_hashes(low, words.start, words.end)
    value, at = windows(words, hashes, n)
    owner = words.text[at]
    count = np.diff(words.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(n - 1):
            has = count[short] > i
            word = hashes[np.minimum(words.first[short] + i, len(hashes) - 1)]
            whole = np.where(has, whole * _SHINGLE + word, whole)
        value = np.concatenate([value, mixed(whole + count[short].astype(np.uint64))])
        owner = np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(texts) + 1), "left")
