"""Arrow text columns as byte buffers: words, hashes and counts without a Python loop over words.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``. Texts are handled in slices of bounded size; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes in a slice; a single longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 2 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalised 64-bit hash of 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each range: a polynomial in the byte codes, from running sums.

    For hashed features alone: texts can be made whose hashes collide, so that equal hashes don't prove equal ranges.
    """
    n = len(buf)
    part = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[buf] * _power("up", _BASE, n), dtype=np.uint64)])
    return mix((part[ends] - part[starts]) * _power("down", _BACK, n + 1)[starts] + (ends - starts).astype(np.uint64))


class Texts:
    """Some texts: ``buf`` their bytes, ``off`` the n + 1 offsets. Null texts are empty. Words are runs without ``space``."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE):
        self.buf, self.off, self.n = buf, off, len(off) - 1
        word = ~space[buf]
        before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[off[:-1][off[:-1] < len(buf)]] = False
        after[off[1:][off[1:] > 0] - 1] = False
        self.word = word
        self.starts, self.ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
        self.doc = np.searchsorted(off, self.starts, "right") - 1
        #: words before each text, with the total last
        self.first = np.searchsorted(self.starts, off)
        self.n_words = np.diff(self.first)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value of each byte over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.off[1:]] - total[self.off[:-1]]

    def per_word_text(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value of each word over each text."""
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return range_hashes(self.buf, starts, ends)

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def distinct_words(self) -> tuple[list[str], np.ndarray]:
        """The distinct words, and for each word its place among them."""
        return distinct_ranges(self.buf, self.starts, self.ends)

    def word_codes(self) -> np.ndarray:
        """A number for each word; words have the same one if, and only if, they are equal."""
        return range_codes(self.buf, self.starts, self.ends)


def _encoded(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.DictionaryArray:
    """The ranges (in order, none into another) dictionary-encoded by their bytes themselves."""
    step = np.zeros(len(buf) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(buf[inside])]).dictionary_encode()


def distinct_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct texts of the ranges (in order, none into another), and for each range its place among them."""
    found = _encoded(buf, starts, ends)
    return found.dictionary.to_pylist(), found.indices.to_numpy()


def range_codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As ``Texts.word_codes``, for any ranges that are in order and don't reach into one another."""
    return _encoded(buf, starts, ends).indices.to_numpy()


def slices(column: pa.Array, limit: int = SLICE_BYTES, space: np.ndarray = SPACE) -> Iterator[tuple[int, Texts]]:
    """(first row, Texts) over a string or binary column, in order."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, Texts(raw[off[row] : off[to]], off[row : to + 1] - off[row], space)
        row = to


def kept_with_text(docs: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, int]:
    """The kept columns as _k0, _k1 ..., and the text as _text unless it is one of them; and the place of the text."""
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    own = docs.schema[text].dataType.typeName() == "string"
    if text in keep and own:
        return docs.select(*kept), keep.index(text)
    return docs.select(*kept, F.col(text).cast("string").alias("_text")), len(keep)
