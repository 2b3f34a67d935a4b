"""Token ids of whole texts from the ids of their distinct words."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from meterlake.llm.textbuf import SLICE_BYTES, Texts, distinct_ranges, slices

#: What no token of the vocabulary crosses: space and line feed.
BREAK = np.zeros(256, bool)
BREAK[[0x20, 0x0A]] = True
#: Words and parts of words that a worker remembers; with more it starts anew.
MEMO_UNITS = 300_000


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) in order, of about ``limit`` bytes each; null texts are empty. A text is never cut."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    row = 0
    while row < len(column):
        to = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield row, column.slice(row, to - row).to_pylist()
        row = to


#: Classes of bytes in plain words: letters, digits, and other visible characters.
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = _OTHER
_CLASS[[ord(c) for c in "<'"]] = 0
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _units(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, words before each text's units) of what can be encoded by itself.

    Plain words (ASCII and Latin-1 letters, digits, other visible ASCII but apostrophes and ``<``) are lower-cased and cut into
    runs of letters, single digits and runs of the rest, just as the vocabulary's splitter cuts them. Other words stay whole.
    """
    buf, kind, lower = t.buf, _CLASS[t.buf], _LOWER[t.buf]
    lead = np.flatnonzero(buf[:-1] == 0xC3) if len(buf) else np.zeros(0, np.int64)
    second = buf[lead + 1]
    latin = lead[(second & 0xC0 == 0x80) & (second != 0x97) & (second != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    upper = latin[buf[latin + 1] < 0x9F] + 1
    lower[upper] += 0x20
    odd = np.concatenate([[0], np.cumsum((kind == 0) & t.word)])
    plain = odd[t.ends] == odd[t.starts]
    inside = np.zeros(len(buf) + 1, np.int8)
    inside[t.starts[plain]] += 1
    inside[t.ends[plain]] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    cut = np.zeros(len(buf), bool)
    cut[1:] = inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
    # a letter of two bytes is never cut in the middle, and a digit ends before what follows it
    cut[t.starts] = True
    cut &= t.word
    starts = np.flatnonzero(cut)
    word = np.searchsorted(t.starts, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(buf)), t.ends[word])
    return np.where(inside, lower, buf), starts, ends, np.searchsorted(starts, t.off)


class WordTokens:
    """Encodes texts by their words: runs without space and line feed, which no token of the vocabulary crosses.

    Distinct words and parts of plain words are encoded once; ``PreTokens`` remembers them.
    """

    def __init__(self, pre_tokens: PreTokens):
        self.pre_tokens = pre_tokens

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the offsets of each text in it. The texts' words are those between BREAKs."""
        units, place = distinct_ranges(*(found := _units(texts))[:3])
        gc.disable()  # a great many small lists, none of them in a cycle
        ids = self.pre_tokens.encode_units(units)
        gc.enable()
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, first = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), np.cumsum(sizes) - sizes
        size = sizes[place]
        ends = np.concatenate([[0], np.cumsum(size)])
        return flat[np.repeat(first[place] - ends[:-1], size) + np.arange(ends[-1])], ends[found[3]]


def break_slices(column: pa.Array) -> Iterator[tuple[int, Texts]]:
    return slices(column, SLICE_BYTES, BREAK)


def _byte_characters() -> dict[int, str]:
    """For ASCII and Latin-1 letters: the characters that stand for their UTF-8 bytes in a byte-level vocabulary.

    Printable bytes stand for themselves; the rest are numbered from 256 on.
    """
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in shown]
    of_byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(of_byte[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_BYTES = _byte_characters()
#: What ``_units`` makes of plain words; anything else is a whole word.
PLAIN_UNIT = re.compile(r"[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")


class PreTokens:
    """Ids of words through their pre-tokens, which ``encode_pre_tokens`` encodes; the library normalizes and splits."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo: dict[str, tuple[int, ...]] = {}

    def pre_tokens(self, word: str) -> list[str | int]:
        """The word's pre-tokens in byte characters; the id where it holds a special token."""
        parts = self.at_special.split(word) if self.at_special else [word]
        normalize, split = self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        return [x for part in parts if part for x in ([self.special[part]] if part in self.special else (p for p, _ in split(normalize(part))))]

    def encode_pre_tokens(self, pre_tokens: list[str]) -> list[tuple[int, ...]]:
        """By the library's own model."""
        tokenize = self.library.model.tokenize
        return [tuple([t.id for t in tokenize(p)]) for p in pre_tokens]

    def encode_units(self, units: list[str]) -> list[tuple[int, ...]]:
        """Ids of parts of plain words, which are pre-tokens already, and of other words."""
        memo = self.memo
        new = [u for u in units if u not in memo]
        if len(memo) + len(new) > MEMO_UNITS:
            memo.clear()
            new = units
        whole = PLAIN_UNIT.fullmatch
        ready = [u for u in new if whole(u)]
        memo.update(zip(ready, self.encode_pre_tokens([u if u.isascii() else u.translate(_BYTES) for u in ready]), strict=True))
        rest = [u for u in new if u not in memo]
        split = [self.pre_tokens(u) for u in rest]
        parts = list({p for found in split for p in found if isinstance(p, str)})
        ids_of = dict(zip(parts, self.encode_pre_tokens(parts), strict=True))
        memo.update((u, tuple([i for p in found for i in ((p,) if isinstance(p, int) else ids_of[p])])) for u, found in zip(rest, split, strict=True))
        return [memo[u] for u in units]


@cache
def library_words(path: str) -> WordTokens:
    """The library's ids; one for each Python worker."""
    return WordTokens(PreTokens(path))
