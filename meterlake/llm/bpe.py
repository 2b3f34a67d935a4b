"""Byte-pair encoding and decoding of whole texts with a public vocabulary, by a pair occurrence index.

A partition's texts are read in slices of bounded size; the distinct pre-tokens that the worker does not remember,
INDEX_WORDS at a time, lie in one linked sequence of symbols. An index maps each mergeable pair to all its positions. The lowest active rank is applied to all its positions at once, and only the lists of the neighbouring pairs
that a merge makes are updated; pairs that a merge has destroyed are recognised when their turn comes.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.word_tokens import PreTokens, WordTokens, break_slices

#: Pre-tokens indexed at a time.
INDEX_WORDS = 5_000


class PairIndexBpe(PreTokens):
    """The BPE model of a tokenizers file whose words end in a suffix."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.merges = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        #: rank of a pair, by its left and by its right symbol
        self.rank_to_right: dict[int, dict[int, int]] = {}
        self.rank_to_left: dict[int, dict[int, int]] = {}
        for r, (a, b, _) in enumerate(self.merges):
            self.rank_to_right.setdefault(a, {})[b] = r
            self.rank_to_left.setdefault(b, {})[a] = r
        # ids of characters inside and at the end of a pre-token, and the ranks of pairs of those
        characters = [c for c in self.vocab if len(c) == 1]
        self.of_character = np.full((2, max(map(ord, characters)) + 2), -1, np.int64)
        for c in characters:
            self.of_character[:, ord(c)] = self.vocab[c], self.vocab.get(c + self.suffix, -1)
        symbols = np.unique(self.of_character[self.of_character >= 0])
        self.of_symbol = np.zeros(len(self.vocab) + len(self.special) + 1, np.int64)
        self.of_symbol[symbols] = np.arange(len(symbols))
        self.first_rank = np.full((len(symbols), len(symbols)), -1, np.int64)
        for i, a in enumerate(symbols.tolist()):
            for b, r in self.rank_to_right.get(a, {}).items():
                if symbols[min(int(np.searchsorted(symbols, b)), len(symbols) - 1)] == b:
                    self.first_rank[i, self.of_symbol[b]] = r

    def _first_symbols(self, pre_tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all characters, the last of a pre-token with the suffix, and the offsets; characters without an id are left out."""
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pre_tokens), np.int64, len(pre_tokens)))])
        points = np.frombuffer("".join(pre_tokens).encode("utf-32-le"), np.uint32)
        last = np.zeros(len(points), np.int64)
        last[at[1:] - 1] = 1
        ids = self.of_character[last, np.minimum(points, self.of_character.shape[1] - 1)]
        return ids[ids >= 0], np.concatenate([[0], np.cumsum(ids >= 0)])[at]

    def encode_pre_tokens(self, pre_tokens: list[str]) -> list[tuple[int, ...]]:
        return [ids for i in range(0, len(pre_tokens), INDEX_WORDS) for ids in self._merged(pre_tokens[i : i + INDEX_WORDS])]

    def _merged(self, pre_tokens: list[str]) -> list[tuple[int, ...]]:
        first, at = self._first_symbols(pre_tokens)
        # the index: positions of each mergeable pair, by rank
        inner = np.ones(len(first), bool)
        inner[at[at > 0] - 1] = False
        left = np.flatnonzero(inner)
        ranks = self.first_rank[self.of_symbol[first[left]], self.of_symbol[first[left + 1]]]
        left, ranks = left[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        found, begin = np.unique(ranks[order], return_index=True)
        where = {r: x.tolist() for r, x in zip(found.tolist(), np.split(left[order], begin[1:]), strict=True)} if len(found) else {}
        sym = first.tolist()
        after, before = np.arange(1, len(sym) + 1), np.arange(-1, len(sym) - 1)
        after[~inner] = -1
        before[at[:-1][at[:-1] < len(sym)]] = -1
        after, before = after.tolist(), before.tolist()
        active = list(where)
        heapq.heapify(active)
        push, none = heapq.heappush, {}
        while active:
            r = heapq.heappop(active)
            old_left, old_right, merged = self.merges[r]
            to_right, to_left = self.rank_to_right.get(merged, none), self.rank_to_left.get(merged, none)
            for i in sorted(where.pop(r)):
                j = after[i]
                if sym[i] != old_left or j < 0 or sym[j] != old_right:
                    continue
                sym[i], sym[j] = merged, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if to_right and (n := to_right.get(sym[k])) is not None:
                        if n in where:
                            where[n].append(i)
                        else:
                            where[n] = [i]
                            push(active, n)
                if to_left and (h := before[i]) >= 0 and (n := to_left.get(sym[h])) is not None:
                    if n in where:
                        where[n].append(h)
                    else:
                        where[n] = [h]
                        push(active, n)
        ids = np.array(sym, np.int64)
        ends = np.concatenate([[0], np.cumsum(ids >= 0)])[at].tolist()
        ids = ids[ids >= 0].tolist()
        return [tuple(ids[i:j]) for i, j in zip(ends, ends[1:], strict=False)]


class TokenTexts:
    """Decodes as a file without a decoder has it: the tokens joined by one space, special ones too. Unknown ids are left out."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokens = {i: t.encode() for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        size = np.zeros(max(tokens, default=-1) + 1, np.int64)
        for i, t in tokens.items():
            size[i] = len(t) + 1
        self.size, self.start = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(tokens[i] + b" " for i in sorted(tokens)), np.uint8)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> pa.Array:
        """Texts of the ids between the offsets."""
        known = (ids >= 0) & (ids < len(self.size))
        known[known] = self.size[ids[known]] > 0
        off = np.concatenate([[0], np.cumsum(known)])[off]
        ids = ids[known]
        size = self.size[ids]
        size[off[1:][off[1:] > off[:-1]] - 1] -= 1
        ends = np.concatenate([[0], np.cumsum(size)])
        data = self.bytes[np.repeat(self.start[ids] - ends[:-1], size) + np.arange(ends[-1])]
        return pa.Array.from_buffers(pa.large_string(), len(off) - 1, [None, pa.py_buffer(ends[off].astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())


@cache
def _words(path: str) -> WordTokens:
    """One for each Python worker."""
    return WordTokens(PairIndexBpe(path))


@cache
def _texts(path: str) -> TokenTexts:
    return TokenTexts(path)


def _other_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in batch.schema.names), *new.values()], [*batch.schema.names, *new])


def _lists(ids: np.ndarray, off: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))


def _encoder(path: str, n: int, decoded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for batch in batches:
            for row, texts in break_slices(batch.column(n)):
                ids, off = words.encode(texts)
                new = {"ids": _lists(ids, off)} | ({"decoded": _texts(path).decode(ids, off)} if decoded else {})
                yield _other_columns(batch.slice(row, texts.n).select(range(n)), new)

    return run


def _decoder(path: str, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(0, batch.num_rows, 1000):
                some = batch.slice(row, 1000)
                ids = some.column(n)
                off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
                flat = pc.fill_null(ids.flatten(), -1).to_numpy(zero_copy_only=False)
                yield _other_columns(some.select(range(n)), {"decoded": _texts(path).decode(flat, off)})

    return run


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", decoded: bool = False) -> DataFrame:
    """``keep`` columns and ids array<int>: the whole text as the tokenizers library encodes it with add_special_tokens=False.

    With ``decoded`` the ids' text comes along, as ``decode`` would give it. Null and empty texts have no ids; repeated
    rows are encoded alike; an empty table gives none. Columns that aren't kept don't matter, whatever their names.
    ``path`` is a file that every executor has.
    """
    inner = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"_k{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep))), "ids array<int>", *["decoded string"] * decoded])
    return inner.mapInArrow(_encoder(path, len(keep), decoded), schema).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "ids", *["decoded"] * decoded)


def decode(encoded: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """``keep`` columns and decoded string, with special tokens; null and empty ids decode to the empty text, null and unknown ones in them to nothing."""
    inner = encoded.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(ids).cast("array<int>").alias("_ids"))
    schema = ", ".join([*(f"_k{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep))), "decoded string"])
    return inner.mapInArrow(_decoder(path, len(keep)), schema).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "decoded")
