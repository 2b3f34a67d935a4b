"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most ``DISTANCE`` bits differ in at most as many bytes, so that they share at
least 8 - DISTANCE of their eight positional bytes: the guaranteed minimum. Postings of single bytes would each hold a
256th of all fingerprints. The index therefore has a posting for each choice of that many positions with the bytes found
there: whatever reaches the minimum meets in one, and nothing else does. The bytes left open bound a posting's
fingerprints (two bytes: 65,536), however large a group of copies is, because equal fingerprints were merged before. In
a posting, shared positional bytes are tallied per pair, pairs that reach the minimum are verified bit by bit, and the
posting gives the links of a spanning forest, fewer than it has members, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.components import connected_components
from meterlake.llm.heavy import looked_up
from meterlake.llm.scratch import table
from meterlake.llm.shingles import digests_of, fingerprint_of, joined_words
from meterlake.llm.word_tokens import text_slices

#: Differing bits up to which fingerprints are linked.
DISTANCE = 2
SHINGLE_WORDS = 3
#: Postings of up to this size compare all their members; larger ones look up each member's neighbours.
SMALL = 128


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Bits set in over half of the XXH64 of the text's shingles, repeats included; 0 for no words."""
    return fingerprint_of(digests_of(joined_words(text), words))


def _fingerprinter(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in text_slices(batch.column(n)):
                prints = np.array([fingerprint(t.encode()) for t in texts], np.uint64).view(np.int64)
                kept = batch.slice(row, len(texts)).select(range(n))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(prints)], [*kept.schema.names, "_print"])

    return run


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and fingerprint (64 bits in a long). Null and empty texts have the fingerprint zero."""
    inner = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"_k{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep))), "_print long"])
    return inner.mapInArrow(_fingerprinter(len(keep)), schema).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_print").alias("fingerprint"))


def _near(difference: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs share enough positional bytes, by tally, and then differ in few enough bits."""
    shared = sum(((difference >> np.uint64(8 * i)) & np.uint64(0xFF)) == 0 for i in range(8))
    return (shared >= 8 - distance) & (np.bitwise_count(difference) <= distance)


def _forest(members: np.ndarray, free: int, distance: int) -> np.ndarray:
    """For each of a posting's distinct fingerprints the place of the first that it is linked to, directly or through others."""
    n = len(members)
    label = np.arange(n)
    if n <= SMALL:
        near = _near(members[:, None] ^ members[None, :], distance)
        while True:
            low = np.where(near, label[None, :], n).min(axis=1)
            if (low == label).all():
                return label
            label = low
    # the open bytes side by side: every fingerprint has its own value there
    shifts = [8 * i for i in range(8) if free >> i & 1]
    value = sum(((members >> np.uint64(s)) & np.uint64(0xFF)) << np.uint64(8 * i) for i, s in enumerate(shifts)).astype(np.int64)
    bits = 8 * len(shifts)
    place = np.full(1 << bits, -1, np.int64)
    place[value] = label
    masks = [sum(1 << b for b in some) for d in range(1, distance + 1) for some in combinations(range(bits), d)]
    while True:
        low = label.copy()
        for mask in masks:
            other = place[value ^ mask]
            np.minimum(low, np.where(other >= 0, label[other], n), out=low)
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _links(distance: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of the postings (free, shared, print), which come sorted; the last posting of a batch is held for the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in _and_end(batches):
            now = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)] if batch is not None else held
            free, shared, prints = now
            if not len(free):
                continue
            edge = np.flatnonzero((free[1:] != free[:-1]) | (shared[1:] != shared[:-1])) + 1
            start, end = np.concatenate([[0], edge]), np.append(edge, len(free))
            held = [x[start[-1] :] for x in now]
            if batch is not None:
                start, end = start[:-1], end[:-1]
            pair = np.flatnonzero(end - start == 2)
            a, b = prints[start[pair]].view(np.uint64), prints[start[pair] + 1].view(np.uint64)
            ok = _near(a ^ b, distance)
            src, dst = [prints[start[pair] + 1][ok]], [prints[start[pair]][ok]]
            for i in np.flatnonzero(end - start > 2):
                own = prints[start[i] : end[i]]
                label = _forest(own.view(np.uint64), int(free[start[i]]), distance)
                linked = label != np.arange(len(own))
                src.append(own[linked])
                dst.append(own[label[linked]])
            yield pa.RecordBatch.from_pydict({"src": np.concatenate(src), "dst": np.concatenate(dst)})

    return run


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def link_fingerprints(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(src, dst) links that connect whatever distinct ``prints`` (column fingerprint) are chained by differences of at most ``distance`` bits."""
    choices = [sum(1 << i for i in some) for some in combinations(range(8), distance)]
    masks = [sum(0xFF << (8 * i) for i in range(8) if not free >> i & 1) for free in choices]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    posting = F.explode(F.array(*(F.struct(F.lit(f).cast("long").alias("free"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("shared")) for f, m in zip(choices, signed, strict=True)))).alias("p")
    postings = prints.select("fingerprint", posting).select("p.free", "p.shared", "fingerprint")
    return postings.repartition("free", "shared").sortWithinPartitions("free", "shared", "fingerprint").mapInArrow(_links(distance), "src long, dst long")


def near_duplicates(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns with fingerprint (16 lower-case hex digits) and component_id, the smallest ``key`` reachable by links.

    One row for each row of ``docs``, repeated ones included. Texts without words link like any other, at fingerprint
    zero. Rows without a key get their component's smallest key, null if none has one. An empty table gives no rows;
    other columns don't matter. ``key`` must be one of ``keep``.
    """
    found = table(fingerprints(docs, keep, text), "fingerprints")
    distinct = found.groupBy("fingerprint").agg(F.min(key).alias("_low"), F.count("*").alias("_n"))
    members = connected_components(link_fingerprints(distinct.select("fingerprint"), distance)).withColumnRenamed("node", "fingerprint")
    chained = distinct.join(members, "fingerprint")
    lowest = chained.groupBy("component").agg(F.min("_low").alias("_least"))
    by_print = distinct.join(chained.join(lowest, "component").select("fingerprint", "_least"), "fingerprint", "left").select("fingerprint", "_n", F.coalesce("_least", "_low").alias("component_id"))
    by_print = table(by_print, "components")
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return looked_up(found, by_print, "fingerprint").select(*keep, hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest key (nulls last).

    Rows are told apart by their place in the input, so that repeated rows count as copies too. Places are stored with
    the rows, once: numbering anew could give other rows the same places if the input is split in another way.
    """
    placed = table(docs.withColumn("_place", F.monotonically_increasing_id()), "placed")
    order = placed.select("_place", F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), "_place").alias("_order"), F.col(text).alias("_text"))
    groups = near_duplicates(order, ("_place", "_order"), distance, "_order", "_text")
    first = groups.where(F.col("_order") == F.col("component_id")).select("_place")
    return placed.join(first, "_place", "left_semi").drop("_place")
