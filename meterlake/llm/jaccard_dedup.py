"""One text of each group of near-duplicates: close SimHash fingerprints, and sets of shingles of a given similarity.

A SimHash puts texts of similarity 0.8 some seven bits of 64 apart, and a wider one more than a bit a byte, so that no
number of shared bytes is guaranteed there: the byte-position index links fingerprints up to ``DISTANCE`` bits, and the
rest is found by MinHash bands and decided by the shingle sets themselves. A signature has BANDS * ROWS minima of the
shingles' hashes under as many seeds. Texts that agree on all rows of a band meet in that band's bucket: a pair of
similarity s meets with probability 1 - (1 - s ** ROWS) ** BANDS, which is 0.99995 at 0.8 and grows with s.

Copies are merged first. Then buckets of the first bands are compared in blocks of bounded size, which joins most of what
belongs together. What is left are buckets, of all bands, that still hold several groups: each pair of different groups
there is compared, in pairs of blocks, so that no task sees a whole bucket and no link is lost to the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.components import connected_components
from meterlake.llm.heavy import looked_up
from meterlake.llm.scratch import table
from meterlake.llm.shingles import digests_of, fingerprint_of, joined_words, shingle_set
from meterlake.llm.simhash_dedup import DISTANCE, link_fingerprints
from meterlake.llm.word_tokens import text_slices

SHINGLE_WORDS = 5
#: Shared shingles among all of two texts, from which they are copies.
LEAST_SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: Bands of the first comparison.
FIRST_BANDS = 5
#: Texts, and shingles, in a block, about; a longer text has more.
BLOCK_ROWS, BLOCK_SHINGLES = 64, 1 << 20
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
#: Sides of a pair of blocks; within BOTH all texts are compared, else those of different sides.
_LEFT, _RIGHT, _BOTH = 0, 1, 2


def bands(shingles: np.ndarray) -> np.ndarray:
    """One hash for each band; none for no shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    mixed, (factor, offset) = shingles ^ (shingles >> np.uint64(29)), _SEEDS[:, :, None]
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for i in range(0, len(mixed), 2048):
        np.minimum(low, (mixed[i : i + 2048] * factor + offset).min(axis=1), out=low)
    low = low.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (order, text): order, content, fingerprint, size and bands."""
    for batch in batches:
        for row, texts in text_slices(batch.column(1)):
            content, prints, sizes, lists = [], [], [], []
            for t in texts:
                joined = joined_words(t.encode())
                digests = digests_of(joined, SHINGLE_WORDS)
                own = np.unique(np.array(digests, np.uint64))
                content.append(xxhash.xxh128_digest(joined))
                prints.append(fingerprint_of(digests))
                sizes.append(len(own))
                lists.append(bands(own))
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            signs = [pa.array(content, pa.binary()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), *signs], ["order", "content", "fingerprint", "size", "bands"])


class _Block:
    """Texts of a block or a pair of blocks, whose groups join as they come."""

    def __init__(self) -> None:
        self.members: list[tuple[int, int, int, np.ndarray]] = []
        self.up: dict[int, int] = {}

    def _root(self, group: int) -> int:
        up = self.up
        while up[group] != group:
            up[group] = group = up[up[group]]
        return group

    def add(self, place: int, group: int, side: int, own: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links to every other group that has a copy of the new text. Texts that matched before are tried first."""
        self.up.setdefault(group, group)
        n, hits = len(own), []
        for j, (other_place, other_group, other_side, other) in enumerate(self.members):
            m = len(other)
            if (side == other_side != _BOTH) or min(n, m) < LEAST_SIMILARITY * max(n, m) or self._root(other_group) == self._root(group):
                continue
            both = len(np.intersect1d(own, other, assume_unique=True))
            if both >= LEAST_SIMILARITY * (n + m - both):
                self.up[self._root(group)] = self._root(other_group)
                hits.append(j)
                yield place, other_place
        for j in hits:
            self.members.insert(0, self.members.pop(j))
        self.members.append((place, group, side, own))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the blocks (bucket, a, b, place, group, side, text), which come sorted."""
    block, now = _Block(), None
    for batch in batches:
        *columns, side = (batch.column(i).to_pylist() for i in range(6))
        links = []
        for row, texts in text_slices(batch.column(6)):
            for i, text in enumerate(texts, row):
                bucket, a, b, place, group = (c[i] for c in columns)
                if (bucket, a, b) != now:
                    block, now = _Block(), (bucket, a, b)
                links.extend(block.add(place, group, side[i], shingle_set(text, SHINGLE_WORDS)))
        yield pa.RecordBatch.from_pydict({"src": pa.array([x for x, _ in links], pa.int64()), "dst": pa.array([y for _, y in links], pa.int64())})


def _compared(units: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (src, dst) of ``units`` (bucket, a, b, place, group, side) over ``texts`` (place, text)."""
    units = table(units, "units")
    wanted = table(units.select("place").distinct(), "wanted")
    # small sets of places are broadcast, by the size of their files, and others shuffled
    rows = texts.join(wanted, "place", "left_semi").join(units, "place").select("bucket", "a", "b", "place", "group", "side", "text")
    return table(rows.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "place").mapInArrow(_verified, "src long, dst long"), "links")


def _n_blocks(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _first_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links within blocks of the first bands' buckets; of buckets with the same texts one is enough."""
    posts = nodes.select("place", "size", F.explode(F.slice("bands", 1, FIRST_BANDS)).alias("bucket"))
    met = posts.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.xxhash64("place").cast("decimal(38,0)")).alias("sum"), F.min("place").alias("least"), F.sum("size").alias("w")).where("n > 1")
    chosen = table(met.groupBy("n", "sum", "least").agg(F.min("bucket").alias("bucket"), F.max(_n_blocks(F.col("n"), F.col("w"))).alias("blocks")).select("bucket", "blocks"), "buckets")
    block = F.pmod(F.xxhash64("place", "bucket"), F.col("blocks")).cast("int")
    return _compared(posts.join(chosen, "bucket").select("bucket", block.alias("a"), F.lit(0).alias("b"), "place", F.col("place").alias("group"), F.lit(_BOTH).alias("side")), texts)


def _other_links(nodes: DataFrame, groups: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between different ``groups`` (node, component) that meet in a bucket of any band.

    A bucket's largest group and its other texts are cut into blocks; each block of others meets each block of both, never
    the largest group itself.
    """
    grouped = nodes.join(groups.withColumnRenamed("node", "place"), "place", "left").select("place", "size", F.coalesce("component", "place").alias("group"), "bands")
    posts = grouped.select("place", "size", "group", F.explode("bands").alias("bucket"))
    live = table(posts.groupBy("bucket").agg(F.min("group").alias("_a"), F.max("group").alias("_b")).where("_a < _b").select("bucket"), "live")
    members = table(posts.join(live, "bucket"), "members")
    sums = members.groupBy("bucket", "group").agg(F.count("*").alias("n"), F.sum("size").alias("w"))
    largest = F.max_by(F.struct("group", "n", "w"), F.struct("n", "group"))
    shape = sums.groupBy("bucket").agg(largest.alias("top"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    shape = table(shape.select("bucket", F.col("top.group").alias("top"), _n_blocks(F.col("top.n"), F.col("top.w")).alias("tops"), _n_blocks(F.col("n") - F.col("top.n"), F.col("w") - F.col("top.w")).alias("rests")), "shape")
    dealt = members.join(shape, "bucket").withColumn("is_top", F.col("group") == F.col("top"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("place", "bucket"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("rests"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    unit = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), side.alias("side"))
    own, right, left = F.col("own"), F.lit(_RIGHT), F.lit(_LEFT)
    # (block of others, block of the largest group), and (block of others, -1 - block of others behind it or itself)
    of_top = F.transform(upto(F.col("rests")), lambda r: unit(r, own, right))
    with_top = F.transform(upto(F.col("tops")), lambda j: unit(own, j, left))
    with_rest = F.transform(upto(F.col("rests")), lambda r: unit(F.least(own, r), -1 - F.greatest(own, r), F.when(r == own, _BOTH).when(r > own, _LEFT).otherwise(_RIGHT)))
    units = dealt.select("bucket", "place", "group", F.explode(F.when(F.col("is_top"), of_top).otherwise(F.concat(with_top, with_rest))).alias("u"))
    return _compared(units.select("bucket", "u.a", "u.b", "place", "group", "u.side"), texts)


def _print_links(nodes: DataFrame, distance: int) -> DataFrame:
    """Links (of places) between nodes whose fingerprints are close."""
    prints = table(nodes.groupBy("fingerprint").agg(F.min("place").alias("first"), F.count("*").alias("_n")), "prints")
    same = looked_up(nodes.select("place", "fingerprint"), prints, "fingerprint").where("place <> first").select(F.col("place").alias("src"), F.col("first").alias("dst"))
    close = link_fingerprints(prints.select("fingerprint"), distance)
    ends = [prints.select(F.col("fingerprint").alias(end), F.col("first").alias(f"{end}_place")) for end in ("src", "dst")]
    across = close.join(ends[0], "src").join(ends[1], "dst").select(F.col("src_place").alias("src"), F.col("dst_place").alias("dst"))
    return same.unionByName(across)


def one_of_each_alike(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest key (nulls last).

    Texts are near-duplicates if their words are the same but for the case of A-Z, if their fingerprints of five-word
    shingles differ in at most ``distance`` bits, or if their sets of five-word shingles have a similarity of at least
    ``LEAST_SIMILARITY``; groups are what such links connect. All texts without words, null ones included, are copies of
    each other. Repeated rows count as copies; an empty table gives none; other columns don't matter.
    """
    placed = table(docs.withColumn("_place", F.monotonically_increasing_id()), "placed")
    order = F.struct(F.col(key).isNull().alias("no_key"), F.col(key).alias("key"), F.col("_place").alias("place"))
    inner = placed.select(order.alias("order"), F.col(text).cast("string").alias("text"))
    signs = table(inner.mapInArrow(_signed, f"order {inner.schema[0].dataType.simpleString()}, content binary, fingerprint long, size long, bands array<long>"), "signs")
    first = signs.groupBy("content").agg(F.min("order").alias("order")).select("order.place")
    nodes = table(signs.withColumn("place", F.col("order.place")).drop("content").join(first, "place", "left_semi"), "nodes")
    texts = placed.select(F.col("_place").alias("place"), F.col(text).cast("string").alias("text"))
    groups = connected_components(_print_links(nodes, distance).unionByName(_first_links(nodes, texts)))
    more = _other_links(nodes, groups, texts)
    if not more.isEmpty():
        groups = connected_components(groups.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more))
    linked = nodes.select("place", "order").join(groups.withColumnRenamed("node", "place"), "place")
    least = linked.groupBy("component").agg(F.min("order").alias("order")).select("order.place")
    gone = signs.select("order.place").join(first, "place", "left_anti").unionByName(linked.select("place").join(least, "place", "left_anti"))
    gone = table(gone.select(F.col("place").alias("_place")), "gone")
    return placed.join(gone, "_place", "left_anti").drop("_place")
