"""Exact top-k search by integer inner product, by distributed histogram selection.

Vectors are packed in blocks. Every query block meets every candidate block in some task, which scores the pair as one
matrix product. A first pass counts scores in coarse bins for each query; the bin that holds the k-th value is split
again until bins are one wide, so that the k-th value is exact. A last pass keeps what lies above it and, of the ties,
the smallest ids. A block counts only the bins from its own k-th best score up: nothing below that can be among the best
k of all, so that what is shuffled is about k bins for each query and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.scratch import table

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
BINS = 4096
#: Bits of the parts that components are cut into where 64 bits don't hold a product, and how many sums of theirs a float holds.
LIMB, LIMB_DIMS = 22, 256
_PACKED = "part long, dim long, ids binary, lows binary, cells binary"


def quantised(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cells): floor(scale * x) of every component, at most the greatest or least 64-bit integer.

    Vectors that are null or hold null or non-finite components, and rows without a key, are left out.
    """
    sound = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("cells"))


def _pack(rows: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        part = 0

        def out(dim: int) -> pa.RecordBatch:
            nonlocal part
            ids, lows, cells = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            part += 1
            least, most = int(cells.min(initial=0)), int(cells.max(initial=0))
            kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "dim": pa.array([dim], pa.int64()), "ids": [ids.tobytes()], "lows": [lows.tobytes()], "cells": [cells.astype(kind).tobytes()]})

        for batch in batches:
            cells = batch.column("cells")
            sizes = np.diff(cells.offsets.to_numpy())
            flat, ids, lows = cells.flatten().to_numpy(zero_copy_only=False), batch.column("vec_id").to_numpy(), batch.column("low").to_numpy()
            at = np.concatenate([[0], np.cumsum(sizes)])
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                for i in range(0, len(mine), rows):
                    these = mine[i : i + rows]
                    matrix = flat[(at[these][:, None] + np.arange(dim)).ravel()]
                    held.setdefault(int(dim), []).append((ids[these], lows[these], matrix))
                    if sum(len(x[0]) for x in held[int(dim)]) >= rows:
                        yield out(int(dim))
        for dim in list(held):
            yield out(dim)

    return packed


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products, at most the greatest or least 64-bit integer: in floats where they hold every sum, else in 64 bits, else in limbs."""
    most = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        kind = np.float32 if most < 2**24 else np.float64
        return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    return q.astype(np.int64) @ c.astype(np.int64).T if most < 2**62 else _wide_scores(q.astype(np.int64), c.astype(np.int64))


def _wide_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products whose sums may leave 64 bits: sums of products of limbs are exact in floats, and carries join them."""
    low = np.int64((1 << LIMB) - 1)
    limbs = [[x & low, x >> LIMB & low, x >> 2 * LIMB] for x in (q, c)]
    sums = [np.zeros((len(q), len(c)), np.int64) for _ in range(5)]
    for i, a in enumerate(limbs[0]):
        for j, b in enumerate(limbs[1]):
            for d in range(0, q.shape[1], LIMB_DIMS):
                sums[i + j] += (a[:, d : d + LIMB_DIMS].astype(float) @ b[:, d : d + LIMB_DIMS].T.astype(float)).astype(np.int64)
    for i in range(4):
        sums[i + 1] += sums[i] >> LIMB
        sums[i] &= low
    # the sum over 2 ** 44, cut off where it is far out of range; the two lowest limbs only add to it
    high = (np.clip(sums[4], -2, 1) << 2 * LIMB) + (sums[3] << LIMB) + sums[2]
    most = np.int64(1 << 63 - 2 * LIMB)
    inside = (np.clip(high, -most, most - 1) << 2 * LIMB) + (sums[1] << LIMB) + sums[0]
    return np.where(high >= most, np.iinfo(np.int64).max, np.where(high < -most, np.iinfo(np.int64).min, inside))


def _matrix(cells: bytes, rows: int, dim: int) -> np.ndarray:
    kind = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[len(cells) // (rows * dim)] if dim else np.int8
    return np.frombuffer(cells, kind).reshape(rows, dim)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(query ids, lows, candidate ids, scores, which pairs count) of each pair of blocks."""
    for batch in batches:
        for q_ids, q_lows, q_cells, c_ids, c_cells, dim in zip(*(batch.column(n).to_pylist() for n in ("q_ids", "q_lows", "q_cells", "ids", "cells", "dim")), strict=True):
            qi, ci, lows = np.frombuffer(q_ids, np.int64), np.frombuffer(c_ids, np.int64), np.frombuffer(q_lows, np.int64)
            yield qi, lows, ci, _scores(_matrix(q_cells, len(qi), dim), _matrix(c_cells, len(ci), dim)), qi[:, None] != ci[None, :]


def _counted(k: int, width: int, span: int):
    """Histogram pass: of scores in [low, low + span), counts by bin of ``width``, from each block's own k-th best up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = span // width + 2
        for qi, lows, _, s, use in _pairs(batches):
            # unsigned, as a difference may take all of 64 bits; scores below wrap to differences beyond the span
            over = s.view(np.uint64) - lows.view(np.uint64)[:, None]
            bins = (over // np.uint64(width)).astype(np.int64)
            use = use & (over <= np.uint64(span - 1))
            ranked = np.where(use, bins, -1)
            kth = np.partition(ranked, ranked.shape[1] - k, axis=1)[:, ranked.shape[1] - k] if ranked.shape[1] > k else np.zeros(len(qi), np.int64)
            row, col = np.nonzero(use & (bins >= kth[:, None]))
            cell, count = np.unique(row * places + bins[row, col], return_counts=True)
            yield pa.RecordBatch.from_pydict({"query_id": qi[cell // places], "bin": cell % places, "n": count.astype(np.int64)})

    return run


def _chosen(k: int):
    """Last pass: everything over the k-th value ``low``, and the k smallest ids of those that tie with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qi, lows, ci, s, use in _pairs(batches):
            order = np.argsort(ci, kind="stable")
            s, use, ci = s[:, order], use[:, order], ci[order]
            tie = use & (s == lows[:, None])
            row, col = np.nonzero((use & (s > lows[:, None])) | (tie & (np.cumsum(tie, axis=1) <= k)))
            yield pa.RecordBatch.from_pydict({"query_id": qi[row], "vec_id": ci[col], "score": s[row, col]})

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", vector: str = "embedding", slots: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of every row whose key is divisible by ``every``.

    Score: inner product of floor(scale * x) as integers; ties go to the smaller key; fewer rows than ``k`` are all
    returned. Vectors are compared with those of their own length. Rows of one key never find each other; as queries,
    repeated rows of one key count once (the least vector). Scores are exact; those that 64 bits don't hold are the
    greatest or least 64-bit integer, and tie as such. Unsound vectors (see ``quantised``) take no part; empty tables give no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    cells = quantised(vectors, scale, key, vector).withColumn("low", F.lit(0).cast("long"))
    blocks = table(cells.mapInArrow(_pack(BLOCK_ROWS), _PACKED), "vectors")
    queries = cells.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("cells").alias("cells"))
    queries = table(queries, "queries")
    bound, n, n_queries = cells.agg(F.max(F.aggregate("cells", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    if slots is None:
        slots = max(1, min(-(-n // BLOCK_ROWS), max(spark.sparkContext.defaultParallelism, -(-n // (64 * BLOCK_ROWS)))))
    # no product exceeds the largest squared length
    low = -int(min((bound or 0.0) * (1 + 1e-9) + 1, 2.0**63))
    span = min(-2 * low + 1, 1 << 64)

    def meet(state: DataFrame, run, schema: str) -> DataFrame:
        """Every block of queries with its state against every block of candidates, slot by slot."""
        packed = state.repartition(max(1, -(-n_queries // QUERY_ROWS))).mapInArrow(_pack(QUERY_ROWS), _PACKED)
        sent = packed.select("dim", F.col("ids").alias("q_ids"), F.col("lows").alias("q_lows"), F.col("cells").alias("q_cells"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
        dealt = blocks.withColumn("slot", F.pmod(F.xxhash64("ids"), F.lit(slots)).cast("int"))
        return dealt.join(sent, ["slot", "dim"]).select("q_ids", "q_lows", "q_cells", "ids", "cells", "dim").mapInArrow(run, schema)

    state = queries.withColumn("low", F.lit(low).cast("long"))
    need = queries.select(F.col("vec_id").alias("query_id"), F.lit(low).cast("long").alias("low"), F.lit(k).cast("long").alias("need"))
    while span > 1:
        width = -(-span // BINS)
        bins = meet(state, _counted(k, width, span), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
        reached = bins.join(need, "query_id").withColumn("seen", F.sum("n").over(down)).withColumn("last", F.min("bin").over(Window.partitionBy("query_id")))
        # the highest bin by which enough are seen; with too few rows in all, the lowest bin
        reached = reached.where((F.col("seen") >= F.col("need")) | (F.col("bin") == F.col("last"))).groupBy("query_id").agg(F.max_by(F.struct("bin", "seen", "n", "low", "need"), "bin").alias("x"))
        half = width // 2  # in two steps, neither of which leaves 64 bits
        need = table(reached.select("query_id", (F.col("x.low") + F.col("x.bin") * half + F.col("x.bin") * (width - half)).alias("low"), (F.col("x.need") - (F.col("x.seen") - F.col("x.n"))).alias("need")), "bounds")
        state = queries.join(need.select(F.col("query_id").alias("vec_id"), "low"), "vec_id")
        span = width
    found = meet(state, _chosen(k), "query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
