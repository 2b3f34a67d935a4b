"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become weighted counts of hashed words, word shapes and runs of character classes; a truncated singular value
decomposition of a bounded labelled sample gives the latent space. The sample's vectors go to every task, which
computes their cosines with its documents block by block; the nearest labels vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.labelled import held_out, labelled_sample
from meterlake.llm.textbuf import Texts, mix, range_hashes, slices

#: Hash cells of words, of word shapes and of runs of four character classes.
WORDS, SHAPES, RUNS = 2048, 1024, 1024
CELLS = WORDS + SHAPES + RUNS
#: Labelled documents of each class in the sample: with LATENT, the bound on what is broadcast.
FIT_DOCS = 1500
LATENT = 64
NEIGHBOURS = 15
#: Votes weigh as this power of the cosine.
SHARPNESS = 8
#: Documents in a block of cosine products.
BLOCK = 512

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 11, 12, 13]] = 0x20


@dataclass
class NeighbourModel:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    #: 1 or 0 for each vector, and how much its vote weighs for the class to count as often as it occurs
    labels: np.ndarray
    weights: np.ndarray


def _term_cells(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell) of every term."""
    words = t.word_hashes()
    again = np.zeros(len(words), bool)
    for back in (1, 2, 3):
        again[back:] |= (words[back:] == words[:-back]) & (t.doc[back:] == t.doc[:-back])
    kind = _CLASS[t.buf]
    change = np.ones(len(kind), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[t.starts] = True
    squeezed, before = kind[change], np.concatenate([[0], np.cumsum(change)])
    shape = range_hashes(squeezed, before[t.starts], before[t.ends]) + again.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)
    doc_of = (np.searchsorted(t.off, np.flatnonzero(change), "right") - 1).astype(np.int64)
    b = squeezed.astype(np.uint32)
    run = (b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)) if len(b) > 3 else np.zeros(0, np.uint32)
    own = doc_of[: len(run)] == doc_of[3:] if len(run) else np.zeros(0, bool)
    cell = np.concatenate([(words % np.uint64(WORDS)).astype(np.int64), WORDS + (mix(shape) % np.uint64(SHAPES)).astype(np.int64), WORDS + SHAPES + (run[own] * np.uint32(0x9E3779B1) >> np.uint32(22)).astype(np.int64)])
    return np.concatenate([t.doc, t.doc, doc_of[: len(run)][own]]), cell


def _blocks(t: Texts) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, log counts) of at most BLOCK texts at a time."""
    doc, cell = _term_cells(t)
    order = np.argsort(doc, kind="stable")
    doc, cell = doc[order], cell[order]
    for i in range(0, t.n, BLOCK):
        j = min(i + BLOCK, t.n)
        a, b = np.searchsorted(doc, [i, j])
        yield i, j, np.log1p(np.bincount((doc[a:b] - i) * CELLS + cell[a:b], minlength=(j - i) * CELLS).reshape(j - i, CELLS)).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("_label").to_numpy()
        for row, t in slices(batch.column("_text")):
            for i, j, x in _blocks(t):
                at = [np.flatnonzero(r) for r in x]
                yield pa.RecordBatch.from_pydict({"label": labels[row + i : row + j], "cells": [a.astype(np.int16).tobytes() for a in at], "counts": [r[a].tobytes() for r, a in zip(x, at, strict=True)]})


def fit_neighbours(docs: DataFrame, labels: DataFrame, per_class: int = FIT_DOCS, key: str = "doc_id", text: str = "text", label: str = "quality") -> NeighbourModel:
    """Latent vectors of about ``per_class`` labelled documents of each class, none of them held out; the order in which they arrive doesn't matter."""
    sample, counts = labelled_sample(docs, labels, label, per_class, key, text)
    rows = sample.mapInArrow(_sampled, "label int, cells binary, counts binary").toArrow().sort_by([("cells", "ascending"), ("counts", "ascending"), ("label", "ascending")])
    y = rows.column("label").to_numpy().astype(np.float32)
    x = np.zeros((len(y), CELLS), np.float32)
    for i, (a, c) in enumerate(zip(rows.column("cells").to_pylist(), rows.column("counts").to_pylist(), strict=True)):
        x[i, np.frombuffer(a, np.int16)] = np.frombuffer(c, np.float32)
    idf = np.log((1 + len(y)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = _unit(x * idf)
    rank = min(LATENT, len(y)) if len(y) else 0
    if rank:
        q = np.random.default_rng(3).standard_normal((CELLS, rank + 16), dtype=np.float32)
        for _ in range(4):
            q = np.linalg.qr(x.T @ (x @ q))[0]
        axes = q @ np.linalg.svd(x @ q, full_matrices=False)[2].T[:, :rank]
    else:
        axes = np.zeros((CELLS, 0), np.float32)
    share = {c: counts.get(c, 0) / max(float((y == c).sum()), 1.0) for c in (0, 1)}
    return NeighbourModel(idf, axes.astype(np.float32), _unit(x @ axes).astype(np.float32), y, np.where(y == 1, share[1], share[0]).astype(np.float32))


def _votes(x: np.ndarray, model: NeighbourModel) -> np.ndarray:
    latent = _unit(x * model.idf @ model.axes)
    if not len(model.labels):
        return np.full(len(x), 0.5)
    cosine = latent @ model.vectors.T
    k = min(NEIGHBOURS, len(model.labels))
    near = np.argpartition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k :]
    found = np.take_along_axis(cosine, near, axis=1)
    vote = _strength(found) * model.weights[near]
    score = (vote * model.labels[near]).sum(axis=1) / vote.sum(axis=1)
    least = found.min(axis=1)
    for i in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):
        # those as near as the last share the places that are left, so that no order of the sample matters
        tied, nearer = cosine[i] == least[i], cosine[i] > least[i]
        vote = _strength(cosine[i]) * model.weights * (nearer + tied * ((k - nearer.sum()) / tied.sum()))
        score[i] = (vote * model.labels).sum() / vote.sum()
    return np.clip(score, 0.0, 1.0)


def _strength(cosine: np.ndarray) -> np.ndarray:
    return np.maximum(cosine, 1e-3).astype(float) ** SHARPNESS


def _scorer(model: NeighbourModel, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in slices(batch.column(n)):
                score = np.concatenate([_votes(x, model) for _, _, x in _blocks(t)])
                score[t.n_words == 0] = 0.0
                kept = batch.slice(row, t.n).select(range(n))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(score)], [*kept.schema.names, "_score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: NeighbourModel | None = None, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns with held_out, score (0 to 1, the neighbours' share of label 1) and predicted (score >= threshold).

    Texts without a word, null ones included, score 0; without labelled rows every other text scores 1/2. Repeated rows
    score alike; an empty table gives none; other columns don't matter.
    """
    model = model or fit_neighbours(docs, labels, key=key, text=text)
    inner = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), held_out(F.col(key)).alias("_held"), F.col(text).cast("string").cast("binary").alias("_text"))
    n = len(keep) + 1
    schema = ", ".join([*(f"_k{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep))), "_held boolean", "_score double"])
    scored = inner.mapInArrow(_scorer(model, n), schema)
    return scored.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_held").alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
