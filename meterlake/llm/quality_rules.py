"""Quality rules: counted facts of each text, and a calibrated logistic regression over hashed words and characters.

Texts are read as byte buffers in Arrow batches; each hashed word and each hashed run of four bytes adds its weight, so
that a text is scored by two lookups a byte and never becomes a vector of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.labelled import labelled_sample
from meterlake.llm.textbuf import Texts, kept_with_text, mix, range_codes, slices

#: Hash cells: half for words, half for runs of four bytes.
CELLS = 1 << 14
#: Labelled documents that the fit takes of each class: a bound on what the driver holds.
FIT_DOCS = 1500
#: Documents are kept from this probability of label 1 up.
KEEP_FROM = 0.5
#: Base rules
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Rows of the sample that the fit sums over at a time.
FIT_BLOCK = 128
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SCALE = 30.0


def _dup_lines(t: Texts) -> np.ndarray:
    edge = np.unique(np.concatenate([t.off[:-1], np.flatnonzero(t.buf == 10) + 1, [len(t.buf)]]))
    start, end = edge[:-1], edge[1:].copy()
    if not len(start):
        return np.zeros(t.n, np.int64)
    end -= t.buf[end - 1] == 10
    has = np.searchsorted(t.starts, end) > np.searchsorted(t.starts, start)
    start, end = start[has], end[has]
    doc = np.searchsorted(t.off, start, "right") - 1
    same = doc * len(start) + range_codes(t.buf, start, end)
    first = np.unique(same, return_index=True)[1]
    return np.bincount(doc, minlength=t.n) - np.bincount(doc[first], minlength=t.n)


def _repeat_words(t: Texts) -> np.ndarray:
    """Words in windows that their text holds twice or more. Hashes find the windows to compare, the words decide."""
    words = t.word_codes().astype(np.int64)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(t.n, np.int64)
    h, codes = np.zeros(n, np.uint64), mix(words.astype(np.uint64) + np.uint64(1))
    for j in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
    inside = np.flatnonzero(t.doc[:n] == t.doc[WINDOW - 1 :])
    key = mix(h[inside] ^ mix(t.doc[inside].astype(np.uint64) + np.uint64(1)))
    at = inside[_often(key)]
    # exact groups among those: one number for text and words so far, word by word
    group, size = t.doc[at], len(words) + 1
    for j in range(WINDOW):
        group = np.unique(group * size + words[at + j], return_inverse=True)[1]
    at = at[_often(group)]
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return t.per_word_text(np.cumsum(cover[:-1]) > 0)


def _often(key: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    return again


def text_facts(t: Texts) -> dict[str, np.ndarray]:
    """The counted facts of each text."""
    return {
        "n_words": t.n_words,
        "word_chars": t.per_text(t.word & ((t.buf & 0xC0) != 0x80)),
        "n_symbols": t.per_text(_SYMBOL[t.buf]),
        "n_dup_lines": _dup_lines(t),
        "n_repeat_words": _repeat_words(t),
    }


def _grams(t: Texts) -> np.ndarray:
    """Cell of the four bytes from each byte on, for all but the last three bytes."""
    b = t.buf.astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.int64)
    g = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    return (g * np.uint32(0x9E3779B1) >> np.uint32(33 - CELLS.bit_length() + 1)).astype(np.int64) + CELLS // 2


def _word_cells(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(CELLS // 2)).astype(np.int64)


def _gram_ranges(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """First gram of each text, and the end of its grams."""
    last = max(len(t.buf) - 3, 0)
    return np.minimum(t.off[:-1], last), np.minimum(np.maximum(t.off[1:] - 3, t.off[:-1]), last)


def linear_scores(t: Texts, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight of a text's words plus mean weight of its runs of four bytes."""
    total = np.concatenate([[0.0], np.cumsum(weights[_grams(t)], dtype=np.float64)])
    start, end = _gram_ranges(t)
    return _SCALE * (t.per_word_text(weights[_word_cells(words)].astype(np.float64)) / np.maximum(t.n_words, 1) + (total[end] - total[start]) / np.maximum(end - start, 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column("_label").to_numpy()
        for row, t in slices(batch.column("_text")):
            grams, words, (start, end) = _grams(t), _word_cells(t.word_hashes()), _gram_ranges(t)
            cells, values = [], []
            for i in range(t.n):
                w, g = words[t.first[i] : t.first[i + 1]], grams[start[i] : end[i]]
                count = np.bincount(w, minlength=CELLS) / max(len(w), 1) + np.bincount(g, minlength=CELLS) / max(len(g), 1)
                at = np.flatnonzero(count)
                cells.append(at.astype(np.int16).tobytes())
                values.append((_SCALE * count[at]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_pydict({"label": labels[row : row + t.n], "cells": cells, "values": values})


Blocks = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _blocks(cells: list[np.ndarray], values: list[np.ndarray], which: np.ndarray) -> Blocks:
    """(cells, values, number of cells of each row) of FIT_BLOCK rows at a time, so that sums over them need little memory."""
    out = []
    for i in range(0, len(which), FIT_BLOCK):
        some = which[i : i + FIT_BLOCK]
        out.append((np.concatenate([cells[j] for j in some]), np.concatenate([values[j] for j in some]), np.array([len(cells[j]) for j in some])))
    return out


def _row_sums(blocks: Blocks, of) -> np.ndarray:
    """Sum over each row of ``of(cells, values)``."""
    return np.concatenate([np.bincount(np.repeat(np.arange(len(size)), size), of(at, value), minlength=len(size)) for at, value, size in blocks])


def _cell_sums(blocks: Blocks, r: np.ndarray) -> np.ndarray:
    """Sum over each cell of its values times their rows' ``r``."""
    out, first = np.zeros(CELLS), 0
    for at, value, size in blocks:
        out += np.bincount(at, value * np.repeat(r[first : first + len(size)], size), minlength=CELLS)
        first += len(size)
    return out


def _fit_logistic(blocks: Blocks, y: np.ndarray, steps: int = 120, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient steps; classes weigh alike."""
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(CELLS), 0.0
    w0, b0 = w, b
    norm = _row_sums(blocks, lambda at, value: value.astype(float) ** 2).max(initial=1e-9) + 1
    for k in range(steps):
        ahead, ahead_b = w + k / (k + 3) * (w - w0), b + k / (k + 3) * (b - b0)
        z = _row_sums(blocks, lambda at, value, ahead=ahead: value * ahead[at]) + ahead_b
        r = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        w0, b0 = w, b
        w, b = ahead - 4 / norm * (_cell_sums(blocks, r) + ridge * ahead), ahead_b - 4 / norm * r.sum()
    return w, b


def _calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make sigmoid(slope * z + shift) a probability (Platt, with smoothed targets, by Newton steps)."""
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, theta = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        theta = theta - np.clip(np.linalg.solve(hess, x.T @ (weight * (p - t)) + 1e-3 * (theta - [1.0, 0.0])), -1, 1)
    return float(theta[0]), float(theta[1])


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = FIT_DOCS, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, float]:
    """(weights, shift): a text's probability of label 1 is sigmoid(linear_scores + shift).

    A quarter of the sample is left to the calibration, which weighs the classes as frequent as they are. Without rows
    of both classes there is nothing to learn: every text gets the probability of the one class, or 1/2.
    """
    sample, counts = labelled_sample(docs, labels, "quality", per_class, key, text)
    rows = sample.mapInArrow(_features, "label int, cells binary, values binary").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    if len(set(y.tolist())) < 2:
        return np.zeros(CELLS, np.float32), 30.0 * (2 * y.mean() - 1) if len(y) else 0.0
    cells, values = ([np.frombuffer(x, kind) for x in rows.column(name).to_pylist()] for name, kind in (("cells", np.int16), ("values", np.float32)))
    del rows
    order = np.argsort([zlib.crc32(c.astype(np.int32).tobytes()) for c in cells], kind="stable")  # as it comes, whatever order rows arrive in
    fit, rest = order[len(order) // 4 :], order[: len(order) // 4]
    if len(set(y[fit].tolist())) < 2 or len(set(y[rest].tolist())) < 2:
        fit = rest = order
    w, b = _fit_logistic(_blocks(cells, values, fit), y[fit])
    z = _row_sums(_blocks(cells, values, rest), lambda at, value: value * w[at]) + b
    prior = {c: counts[c] / sum(counts.values()) / max((y[rest] == c).mean(), 1e-9) for c in (0, 1)}
    slope, shift = _calibrate(z, y[rest], np.where(y[rest] == 1, prior[1], prior[0]))
    return (slope * w).astype(np.float32), slope * b + shift


def _scorer(weights: np.ndarray, shift: float, n: int, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in slices(batch.column(at)):
                words = t.word_hashes()
                facts = text_facts(t)
                z = linear_scores(t, words, weights) + shift
                kept = batch.slice(row, t.n).select(range(n))
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v.astype(np.int64)) for v in facts.values()), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*kept.schema.names, *facts, "_p"])

    return run


def judge_quality(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", keep_from: float = KEEP_FROM, model: tuple[np.ndarray, float] | None = None, key: str = "doc_id") -> DataFrame:
    """``keep`` columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, probability, kept.

    A text is kept if the base rules pass it and its probability of label 1 reaches ``keep_from``. Null and empty
    texts have no words and fail. Repeated rows are judged alike; an empty table gives none; other columns don't matter.
    """
    weights, shift = model or fit_quality(docs, labels, key=key, text=text)
    inner, at = kept_with_text(docs, keep, text)
    facts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = ", ".join([*(f"_k{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep))), *(f"{f} long" for f in facts), "_p double"])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = inner.mapInArrow(_scorer(weights, shift, len(keep), at), schema)
    return judged.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *facts, failed.alias("base_failed"), F.col("_p").alias("probability"), (~failed & (F.col("_p") >= keep_from)).alias("kept"))
