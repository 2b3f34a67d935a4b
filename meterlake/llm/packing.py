"""Packing of tokenized documents into training windows by non-negative least squares over a length histogram.

Documents are cut into full windows; what remains of each has a length below the window. Shallow combinations of length
classes that fill a window are enumerated, and non-negative least squares finds how often to repeat each so that the
histogram of lengths is met; the counts are rounded down and more windows are taken greedily while documents last.
As lengths are counted in classes, a window of classes leaves a small gap. The documents that no combination took, and
a share held back for it, are laid end to end and cut to fill the gaps exactly; what is left over is cut into
full windows, and the very end into windows whose lengths are powers of two, which need no padding.

Only the histogram reaches the driver. Who goes where follows from running numbers, which are counted in slots whose size
and number grow with the square root of the rows, so that no task sees a whole length class.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.scratch import table
from meterlake.llm.word_tokens import break_slices, library_words

WINDOW = 4096
END_ID = 2
#: Length classes to a window.
CLASSES = 64
#: Most lengths in an enumerated combination; windows of one repeated class may have more.
DEPTH = 3
#: Tokens of the line of gaps whose cuts are found together.
LINE_BLOCK = 65_536


def _tokenizer(path: str, n: int, end_id: int, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_words(path)
        for batch in batches:
            for row, texts in break_slices(batch.column(n)):
                ids, off = words.encode(texts)
                sizes, full, rest, crc = [], [], [], []
                for i in range(texts.n):
                    own = np.append(ids[off[i] : off[i + 1]], end_id).astype("<u4")
                    cut = len(own) // window * window
                    sizes.append(len(own))
                    full.append([zlib.crc32(own[j : j + window].tobytes()) for j in range(0, cut, window)])
                    rest.append(own[cut:].astype("<u2" if own.max() < 1 << 16 else "<u4").tobytes())
                    crc.append(zlib.crc32(own[cut:].tobytes()))
                kept = batch.slice(row, texts.n).select(range(n))
                new = {"doc_tokens": pa.array(sizes, pa.int64()), "full": pa.array(full, pa.list_(pa.int64())), "rest": pa.array(rest, pa.binary()), "rest_crc": pa.array(crc, pa.int64())}
                yield pa.RecordBatch.from_arrays([*kept.columns, *new.values()], [*kept.schema.names, *new])

    return run


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by an active set."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    slope = a.T @ b
    while rounds and (~free).any() and slope[~free].max() > 1e-9 * max(1.0, np.abs(b).max()):
        free[np.where(free, -np.inf, slope).argmax()] = True
        while rounds:
            rounds -= 1
            s = np.zeros_like(x)
            s[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            if s[free].min(initial=0) >= 0:
                break
            down = free & (s < 0)
            x += np.min(x[down] / (x[down] - s[down])) * (s - x)
            free &= x > 1e-12
            x[~free] = 0
        x = np.maximum(s, 0)
        slope = a.T @ (b - a @ x)
    return x


def combinations_filling(classes: int = CLASSES, depth: int = DEPTH) -> np.ndarray:
    """Columns: how many of each class 1..classes; every column's classes sum to ``classes``."""
    found = {tuple(sorted((*some, classes - sum(some)))) for d in range(depth) for some in itertools.combinations_with_replacement(range(1, classes), d) if sum(some) < classes}
    found |= {tuple(sorted([c] * (classes // c) + [classes % c] * (classes % c > 0))) for c in range(1, classes + 1)}
    return np.stack([np.bincount(c, minlength=classes + 1)[1:] for c in sorted(found)], 1)


def solve_counts(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Whole repeat counts of each combination that the histogram can serve: least squares, rounded down, then greedily more."""
    wanted = nonnegative_least_squares(combos.astype(float), histogram.astype(float))
    counts, left = np.zeros(combos.shape[1], np.int64), histogram.astype(np.int64).copy()
    order = np.argsort(-wanted, kind="stable")
    for limit in (np.floor(wanted + 1e-6), np.full(len(wanted), np.inf)):
        for c in order:
            used = combos[:, c] > 0
            more = int(min(limit[c], (left[used] // combos[used, c]).min()))
            counts[c] += more
            left -= more * combos[:, c]
    return counts


def _numbered(rows: DataFrame, row: str, by: str | None, **values: Column) -> DataFrame:
    """``rows`` with the running sums of ``values`` before each row (within each value of ``by``, if given), in an order that depends on the data alone."""
    # as many slots as rows in each, about: neither those in a slot nor the slots' totals are many
    slots = max(1, math.isqrt(rows.count()))
    groups = [by] if by else []
    dealt = rows.withColumns({"_slot": F.pmod(F.xxhash64(row), F.lit(slots)).cast("int")} | {f"_v_{k}": v for k, v in values.items()})
    ahead = Window.partitionBy("_slot", *groups).orderBy(row).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_v_{k}").over(ahead), F.lit(0)) for k in values})
    totals = dealt.groupBy("_slot", *groups).agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values))
    before = Window.partitionBy(*groups).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_slot", *groups, *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_at_{k}") for k in values))
    out = own.join(starts, ["_slot", *groups])
    return out.select(*rows.columns, *((F.col(f"_in_{k}") + F.col(f"_at_{k}")).alias(k) for k in values))


def _placer(combos: np.ndarray, counts: np.ndarray, first_sequence: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From the class and the number of a rest within it: its sequence and its place there; null for those left over."""
    base = first_sequence + np.cumsum(counts) - counts
    places = np.cumsum(combos[::-1], axis=0)[::-1] - combos  # longer ones come first
    plan = []
    for c in range(len(combos)):
        used = np.flatnonzero((combos[c] > 0) & (counts > 0))
        plan.append((np.cumsum(combos[c, used] * counts[used]), combos[c, used], base[used], places[c, used]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, number = batch.column("class").to_numpy(), batch.column("number").to_numpy()
            sequence, place = np.full(len(number), -1, np.int64), np.zeros(len(number), np.int64)
            for c in np.unique(classes):
                ends, each, start, at = plan[c - 1]
                mine = np.flatnonzero(classes == c)
                k = np.searchsorted(ends, number[mine], "right")
                mine, k = mine[k < len(ends)], k[k < len(ends)]
                inside = number[mine] - (ends[k] - each[k] * ((ends[k] - np.concatenate([[0], ends])[k]) // each[k]))
                sequence[mine], place[mine] = start[k] + inside // each[k], at[k] + inside % each[k]
            names = [n for n in batch.schema.names if n not in ("class", "number")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(sequence, mask=sequence < 0), pa.array(place)], [*names, "sequence_id", "place"])

    return run


def _cutter(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Checksums of the pieces of rests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rests, tokens, cuts = (batch.column(n).to_pylist() for n in ("rest", "_rest_tokens", "cuts"))
            row, out = [], {"start": [], "length": [], "ids_crc32": [], "sequence_id": [], "offset": []}
            for i, (rest, n, pieces) in enumerate(zip(rests, tokens, cuts, strict=True)):
                ids = np.frombuffer(rest, "<u2" if len(rest) == 2 * n else "<u4").astype("<u4")
                for piece in pieces:
                    row.append(i)
                    at = piece["at"]
                    out["start"].append(piece["start"])
                    out["length"].append(piece["length"])
                    out["ids_crc32"].append(zlib.crc32(ids[at : at + piece["length"]].tobytes()))
                    out["sequence_id"].append(piece["sequence_id"])
                    out["offset"].append(piece["offset"])
            kept = batch.select(keys).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(v, pa.int64()) for v in out.values())], [*keys, *out])

    return run


def _overlaid(fillers: DataFrame, gaps: DataFrame) -> DataFrame:
    """(_row, at, length, sequence_id, offset): both sides tile one line from 0; a piece is where a filler and a gap overlap.

    ``fillers``: _row, line, size; ``gaps``: sequence_id, offset, line, size. Both are dealt by blocks of the line; within
    a block the starts of both, in order, are the cuts.
    """

    def events(side: DataFrame, name: str, what: Column) -> DataFrame:
        blocks = F.sequence(F.expr(f"line div {LINE_BLOCK}"), F.expr(f"(line + size - 1) div {LINE_BLOCK}"))
        nothing = F.lit(None)
        cut = side.where("size > 0").select(F.explode(blocks).alias("block"), "line", (F.col("line") + F.col("size")).alias("to"), what.alias("what"))
        own = F.struct("what", "line", "to")
        return cut.select("block", F.greatest("line", F.col("block") * LINE_BLOCK).alias("pos"), *((own if side_name == name else nothing).alias(side_name) for side_name in ("filler", "gap")))

    starts = events(fillers, "filler", F.struct("_row"))
    ends = events(gaps, "gap", F.struct("sequence_id", "offset"))
    both = starts.unionByName(ends)
    line = Window.partitionBy("block").orderBy("pos", F.col("gap").isNull())
    seen = line.rowsBetween(Window.unboundedPreceding, 0)
    cuts = both.select(
        "pos",
        F.last("filler", ignorenulls=True).over(seen).alias("filler"),
        F.last("gap", ignorenulls=True).over(seen).alias("gap"),
        F.lead("pos").over(line).alias("next"),
        ((F.col("block") + 1) * LINE_BLOCK).alias("end"),
    )
    to = F.least(F.coalesce("next", "end"), "filler.to", "gap.to")
    pieces = cuts.where(F.col("filler").isNotNull() & F.col("gap").isNotNull()).select("filler", "gap", "pos", (to - F.col("pos")).alias("length")).where("length > 0")
    return pieces.select(F.col("filler.what._row").alias("_row"), (F.col("pos") - F.col("filler.line")).alias("at"), "length", F.col("gap.what.sequence_id").alias("sequence_id"), (F.col("gap.what.offset") + F.col("pos") - F.col("gap.line")).alias("offset"))


def pack_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row for each piece: ``keep`` columns, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids (by the tokenizers library, without special tokens added) and ``end_id``; null and empty texts
    are ``end_id`` alone. Every id lies in one piece; ``start`` counts the document's ids before the piece, ``offset`` the
    sequence's. Sequences hold ``window`` ids, but for some at the very end whose lengths are powers of two (and, of
    inputs too small to fill a gap, padded ones). Repeated rows are documents of their own; an empty table gives no
    rows; other columns don't matter.
    """
    spark = docs.sparkSession
    keys = [f"_k{i}" for i in range(len(keep))]
    inner = docs.select(*(F.col(c).alias(k) for c, k in zip(keep, keys, strict=True)), F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"{k} {inner.schema[i].dataType.simpleString()}" for i, k in enumerate(keys)), "doc_tokens long, full array<long>, rest binary, rest_crc long"])
    tokens = table(inner.mapInArrow(_tokenizer(path, len(keep), end_id, window), schema).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    grid = window // CLASSES
    rests = tokens.select("_row", *keys, "doc_tokens", F.expr(f"doc_tokens % {window}").alias("size"), "rest_crc").where("size > 0").withColumn("class", F.expr(f"(size + {grid - 1}) div {grid}"))
    out = [*keys, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    # full windows
    whole = _numbered(tokens.where(F.size("full") > 0).select("_row", *keys, "doc_tokens", "full"), "_row", None, before=F.size("full").cast("long"))
    windows = whole.select(*keys, "doc_tokens", "before", F.posexplode("full").alias("i", "ids_crc32"))
    windows = windows.select(*keys, (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("before") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # combinations
    histogram = {r[0]: r[1:] for r in rests.groupBy("class").agg(F.count("*"), F.sum("size")).collect()}
    n_full = tokens.agg(F.sum(F.size("full").cast("long"))).first()[0] or 0
    counts = np.array([histogram.get(c, (0, 0))[0] for c in range(1, CLASSES + 1)], np.int64)
    sizes = np.array([histogram.get(c, (0, 0))[1] for c in range(1, CLASSES + 1)], np.int64)
    gap = float((counts * np.arange(1, CLASSES + 1) * grid - sizes).sum())
    held_back = 1.03 * gap / max(1.0, gap + float(sizes.sum()))
    combos = combinations_filling()
    repeats = solve_counts(np.floor(counts * (1 - held_back)).astype(np.int64), combos)
    numbered = _numbered(rests, "_row", "class", number=F.lit(1).cast("long"))
    kinds = ", ".join(f"{k} {rests.schema[k].dataType.simpleString()}" for k in keys)
    placed = table(
        numbered.select("_row", *keys, "doc_tokens", "size", "rest_crc", "class", "number").mapInArrow(_placer(combos, repeats, n_full), f"_row long, {kinds}, doc_tokens long, size long, rest_crc long, sequence_id long, place long"),
        "placed",
    )
    taken = placed.where("sequence_id IS NOT NULL")
    ahead = Window.partitionBy("sequence_id").orderBy("place")
    laid = taken.withColumn("offset", F.sum("size").over(ahead) - F.col("size"))
    combined = laid.select(*keys, (F.col("doc_tokens") - F.col("size")).alias("start"), F.col("size").alias("length"), F.col("rest_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

    # gaps, and the line of what is left over
    open_ends = table(taken.groupBy("sequence_id").agg(F.sum("size").alias("offset")).where(F.col("offset") < window).withColumn("size", window - F.col("offset")), "gaps")
    fillers = placed.where("sequence_id IS NULL").select("_row", "size")
    n_gap, n_fill = (d.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] for d in (open_ends, fillers))
    next_id = n_full + int(repeats.sum())
    gaps = _numbered(open_ends, "sequence_id", None, line=F.col("size"))
    more, end = divmod(max(0, n_fill - n_gap), window)
    extra = spark.range(more).select((F.col("id") + next_id).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), (F.col("id") * window + n_gap).alias("line"), F.lit(window).cast("long").alias("size"))
    tail, at = [], n_gap + more * window
    for bit in reversed(range(window.bit_length())):
        if end >> bit & 1:
            tail.append((next_id + more + len(tail), 0, at, 1 << bit))
            at += 1 << bit
    columns = ["sequence_id", "offset", "line", "size"]
    all_gaps = gaps.select(columns).unionByName(extra).unionByName(spark.createDataFrame(tail, ", ".join(f"{c} long" for c in columns)))
    pieces = _overlaid(_numbered(fillers, "_row", None, line=F.col("size")), all_gaps)
    own = pieces.groupBy("_row").agg(F.collect_list(F.struct("at", "length", "sequence_id", "offset")).alias("cuts"))
    stored = tokens.where(F.expr(f"doc_tokens % {window} > 0")).select("_row", *keys, "doc_tokens", F.expr(f"doc_tokens % {window}").alias("_rest_tokens"), "rest")
    based = own.join(stored, "_row").withColumn("cuts", F.transform("cuts", lambda c: c.withField("start", c["at"] + F.col("doc_tokens") - F.col("_rest_tokens"))))
    cut = based.select(*keys, "doc_tokens", "_rest_tokens", "rest", "cuts").mapInArrow(_cutter([*keys, "doc_tokens"]), f"{kinds}, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long")
    packed = windows.select(out).unionByName(combined.select(out)).unionByName(cut.select(out))
    return packed.select(*(F.col(k).alias(c) for c, k in zip(keep, keys, strict=True)), *out[len(keys) :])
