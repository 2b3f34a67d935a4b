"""Removal of every byte that lies in a string of ``window`` bytes which starts at another place too.

Windows that are equal have the same anchor (``anchors.py``), at the same offset. The offsets are cut into ranges of STEP, and what
all windows of an anchor and range have in common is their core: equal windows have equal cores. A member of a core is one
place of it, with the few bytes on either side to which its windows reach: its context. Equal contexts count once, with their
number; the contexts of a core that differ are written down with one symbol for the core, and a suffix array over these tells which
windows stand next to an equal one. A core of more than MANY contexts is split: each half of its range of offsets has a longer
core and shorter contexts, until a core is a window of its own and has one context only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.llm.anchors import GRAM, anchors
from meterlake.llm.heavy import looked_up
from meterlake.llm.scratch import table
from meterlake.llm.suffix_array import neighbours_alike, suffix_array
from meterlake.llm.textbuf import SLICE_BYTES, Texts, slices

WINDOW = 200
#: Offsets of windows that share a core, before any split: a power of two.
STEP = 64
#: Differing contexts of a core that are sorted together.
MANY = 2048
#: Symbols that are sorted together, if one core has no more.
BLOCK_SYMBOLS = 1 << 17
_END, _BETWEEN, _CORES = 0, 1, 258
_SPANS = "array<struct<start:long,end:long>>"


def _in_pieces(column: pa.Array, window: int) -> Iterator[tuple[int, int, Texts]]:
    """(first row, bytes before, Texts): slices of a column; a text that is longer than a slice comes in pieces that overlap by a window."""
    for row, texts in slices(column):
        n = len(texts.buf)
        if n <= 2 * SLICE_BYTES:
            yield row, 0, texts
            continue
        for at in range(0, n - window + 1, SLICE_BYTES):
            piece = texts.buf[at : at + SLICE_BYTES + window - 1]
            yield row, at, Texts(piece, np.array([0, len(piece)]))


def _anchored(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, at, texts in _in_pieces(batch.column(1), window):
                doc, hashes, place, first, last = anchors(texts, window)
                if not len(doc):
                    continue
                shift = at - texts.off[doc]
                columns = [batch.column(0).take(pa.array(row + doc)), pa.array(hashes.view(np.int64)), pa.array(place + shift), pa.array((place - first).astype(np.int16)), pa.array((place - last).astype(np.int16))]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "hash", "place", "most", "least"])

    return run


def _membered(window: int, step: int):
    """A row for each anchor and range of its offsets: where the core is, its digest, and the context."""
    core = window - step + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("uid", "at", "core", "ahead", "behind")}
            for uid, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text.encode()
                for a in found:
                    place, most, least = a["place"], a["most"], a["least"]
                    for k in range(least // step, most // step + 1):
                        at = place - k * step
                        first, last = max(place - most, at - step + 1), min(place - least, at)
                        out["uid"].append(uid)
                        out["at"].append(at)
                        out["core"].append(hashlib.sha256(text[at : at + core]).digest()[:16])
                        out["ahead"].append(text[first:at])
                        out["behind"].append(text[at + core : last + window])
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    return run


def _shared(texts: list[bytes]) -> int:
    """Bytes that all of them begin with."""
    a, b = min(texts), max(texts)
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _offsets(groups: list[list[tuple[bytes, bytes, int]]], step: int) -> list[list[list[int]]]:
    """For each context (ahead, behind, number) of each core the offsets of its windows that occur elsewhere, as [least, most, least, most ...]."""
    symbols: list[np.ndarray] = []
    core_at, n_ahead, n_behind, left, right, often = [], [], [], [], [], []
    at = 0
    for g, contexts in enumerate(groups):
        mirrored = [a[::-1] for a, _, _ in contexts]
        # what stands on either side of the core in all contexts is as good as part of it
        pl, pr = _shared(mirrored), _shared([b for _, b, _ in contexts])
        for ahead, behind, n in contexts:
            own = np.concatenate([np.frombuffer(ahead[: len(ahead) - pl], np.uint8).astype(np.int32) + 2, [_CORES + g], np.frombuffer(behind[pr:], np.uint8).astype(np.int32) + 2, [_BETWEEN]])
            symbols.append(own)
            core_at.append(at + len(ahead) - pl)
            n_ahead.append(len(ahead))
            n_behind.append(len(behind))
            left.append(pl)
            right.append(pr)
            often.append(n > 1)
            at += len(own)
    core_at, n_ahead, n_behind, left, right, often = map(np.array, (core_at, n_ahead, n_behind, left, right, often))
    text = np.concatenate([*symbols, [_END]]).astype(np.int32)
    ends = core_at + 1 + n_behind - right
    room = np.zeros(len(text), np.int64)
    lengths = np.diff(np.append(0, ends + 1))
    room[: len(text) - 1] = np.repeat(ends, lengths) - np.arange(len(text) - 1)
    alike = neighbours_alike(text, suffix_array(text), np.maximum(room, 0), step + 1)
    # a window d bytes ahead of the core reaches step - 1 - d behind it
    least, most = step - 1 - n_behind, n_ahead
    each = most - least + 1
    member = np.repeat(np.arange(len(each)), each)
    d = np.arange(len(member)) - np.repeat(np.cumsum(each) - each, each) + least[member]
    outside = np.maximum(0, d - left[member])
    needed = outside + 1 + np.maximum(0, step - 1 - d - right[member])
    hit = often[member] | (alike[core_at[member] - outside] >= needed)
    edge = np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))
    inner = np.flatnonzero((member[1:] != member[:-1]) & hit[1:] & hit[:-1]) + 1
    first, last = np.sort(np.append(np.flatnonzero(edge > 0), inner)), np.sort(np.append(np.flatnonzero(edge < 0), inner)) - 1
    out: list[list[int]] = [[] for _ in range(len(each))]
    for m, a, b in zip(member[first].tolist(), d[first].tolist(), d[last].tolist(), strict=True):
        out[m] += [a, b]
    cuts = np.cumsum([0, *map(len, groups)]).tolist()
    return [out[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _sorted_cores(step: int):
    """The offsets of repeated windows of each context; rows come core by core."""

    def done(groups: list[list[tuple]]) -> pa.RecordBatch:
        found = _offsets([[(r[2], r[3], r[4]) for r in g] for g in groups], step)
        rows = [(r[1], r[4], o) for g, offsets in zip(groups, found, strict=True) for r, o in zip(g, offsets, strict=True) if o]
        columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, ["context", "n", "offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[tuple]] = []
        n, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    if n >= BLOCK_SYMBOLS:
                        yield done(groups)
                        groups, n = [], 0
                    groups.append([])
                    last = row[0]
                groups[-1].append(row)
                n += len(row[2]) + len(row[3]) + 2
        if groups:
            yield done(groups)

    return run


def _digest(*parts: Column) -> Column:
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


def _keyed(members: DataFrame) -> DataFrame:
    """With the context's key for the core: the core, and some of a digest of core, ahead (its length first) and behind."""
    size = F.concat(F.length("ahead").cast("string"), F.lit(":")).cast("binary")
    own = F.substring(_digest(F.col("core"), size, F.col("ahead"), F.col("behind")), 1, 10)
    return members.select("uid", "at", F.concat("core", own).alias("context"), "ahead", "behind")


def _core() -> Column:
    return F.substring("context", 1, 16)


def _halved(members: DataFrame, step: int) -> DataFrame:
    """Members of the cores of half as many offsets: the lower ones, whose core is longer to the right, and those ahead of them."""
    half = step // 2
    # the windows lie between these offsets ahead of the core
    most, least = F.length("ahead"), step - 1 - F.length("behind")
    ahead, behind = F.col("ahead"), F.col("behind")
    near = F.least(most, F.lit(half - 1))
    right = members.where(least < half).select(
        "uid", "at", _digest(F.col("core"), F.lit(b">"), F.substring(behind, F.lit(1), F.lit(half))).alias("core"), F.substring(ahead, most - near + 1, near).alias("ahead"), F.substring(behind, F.lit(half + 1), F.lit(step)).alias("behind")
    )
    reach = step - 1 - F.greatest(least, F.lit(half))
    left = members.where(most >= half).select(
        "uid", (F.col("at") - half).alias("at"), _digest(F.col("core"), F.lit(b"<"), F.substring(ahead, most - half + 1, F.lit(half))).alias("core"), F.substring(ahead, F.lit(1), most - half).alias("ahead"), F.substring(behind, F.lit(1), reach).alias("behind")
    )
    return right.unionByName(left)


def _repeated(members: DataFrame, step: int, window: int, many: int) -> DataFrame:
    """(uid, start, end) of what repeated windows cover, from members of cores of ``step`` offsets."""
    found = None
    while True:
        keyed = table(_keyed(members), "members")
        contexts = table(keyed.groupBy("context").agg(F.first("ahead").alias("ahead"), F.first("behind").alias("behind"), F.count("*").alias("n")).withColumn("core", _core()), "contexts")
        cores = table(contexts.groupBy("core").agg(F.count("*").alias("_n"), F.sum("n").alias("n")).where("n > 1"), "cores")
        small = contexts.join(cores.where(F.col("_n") <= many).select("core", "_n"), "core")
        # a core's only context is repeated with all its windows if the core is
        alone = small.where("_n = 1").select("context", "n", F.array((F.lit(step - 1) - F.length("behind")), F.length("ahead")).alias("offsets"))
        several = small.where("_n > 1").select("core", "context", "ahead", "behind", "n")
        ordered = several.repartition("core").sortWithinPartitions("core").mapInArrow(_sorted_cores(step), "context binary, n long, offsets array<int>")
        at = looked_up(keyed.select("uid", "at", "context"), table(alone.unionByName(ordered), "hits"), "context", "n")
        pairs = F.transform(F.sequence(F.lit(0), F.expr("size(offsets) div 2 - 1")), lambda i: F.struct((F.col("at") - F.get("offsets", 2 * i + 1)).alias("start"), (F.col("at") - F.get("offsets", 2 * i) + window).alias("end")))
        covered = at.select("uid", F.inline(pairs))
        found = covered if found is None else found.unionByName(covered)
        large = cores.where(F.col("_n") > many).select("core", "n")
        if step == 1 or not large.take(1):
            return found
        members, step = _halved(looked_up(keyed.select("uid", "at", _core().alias("core"), "ahead", "behind"), large, "core", "n"), step), step // 2


def _cut(window: int):
    """What is left of each text without its spans, as a digest; spans joined where they overlap or touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("digest", "copies", "spans", "kept_sha256")}
            for digest, copies, text, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text.encode()
                spans: list[list[int]] = []
                if copies > 1:
                    spans = [[0, len(text)]]
                elif found:
                    for s in sorted((x["start"], x["end"]) for x in found):
                        if spans and s[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], s[1])
                        else:
                            spans.append(list(s))
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(text[at:a])
                    at = b
                kept.update(text[at:])
                out["digest"].append(digest)
                out["copies"].append(copies)
                out["spans"].append([{"start": a, "end": b} for a, b in spans])
                out["kept_sha256"].append(kept.hexdigest())
            spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.binary(), pa.int64(), spans_type, pa.string()), strict=True)], list(out))

    return run


def repeated_spans(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", window: int = WINDOW, step: int = STEP, many: int = MANY) -> DataFrame:
    """``keep`` columns, n_bytes, spans array<struct<start, end>> of the bytes to remove, and kept_sha256 of the bytes left.

    A byte is removed if a string of ``window`` bytes that covers it also starts elsewhere, in any text or the same one. Texts are
    UTF-8; null ones are empty; repeated rows are texts of their own, and so remove each other whole if they are as long as a window. Shorter texts stay as they are. An empty table
    gives no rows; other columns don't matter.
    """
    if window <= GRAM or step & (step - 1) or not 0 < step <= window:
        raise ValueError("window must be over GRAM, and step a power of two that is no more than it")
    inner = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    keys = [f"_k{i}" for i in range(len(keep))]
    size = F.octet_length("_text").cast("long")
    none = F.array().cast(_SPANS)
    short = inner.where(size < window).select(*keys, size.alias("n_bytes"), none.alias("spans"), F.sha2("_text", 256).alias("kept_sha256"))
    long = inner.where(size >= window)
    digest = F.substring(F.unhex(F.sha2("_text", 256)), 1, 16).alias("digest")
    # equal texts once
    texts = table(long.select(digest, "_text").groupBy("digest").agg(F.first("_text").alias("text"), F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id()), "texts")
    found = table(texts.select("uid", "text").mapInArrow(_anchored(window), "uid long, hash long, place long, most short, least short"), "anchors")
    again = table(found.groupBy("hash").agg(F.count("*").alias("_n")).where("_n > 1"), "again")
    places = looked_up(found, again, "hash").groupBy("uid").agg(F.collect_list(F.struct("place", "most", "least")).alias("found"))
    members = texts.select("uid", "text").join(places, "uid").select("uid", "text", "found").mapInArrow(_membered(window, step), "uid long, at long, core binary, ahead binary, behind binary")
    spans = _repeated(members, step, window, many).groupBy("uid").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    cut = texts.join(spans, "uid", "left").select("digest", "copies", "text", "found").mapInArrow(_cut(window), f"digest binary, copies long, spans {_SPANS}, kept_sha256 string")
    judged = looked_up(long.select(*keys, size.alias("n_bytes"), digest), table(cut, "cut"), "digest", "copies")
    every = judged.select(*keys, "n_bytes", "spans", "kept_sha256").unionByName(short)
    return every.select(*(F.col(k).alias(c) for c, k in zip(keep, keys, strict=True)), "n_bytes", "spans", "kept_sha256")


def without(text: Column, spans: Column) -> Column:
    """The bytes of ``text`` outside ``spans``, which are in order and apart; they need not be whole characters."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")

    def step(acc: Column, s: Column) -> Column:
        return F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(raw, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).cast("long").alias("at"), F.lit(b"").alias("out")), step, lambda a: F.concat(a["out"], F.substring(raw, (a["at"] + 1).cast("int"), F.length(raw))))
