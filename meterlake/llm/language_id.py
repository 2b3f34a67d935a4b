"""Language identification of mixed texts: scripts narrow the languages, Viterbi labels spans of words.

Every word has a score for each learned language, from hashed runs of four bytes. Languages that don't write the word's
scripts are out. The best sequence of languages, at a fixed penalty for each switch, gives the text's spans. Where no run
of words favours other languages by more than the penalty, the best sequence is one language throughout, and it is
taken without stepping through the words; all other texts are stepped through together, word by word.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.labelled import held_out
from meterlake.llm.textbuf import Texts, kept_with_text, slices

#: Hash cells of the model; a model has this many numbers for each language.
CELLS = 1 << 15
#: Documents of each language that the fit takes.
FIT_DOCS = 2000
#: Natural-log cost of a change of language between two words.
SWITCH = 12.0
#: A language writes a script if this share of its letters is in it.
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: First code points of script ranges, and the script that begins there (0: common).
SCRIPT_STARTS = (0x0, 0xAA, 0x2B0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xA00, 0xB00, 0xC00, 0xD00, 0xE00, 0xF00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x30A0, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0xFB50, 0xFE70, 0xFF00, 0x20000)
SCRIPT_CODES = (1, 1, 0, 2, 3, 4, 5, 6, 0, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 1, 2, 0, 18, 18, 19, 19, 0, 16, 0, 19, 1, 6, 6, 0, 19)
N_SCRIPTS = 20


@dataclass
class LanguageModel:
    names: list[str]
    #: log probability of each cell less its mean over the languages, cells x languages
    table: np.ndarray
    #: scripts x languages: is it written in it
    writes: np.ndarray


def _letters(t: Texts) -> np.ndarray:
    """The bytes with ASCII letters lower-cased and all but letters and non-ASCII bytes made spaces."""
    lower = np.full(256, 0x20, np.uint8)
    lower[97:123] = lower[65:91] = np.arange(97, 123)
    lower[128:] = np.arange(128, 256)
    return lower[t.buf]


def _cells(t: Texts, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of letter bytes, and the cell of the bytes from one before to two after; texts don't see each other."""
    padded = np.full(len(letters) + 3 * t.n + 3, 0x20, np.uint8)
    doc = np.repeat(np.arange(t.n), np.diff(t.off))
    at = np.arange(len(letters)) + 3 * doc + 1
    padded[at] = letters
    where = np.flatnonzero(letters != 0x20)
    p = at[where]
    b = padded.astype(np.uint32)
    g = b[p - 1] | b[p] << np.uint32(8) | b[p + 1] << np.uint32(16) | b[p + 2] << np.uint32(24)
    return where, (g * np.uint32(0x9E3779B1) >> np.uint32(33 - CELLS.bit_length())).astype(np.int64)


def _points(t: Texts, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the characters outside ASCII, and their code points."""
    lead = np.flatnonzero(letters >= 0xC0)
    b = np.concatenate([t.buf, np.zeros(3, np.uint8)]).astype(np.int64)
    first, second, third, fourth = (b[lead + i] for i in range(4))
    tail = ((second & 63) << 12) | ((third & 63) << 6) | (fourth & 63)
    return lead, np.where(first < 0xE0, ((first & 31) << 6) | (second & 63), np.where(first < 0xF0, ((first & 15) << 12) | ((second & 63) << 6) | (third & 63), ((first & 7) << 18) | tail))


def _scripts(letters: np.ndarray, lead: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Script of each byte that begins a letter (0: common or none)."""
    out = np.zeros(len(letters), np.int64)
    out[(letters >= 97) & (letters < 123)] = 1
    out[lead] = np.array(SCRIPT_CODES)[np.searchsorted(SCRIPT_STARTS, point, "right") - 1]
    return out


@cache
def _is_letter() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _counter(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of cells (and, at CELLS + script, of scripts) by language, once for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {x: i for i, x in enumerate(names)}
        width = CELLS + N_SCRIPTS
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = [known[x] for x in batch.column("_lang").to_pylist()]
            for row, t in slices(pc.utf8_lower(batch.column("_text"))):
                letters = _letters(t)
                where, cell = _cells(t, letters)
                script = _scripts(letters, *_points(t, letters))
                lang = np.array(langs[row : row + t.n])
                doc = np.searchsorted(t.off, np.arange(len(letters)), "right") - 1
                for k in np.unique(lang):
                    mine = (lang == k)[doc]
                    counts.setdefault(int(k), np.zeros(width, np.int64))[:CELLS] += np.bincount(cell[mine[where]], minlength=CELLS)
                    counts[int(k)][CELLS:] += np.bincount(script[mine & (script > 0)], minlength=N_SCRIPTS)
        for k, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": np.full(len(at), k, np.int32), "cell": at.astype(np.int32), "n": n[at]})

    return run


def fit_languages(docs: DataFrame, per_language: int = FIT_DOCS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Counts about ``per_language`` whole texts of each language, chosen by a hash, out of those that are not held out.

    The counts are summed in Spark: languages x CELLS numbers reach the driver, whatever the size of the input. Texts
    or languages that are null teach nothing.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(key))).select(F.col(key).alias("_id"), F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text"))
    sizes = {r[0]: r[1] for r in usable.groupBy("_lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return LanguageModel([], np.zeros((CELLS, 0), np.float32), np.zeros((N_SCRIPTS, 0), bool))
    share = F.create_map(*(F.lit(x) for name in names for x in (name, min(1.0, per_language / sizes[name]))))
    sample = usable.where(F.pmod(F.xxhash64("_id", F.lit(5)), F.lit(1 << 30)) < share[F.col("_lang")] * float(1 << 30)).select("_lang", "_text")
    sums = sample.mapInArrow(_counter(names), "lang int, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros((CELLS + N_SCRIPTS, len(names)))
    n[sums.column("cell").to_numpy(), sums.column("lang").to_numpy()] = sums.column("n").to_numpy()
    p = np.log((n[:CELLS] + 0.5) / (n[:CELLS].sum(axis=0) + 0.5 * CELLS))
    writes = n[CELLS:] >= SCRIPT_SHARE * np.maximum(n[CELLS:].sum(axis=0), 1)
    return LanguageModel(names, (p - p.mean(axis=1, keepdims=True)).astype(np.float32), writes)


def _word_scores(t: Texts, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Scores of each word for each language, and the letters (code points) of each word."""
    letters = _letters(t)
    where, cell = _cells(t, letters)
    lead, point = _points(t, letters)
    script = _scripts(letters, lead, point)
    word = np.searchsorted(t.starts, where, "right") - 1
    n, k = len(t.starts), len(model.names)
    scores = np.stack([np.bincount(word, model.table[cell, i], minlength=n) for i in range(k)], 1) if k else np.zeros((n, 0))
    own = np.concatenate([np.flatnonzero((letters >= 97) & (letters < 123)), lead[_is_letter()[point]]])
    size = np.bincount(np.searchsorted(t.starts, own, "right") - 1, minlength=n)
    foreign = np.flatnonzero(script > 1)
    if k and len(foreign) or (k and not model.writes[1].all()):
        used = np.flatnonzero(script > 0)
        seen = np.zeros((n, N_SCRIPTS), bool)
        seen[np.searchsorted(t.starts, used, "right") - 1, script[used]] = True
        can = (seen.astype(np.float32) @ model.writes.astype(np.float32)) > 0
        scores = np.where(can | ~can.any(axis=1, keepdims=True), scores, -1e6)
    return scores, size


def _viterbi(scores: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best language of each word, text by text; ``first``: offsets of the texts in the words. Ties: the earlier name, and no switch."""
    n_texts, k = len(first) - 1, scores.shape[1]
    label = np.zeros(len(scores), np.int64)
    sizes = np.diff(first)
    some = np.flatnonzero(sizes > 0)
    if not len(some) or k < 2:
        return label
    total = np.add.reduceat(scores, first[some], axis=0)
    main = np.zeros(n_texts, np.int64)
    main[some] = total.argmax(axis=1)
    label[:] = np.repeat(main, sizes)
    gain = np.concatenate([[0.0], np.cumsum(scores.max(axis=1) - scores[np.arange(len(scores)), label])])
    steps = []
    for i in some:
        part = gain[first[i] : first[i + 1] + 1]
        if (part - np.minimum.accumulate(part)).max() > SWITCH:
            steps.append(i)
    if not steps:
        return label
    order = np.array(sorted(steps, key=lambda i: -sizes[i]))
    size = sizes[order]
    back = np.zeros((int(size.sum()), k), np.int8 if k < 128 else np.int32)
    base = np.concatenate([[0], np.cumsum(size)])[:-1]
    best = scores[first[order]].copy()
    alive = len(order)
    for step in range(1, int(size[0])):
        while size[alive - 1] <= step:
            alive -= 1
        now = best[:alive]
        top = now.argmax(axis=1)
        jump = now[np.arange(alive), top] - SWITCH
        stay = now >= jump[:, None]
        back[base[:alive] + step] = np.where(stay, np.arange(k), top[:, None])
        best[:alive] = np.where(stay, now, jump[:, None]) + scores[first[order[:alive]] + step]
    state = best.argmax(axis=1)
    for j, i in enumerate(order):
        own, s = back[base[j] : base[j] + size[j]], int(state[j])
        out = np.empty(size[j], np.int64)
        for step in range(size[j] - 1, -1, -1):
            out[step] = s
            s = int(own[step, s])
        label[first[i] : first[i + 1]] = out
    return label


def _labeller(model: LanguageModel, n: int, text_at: int, spans: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.names)
        names = np.array([*model.names, UNKNOWN], object)
        for batch in batches:
            for row, t in slices(pc.utf8_lower(batch.column(text_at))):
                scores, size = _word_scores(t, model)
                label = _viterbi(scores, t.first) if k else np.zeros(len(size), np.int64)
                share = np.stack([t.per_word_text(size * (label == i)) for i in range(k)], 1) if k else np.zeros((t.n, 0))
                letters = t.per_word_text(size)
                has = (letters > 0) & (k > 0)
                best = np.where(has, share.argmax(axis=1), k) if k else np.full(t.n, k)
                score = np.where(has, share[np.arange(t.n), np.minimum(best, k - 1)] / np.maximum(letters, 1), 0.0) if k else np.zeros(t.n)
                kept = batch.slice(row, t.n).select(range(n))
                new = {"_pred": pa.array(names[best], pa.string()), "_score": pa.array(score)}
                if spans:
                    starts = np.ones(len(label), bool)
                    starts[1:] = (label[1:] != label[:-1]) | (t.doc[1:] != t.doc[:-1])
                    at = np.flatnonzero(starts)
                    end = np.append(at[1:], len(label))
                    fields = [pa.array((at - t.first[t.doc[at]]).astype(np.int32)), pa.array((end - at).astype(np.int32)), pa.array(names[label[at]], pa.string())]
                    offsets = pa.array(np.searchsorted(at, t.first).astype(np.int32))
                    new["_spans"] = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["first_word", "n_words", "lang"]))
                yield pa.RecordBatch.from_arrays([*kept.columns, *new.values()], [*kept.schema.names, *new])

    return run


def identify_languages(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), model: LanguageModel | None = None, spans: bool = False, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``keep`` columns with lang_pred, score and, if asked for, spans array<struct<first_word, n_words, lang>>.

    lang_pred is the language of most letters, and score their share; ``und`` with score 0 where the text is null, has
    no letter, or no language was learned. Words are runs outside ASCII white space. Ties go to the first name. Repeated
    rows are labelled alike; an empty table gives none; other columns don't matter.
    """
    model = model or fit_languages(docs, key=key, text=text, lang=lang)
    inner, at = kept_with_text(docs, keep, text)
    schema = [*(f"_k{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep))), "_pred string", "_score double"]
    schema += ["_spans array<struct<first_word:int,n_words:int,lang:string>>"] * spans
    out = inner.mapInArrow(_labeller(model, len(keep), at, spans), ", ".join(schema))
    return out.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"), *[F.col("_spans").alias("spans")] * spans)
