import math
import re
from collections import Counter

import numpy as np

from meterlake.llm import queries
from meterlake.llm.quality_rules import CELLS, fit_quality, judge_quality
from meterlake.llm.textbuf import range_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_facts_and_verdicts(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op8_quality_rules(spark, sf).collect()
    assert len(got) == len(docs)
    right = Counter()
    for r in got:
        n, chars, symbols, lines, repeats = want = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert not (r.kept and r.base_failed)
        if r.doc_id in labels and not r.base_failed:
            right[labels[r.doc_id], r.kept == bool(labels[r.doc_id])] += 1
    assert right[1, True] >= 0.98 * (right[1, True] + right[1, False])
    assert right[0, True] >= 0.9 * (right[0, True] + right[0, False])


def test_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, None), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    got = judge_quality(odd_docs, labels, keep=("doc_id", "text")).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
    assert judge_quality(odd_docs.limit(0), labels.limit(0)).count() == 0


def test_lines_and_windows_of_equal_hashes_are_told_apart(spark, twins):
    a, b = twins
    words = "one two three four five six seven".split()
    texts = [f"{a}\n{b}\n{a}", f"{a}\n{b}", " ".join([*words, a, *words, b]), " ".join([*words, a, *words, a, b]), "\n".join([a, " ", "", b, a + " ", a])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    for r in judge_quality(rows, labels).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id]), r.doc_id


def test_probabilities_against_plain_sums(spark, sf):
    """Mean weight of the words plus mean weight of all runs of four bytes, through the calibrated sigmoid."""
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    weights, shift = model = fit_quality(docs, labels)
    some = docs.orderBy("doc_id").limit(120)
    got = {r.doc_id: r.probability for r in judge_quality(some, labels, model=model).collect()}
    for r in some.collect():
        text = (r.text or "").encode()
        words = [m.encode() for m in WORD.findall(r.text or "")]
        cell = lambda w: int(range_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) % (CELLS // 2)
        by_word = [float(weights[cell(w)]) for w in words]
        grams = [int.from_bytes(text[i : i + 4], "little") * 0x9E3779B1 % (1 << 32) >> 33 - CELLS.bit_length() + 1 for i in range(len(text) - 3)]
        by_gram = [float(weights[g + CELLS // 2]) for g in grams]
        z = 30 * (sum(by_word) / max(len(by_word), 1) + sum(by_gram) / max(len(by_gram), 1)) + shift
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-5
