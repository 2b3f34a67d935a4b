import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from meterlake.llm import queries
from meterlake.llm.packing import combinations_filling, nonnegative_least_squares, pack_documents, solve_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def verify(pieces, texts, window=4096, padding=0.0):
    """Every id in one piece with its checksum, sequences gapless; returns the padding."""
    library = Tokenizer.from_file(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc_id, own in by_doc.items():
        ids = np.array([*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    padded = total = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        total += at
        padded += 0 if at & (at - 1) == 0 else window - at
    assert padded <= padding * total
    return len(by_sequence)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    pieces = queries.op3_packing(spark, sf).collect()
    verify(pieces, docs)
    assert len(pieces) < 3 * len(docs)


def test_odd_rows(spark, odd_docs):
    unique = odd_docs.where("doc_id IS NOT NULL AND doc_id <> 5")
    verify(pack_documents(unique, PATH).collect(), {r.doc_id: r.text for r in unique.collect()}, padding=0.2)
    assert pack_documents(odd_docs.limit(0), PATH).count() == 0
    repeated = pack_documents(odd_docs, PATH)
    assert repeated.where("doc_id = 5").groupBy().sum("length").first()[0] == 2 * repeated.where("doc_id = 5").first().doc_tokens
    one = pack_documents(odd_docs.where("doc_id = 2"), PATH).collect()
    assert [(p.length, p.doc_tokens, p.offset) for p in one] == [(1, 1, 0)]


def test_least_squares_and_counts():
    rng = np.random.default_rng(4)
    a = rng.random((20, 30))
    x = np.maximum(rng.normal(0, 1, 30), 0)
    got = nonnegative_least_squares(a, a @ x)
    assert (got >= 0).all() and np.abs(a @ got - a @ x).max() < 1e-6
    combos = combinations_filling()
    assert (np.arange(1, 65) @ combos == 64).all()
    histogram = rng.integers(0, 1000, 64)
    counts = solve_counts(histogram, combos)
    assert (combos @ counts <= histogram).all() and (combos @ counts).sum() > 0.5 * histogram.sum()


def test_words_of_equal_hashes_are_told_apart(spark, twins):
    texts = {1: " ".join(twins), 2: twins[1], 3: twins[0]}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    verify(pack_documents(rows, PATH).collect(), texts, padding=1.0)
