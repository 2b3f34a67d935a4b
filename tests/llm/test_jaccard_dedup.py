import random

import pytest

import corpus_pipeline
from meterlake.llm import jaccard_dedup
from meterlake.llm.jaccard_dedup import one_of_each_alike


def _shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_stage_leaves_no_pair_of_similarity_080(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(60):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        rows.append((7 * k, " ".join(base)))
        for c in range(1, 5):
            copy = list(base)
            for at in rng.sample(range(len(base)), max(1, len(base) * c // 100)):
                copy[at] = rng.choice(vocabulary)
            rows.append((7 * k + c, " ".join(copy)))
    rng.shuffle(rows)
    sets = {k: _shingles(t) for k, t in rows}
    group = {k: {k} for k in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] is not group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                merged = group[a] | group[b]
                group.update(dict.fromkeys(merged, merged))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    alike = [(a, b) for a in kept for b in kept if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert not alike
    assert kept <= {min(g) for g in group.values()}
    assert {k - k % 7 for k in kept} == {7 * k for k in range(60)}


def _groups(sets):
    group = {k: {k} for k in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] is not group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                merged = group[a] | group[b]
                group.update(dict.fromkeys(merged, merged))
    return group


@pytest.mark.parametrize("rows", [4, 256])
def test_blocks_lose_no_link(spark, monkeypatch, rows):
    """A large group of near copies, chains to its edge, and look-alikes below the threshold, in blocks of a few texts."""
    monkeypatch.setattr(jaccard_dedup, "BLOCK_ROWS", rows)
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = rng.choices(vocabulary, k=150)

    def changed(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = rng.choice(vocabulary)
        return words

    texts = [base, *(changed(base, 1) for _ in range(60)), *(changed(base, 4) for _ in range(40))]
    chain = base
    for _ in range(12):  # each near the one before it, the ends far apart
        chain = chain[5:] + rng.choices(vocabulary, k=5)
        texts.append(chain)
    texts += [changed(base, 20) for _ in range(20)] + [rng.choices(vocabulary, k=80) for _ in range(20)]
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    group = _groups({i: _shingles(" ".join(t)) for i, t in enumerate(texts)})
    assert {r.doc_id for r in one_of_each_alike(docs).collect()} == {min(g) for g in group.values()}


def test_odd_rows(spark, odd_docs):
    kept = one_of_each_alike(odd_docs)
    assert kept.columns == odd_docs.columns
    # 4 and 5 repeat the same words; 1, 2 and 3 have none
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 6, 7, 8]
    assert one_of_each_alike(odd_docs.limit(0)).count() == 0
