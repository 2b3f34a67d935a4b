import re

import numpy as np
import xxhash

from meterlake.llm import queries
from meterlake.llm.components import connected_components
from meterlake.llm.scratch import table
from meterlake.llm.simhash_dedup import _forest, link_fingerprints, near_duplicates, one_of_each

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_print(text, n=3):
    words = WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    group = {p: {p} for p in prints}
    distinct = sorted(group)
    for i, p in enumerate(distinct):
        for q in distinct[i + 1 :]:
            if (p ^ q).bit_count() <= 2 and group[p] is not group[q]:
                merged = group[p] | group[q]
                group.update(dict.fromkeys(merged, merged))
    return group


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {k: brute_print(t) for k, t in docs.items()}
    group = brute_groups(prints.values())
    least = {}
    for k, p in sorted(prints.items()):
        least.setdefault(id(group[p]), k)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash_dedup(spark, sf).collect()}
    assert got == {k: (f"{p:016x}", least[id(group[p])]) for k, p in prints.items()}


def test_dense_cloud_keeps_every_link(spark):
    rng = np.random.default_rng(5)
    base = int(rng.integers(1 << 62))
    prints = {base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(600)}
    prints |= {base ^ (i << 16) for i in range(500)} | {int(x) for x in rng.integers(0, 1 << 62, 300)}
    rows = spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in prints], "fingerprint long")
    found = {r.node & (1 << 64) - 1: r.component for r in connected_components(link_fingerprints(rows)).collect()}
    group = brute_groups(prints)
    for p in prints:
        for q in list(prints)[:200]:
            assert (group[p] is group[q]) == (p == q or (p in found and found.get(p) == found.get(q)))


def test_large_posting_agrees_with_small(monkeypatch):
    rng = np.random.default_rng(2)
    members = np.unique(rng.integers(0, 1 << 16, 900)).astype(np.uint64) << np.uint64(16)
    large = _forest(members, 0b1100, 2)
    monkeypatch.setattr("meterlake.llm.simhash_dedup.SMALL", 10_000)
    small = _forest(members, 0b1100, 2)
    assert (large == small).all()


def test_odd_rows(spark, odd_docs):
    rows = near_duplicates(odd_docs, keep=("doc_id", "text", "label")).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r.fingerprint == f"{brute_print(r.text):016x}"
    assert {r.component_id for r in rows if not (r.text or "").strip()} == {1}
    kept = one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len({r.component_id for r in rows if r.doc_id is not None}) + len({r.fingerprint for r in rows if r.doc_id is None})
    assert near_duplicates(odd_docs.limit(0)).count() == 0


def test_places_are_read_not_numbered_again(spark, tmp_path, monkeypatch):
    from meterlake.llm import simhash_dedup

    path = str(tmp_path / "docs")
    rows = [(i, f"text number {i // 2} stands alone with words {'abcdefghij'[i // 2 % 10] * 9} {i // 2 * 7919}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(16).write.parquet(path)
    size = "spark.sql.files.maxPartitionBytes"
    before, found = spark.conf.get(size), simhash_dedup.near_duplicates

    def split_anew(*args):
        groups = table(found(*args), "groups")
        spark.conf.set(size, "1k")
        return groups

    docs = spark.read.parquet(path)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    monkeypatch.setattr(simhash_dedup, "near_duplicates", split_anew)
    try:
        kept = sorted(r.doc_id for r in one_of_each(docs).collect())
    finally:
        spark.conf.set(size, before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert kept == list(range(0, 400, 2))


def test_a_third_of_all_rows_of_one_fingerprint(spark):
    """Fingerprints of many rows take the broadcast way, the rest the other."""
    rows = [(i, "one text that is copied very often") for i in range(700)] + [(700 + i, f"text {i // 2} of its own, twice {i // 2 * 7919} over") for i in range(1500)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = {i: brute_print(t) for i, t in rows}
    group, least = brute_groups(prints.values()), {}
    for i, p in sorted(prints.items()):
        least.setdefault(id(group[p]), i)
    assert got == {i: least[id(group[p])] for i, p in prints.items()}
    assert {got[i] for i in range(700)} == {0}
