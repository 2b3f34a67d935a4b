import re

import corpus_pipeline
from meterlake.llm.scratch import table

from .test_packing import verify
from .test_quality_rules import brute as facts
from .test_secret_scan import brute as secrets_of
from .test_simhash_dedup import WORD, brute_print


def brute_kept(docs):
    """The smallest id of each group that close fingerprints and similar sets of five-word shingles connect."""
    words = {k: tuple(WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), r.text or ""))) for k, r in docs.items()}
    sets = {k: {w[i : i + 5] for i in range(max(1, len(w) - 4))} for k, w in words.items()}
    prints = {k: brute_print(r.text, 5) for k, r in docs.items()}
    group = {k: {k} for k in docs}
    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n, m = len(sets[a]), len(sets[b])
            if group[a] is group[b]:
                continue
            near = (prints[a] ^ prints[b]).bit_count() <= 2 or words[a] == words[b]
            if not near and min(n, m) >= 0.8 * max(n, m):
                both = len(sets[a] & sets[b])
                near = both >= 0.8 * (n + m - both)
            if near:
                merged = group[a] | group[b]
                group.update(dict.fromkeys(merged, merged))
    return {min(g) for g in group.values()}


def test_each_stage_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    inputs = []
    for name, stage in corpus_pipeline.STAGES:
        inputs.append({r.doc_id: r for r in docs.collect()})
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.schema.names == docs.schema.names
        docs = table(out, "stage")
    everything, judged, named, distinct, clean = inputs
    for k, r in everything.items():
        n, _, _, _, repeats = facts(r.text)
        if n < 20 or 100 * repeats > 30 * n:
            assert k not in judged
    good = [k for k in everything if labels.get(k) == 1 and facts(everything[k].text)[0] >= 20]
    assert sum(k in judged for k in good) >= 0.98 * len(good)
    assert sum(k in judged for k in everything if labels.get(k) == 0) <= 0.1 * sum(v == 0 for v in labels.values())
    assert len(named) >= 0.99 * len(judged)
    assert set(distinct) == brute_kept(named)
    assert set(clean) == set(distinct)
    for k, r in clean.items():
        spans = secrets_of(distinct[k].text)[1]
        assert (r.text == distinct[k].text) == (not spans) and r.n_chars == len(r.text)
        at, want = 0, ""
        for _, a, b in spans:
            if a >= at:
                want += distinct[k].text[at:a] + "[REDACTED]"
            at = max(at, b)
        assert r.text == want + distinct[k].text[at:]
    verify(docs.collect(), {k: r.text for k, r in clean.items()})


def test_run_applies_the_stages(spark, sf, odd_docs, tmp_path):
    packed = corpus_pipeline.run(spark, sf)
    assert packed.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert packed.count() > 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name, docs in (("odd", odd_docs), ("none", odd_docs.limit(0))):
        docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() >= 0
