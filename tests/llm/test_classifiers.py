import zlib

import numpy as np
import pyarrow as pa

from meterlake.llm import queries
from meterlake.llm.labelled import labelled_sample
from meterlake.llm.language_id import CELLS, SWITCH, _viterbi, _word_scores, fit_languages, identify_languages
from meterlake.llm.quality_classifier import BLOCK, NEIGHBOURS, SHARPNESS, _blocks, _votes, fit_neighbours, score_quality
from meterlake.llm.textbuf import slices


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_languages_of_held_out_documents(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_language_id(spark, sf).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    out = [(r.lang_pred, docs[r.doc_id].lang) for r in got if r.held_out]
    assert np.mean([a == b for a, b in out]) >= 0.97


def test_viterbi_is_the_best_sequence():
    rng = np.random.default_rng(1)
    for n, scale in ((0, 1), (1, 9), (9, 3), (40, 9), (200, 20)):
        scores = rng.normal(0, scale, (n, 3)).cumsum(axis=0) * 0.3
        got = _viterbi(scores, np.array([0, n]))
        best = np.full((max(n, 1), 3), -np.inf)
        if not n:
            continue
        best[0] = scores[0]
        for i in range(1, n):
            best[i] = [scores[i, j] + max(best[i - 1, k] - SWITCH * (k != j) for k in range(3)) for j in range(3)]
        value = scores[np.arange(n), got].sum() - SWITCH * (got[1:] != got[:-1]).sum()
        assert abs(value - best[-1].max()) < 1e-6


def test_mixed_text_has_spans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {lang: docs.where(f"lang = '{lang}' AND n_chars > 3000").orderBy("doc_id").first().text.split()[:120] for lang in ("en", "fr", "de")}
    both = spark.createDataFrame([(1, " ".join(text["fr"] + text["en"])), (2, " ".join(text["de"][:60] + text["fr"] + text["de"][60:]))], "doc_id long, text string")
    one, two = (r.spans for r in identify_languages(both, model=fit_languages(docs), spans=True).orderBy("doc_id").collect())
    assert [s.lang for s in one] == ["fr", "en"] and abs(one[1].first_word - 120) < 8
    assert [s.lang for s in two] == ["de", "fr", "de"] and sum(s.n_words for s in two) == 240


def test_odd_rows_of_languages(spark, odd_docs):
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in identify_languages(odd_docs, keep=("doc_id", "text")).collect()}
    assert got[1, None] == got[2, ""] == got[3, " \t\n\r "] == ("und", 0.0)
    assert all(p in ("en", "fr", "de") for (_, t), (p, _) in got.items() if t and t.strip())
    assert identify_languages(odd_docs.limit(0)).count() == 0
    assert {r.lang_pred for r in identify_languages(odd_docs.withColumn("lang", odd_docs.source.substr(9, 1))).collect()} <= {"und", ""}


def test_scores_of_held_out_documents(spark, sf):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op6_quality_classifier(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3) for r in got)
    out = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in out]) >= 0.95


def test_odd_rows_of_quality(spark, odd_docs):
    labels = spark.createDataFrame([(4, 1, None), (5, 0, 1), (None, 1, 1), (6, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = score_quality(odd_docs, labels, keep=("doc_id", "text", "ids")).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 for r in got if not (r.text or "").strip())
    assert score_quality(odd_docs, labels.limit(0)).where("score NOT IN (0, 0.5)").count() == 0
    assert score_quality(odd_docs.limit(0), labels).count() == 0


def test_word_scores_are_sums_over_their_letters(spark, sf):
    """Scores and letters of each word, byte by byte."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit_languages(docs)
    texts = ["été — ça! x—y 12 don't", "der straße…", "", "日本 a", *(r.text.lower()[:400] for r in docs.orderBy("doc_id").limit(20).collect())]
    for row, t in slices(pa.array(texts)):
        scores, sizes = _word_scores(t, model)
        at = 0
        for i in range(t.n):
            text = texts[row + i].encode()
            shown = [b if 97 <= b < 123 or b >= 128 else 32 for b in text]
            padded = [32, *shown, 32, 32]
            place = 0
            for word in text.split():
                place = text.index(word, place)
                own = [k for k in range(place, place + len(word)) if shown[k] != 32]
                cells = [(sum(padded[k + j] << 8 * j for j in range(4)) * 0x9E3779B1 % (1 << 32)) >> 33 - CELLS.bit_length() for k in own]
                assert np.allclose(scores[at], model.table[cells].sum(axis=0), atol=1e-3) or (scores[at] < -1e5).any()
                assert sizes[at] == sum(c.isalpha() for c in word.decode())
                place, at = place + len(word), at + 1
        assert at == len(scores)


def test_dashes_are_no_letters(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    french = docs.where("lang = 'fr' AND n_chars > 3000").orderBy("doc_id").first().text[:1500]
    rows = spark.createDataFrame([(1, french), (2, french + " —" * 2000), (3, "— … 12 😀")], "doc_id long, text string")
    one, two, three = identify_languages(rows, model=fit_languages(docs)).orderBy("doc_id").collect()
    assert (one.lang_pred, two.lang_pred, three.lang_pred) == ("fr", "fr", "und") and abs(one.score - two.score) < 0.02 and three.score == 0


def test_votes_against_all_cosines(spark, sf):
    """The nearest labelled vectors vote, each by a power of its cosine."""
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = fit_neighbours(docs, labels)
    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(BLOCK + 40).collect()]
    got = np.concatenate([_votes(x, model) for _, t in slices(pa.array(texts)) for _, _, x in _blocks(t)])
    counts = np.concatenate([x for _, t in slices(pa.array(texts)) for _, _, x in _blocks(t)])
    assert len(got) == len(texts)
    for x, score in zip(counts.astype(float), got, strict=True):
        latent = (x * model.idf) @ model.axes.astype(float)
        cosines = [float(v @ latent / max(np.linalg.norm(latent), 1e-12)) for v in model.vectors.astype(float)]
        near = sorted(range(len(cosines)), key=lambda i: -cosines[i])
        cut = cosines[near[NEIGHBOURS - 1]]
        if cut - cosines[near[NEIGHBOURS]] < 1e-4:
            continue  # which of two alike is the last to vote depends on rounding
        votes = [(max(cosines[i], 1e-3) ** SHARPNESS * model.weights[i], model.labels[i]) for i in near[:NEIGHBOURS]]
        assert abs(score - sum(w for w, y in votes if y == 1) / sum(w for w, _ in votes)) < 1e-3


def test_samples_are_bounded_whatever_repeats(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i % 40} {i // 400}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 50, i % 2) for i in range(500)] + [(3, 0)], "doc_id long, quality int")
    sample, counts = labelled_sample(docs, labels, "quality", 7)
    rows = sample.collect()
    again = labelled_sample(docs.repartition(7), labels.repartition(3), "quality", 7)[0].collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert 0 < len(rows) <= 14 and len({r._text.split()[1] for r in rows}) == len(rows)
    assert sum(counts.values()) == sum(not held(i % 50) for i in range(500)) + (not held(3))


def test_votes_do_not_depend_on_the_order_of_equally_near_rows():
    import numpy as np

    from meterlake.llm.quality_classifier import CELLS, NEIGHBOURS, NeighbourModel, _votes

    rng = np.random.default_rng(1)
    axes = np.linalg.qr(rng.standard_normal((CELLS, 4)))[0].astype(np.float32)
    base = np.eye(4, dtype=np.float32)
    vectors = np.concatenate([np.repeat(base[:1], NEIGHBOURS + 9, axis=0), np.repeat(base[1:2], 3, axis=0), base])
    labels = rng.integers(0, 2, len(vectors)).astype(np.float32)
    x = (rng.integers(0, 3, (20, CELLS))).astype(np.float32)
    x[:5] = np.abs(axes[:, 0])
    scores = []
    for _ in range(4):
        order = rng.permutation(len(vectors))
        scores.append(_votes(x, NeighbourModel(np.ones(CELLS, np.float32), axes, vectors[order], labels[order], np.ones(len(vectors), np.float32))))
    assert all(np.allclose(scores[0], s, atol=1e-6) for s in scores)
