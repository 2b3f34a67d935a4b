import hashlib

import public_tokenizers
from tokenizers import Tokenizer

from meterlake.llm import queries
from meterlake.llm.bpe import _words, decode, encode

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_and_decoded_text_are_the_librarys(spark, odd_docs):
    library = Tokenizer.from_file(PATH)
    encoded = encode(odd_docs, PATH, keep=("doc_id", "text"), decoded=True)
    got = decode(encoded, PATH, keep=("text", "ids", "decoded")).toDF("text", "ids", "at_once", "decoded").collect()
    assert len(got) == odd_docs.count()
    for row in got:
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == ids
        assert row.decoded == row.at_once == library.decode(ids, skip_special_tokens=False)


def test_query_digests(spark, sf):
    library = Tokenizer.from_file(PATH)
    want = {}
    for doc_id, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want[doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r[1:]) for r in queries.op10_bpe(spark, sf).collect()} == want


def test_empty_table(spark, odd_docs):
    assert encode(odd_docs.limit(0), PATH).count() == 0


def test_unknown_and_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, [320, 99999, None, -5, 321]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.decoded for r in decode(rows, PATH).collect()} == {1: "a</w> b</w>", 2: "", 3: ""}


def test_words_encode_as_the_library_encodes_them():
    import itertools

    import pyarrow as pa

    from meterlake.llm.word_tokens import break_slices, library_words

    library = Tokenizer.from_file(PATH)
    characters = [chr(c) for c in (*range(1, 0x7F), *range(0xC0, 0x100), 0x100, 0x178, 0x301, 0x3A3, 0x2028, 0x4E00, 0x1F600)]
    texts = [" ".join(a + "".join(x) for x in itertools.product(characters, repeat=1)) for a in characters]
    texts += ["".join(x) for x in itertools.product("aÉ1×'<sÿ. ", repeat=4)][::7] + ["don'T!!x'll'S'é", "ÀÉÿß12ab''re'd", "<|endoftext|>é1!", "a\u0301b"]
    for encoder in (library_words(PATH), _words(PATH)):
        for row, t in break_slices(pa.array(texts)):
            ids, off = encoder.encode(t)
            for i in range(t.n):
                assert ids[off[i] : off[i + 1]].tolist() == library.encode(texts[row + i], add_special_tokens=False).ids, repr(texts[row + i])


def test_words_of_equal_hashes_are_told_apart(spark, twins):
    library = Tokenizer.from_file(PATH)
    texts = {1: " ".join(twins), 2: twins[1], 3: twins[0]}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    for r in encode(rows, PATH).collect():
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids
