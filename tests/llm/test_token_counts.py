import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer, models, pre_tokenizers

from meterlake.llm import queries
from meterlake.llm.textbuf import slices
from meterlake.llm.token_counts import MARK, UNKNOWN_PENALTY, UnigramTrie, count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(word, trie):
    """Piece count by the textbook recurrence, word by word."""
    best = [(0.0, 0)]
    for n in range(1, len(word) + 1):
        ways = [(best[n - 1][0] + trie.unknown, -len(word[n - 1].encode()) - best[n - 1][1], 0)]
        ways += [(best[k][0] + trie.pieces[word[k:n]], 0, k) for k in range(n) if word[k:n] in trie.pieces]
        top = max(w[0] for w in ways)
        known = [w for w in ways if w[0] == top and w[1] == 0]
        if known:
            k = min(w[2] for w in known)
            best.append((top, best[k][1] + 1))
        else:
            best.append((top, best[n - 1][1] + len(word[n - 1].encode())))
    return best[-1][1]


def test_counts_against_the_recurrence_and_the_library(spark, sf):
    trie = UnigramTrie.from_file(PATH)
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *trie.pieces.items()], unk_id=0))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(150).collect()}
    words = sorted({MARK + w for t in docs.values() for w in t.split()})
    got = dict(zip(words, trie.counts(words), strict=True))
    for w in words:
        assert got[w] == plain(w, trie), w
        if all(c in trie.pieces for c in w):
            assert got[w] == len(library.encode(w).ids), w
    counted = {r.doc_id: r for r in queries.op1_token_counts(spark, sf).collect()}
    assert len(counted) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for k, t in docs.items():
        assert counted[k].n_pre_tokens == len(t.split()) and counted[k].n_tokens == sum(got[MARK + w] for w in t.split())


def test_odd_rows(spark, odd_docs):
    trie = UnigramTrie.from_file(PATH)
    for r in count_tokens(odd_docs, PATH, keep=("doc_id", "text")).collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        assert r.n_pre_tokens == len(words)
        if len(r.text or "") < 5000:
            assert r.n_tokens == sum(plain(MARK + w, trie) for w in words)
    assert count_tokens(odd_docs.limit(0), PATH).count() == 0
    assert UnigramTrie({"a": -1.0, MARK: -1.0}).counts([MARK + "aé", "", MARK]) == [4, 0, 1]
    assert UNKNOWN_PENALTY > 0


def test_words_of_equal_hashes_are_told_apart(spark, twins):
    trie = UnigramTrie.from_file(PATH)
    a, b = twins
    rows = spark.createDataFrame([(1, a), (2, b), (3, f"{a} {b} {a[:-1]}x")], "doc_id long, text string")
    want = {1: plain(MARK + a, trie), 2: plain(MARK + b, trie)}
    want[3] = want[1] + want[2] + plain(MARK + a[:-1] + "x", trie)
    assert {r.doc_id: r.n_tokens for r in count_tokens(rows.coalesce(1), PATH).collect()} == want
    t = next(slices(pa.array([f"{a} {b} {a}"])))[1]
    words, place = t.distinct_words()
    assert words == [a, b] and place.tolist() == [0, 1, 0]
