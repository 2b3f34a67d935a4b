"""Token counts under a unigram vocabulary by trie-shared dynamic programming.

A partition's texts are read in slices of bounded size; the distinct pre-tokens of a slice that the worker does not
remember go into a trie. Walking it, the best score of each prefix (over all ways to
split it into pieces of the vocabulary) is computed once, however many pre-tokens share the prefix; a terminal stores
the number of pieces of its best split. A text's count is the sum over its pre-tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.textbuf import slices

#: Stands for the white space before a pre-token.
MARK = "▁"
#: A character that no piece holds costs this much more than the worst piece, and counts as its UTF-8 bytes.
UNKNOWN_PENALTY = 10.0
#: Distinct pre-tokens that a worker remembers; with more it starts anew.
MEMO_WORDS = 500_000


class UnigramTrie:
    """Piece counts of pre-tokens under the pieces and scores of a sentencepiece file."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY

    @classmethod
    def from_file(cls, path: str) -> UnigramTrie:
        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls({m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))})

    def counts(self, words: list[str]) -> list[int]:
        """Pieces of the best split of each word; of splits that score alike, that whose last piece is longest."""
        trie: dict = {}
        for place, word in enumerate(words):
            node = trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = place
        out = [0] * len(words)
        # forward scores and counts of the prefixes on the way to the node that is walked
        score, count, prefix = [0.0], [0], []
        todo = [(trie, iter(trie.items()))]
        pieces, longest = self.pieces, self.longest
        while todo:
            _, items = todo[-1]
            for c, below in items:
                if c == "":
                    out[below] = count[-1]
                    continue
                prefix.append(c)
                n = len(prefix)
                text = "".join(prefix[-longest:])
                best, pieces_to = score[n - 1] + self.unknown, count[n - 1] + len(c.encode())
                for i in range(len(text)):
                    if (s := pieces.get(text[i:])) is not None:
                        k = n - (len(text) - i)
                        if (s + score[k]) > best or (i == len(text) - 1 and s + score[k] >= best):
                            best, pieces_to = s + score[k], count[k] + 1
                score.append(best)
                count.append(pieces_to)
                todo.append((below, iter(below.items())))
                break
            else:
                todo.pop()
                if prefix:
                    prefix.pop()
                    score.pop()
                    count.pop()
        return out


@cache
def _model(path: str) -> tuple[UnigramTrie, dict[str, int]]:
    """One for each Python worker, with the counts that it remembers."""
    return UnigramTrie.from_file(path), {}


def _counter(path: str, n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, known = _model(path)
        for batch in batches:
            for row, t in slices(batch.column(n)):
                words, place = t.distinct_words()
                new = [w for w in words if w not in known]
                if len(known) + len(new) > MEMO_WORDS:
                    known.clear()
                    new = words
                known.update(zip(new, trie.counts([MARK + w for w in new]), strict=True))
                counts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                kept = batch.slice(row, t.n).select(range(n))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(t.n_words), pa.array(t.per_word_text(counts[place]))], [*kept.schema.names, "n_pre_tokens", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns with n_pre_tokens (words outside ASCII white space) and n_tokens of the whole text.

    Null and empty texts count 0; repeated rows count alike; an empty table gives none; other columns don't matter.
    ``path`` is a sentencepiece file that every executor has, whose pieces and scores are taken as a unigram model.
    """
    inner = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).cast("string").alias("_text"))
    schema = ", ".join([*(f"_k{i} {inner.schema[i].dataType.simpleString()}" for i in range(len(keep))), "n_pre_tokens long, n_tokens long"])
    return inner.mapInArrow(_counter(path, len(keep)), schema).select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), "n_pre_tokens", "n_tokens")
