"""Anchors: a choice of places in a text by which any two equal strings of a given length find each other.

Each window of ``window`` bytes has an anchor, that of its ``gram``-byte strings whose hash is least, the leftmost of equals. It
follows from the window's bytes alone, so that equal windows have their anchors at the same offset, whatever stands around them.
"""

from __future__ import annotations

import numpy as np

from meterlake.llm.textbuf import Texts, range_hashes

GRAM = 32


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values: of the end of one block and the beginning of the next."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(texts: Texts, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, place, first, last) of each anchor: the windows that start from ``first`` to ``last`` have it. Places are in ``texts.buf``.

    Texts shorter than a window have none. The hash only says which anchors to compare.
    """
    n = len(texts.buf)
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    at = np.arange(n - gram + 1)
    hashes = range_hashes(texts.buf, at, at + gram)
    low = np.uint64(0xFFFFFFFF)
    keys = (hashes & ~low) | at.astype(np.uint64)
    place = (_least(keys, window - gram + 1) & low).astype(np.int64)
    lengths = np.diff(texts.off)
    inside = np.zeros(n + 1, np.int64)
    long = lengths >= window
    np.add.at(inside, texts.off[:-1][long], 1)
    np.add.at(inside, texts.off[1:][long] - window + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside)[: len(place)] > 0)
    if not len(starts):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    found, doc = place[starts], np.searchsorted(texts.off, starts, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])]))
    last = starts[np.append(new[1:], len(starts)) - 1]
    return doc[new], hashes[found[new]], found[new], starts[new], last
