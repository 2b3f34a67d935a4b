"""Word shingles: their hashes, SimHash fingerprints and sets."""

from __future__ import annotations

import numpy as np
import xxhash

SEED = 42


def joined_words(text: bytes) -> bytes:
    """The words (outside ASCII white space), A-Z in lower case, with one space between."""
    return b" ".join(text.lower().split())


def digests_of(joined: bytes, words: int) -> list[int]:
    """XXH64 of each shingle of ``joined_words``, in order; of all words if there are no more than ``words``, and none for no words."""
    if not joined:
        return []
    gap = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    if len(gap) + 1 <= words:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    starts = [0, *(gap[: len(gap) + 1 - words] + 1).tolist()]
    ends = [*gap[words - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[i:j], SEED) for i, j in zip(starts, ends, strict=True)]


def fingerprint_of(digests: list[int]) -> int:
    """Bits set in over half of the digests, repeats included; 0 for none."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(digests), 1 << 16):
        part = np.array(digests[i : i + (1 << 16)], "<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(digests), bitorder="little").view("<u8")[0])


def shingle_set(text: str, words: int) -> np.ndarray:
    """Hashes of the text's shingles, sorted and without repeats."""
    return np.unique(np.array(digests_of(joined_words(text.encode()), words), np.uint64))
