"""Words of a text in plain form, and hashes of its runs of words."""

from __future__ import annotations

import itertools

import numpy as np
import xxhash

SEED = 42

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def plain(text: bytes | None) -> bytes:
    """The words of a text with a blank between them, A-Z in lower case."""
    return b" ".join((text or b"").translate(_LOWER).split())


def shingles(whole: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the different runs of ``words`` words of ``plain`` text; of a shorter one, the hash of the whole."""
    if not whole:
        return np.zeros(0, np.uint64)
    ends = list(itertools.accumulate(len(x) + 1 for x in whole.split(b" ")))
    begins = [0, *ends[: max(0, len(ends) - words)]]
    hashed, view, last = xxhash.xxh64_intdigest, memoryview(whole), ends[words - 1 :] or ends[-1:]
    return np.unique(np.fromiter((hashed(view[a : b - 1], SEED) for a, b in zip(begins, last)), np.uint64, len(last)))
