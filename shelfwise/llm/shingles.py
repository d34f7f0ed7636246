"""Sets of hashed word shingles of texts; helpers for tasks."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

_A, _B, _C = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str], width: int = 3) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles of ``width`` words.

    A-Z count as a-z and words are runs without ASCII white space.  Fewer words than ``width`` make one
    shingle, none make an empty set.
    """
    split = [t.encode("utf-8", "replace").lower().split() for t in texts]  # bytes: only A-Z become lower case
    sizes = [len(w) for w in split]
    if not sum(sizes):
        return [np.empty(0, dtype=np.uint64) for _ in texts]
    codes, distinct = pd.factorize(np.array([w for words in split for w in words], dtype=object))
    hashes = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)[codes]
    rolled = np.zeros(len(hashes), dtype=np.uint64)
    m = len(hashes) - width + 1
    if m > 0:
        value = _mixed(hashes[:m] * _A)
        for k in range(1, width):
            value = _mixed(value + hashes[k : k + m] * (_B if k % 2 else _C))
        rolled[:m] = value
    out, at = [], 0
    for n in sizes:
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:
            word = hashes[at : at + n]
            value = _mixed(word[:1] * _B + np.uint64(n))
            for k in range(1, n):
                value = _mixed(value + word[k : k + 1] * _C)
            out.append(value)
        else:
            out.append(np.empty(0, dtype=np.uint64))
        at += n
    return out


def set_key(shingles: np.ndarray) -> int:
    """64-bit key of a set: equal sets have equal keys."""
    return int.from_bytes(hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=8).digest(), "little", signed=True)
