"""Words of a text as 64-bit hashes, for operators that run over Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from loomdex.functions.text import WORD

_find = re.compile(WORD).findall
_known: dict[str, int] = {}


def words(text: str) -> list[str]:
    return _find(text.lower())


def word_hashes(found: list[str]) -> np.ndarray:
    """One uint64 for each word. The cache of a worker is emptied when it has grown to half a million words."""
    if len(_known) > 500_000:
        _known.clear()
    get, out = _known.get, []
    for w in found:
        h = get(w)
        if h is None:
            h = _known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` successive words, repeats kept; a shorter text has one run, all of its words."""
    n = min(size, len(h))
    if len(h) <= size:
        acc = np.full(1, n, dtype=np.uint64)
        for x in h:
            acc = mix(acc * _STEP + x)
        return acc
    acc = np.full(len(h) - size + 1, n, dtype=np.uint64)
    for i in range(size):
        acc = mix(acc * _STEP + h[i : len(h) - size + 1 + i])
    return acc


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after the other, and where each text's begin. Every text has one at least."""
    found = [words(t) for t in texts]
    lengths = np.array([len(f) for f in found], dtype=np.int64)
    h = word_hashes([w for f in found for w in f])
    doc = np.repeat(np.arange(len(texts)), lengths)
    ends = np.cumsum(lengths)
    places = np.flatnonzero(np.arange(len(h)) + size <= ends[doc])
    acc = np.full(len(places), size, dtype=np.uint64)
    for i in range(size):
        acc = mix(acc * _STEP + h[places + i])
    short = np.flatnonzero(lengths < size)
    few = [shingles(h[ends[i] - lengths[i] : ends[i]], size)[0] for i in short.tolist()]
    values, owner = np.concatenate([acc, np.array(few, dtype=np.uint64)]), np.concatenate([doc[places], short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts)))
