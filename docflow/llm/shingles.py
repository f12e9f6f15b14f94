"""Word shingles of a batch of texts, and their minhash signatures (helpers that run inside a task)."""

from __future__ import annotations

import numpy as np

from .seeds import U64, Prefix, mix, words_of

_SHINGLE_BASE = 0x8EBC6AF09C88C6E3
COMPONENTS = 40


def shingle_sets(texts: list, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles: hashes sorted within each text, and each text's first place (len(texts) + 1).

    Words are runs without ASCII white space, A-Z lower-cased; a text with fewer words has its whole sequence.
    """
    w = words_of([t or b"" for t in texts], lower=True)
    prefix = Prefix(w.hashes, _SHINGLE_BASE)
    sizes = np.diff(w.first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    start = np.arange(len(w.hashes))
    full = start + words <= w.first[1:][owner]
    short = (start == w.first[:-1][owner]) & ~full
    start, owner = start[full | short], owner[full | short]
    end = np.minimum(start + words, w.first[1:][owner])
    hashes = mix(prefix.ranges(start, end) + (end - start).astype(U64))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(sizes) + 1))


def _seeds() -> np.ndarray:
    return mix(np.arange(1, 2 * COMPONENTS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)).reshape(2, -1)


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minhash signatures, 16 bits a component, of the texts that have shingles (others: zeros)."""
    out = np.zeros((len(first) - 1, COMPONENTS), np.uint16)
    some = np.flatnonzero(np.diff(first))
    if not len(some):
        return out
    at = first[some]
    for j, (c, a) in enumerate(_seeds().T):
        x = (hashes ^ c) * (a | U64(1))
        x ^= x >> U64(32)
        x *= U64(0xD6E8FEB86659FD93)
        low = np.minimum.reduceat(x, at)
        out[some, j] = mix(low).astype(np.uint16)
    return out


def fingerprints(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, the same for equal sets."""
    out = []
    for c in (0x1D8E4E27C47D124F, 0xEB44ACCAB455D165):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(hashes ^ U64(c)))])
        out.append(total[first[1:]] - total[first[:-1]])
    return out[0], out[1]
