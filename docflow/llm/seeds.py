"""Winnowed anchors over symbol sequences (words or bytes), vectorised per Arrow batch.

A *window* is ``length`` consecutive symbols of one document.  Among the ``length - gram + 1``
grams (``gram`` consecutive symbols) inside a window the one with the least hash, leftmost on a tie,
is the window's *anchor*.  The choice depends on the window's content alone, so equal windows have
equal anchors at equal offsets, wherever they stand.  Consecutive windows that share one anchor
occurrence form a *unit*: the anchor extended both ways as far as its windows reach.

Only helpers that run inside a task live here; the joins between documents are Spark's.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np

U64 = np.uint64
_BASE1 = 0x9E3779B97F4A7C15 | 1
#: Positions inside a block take the low bits of the packed gram key; a block never holds more symbols.
_POS_BITS = 28
_POS_MASK = U64((1 << _POS_BITS) - 1)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, U64)
    out[0] = 1
    done = 1
    step = base
    while done < n:  # doubling: the next stretch is the known one times base**done
        m = min(done, n - done)
        out[done : done + m] = out[:m] * U64(step)
        done += m
        step = step * step % (1 << 64)
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables are kept for sizes rounded up to a power of two."""
    return _powers(base, 1 << max(10, (n - 1).bit_length()))[:n]


@lru_cache(maxsize=8)
def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public constants of MurmurHash3)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Prefix:
    """Prefix polynomial of a symbol array: hashes of any ranges in one vectorised step.

    Modulo 2**64 such hashes collide on made-up long inputs (Thue-Morse words), so they only route: equality is
    decided by digests or by the bytes.
    """

    def __init__(self, symbols: np.ndarray, base: int):
        self.base = base
        self.sums = np.zeros(len(symbols) + 1, U64)
        np.cumsum(symbols * powers(base, len(symbols)), out=self.sums[1:]) if len(symbols) else None

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = powers(inverse(self.base), len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * back[start])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all ranges of k symbols."""
        n = len(self.sums) - k
        if n <= 0:
            return np.empty(0, U64)
        out = self.sums[k:] - self.sums[:n]
        out *= powers(inverse(self.base), len(self.sums))[:n]
        return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values, by doubling spans."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(out) - (w - span)], out[w - span :])
    return out


@lru_cache(maxsize=1)
def _byte_symbols() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _byte_symbols()[data]


#: Word hashes a task remembers, of words up to so many bytes; beyond it the memory starts anew.
MEMO, MEMO_BYTES = 100_000, 64


class _WordHashes(dict):
    """Word -> the first 64 bits of its BLAKE2b digest: no two words of any making are known to share it."""

    def __missing__(self, word: bytes) -> int:
        found = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = found
        return found


_word_hashes = _WordHashes()


def forget() -> None:
    """Drop what the helpers of this module remember."""
    _word_hashes.clear()
    _powers.cache_clear()


@dataclass
class Words:
    """Words of a batch of texts: themselves, hashes, places in the joined bytes, and the first word of each text."""

    data: np.ndarray
    words: list[bytes]
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # len(texts) + 1


def words_of(texts: list[bytes], table: bytes | None = None, lower: bool = False) -> Words:
    """Runs of bytes other than ASCII white space; table (256 bytes) is applied first, lower changes A-Z."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=at[1:])
    whole = b" ".join(texts) + b" " if texts else b""
    whole = whole.translate(table) if table else whole
    whole = whole.lower() if lower else whole
    words = whole.split()
    data = np.frombuffer(whole, np.uint8)
    gap = (data == 0x20) | ((data - np.uint8(9)) < 5)
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    hashes = np.fromiter(map(_word_hashes.__getitem__, words), U64, len(words))
    return Words(data, words, hashes, start, end, np.searchsorted(start, at))


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    """128-bit BLAKE2b digests of ranges: the keys by which sequences count as equal."""
    view = memoryview(data)
    return [blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist())]


@dataclass
class Units:
    doc: np.ndarray  # index of the text in the batch
    start: np.ndarray  # first symbol of the first window, within the text
    count: np.ndarray  # windows that share the anchor
    lead: np.ndarray  # symbols between the first window's start and the anchor
    anchor: np.ndarray  # hash of the anchor gram
    begin: np.ndarray  # first symbol within the batch


def units_of(symbols: np.ndarray, first: np.ndarray, length: int, gram: int) -> Units:
    """Units of every text; text i owns symbols first[i]:first[i + 1] (gaps between texts are not allowed)."""
    w = length - gram + 1
    n = len(symbols)
    empty = np.empty(0, np.int64)
    if n < length:
        return Units(empty, empty, empty, empty, empty.view(U64), empty)
    if n > int(_POS_MASK):
        raise ValueError("a batch of texts holds too many symbols; lower the batch size")
    grams = Prefix(symbols, _BASE1).grams(gram)
    key = (grams & ~_POS_MASK) | np.arange(len(grams), dtype=U64)
    anchor_at = (sliding_min(key, w) & _POS_MASK).astype(np.int64)  # of the window that starts at each symbol
    starts = np.arange(len(anchor_at))
    sizes = np.diff(first)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    inside = starts + length <= first[1:][doc[: len(starts)]]
    change = np.ones(len(starts), bool)
    change[1:] = (anchor_at[1:] != anchor_at[:-1]) | (doc[1 : len(starts)] != doc[: len(starts) - 1])
    head = np.flatnonzero(change & inside)
    if not len(head):
        return Units(empty, empty, empty, empty, empty.view(U64), empty)
    # windows of a unit: up to the next change, or up to the last window inside the text
    nxt = np.append(np.flatnonzero(change), len(starts))
    stop = nxt[np.searchsorted(nxt, head, side="right")]
    last = first[1:][doc[head]] - length + 1
    stop = np.minimum(stop, last)
    return Units(doc[head], head - first[doc[head]], stop - head, anchor_at[head] - head, grams[anchor_at[head]], head)
