"""A run-length index over one block of texts: helpers that run inside a task.

The block's suffixes are sorted (as deep as its longest text), the Burrows-Wheeler transform is cut
into runs, and only at run ends are suffix positions sampled with the length of their match to the neighbouring
suffix.  Inside a run, a match is the next position's match less one byte, so streaming the samples with a running
maximum gives, for every position of the block, its longest match elsewhere (its matching statistic).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PACK = 7


@dataclass
class RunIndex:
    ranks: dict  # depth -> rank of the suffix by its first depth bytes, for PACK, twice PACK and so on
    n_runs: int
    sampled: np.ndarray  # positions of the sampled run ends
    to_previous: np.ndarray  # their match with the suffix before, 0 where not sampled on that side
    to_next: np.ndarray


def _rank(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(key)
    sorted_key = key[order]
    step = np.empty(len(key), np.int64)
    step[0] = 0
    np.cumsum(sorted_key[1:] != sorted_key[:-1], out=step[1:])
    rank = np.empty(len(key), np.int64)
    rank[order] = step
    return rank, order


def _match(symbols: np.ndarray, ranks: dict, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a and b."""
    n = len(symbols)
    *rest, deepest = sorted(ranks)
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    active = np.arange(len(a))
    while len(active):  # whole steps of the largest depth
        active = active[(a[active] < n) & (b[active] < n)]
        active = active[ranks[deepest][a[active]] == ranks[deepest][b[active]]]
        for x in (a, b, out):
            x[active] += deepest
    for depth in reversed(rest):
        same = (a < n) & (b < n)
        same[same] = ranks[depth][a[same]] == ranks[depth][b[same]]
        step = depth * same
        out += step
        a += step
        b += step
    open_ = np.ones(len(a), bool)
    for _ in range(PACK - 1):
        open_ &= (a < n) & (b < n)
        open_[open_] = symbols[a[open_]] == symbols[b[open_]]
        out += open_
        a += open_
        b += open_
    return out


def build(symbols: np.ndarray, longest: int, length: int = 100) -> RunIndex:
    """symbols: bytes + 1, 0 after each text; longest: bytes of the longest text; ranks are kept to depths of up to length."""
    n = len(symbols)
    padded = np.zeros(n + PACK, np.int64)
    padded[:n] = symbols
    key = np.zeros(n, np.int64)
    for i in range(PACK):
        key = (key << 9) | padded[i : n + i]
    ranks = {}
    rank, order = _rank(key)
    ranks[PACK] = rank
    depth = PACK
    while depth * 2 <= length or depth <= longest and rank[order[-1]] < n - 1:
        behind = np.full(n, -1, np.int64)
        behind[: n - depth] = rank[depth:] if n > depth else []
        rank, order = _rank(rank * (n + 1) + behind + 1)
        depth *= 2
        if depth <= length:
            ranks[depth] = rank
    bwt = np.where(order > 0, symbols[order - 1], 0)
    head = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1  # run starts but for the first
    lengths = _match(symbols, ranks, order[head], order[head - 1])
    previous, following = np.zeros(n, np.int64), np.zeros(n, np.int64)
    previous[order[head]] = lengths
    following[order[head - 1]] = lengths
    # a text start has no byte before it: sample its neighbours as well
    first = np.flatnonzero(np.concatenate([[True], symbols[:-1] == 0]))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    for side, out in ((-1, previous), (1, following)):
        near = place[first] + side
        ok = (near >= 0) & (near < n)
        out[first[ok]] = np.maximum(out[first[ok]], _match(symbols, ranks, first[ok], order[near[ok]]))
    mark = np.zeros(n, bool)
    for part in (order[head], order[head - 1], first):
        mark[part] = True
    sampled = np.flatnonzero(mark)
    return RunIndex(ranks, len(head) + 1, sampled, previous[sampled], following[sampled])


def matching_statistics(index: RunIndex, n: int) -> np.ndarray:
    """Longest match elsewhere of the suffix at each position, streamed from the sampled run ends."""
    at, out = np.arange(n), np.zeros(n, np.int64)
    for lengths in (index.to_previous, index.to_next):
        reach = np.zeros(n, np.int64)
        reach[index.sampled] = index.sampled + lengths
        out = np.maximum(out, np.maximum.accumulate(reach) - at)
    return out


def repeated(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, start) of every window of ``length`` bytes that also starts at an earlier place of the list.

    Equal texts and several places in one text both count.
    """
    if length < PACK:
        raise ValueError(f"length must be {PACK} at least")
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[begin + sizes - 1] = 0
    index = build(symbols, int(sizes.max()), length)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(symbols))
    inside = at + length <= (begin + sizes - 1)[owner]
    hit = np.flatnonzero(inside & (matching_statistics(index, len(symbols)) >= length))
    if not len(hit):
        return hit, hit
    # exact check: classes of equal windows by two overlapping ranks; all but the earliest are repeats
    depth = max(index.ranks)
    deep = index.ranks[depth]
    _, first, group = np.unique(deep[hit] * (len(symbols) + 1) + deep[hit + length - depth], return_index=True, return_inverse=True)
    late = hit[hit != hit[first][group]]
    return owner[late], late - begin[owner[late]]
