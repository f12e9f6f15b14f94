"""Operator 4, byte-level BPE encoding and decoding.

A pre-token's bytes are the leaves of a segment tree; a leaf holds the rank of the pair that begins there, an inner
node the least rank below it, leftmost on a tie.  The root names the next merge; a merge changes three leaves (the
pair's, its right part's, its left neighbour's), each a logarithmic point update, so a pre-token of n bytes takes
O(n log n) whatever its content.

Defined results: null is encoded as the empty text; an empty text has no tokens; special tokens' strings are ordinary
text; bytes without a rank cannot occur with a byte-level vocabulary (a missing rank raises KeyError); every other
input column is ignored; bytes that are not valid UTF-8 are encoded, and come back, as U+FFFD.  Rows stand for themselves: repeated rows give repeated results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, lean, table

#: Distinct pre-tokens whose ids a task remembers; beyond it a new memory starts, and what the one before it holds is taken
#: over as it comes up again (results do not change).
MEMO = 150_000
_NONE = 1 << 62
#: Longest pre-token, in bytes, that is merged together with others of its size; longer ones are merged one by one.
TOGETHER = 64
#: How many pre-tokens are merged together: their trees stay in a core's cache.
STEPPED = 4_000


class Bpe:
    """Ranks, pre-token pattern, and the ids of pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.vocab = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.vocab[i] = token
        compiled = regex.compile(pattern)
        self.split, self.finditer = compiled.findall, compiled.finditer
        # ids are remembered packed, four bytes each: a text's ids are one join of these
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tokens = np.array([*self.vocab, None], object)[:-1]
        self.slot_key, self.path = None, path

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        size = 1 << (n - 1).bit_length()
        bits = size - 1
        shift = size.bit_length() - 1
        part = [piece[i : i + 1] for i in range(n)]  # bytes of the live token that begins at i
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        tree = [_NONE] * (2 * size)
        get = ranks.get
        for i in range(n - 1):
            r = get(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << shift | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        while (best := tree[1]) != _NONE:
            i = best & bits
            j = after[i]
            k = after[i] = after[j]
            part[i] += part[j]
            if k < n:
                before[k] = i
                r = get(part[i] + part[k])
                mine = _NONE if r is None else r << shift | i
            else:
                mine = _NONE
            changed = [(i, mine), (j, _NONE)]
            h = before[i]
            if h >= 0:
                r = get(part[h] + part[i])
                changed.append((h, _NONE if r is None else r << shift | h))
            for at, value in changed:
                at += size
                if tree[at] == value:
                    continue
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    at >>= 1
                    value = value if value < other else other
                    if tree[at] == value:
                        break
                    tree[at] = value
        out, i = [], 0
        while i < n:
            out.append(ranks[part[i]])
            i = after[i]
        return tuple(out)

    def _pair_table(self) -> None:
        """Open-addressing table: pair of ids -> id of the joined token.  A few MB of numbers, which outlive the task."""
        if self.path in _tables:
            self.slots, self.slot_key, self.slot_value, self.byte_ids = _tables[self.path]
            return
        pairs = {}
        for token, i in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        keys, values = np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs))
        self.slots = size = 1 << max(4, (2 * len(pairs)).bit_length())
        self.slot_key, self.slot_value = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):  # all unplaced keys try their slot, the winners stay
            free = left[self.slot_key[at[left]] < 0]
            self.slot_key[at[free]] = keys[free]
            placed = self.slot_key[at[left]] == keys[left]
            self.slot_value[at[left[placed]]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & (size - 1)
        self.byte_ids = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        _tables[self.path] = self.slots, self.slot_key, self.slot_value, self.byte_ids

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - self.slots.bit_length())).astype(np.int64)

    def _joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the joined pairs, -1 where there is none."""
        key = a << 32 | b
        at = self._slot(key)
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        while len(left):
            found = self.slot_key[at[left]]
            hit = found == key[left]
            out[left[hit]] = self.slot_value[at[left[hit]]]
            left = left[~hit & (found >= 0)]
            at[left] = (at[left] + 1) & (self.slots - 1)
        return out

    def merge_together(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens of at least 2 and at most TOGETHER bytes: one segment tree each, all stepped at once."""
        if self.slot_key is None:
            self._pair_table()
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        n = len(pieces)
        shift = int(lens.max() - 1).bit_length()
        size = 1 << shift
        text = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        live = np.arange(size) < lens[:, None]
        token = self.byte_ids[text]
        after = np.minimum(np.arange(1, size + 1), lens[:, None]).ravel()
        before = np.tile(np.arange(-1, size - 1), n)
        joined = self._joined(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, size - 1)
        kind = np.int32 if len(self.vocab) <= 1 << 24 else np.int64  # a rank and a place below TOGETHER
        none = np.iinfo(kind).max
        tree = np.full((n, 2 * size), none, kind)
        tree[:, size : 2 * size - 1] = np.where((joined >= 0) & live[:, 1:], joined << shift | np.arange(size - 1), none)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        tree, token, live = tree.ravel(), token.ravel(), live.ravel()
        rows = np.arange(n)
        while True:
            best = tree[rows * 2 * size + 1]
            going = best != none
            rows, best = rows[going], best[going].astype(np.int64)
            if not len(rows):
                break
            base, root = rows * size, rows * 2 * size
            i = best & (size - 1)
            merged = best >> shift
            j = after[base + i]
            k = after[base + j]
            token[base + i] = merged
            live[base + j] = False
            after[base + i] = k
            right = k < lens[rows]
            before[base[right] + k[right]] = i[right]
            h = before[base + i]
            left = h >= 0
            tree[root + size + j] = none
            value = np.full(len(rows), none, kind)
            rank = self._joined(merged[right], token[base[right] + k[right]])
            value[right] = np.where(rank >= 0, rank << shift | i[right], none)
            tree[root + size + i] = value
            rank = self._joined(token[base[left] + h[left]], merged[left])
            tree[root[left] + size + h[left]] = np.where(rank >= 0, rank << shift | h[left], none)
            h = np.where(left, h, i)
            paths = [size + h, size + i, size + j]
            for _ in range(shift):
                for p in paths:
                    p >>= 1
                for p in paths:
                    at = root + 2 * p
                    tree[root + p] = np.minimum(tree[at], tree[at + 1])
        ids = token[live].astype(np.int32).tobytes()
        stop = (4 * np.cumsum(live.reshape(n, size).sum(1))).tolist()
        return [ids[a:b] for a, b in zip([0, *stop], stop)]

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pre-tokens, those of about one size together."""
        new = pieces.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.older, self.memo, new = self.memo, {}, pieces
        memo, older, ranks = self.memo, self.older, self.ranks
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for p in new:
            ids = older.get(p)
            if ids is not None:
                memo[p] = ids
                continue
            b = p.encode()
            whole = ranks.get(b)
            if whole is not None:
                memo[p] = pack((whole,))
            elif len(b) <= TOGETHER:
                by_size.setdefault((len(b) - 1).bit_length(), []).append((p, b))
            else:
                memo[p] = pack(self.merge(b))
        for found in by_size.values():
            for at in range(0, len(found), STEPPED):
                part = found[at : at + STEPPED]
                memo.update(zip([p for p, _ in part], self.merge_together([b for _, b in part])))

    def piece_ids(self, piece: str) -> bytes:
        ids = self.memo.get(piece)
        if ids is None:
            if len(self.memo) >= MEMO:
                self.older, self.memo = self.memo, {}
            ids = self.older.get(piece)
            ids = self.memo[piece] = pack(self.merge(piece.encode())) if ids is None else ids
        return ids

    def forget(self) -> None:
        """At a task's end: a worker that goes on to other work holds on to neither the memories nor the vocabulary's tokens."""
        self.memo.clear()
        self.older.clear()
        _loaded.clear()

    def counts(self, pieces: list[str]) -> list[int]:
        """Numbers of ids of pre-tokens."""
        memo = self.memo
        try:
            return [len(memo[p]) >> 2 for p in pieces]
        except KeyError:
            return [len(self.piece_ids(p)) >> 2 for p in pieces]

    def scan(self, text: str, start: int):
        """Matches of the pattern from a place on; what stands before it plays no part."""
        return self.finditer(text, start)

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a batch of texts, whose pre-tokens are learned together."""
        split = [self.split(t) for t in texts]
        self.learn(set().union(*split))
        ids_of = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(ids_of, pieces)), np.int32) for pieces in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_texts([text])[0].tolist()

    def decode(self, ids) -> bytes:
        return b"".join(self.tokens[np.asarray(ids, np.int64)].tolist())


def pack(ids) -> bytes:
    return np.array(ids, np.int32).tobytes()


_loaded: dict = {}
_tables: dict = {}


def bpe(path: str, pattern: str) -> Bpe:
    """One encoder per task and vocabulary."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Bpe(path, pattern)
    return _loaded[path, pattern]


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, decoded: bool = False) -> DataFrame:
    """doc_id, ids (array<int>) of every text, and if ``decoded``, decoded (binary): the bytes that the ids stand for, made in
    the same pass.  The ranks' path must exist on every executor."""
    path, pattern = (path, pattern) if path else default_vocabulary()
    names = ["doc_id", "ids", *(["decoded"] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for part, texts in blocks(batches, "text"):
            ids = coder.encode_texts([(t or b"").decode(errors="replace") for t in texts])
            stops = pa.array(np.append(0, np.cumsum([len(x) for x in ids])), pa.int32())
            back = [pa.array(map(coder.decode, ids), pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(stops, pa.array(np.concatenate(ids))), *back], names=names)
        coder.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"doc_id long, ids array<int>{', decoded binary' if decoded else ''}")


def decode(coded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The rows of coded with ids (null: no tokens) replaced by decoded (binary)."""
    path, pattern = (path, pattern) if path else default_vocabulary()
    kept = [c for c in coded.columns if c != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for whole in batches:
            for at in range(0, len(whole), 500):
                part = whole.slice(at, 500)
                lists = part.column("ids")
                flat, stops = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).tolist()
                texts = [coder.decode(flat[a:b]) for a, b in zip(stops, stops[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.binary())], names=[*kept, "decoded"])

    return coded.select(*kept, "ids").mapInArrow(lean(run), f"{schema}, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of texts encoded and decoded in one pass, by one worker a task."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
