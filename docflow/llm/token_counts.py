"""Operator 7, edit-aware token counts.

A document keeps a segment tree over its pre-tokens; a node holds the characters and the tokens below it.  An edit
(start, stop, text; in characters of the text as it then is) looks up the pre-tokens it touches by the tree's character
sums, re-splits and re-encodes from the last pre-token whose match the edit cannot have seen until the new splits
meet the old ones again, and updates the sums on the paths above the changed leaves.  A leaf whose pre-tokens were
replaced holds several; emptied leaves stay with sums of 0.

Defined results: a null text is empty; a null or empty list of edits changes nothing; null fields of an edit are 0, 0 and
''; bytes that are not valid UTF-8 count, and come back, as U+FFFD; positions beyond the text are cut to it, and a stop before its start is the start; edits apply in the list's order.
Of a kept tree only the leaves are stored; a null one, or one whose characters are not as many as the text's, is built
anew from the text.  That a pre-token ending two characters before an edit has not seen it holds for the default
pattern, which looks one character ahead; another pattern must look no further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Bpe, bpe, default_vocabulary
from .common import blocks, lean, stage, table

EDITS = "array<struct<start:int,stop:int,text:string>>"
TREE = "array<struct<chars:int,tokens:int>>"


class CountTree:
    def __init__(self, coder: Bpe, text: str, pieces: list[str] | None = None, kept: np.ndarray | None = None):
        """A tree over the text's pre-tokens, or over kept ones (rows of characters and tokens), which are not encoded."""
        self.coder, self.text = coder, text
        if kept is None:
            pieces = coder.split(text) if pieces is None else pieces
            kept = np.array([list(map(len, pieces)), coder.counts(pieces)], np.int64).T
        n = len(kept)
        self.n_leaves = max(1, n)
        self.size = size = 1 << (self.n_leaves - 1).bit_length()
        #: Characters and tokens below each node; node 1 is the root, leaf i is node size + i.
        self.sums = sums = np.zeros((2 * size, 2), np.int64)
        sums[size : size + n] = kept
        level = size
        while level > 1:  # each level at once
            sums[level // 2 : level] = sums[level : 2 * level : 2] + sums[level + 1 : 2 * level : 2]
            level //= 2
        #: Pre-tokens (characters, tokens) of the leaves that edits have changed; any other leaf holds one.
        self.edited: dict[int, list[tuple[int, int]]] = {} if n else {0: []}
        self.reencoded = 0

    def leaf(self, i: int) -> list[tuple[int, int]]:
        found = self.edited.get(i)
        return [tuple(self.sums[self.size + i].tolist())] if found is None else found

    def leaves(self) -> np.ndarray:
        """Characters and tokens of every pre-token, in order: what another tree can be built from."""
        parts, at = [np.zeros((0, 2), np.int64)], self.size
        for i in sorted(self.edited):
            parts += [self.sums[at : self.size + i], np.array(self.edited[i], np.int64).reshape(-1, 2)]
            at = self.size + i + 1
        return np.concatenate([*parts, self.sums[at : self.size + self.n_leaves]])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at ``position`` (or the last one), and the leaf's first character."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if position >= before + self.sums[node, 0] and self.sums[node + 1, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.size, before

    def _set(self, leaf: int, pieces: list[tuple[int, int]]) -> None:
        self.edited[leaf] = pieces
        node = leaf + self.size
        chars, tokens = self.sums[node].tolist()
        change = sum(p[0] for p in pieces) - chars, sum(p[1] for p in pieces) - tokens
        if any(change):
            path = []
            while node:
                path.append(node)
                node //= 2
            self.sums[path] += change

    def edit(self, start: int, stop: int, new: str) -> None:
        text = self.text
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        self.text = text[:start] + new + text[stop:]
        shift = len(new) - (stop - start)
        # a pre-token that ends two characters before the edit has not looked at it
        leaf, at = self._leaf_at(max(0, start - 2))
        begin = at
        first = leaf
        kept: list[tuple[int, int]] = []
        for piece in self.leaf(leaf):
            if begin + piece[0] + 1 >= start:
                break
            kept.append(piece)
            begin += piece[0]
        # old boundaries from the edit's end on, leaf by leaf, until the new splits meet one
        fresh: list[tuple[int, int]] = []
        old_leaf, old_at, old_piece = first, begin, len(kept)
        position = begin
        scan = self.coder.scan(self.text, begin)
        while True:
            if position >= start + len(new):
                while old_leaf < self.n_leaves and old_at + shift < position:
                    held = self.leaf(old_leaf)
                    if old_piece < len(held):
                        old_at += held[old_piece][0]
                        old_piece += 1
                    else:
                        old_leaf, old_piece = old_leaf + 1, 0
                if old_at + shift == position and old_at >= stop:
                    break
            match = next(scan, None)
            if match is None:
                old_leaf, old_piece = self.n_leaves, 0
                break
            piece = match.group()
            fresh.append((len(piece), len(self.coder.piece_ids(piece)) // 4))
            position += len(piece)
        self.reencoded += len(fresh)
        rest = self.leaf(old_leaf)[old_piece:] if old_leaf < self.n_leaves else []
        if old_leaf == first:
            self._set(first, kept + fresh + rest)
            return
        self._set(first, kept + fresh)
        for leaf in range(first + 1, min(old_leaf, self.n_leaves)):
            self._set(leaf, [])
        if old_leaf < self.n_leaves:
            self._set(old_leaf, rest)


def kept_leaves(column: pa.ListArray, texts: list[str]) -> list[np.ndarray | None]:
    """The leaves of each row's kept tree; None where there is none, or none of this text."""
    flat = column.flatten()
    values = np.stack([flat.field(k).fill_null(0).to_numpy() for k in ("chars", "tokens")], axis=1).astype(np.int64)
    ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False))
    rows = [values[b - n : b] for b, n in zip(ends, np.diff(ends, prepend=0))]
    return [r if ok and r[:, 0].sum() == len(t) else None for r, ok, t in zip(rows, column.is_valid().to_pylist(), texts)]


def leaf_column(trees: list[CountTree]) -> pa.ListArray:
    found = [t.leaves() for t in trees]
    offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
    chars, tokens = np.concatenate([np.zeros((0, 2), np.int64), *found]).astype(np.int32).T
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(chars), pa.array(tokens)], names=["chars", "tokens"]))


def edit_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None, kept: str | None = None, keep: bool = False) -> DataFrame:
    """(doc_id, text, edits) -> doc_id, n_edits, n_pretokens, tokens_before, tokens_after, n_reencoded, text (edited), and
    if ``keep``, tree: its leaves after the edits.

    kept: a column of docs that holds the trees of an earlier call over the same texts; their texts are neither split
    nor encoded but around the edits.
    """
    path, pattern = (path, pattern) if path else default_vocabulary()
    names = ["n_edits", "n_pretokens", "tokens_before", "tokens_after", "n_reencoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path, pattern)
        for part, texts in blocks(batches, "text"):
            rows, edited = [], []
            decoded = [(t or b"").decode(errors="replace") for t in texts]
            held = kept_leaves(part.column("tree"), decoded) if kept else [None] * len(decoded)
            split = [coder.split(t) if h is None else [] for t, h in zip(decoded, held)]
            coder.learn(set().union(*split))
            trees = []
            for t, pieces, leaves, edits in zip(decoded, split, held, part.column("edits").to_pylist()):
                tree = CountTree(coder, t, pieces, leaves)
                before, n_pieces = tree.tokens, len(pieces if leaves is None else leaves)
                for e in edits or []:
                    if e is not None:
                        tree.edit(e["start"] or 0, e["stop"] or 0, e["text"] or "")
                rows.append((len(edits or []), n_pieces, before, tree.tokens, tree.reencoded))
                edited.append(tree.text)
                if keep:
                    trees.append(tree)
            columns = [part.column("doc_id"), *(pa.array(c, pa.int64()) for c in zip(*rows)), pa.array(edited, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, leaf_column(trees)] if keep else columns, names=["doc_id", *names, "text", *(["tree"] if keep else [])])
        coder.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "edits", *([F.col(f"`{kept}`").cast(TREE).alias("tree")] if kept else []))
    return rows.mapInArrow(lean(run), f"doc_id long, {', '.join(f'{n} long' for n in names)}, text string{f', tree {TREE}' if keep else ''}")


def token_recounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of edits: the second takes the trees that the first has kept, so its texts are neither split nor encoded
    but around the edit."""
    docs = table(spark, sf_dir, "documents")
    middle = (F.char_length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    edit = lambda at, length, text: F.struct(at.alias("start"), (at + length).alias("stop"), F.lit(text).alias("text"))
    first = stage(edit_counts(docs.withColumn("edits", F.array(edit(F.lit(0), 5, "A new beginning. "), edit(middle, 0, " (seen) "))), keep=True), "kept-trees")
    again = first.withColumn("edits", F.array(edit((F.char_length("text") / 3).cast("int"), 12, "'ll be 42 ")))
    out = edit_counts(again, kept="tree")
    return out.select("doc_id", "n_pretokens", "tokens_before", "tokens_after", "n_reencoded", F.sha2("text", 256).alias("text_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document: a cut of up to 20 characters, an insertion, and a replacement, at places fixed by its text."""
    docs = table(spark, sf_dir, "documents")
    place = lambda seed: F.pmod(F.crc32(F.concat(F.lit(seed), F.coalesce(F.substring("text", 1, 64), F.lit(""))).cast("binary")), F.greatest(F.char_length(F.coalesce("text", F.lit(""))), F.lit(1))).cast("int")
    edit = lambda at, length, text: F.struct(at.alias("start"), (at + length).alias("stop"), F.lit(text).alias("text"))
    edits = F.array(edit(place("cut"), 20, ""), edit(place("add"), 0, " inserted, it's 2026\n"), edit(place("swap"), 10, "  new words "))
    out = edit_counts(docs.withColumn("edits", edits))
    return out.select("doc_id", "n_edits", "n_pretokens", "tokens_before", "tokens_after", "n_reencoded", F.sha2("text", 256).alias("text_sha256"))
