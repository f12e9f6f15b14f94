"""Confirmed links of a similarity join whose candidates meet in buckets; shared by the joins on shingle sets.

Nodes are classes of equal sets.  Buckets are never expanded into pairs: members are confirmed against the smallest of
their bucket first, and only buckets whose other members lie in several components are looked at again, in blocks that
are bounded by members and by the bytes of their sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_signed, blocks, few, lean, reduced, stage
from .components import components
from .seeds import U64
from .shingles import fingerprints, shingle_sets

#: Documents that one task compares with as many others, and the bytes of their shingle sets (a larger set is alone).
BLOCK, BLOCK_SET_BYTES = 512, 8_000_000


def blocks_for(members: Column, shingles: Column) -> Column:
    """How many blocks so many members with so many shingles (8 bytes each) make."""
    return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles * 8 / BLOCK_SET_BYTES), F.lit(1)).cast("int")


def block_of(key: Column, n: Column) -> Column:
    """The block of n that a key is dealt to."""
    return (F.pmod(F.xxhash64(key), F.lit(1 << 30)) % n).cast("int")


def agree(percent: int):
    """Rows with two shingle sets -> the links (a, b) that are confirmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(part.column("shingles"), part.column("low_shingles")):
                x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("low")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def forest(ids: np.ndarray, a: list, b: list) -> pa.Table:
    """Spanning links (a, b) of the pairs given by place."""
    top = {}

    def find(x):
        while top.get(x, x) != x:
            top[x] = x = top.get(top[x], top[x])
        return x

    out_a, out_b = [], []
    for x, y in zip(ids[a].tolist(), ids[b].tolist()):
        p, q = find(x), find(y)
        if p != q:
            top[max(p, q)] = min(p, q)
            out_a.append(x)
            out_b.append(y)
    return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def overlaps(sets_a: list[np.ndarray], sets_b: list[np.ndarray], most_cells: int = 1 << 22) -> np.ndarray:
    """Sizes of the intersections of each set of one list with each of the other."""
    out = np.zeros((len(sets_a), len(sets_b)), np.int64)
    flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
    row_a = np.repeat(np.arange(len(sets_a)), [len(s) for s in sets_a])
    row_b = np.repeat(np.arange(len(sets_b)), [len(s) for s in sets_b])
    known, at = np.unique(flat_a, return_inverse=True)
    place = np.searchsorted(known, flat_b)
    place[place == len(known)] = 0
    ok = known[place] == flat_b
    flat, both = np.unique(place[ok], return_inverse=True)  # shingles in both lists
    col_a = np.searchsorted(flat, at)
    col_a[col_a == len(flat)] = 0
    ok_a = flat[col_a] == at if len(flat) else np.zeros(len(at), bool)
    row_a, col_a, row_b, col_b = row_a[ok_a], col_a[ok_a], row_b[ok], both
    step = max(1, most_cells // max(len(sets_a), len(sets_b)))
    for begin in range(0, len(flat), step):
        width = min(step, len(flat) - begin)
        m, n = np.zeros((len(sets_a), width), np.float32), np.zeros((len(sets_b), width), np.float32)
        i = (col_a >= begin) & (col_a < begin + width)
        m[row_a[i], col_a[i] - begin] = 1
        j = (col_b >= begin) & (col_b < begin + width)
        n[row_b[j], col_b[j] - begin] = 1
        out += (m @ n.T).astype(np.int64)
    return out


def confirmed(percent: int):
    """Candidates of two blocks with full sets -> a forest of the confirmed links between components."""

    def run(group: pa.Table) -> pa.Table:
        ids, comp, outside = (group.column(c).to_numpy() for c in ("id", "comp", "outside"))
        sets = [np.frombuffer(x, U64) for x in group.column("shingles").to_pylist()]
        left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
        if not len(left) or not len(right):
            return forest(ids, [], [])
        common = overlaps([sets[i] for i in left], [sets[i] for i in right])
        size = np.array([len(s) for s in sets])
        union = size[left][:, None] + size[right][None, :] - common
        a, b = np.nonzero((100 * common >= percent * union) & (comp[left][:, None] != comp[right][None, :]))
        return forest(ids, left[a], right[b])

    return run


def sets_of(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            hashes, first = shingle_sets(texts, words)
            hi, lo = fingerprints(hashes, first)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(as_signed(hi)), pa.array(as_signed(lo)), pa.array([hashes[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["doc_id", "hi", "lo", "shingles"])

    return run


def shingles_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, shingles (packed) of the wanted classes, each from one text of its smallest doc_id."""
    heads = stage(classes.join(few(wanted), "id", "left_semi").select("id", "doc_id", "hi", "lo"), "wanted")
    texts = reduced(docs, heads.select("doc_id").distinct(), "doc_id")
    sets = texts.mapInArrow(lean(sets_of(words)), "doc_id long, hi long, lo long, shingles binary")
    found = stage(sets.join(few(heads), ["doc_id", "hi", "lo"]).select("id", "shingles"), "sets")
    return stage(found.dropDuplicates(["id"]), "sets") if found.count() > heads.count() else found  # repeated rows


def mixed_blocks(members: DataFrame, known: DataFrame, signed: DataFrame) -> DataFrame:
    """key, fs, ms, id, comp, n, sig, outside: of buckets whose members other than the smallest (it has met them all) are in
    several components, those outside the largest beside all, in blocks.

    members: key, id, low; known: id, n, comp (each class's component so far); signed: id, sig.
    """
    placed = stage(members.where("id <> low").join(known, "id").select("key", "id", "n", "comp"), "placed")
    met = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"), *(F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(20,0)")).alias(f"mark{i}") for i in (0, 1)))
    mixed = met.groupBy("key").agg(F.sum("c").alias("m"), F.sum("s").alias("all"), F.max(F.struct("c", "comp", "s")).alias("most"), F.count("*").alias("k"), F.sum("mark0").alias("mark0"), F.sum("mark1").alias("mark1")).where("k > 1")
    # buckets with the same members are one
    once = mixed.groupBy("m", "all", "mark0", "mark1", "most").agg(F.min("key").alias("key"))
    outer_blocks = blocks_for(F.col("m") - F.col("most.c"), F.col("all") - F.col("most.s"))
    cuts = stage(once.select("key", F.col("most.comp").alias("main"), outer_blocks.alias("fb"), blocks_for(F.col("m"), F.col("all")).alias("mb")), "cuts")
    rows = placed.join(cuts, "key").join(signed, "id")
    column = ["key", "id", "comp", "n", "sig"]
    outer = rows.where("comp <> main").select(*column, block_of(F.col("id"), F.col("fb")).alias("fs"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("ms"), F.lit(True).alias("outside"))
    every = rows.select(*column, F.explode(F.sequence(F.lit(0), F.col("fb") - 1)).alias("fs"), block_of(F.col("id"), F.col("mb")).alias("ms"), F.lit(False).alias("outside"))
    return outer.unionByName(every)


def near_links(docs: DataFrame, classes: DataFrame, keys: DataFrame, near: Callable, candidates: Callable, percent: int, words: int) -> DataFrame:
    """Confirmed links (a, b) that connect what is connected.

    classes: id, doc_id, n, hi, lo, sig; keys: key, id (a class's buckets).  near (for mapInArrow) leaves of rows with two
    signatures (id, n, sig, low, low_n, low_sig) the (id, low) that may be linked; candidates (for applyInArrow) leaves of
    two blocks of a bucket, outside members and all, those that may be linked with one of another component.
    """
    signed = classes.select("id", "n", "sig")
    lows = stage(keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key", "low"), "buckets")
    members = stage(keys.join(lows, "key"), "members")
    low_side = signed.select(F.col("id").alias("low"), F.col("n").alias("low_n"), F.col("sig").alias("low_sig"))
    stars = members.where("id <> low").select("id", "low").distinct()
    close = stage(stars.join(signed, "id").join(low_side, "low").mapInArrow(lean(near), "id long, low long"), "near")
    sets = shingles_of(docs, classes, stage(close.select("id").unionByName(close.select(F.col("low").alias("id"))).distinct(), "ids"), words)
    low_sets = reduced(sets, close.select(F.col("low").alias("id")).distinct(), "id").withColumnsRenamed({"id": "low", "shingles": "low_shingles"})
    links = stage(close.join(sets, "id").join(low_sets, "low").mapInArrow(lean(agree(percent)), "a long, b long"), "stars")
    parts = classes.select("id", "n").join(components(links), F.col("id") == F.col("node"), "left")
    known = stage(parts.select("id", "n", F.coalesce("component", "id").alias("comp")), "parts")
    rows = mixed_blocks(members, known, signed.select("id", "sig"))
    found = rows.groupBy("key", "fs", "ms").applyInArrow(candidates, "key long, fs int, ms int, id long, comp long, n long, outside boolean")
    found = stage(found, "candidates")
    more = shingles_of(docs, classes, stage(found.select("id").distinct(), "ids"), words)
    cross = found.join(more, "id").groupBy("key", "fs", "ms").applyInArrow(confirmed(percent), "a long, b long")
    return links.unionByName(stage(cross, "cross"))
