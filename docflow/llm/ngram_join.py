"""Operator 11, n-gram Jaccard join by an R-tree of count vectors.

A document's shingles are hashed into groups; how many fall into each group is a point.  Two sets share at most the sum
of the smaller of their counts, group by group, and a set shares at most that sum with any point below a box's upper
corner; so a node of the tree is left out when even its box cannot reach the similarity.  What survives is verified on
the full sets.

The top of the tree is Spark's.  Sets of x and y shingles with a similarity of at least p percent differ in at most
d = (x + y) (100 - p) / (100 + p) shingles.  For sets of one band of sizes and the next, the groups (so fine that they
hardly share shingles) are cut into d + 1 slabs; by the pigeonhole principle the points agree in all groups of a slab.
Each point is listed under its sub-vector of every slab (about a row for every five shingles), and trees are built of
those that share one.  Sub-vectors without any count say little: a point that has one is listed in a second layout of
the groups, drawn by another hash, where its partners by an empty slab are listed too, and so on; empty slabs of the
last layout are listed as they are.  So no pair over the threshold is lost.

Buckets are not expanded into pairs.  Their members meet the smallest one by their points; where the others are still
in several families (components of what may be linked) afterwards, those outside the largest probe trees of all.  So
all that may be linked is in one family, and a family's members, cut into blocks by number and bytes, meet block by
block once: a tree of one block is probed with the points of the other, and what survives is verified on full sets.  A
block emits a row a member (how many documents it is linked with) and a spanning forest of its links, never its
pairs; the forests give the components.  Small families share blocks.  Links are counted one by one, so a family's
counting costs the square of its different sets in comparisons, though not in rows.

Defined results: A-Z are lower-cased; a text with fewer than ``words`` words has its whole sequence as its one shingle;
null, empty or blank texts have no shingles and are linked with nothing; a null doc_id is linked with nothing and its
component is null; rows that repeat a doc_id count as one document, linked by any of its texts; equal sets are always
linked; other input columns are ignored, whatever their names.  Shingles are compared as 64-bit hashes of their words'
BLAKE2b digests, sets of different classes by 128 bits of these.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_signed, blocks, few, lean, stage, table
from .components import components
from .links import BLOCK, block_of, blocks_for, forest, mixed_blocks, overlaps, shingles_of
from .seeds import U64, mix
from .shingles import fingerprints, shingle_sets

#: Groups of a point, entries of a tree's node, layouts of slabs, and fine groups of a slab.
GROUPS, FANOUT, LAYOUTS, FINE = 128, 16, 4, 1 << 20
#: Components of up to so many sets share blocks.
SMALL = 64


def points(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The counts of each text's shingles by group."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    group = (hashes >> U64(20)) % U64(GROUPS)
    return np.bincount(owner * GROUPS + group.astype(np.int64), minlength=n * GROUPS).reshape(n, GROUPS).astype(np.uint32)


@lru_cache(maxsize=4)
def bands(percent: int, most: int) -> np.ndarray:
    """First sizes of the bands, up to two beyond most: a set's partners lie in its band, the one before or the next."""
    edges = [1, 2]
    while edges[-3:][0] <= most:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // percent + 1))
    return np.array([*edges, edges[-1] * 100 // percent + 1])


def slab_keys(hashes: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of every sub-vector that the texts are listed under; hashes are sorted within a text."""
    sizes = np.diff(first)
    edges = bands(percent, int(sizes.max(initial=1)))
    band = np.searchsorted(edges, sizes, side="right") - 1
    texts, keys = [], []
    for scheme in (band - 1, band):  # with the smaller band, and with the larger
        some = np.flatnonzero((sizes > 0) & (scheme >= 0))
        scheme = scheme[some]
        slabs = (edges[scheme + 1] + edges[scheme + 2] - 2) * (100 - percent) // (100 + percent) + 1
        some, scheme, slabs = some[slabs > 1], scheme[slabs > 1], slabs[slabs > 1]  # else only equal sets are similar
        for layout in range(LAYOUTS):
            if not len(some):
                break
            n = sizes[some]
            owner = np.repeat(np.arange(len(some)), n)
            x = hashes[np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(len(owner))]
            if layout:
                x = mix(x ^ U64(0xA24BAED4963EE407 * layout % (1 << 64)))
                x = x[np.lexsort((x, owner))]
            slab = ((x >> U64(32)) * slabs[owner].astype(U64)) >> U64(32)
            base = np.cumsum(slabs) - slabs
            at = base[owner] + slab.astype(np.int64)  # ascending
            sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix((x % U64(FINE)) + slab * U64(FINE) + U64(1)))])
            begin = np.flatnonzero(np.diff(at, prepend=-1))
            held = at[begin]
            total = np.zeros(int(slabs.sum()), U64)
            total[held] = sums[np.append(begin[1:], len(at))] - sums[begin]
            full = np.zeros(len(total), bool)
            full[held] = True
            of = np.repeat(np.arange(len(some)), slabs)
            name = (scheme[of].astype(U64) << U64(32)) + (np.arange(len(total)) - base[of]).astype(U64) + (U64(layout) << U64(56))
            listed = np.ones(len(total), bool) if layout == LAYOUTS - 1 else full
            texts.append(some[of[listed]])
            keys.append(mix(total[listed] ^ mix(name[listed])))
            bare = np.bincount(of[~full], minlength=len(some)) > 0
            some, scheme, slabs = some[bare], scheme[bare], slabs[bare]
    text = np.concatenate([np.zeros(0, np.int64), *texts])
    order = np.argsort(text, kind="stable")
    return text[order], np.concatenate([np.zeros(0, U64), *keys])[order]


def may_link(least: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m shingles, with at most ``least`` in common, can be similar."""
    return (100 + percent) * least >= percent * (n + m)


class CountTree:
    """An R-tree over points, packed at once: halves by the widest coordinate down to nodes of FANOUT entries."""

    def __init__(self, at: np.ndarray, n: np.ndarray, percent: int):
        self.percent, self.at, self.n = percent, at, n
        runs = [np.arange(len(at))]
        while any(len(r) > FANOUT for r in runs):
            runs = [h for r in runs for h in (self._halves(r) if len(r) > FANOUT else (r,))]
        #: From the leaves up: the entries of each node, the upper corners of their boxes, and their smallest sizes.
        self.levels = [[runs, self._corners(runs, at), self._least(runs, n)]]
        while len(self.levels[-1][0]) > FANOUT:
            _, high, low = self.levels[-1]
            runs = [np.arange(i, min(i + FANOUT, len(low))) for i in range(0, len(low), FANOUT)]
            self.levels.append([runs, self._corners(runs, high), self._least(runs, low)])

    def _halves(self, run: np.ndarray):
        part = self.at[run]
        wide = int(np.argmax(part.max(0) - part.min(0)))
        order = np.argpartition(part[:, wide], len(run) // 2)
        return run[order[: len(run) // 2]], run[order[len(run) // 2 :]]

    @staticmethod
    def _corners(runs, at):
        return np.stack([at[r].max(0) for r in runs]) if runs and len(at) else np.zeros((0, GROUPS), np.uint32)

    @staticmethod
    def _least(runs, n):
        return np.array([n[r].min() for r in runs if len(r)], np.int64)

    def probe(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probe, entry) of all whose summed minima allow the similarity."""
        if not len(self.at) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = len(self.levels[-1][0])
        left, node = np.repeat(np.arange(len(at)), top), np.tile(np.arange(top), len(at))
        for runs, high, low in reversed(self.levels):
            left, node = self._kept(at, n, left, node, high, low)
            count = np.array([len(r) for r in runs])[node]
            node = np.concatenate([np.zeros(0, np.int64), *(runs[i] for i in node)])
            left = np.repeat(left, count)
        return self._kept(at, n, left, node, self.at, self.n)

    def _kept(self, at, n, left, node, high, low):
        ok = np.zeros(len(left), bool)
        for i in range(0, len(left), 20_000):
            l, h = left[i : i + 20_000], node[i : i + 20_000]
            ok[i : i + 20_000] = may_link(np.minimum(at[l], high[h]).sum(1, dtype=np.int64), n[l], low[h], self.percent)
        return left[ok], node[ok]


def _vectors(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, GROUPS)


def _listed(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            hashes, first = shingle_sets(texts, words)
            hi, lo = fingerprints(hashes, first)
            text, keys = slab_keys(hashes, first, percent)
            ends = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(as_signed(keys)))
            vectors = pa.array([p.tobytes() for p in points(hashes, first)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(as_signed(hi)), pa.array(as_signed(lo)), vectors, lists], names=["doc_id", "n", "hi", "lo", "sig", "keys"])

    return run


def _near(percent: int):
    """Rows with two points -> the (id, low) whose summed minima allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if len(part):
                least = np.minimum(_vectors(part.column("sig")), _vectors(part.column("low_sig"))).sum(1, dtype=np.int64)
                ok = may_link(least, part.column("n").to_numpy(), part.column("low_n").to_numpy(), percent)
                yield part.select(["id", "low"]).filter(pa.array(ok))

    return run


def _candidates(percent: int):
    """A block of outside members against a block of members -> a forest (a, b) of what may be linked across families."""

    def run(group: pa.Table) -> pa.Table:
        outside, comp, n, at = group.column("outside").to_numpy(), group.column("comp").to_numpy(), group.column("n").to_numpy(), _vectors(group.column("sig"))
        left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
        a, b = CountTree(at[right], n[right], percent).probe(at[left], n[left])
        a, b = left[a], right[b]
        other = comp[a] != comp[b]
        return forest(group.column("id").to_numpy(), a[other], b[other])

    return run


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the members of both blocks; a block that meets itself is both."""
    left = group.column("left").to_numpy()
    right = np.flatnonzero(~left)
    return np.flatnonzero(left), right if len(right) else np.flatnonzero(left)


def _survivors(percent: int):
    """Two blocks of a family's members -> the members that may be linked."""

    def run(group: pa.Table) -> pa.Table:
        comp, n, at = group.column("comp").to_numpy(), group.column("n").to_numpy(), _vectors(group.column("sig"))
        left, right = _sides(group)
        a, b = CountTree(at[right], n[right], percent).probe(at[left], n[left])
        a, b = left[a], right[b]
        ok = (comp[a] == comp[b]) & (a != b)
        hit = np.zeros(len(comp), bool)
        hit[a[ok]] = hit[b[ok]] = True
        return group.select(["pack", "x", "y", "id", "comp", "docs", "left"]).filter(pa.array(hit))

    return run


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, comp: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (by place) of the two sides that are similar, of one component; equal places are none."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    size = np.array([len(s) for s in sets], np.int64)
    names = np.unique(comp)
    order = {c: (left[comp[left] == c], right[comp[right] == c]) for c in names.tolist()} if len(names) > 1 else {0: (left, right)}
    for a, b in order.values():
        if len(a) and len(b):
            common = overlaps([sets[i] for i in a], [sets[i] for i in b])
            i, j = np.nonzero(100 * common >= percent * (size[a][:, None] + size[b][None, :] - common))
            i, j = a[i], b[j]
            out_a.append(i[i != j])
            out_b.append(j[i != j])
    return np.concatenate(out_a), np.concatenate(out_b)


def _counted(percent: int):
    """Two blocks of members with full sets -> (a, null, found): how many documents a is linked with in the other block; and
    (a, b, 0): a forest of the links."""

    def run(group: pa.Table) -> pa.Table:
        docs, comp, ids = (group.column(c).to_numpy() for c in ("docs", "comp", "id"))
        sets = [np.frombuffer(x, U64) for x in group.column("shingles").to_pylist()]
        left, right = _sides(group)
        found = np.zeros(len(docs), np.int64)
        a, b = linked(sets, left, right, comp, percent)
        np.add.at(found, a, docs[b])
        if not np.array_equal(left, right):
            np.add.at(found, b, docs[a])
        some, tree = np.flatnonzero(found), forest(ids, a, b)
        none = pa.nulls(len(some), pa.int64())
        zero = pa.array(np.zeros(len(tree), np.int64))
        return pa.table({"a": pa.chunked_array([pa.array(ids[some]), *tree.column("a").chunks]), "b": pa.chunked_array([none, *tree.column("b").chunks]), "found": pa.chunked_array([pa.array(found[some]), zero])})

    return run


def families(classes: DataFrame, keys: DataFrame, percent: int) -> DataFrame:
    """node, component: everything that may be linked is in one component.  classes: id, n, sig; keys: key, id."""
    own = Window.partitionBy("key")
    met = keys.select("key", "id", F.min("id").over(own).alias("low"), F.max("id").over(own).alias("high"))
    members = stage(met.where("low < high").select("key", "id", "low"), "members")
    low_side = classes.select(F.col("id").alias("low"), F.col("n").alias("low_n"), F.col("sig").alias("low_sig"))
    stars = members.where("id <> low").select("id", "low").distinct().join(classes.select("id", "n", "sig"), "id").join(low_side, "low")
    near = stage(stars.mapInArrow(lean(_near(percent)), "id long, low long").select(F.col("id").alias("a"), F.col("low").alias("b")), "near")
    parts = classes.select("id", "n").join(components(near), F.col("id") == F.col("node"), "left")
    known = stage(parts.select("id", "n", F.coalesce("component", "id").alias("comp")), "parts")
    blocks_ = mixed_blocks(members, known, classes.select("id", "sig"))
    more = stage(blocks_.groupBy("key", "fs", "ms").applyInArrow(_candidates(percent), "a long, b long"), "more")
    return stage(components(near.unionByName(more)), "families")


def links_within(docs: DataFrame, classes: DataFrame, parts: DataFrame, percent: int, words: int) -> DataFrame:
    """Verified links within families: (a, null, found) with how many documents of other classes a class is linked, in
    parts that add up; and links (a, b, 0) that connect what is connected.  classes: id, doc_id, n, hi, lo, sig, docs."""
    sizes = parts.join(classes.select(F.col("id").alias("node"), "n"), "node").groupBy("component").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    sizes = stage(sizes, "sizes")
    small = (F.col("m") <= SMALL) & (F.col("s") * 8 <= 1_000_000)
    rest = sizes.agg(F.sum(F.when(small, F.col("m"))), F.sum(F.when(small, F.col("s")))).first()
    packs = max(1, -(-(rest[0] or 0) // (BLOCK // 2)), -(-(rest[1] or 0) * 8 // 4_000_000))
    pack = F.when(small, F.pmod(F.xxhash64("component"), F.lit(packs)) - packs).otherwise(F.col("component"))
    cuts = stage(sizes.select("component", pack.alias("pack"), F.when(small, F.lit(1)).otherwise(blocks_for(F.col("m"), F.col("s"))).alias("b")), "cuts")
    members = parts.join(cuts, "component").join(classes.select(F.col("id").alias("node"), "n", "sig", "docs"), "node").withColumn("own", block_of(F.col("node"), F.col("b")))
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    tiles = met.select("pack", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), F.col("node").alias("id"), F.col("component").alias("comp"), "n", "docs", (F.col("own") <= F.col("other")).alias("left"), "sig")
    found = stage(tiles.groupBy("pack", "x", "y").applyInArrow(_survivors(percent), "pack long, x int, y int, id long, comp long, docs long, left boolean"), "survivors")
    sets = shingles_of(docs, classes, stage(found.select("id").distinct(), "ids"), words)
    return stage(found.join(sets, "id").groupBy("pack", "x", "y").applyInArrow(_counted(percent), "a long, b long, found long"), "links")


def ngram_join(docs: DataFrame, percent: int = 90, words: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links (documents linked with this text, itself left out); one row per input row.
    Links have 100 * intersection >= percent * union."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    listed = docs.mapInArrow(lean(_listed(words, percent)), "doc_id long, n long, hi long, lo long, sig binary, keys array<long>")
    # staged, so the numbers of the rows stay as they are
    rows = stage(listed.withColumn("row", F.monotonically_increasing_id()), "listed")
    some = rows.where("n > 0 and doc_id is not null")
    heads = some.groupBy("hi", "lo", "n").agg(F.min(F.struct("doc_id", "row")).alias("head"), F.countDistinct("doc_id").alias("docs"))
    heads = stage(heads.select("hi", "lo", "n", "head.doc_id", F.col("head.row").alias("id"), "docs"), "heads")
    own = few(heads.select(F.col("id").alias("row"), "docs"))
    known = rows.join(own, "row").withColumnRenamed("row", "id")
    classes, there = known.select("id", "doc_id", "n", "hi", "lo", "sig", "docs"), docs.where("doc_id is not null")
    kin = families(classes, known.select(F.explode("keys").alias("key"), "id"), percent)
    links = links_within(there, classes, kin, percent, words)
    counts = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("found").alias("found"))
    links = links.where("b is not null").select("a", "b")
    numbered = stage(rows.select("row", "doc_id", "n", "hi", "lo").join(heads.select("id", "hi", "lo", "n", "docs", F.col("doc_id").alias("least")), ["hi", "lo", "n"], "left").select("doc_id", "n", *(F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in ("id", "docs", "least"))), "rows")
    # a doc_id with several texts connects their classes
    several = numbered.where("id is not null").groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("high")).where("b < high").select("doc_id", "b")
    same = numbered.join(stage(several, "several"), "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")
    whole = components(links.unionByName(same))
    least = heads.select(F.col("id").alias("node"), "doc_id").join(whole, "node")
    named = stage(least.join(least.groupBy("component").agg(F.min("doc_id").alias("name")), "component").select(F.col("node").alias("id"), "name"), "names")
    out = numbered.join(named, "id", "left").join(counts, "id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("name", "least", "doc_id").alias("component_id"), F.coalesce(F.col("docs") - 1 + F.coalesce("found", F.lit(0)), F.lit(0)).cast("long").alias("n_links"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
