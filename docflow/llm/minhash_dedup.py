"""Operator 8, near-duplicates by a multi-index Hamming join of b-bit minhash signatures.

A document's signature has 40 minhash components of 16 bits.  It is cut into 8 chunks of 5; two signatures that differ
in at most 15 components have, by the pigeonhole principle, a chunk with at most one difference, so indexing every
chunk under its 5 choices of a component to leave out (40 keys a document) brings every such pair into a bucket.  At a
similarity of 0.85 a pair differs in 6 components on average and in more than 15 about once in 10,000.  For
similarities from 0.80 there are 10 chunks of 4, again 40 keys, which bring every pair with at most 19 differences
together; at 0.80 a pair differs in 8 on average and in more than 19 less than once in 10,000.

Nodes are classes of equal sets, so copies are never compared.  Buckets are never expanded into pairs.  Members of a
bucket that are within the distance of its smallest one are confirmed against it on full sets, and confirmed links
make components.  Only buckets whose other members lie in several components are looked at again: the members
outside the bucket's largest component meet all members in blocks, where signatures tell which of them are near one of
another component, and these are confirmed on full sets.  So a family of near copies costs in proportion to its size,
and no pair within the distance is left unconfirmed unless its ends are already connected.

Defined results: A-Z are lower-cased; a text with fewer than ``words`` words has its whole sequence as its one shingle;
null, empty or blank texts have no shingles and are linked with nothing; equal sets are always linked, whatever their
number; a null doc_id is linked with nothing and is its own component (null, kept); rows that repeat a doc_id
count as one document, linked by any of its texts (each row with its own n_shingles); other input columns are ignored.
Shingles are compared as 64-bit hashes of their words' BLAKE2b digests, sets of different classes by 128 bits of these.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_signed, blocks, lean, stage, table
from .components import components
from .links import near_links
from .seeds import U64, mix
from .shingles import COMPONENTS, fingerprints, shingle_sets, signatures

#: Least percentage -> components a chunk, and the differences within which all pairs meet.
CUTS = {85: (5, 15), 80: (4, 19)}


def _signed(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            hashes, first = shingle_sets(texts, words)
            hi, lo = fingerprints(hashes, first)
            sigs = signatures(hashes, first)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(as_signed(hi)), pa.array(as_signed(lo)), pa.array([s.tobytes() for s in sigs], pa.binary())], names=["doc_id", "n", "hi", "lo", "sig"])

    return run


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COMPONENTS)


def _keys(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 20_000):
                part = whole.slice(at, 20_000)
                sigs, ids = matrix(part.column("sig")).astype(U64), part.column("id")
                for chunk in range(0, COMPONENTS, size):
                    for left_out in range(chunk, chunk + size):
                        key = np.zeros(len(sigs), U64)
                        for j in range(chunk, chunk + size):
                            if j != left_out:
                                key = key << U64(16) | sigs[:, j]
                        key = mix(key ^ mix(np.array([left_out + 1], U64)))
                        yield pa.RecordBatch.from_arrays([pa.array(as_signed(key)), ids], names=["key", "id"])

    return run


def close(sig: np.ndarray, n: np.ndarray, others: np.ndarray, m: np.ndarray, percent: int, distance: int) -> np.ndarray:
    """Which signatures are within the distance, of sets whose sizes allow the similarity."""
    return ((sig != others).sum(-1) <= distance) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))


def _near(percent: int, distance: int):
    """Rows with two signatures -> the (id, low) that are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            if len(part):
                n, m = part.column("n").to_numpy(), part.column("low_n").to_numpy()
                near = pa.array(close(matrix(part.column("sig")), n, matrix(part.column("low_sig")), m, percent, distance))
                yield part.select(["id", "low"]).filter(near)

    return run


def _candidates(percent: int, distance: int):
    """A block of outside members against a block of members -> those near one of another component."""

    def run(group: pa.Table) -> pa.Table:
        outside, comp, n, sig = group.column("outside").to_numpy(), group.column("comp").to_numpy(), group.column("n").to_numpy(), matrix(group.column("sig").combine_chunks())
        left, right = np.flatnonzero(outside), np.flatnonzero(~outside)
        hit = np.zeros(len(comp), bool)
        for i in left:
            near = (comp[right] != comp[i]) & close(sig[right], n[right], sig[i], n[i], percent, distance)
            if near.any():
                hit[i] = True
                hit[right[near]] = True
        return group.select(["key", "fs", "ms", "id", "comp", "n", "outside"]).filter(pa.array(hit))

    return run


def minhash_dedup(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per input row.  Links have 100 * intersection >= percent * union."""
    if not min(CUTS) <= percent <= 100:
        raise ValueError("the signature distances are set for similarities of 80 to 100 percent")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = stage(docs.mapInArrow(lean(_signed(words)), "doc_id long, n long, hi long, lo long, sig binary"), "signed")
    some = signed.where("n > 0 and doc_id is not null")
    heads = some.groupBy("hi", "lo", "n").agg(F.min(F.struct("doc_id", "sig")).alias("head"))
    # staged, so the numbers of the classes stay as they are
    classes = stage(heads.select(F.monotonically_increasing_id().alias("id"), "hi", "lo", "n", "head.doc_id", "head.sig"), "classes")
    chunk, distance = CUTS[max(p for p in CUTS if p <= percent)]
    keys = classes.select("id", "sig").mapInArrow(lean(_keys(chunk)), "key long, id long")
    links = near_links(docs.where("doc_id is not null"), classes, keys, _near(percent, distance), _candidates(percent, distance), percent, words)
    rows = stage(signed.select("doc_id", "n", "hi", "lo").join(classes.select("id", "hi", "lo", "n"), ["hi", "lo", "n"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("id")).alias("id")), "rows")
    # a doc_id with several texts links their classes
    several = rows.where("id is not null").groupBy("doc_id").agg(F.min("id").alias("b"), F.max("id").alias("high")).where("b < high").select("doc_id", "b")
    same = rows.join(stage(several, "several"), "doc_id").where("id <> b").select(F.col("id").alias("a"), "b")
    found = components(links.unionByName(same)).withColumnRenamed("node", "id")
    least = classes.select("id", "doc_id").join(found, "id")
    named = stage(least.join(least.groupBy("component").agg(F.min("doc_id").alias("name")), "component").select("id", "name"), "names")
    alone = classes.select("id", F.col("doc_id").alias("head"))
    out = rows.join(alone, "id", "left").join(named, "id", "left")
    component = F.coalesce("name", "head", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))
