"""Operator 2, language-model scoring by cross-entropy difference.

A target and a background corpus are counted in full: every word, every context and every bigram keeps its exact
count, so the models grow with the corpora.  Both have the same form, bigrams interpolated with add-one unigrams over
the words of both corpora together and one unknown word.  A text's score is the mean over its tokens of the target
loss less the background loss; lower is closer to the target.

No model is gathered anywhere.  Texts are packed into blocks; a block sends its distinct keys with its counts, packed,
to the bucket of each key.  A bucket adds up what all blocks sent and answers every block to be scored with the counts
of its keys.  A key crosses once per block, so a frequent one is no hot spot; buckets grow in number with the input.

Defined results: words are runs without ASCII white space, A-Z lower-cased; null and empty texts have 0 tokens and
null losses; words are bytes, valid UTF-8 or not; empty corpora leave uniform models; equal texts get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, blocks, dropped_shuffles, lean, stage, table
from .seeds import U64, mix, words_of

#: Bytes of text whose keys are sent together (a longer single text is its own block).
PACK_BYTES = 6_000_000
TARGET, BACKGROUND, NEITHER = 0, 1, 2
_WORD, _CONTEXT, _BIGRAM, _BEGIN = (U64(c) for c in (0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165))
_BLOCKS = "block long, doc_ids array<long>, sizes array<int>, data binary"
_COUNTS = "block long, bucket int, near binary, far binary, words long, near_total long, far_total long"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of doc_id and text -> one row for each block of texts."""
    ids, held, size, n = [], [], 0, 0

    def row():
        data = pa.compress(b"".join(held), "zstd", asbytes=True)
        block = TaskContext.get().partitionId() << 32 | n
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[len(t) for t in held]], pa.list_(pa.int32())), pa.array([data], pa.binary())], names=["block", "doc_ids", "sizes", "data"])

    for part, texts in blocks(batches, "text"):
        ids += part.column("doc_id").to_pylist()
        held += [t or b"" for t in texts]
        size += sum(len(t or b"") for t in texts)
        if size >= PACK_BYTES or len(ids) >= 1_000_000:
            yield row()
            ids, held, size, n = [], [], 0, n + 1
    if ids:
        yield row()


def _keys(sizes: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a block; the place in them of each token's word, context and bigram (3 rows); tokens a text.

    Keys of words are odd, the others even.
    """
    ends = np.cumsum(sizes)
    raw = memoryview(pa.decompress(data, int(ends[-1]), "zstd", asbytes=True) if ends[-1] else b"")
    words, before, many, at = [], [], [], 0
    while at < len(sizes):
        begin = int(ends[at] - sizes[at])
        stop = max(at + 1, int(np.searchsorted(ends, begin + BLOCK_BYTES, side="right")))
        w = words_of([bytes(raw[e - s : e]) for s, e in zip(sizes[at:stop].tolist(), ends[at:stop].tolist())], lower=True)
        n = np.diff(w.first)
        prev = np.empty_like(w.hashes)
        prev[1:] = w.hashes[:-1]
        prev[w.first[:-1][n > 0]] = _BEGIN
        words.append(w.hashes)
        before.append(prev)
        many.append(n)
        at = stop
    word, prev = np.concatenate(words), np.concatenate(before)
    every = np.concatenate([mix(word ^ _WORD) | U64(1), mix(prev ^ _CONTEXT) & ~U64(1), mix(mix(prev ^ _BIGRAM) + word) & ~U64(1)])
    keys, place = np.unique(every, return_inverse=True)
    return keys, place.reshape(3, -1), np.concatenate(many)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Each bucket's first place in sorted keys (buckets + 1)."""
    return np.searchsorted((keys >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1, dtype=U64))


def _pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers, some at least: their width, how many they are, and one byte plane after the other, compressed: the
    planes of high bytes are nearly empty."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T)
    return bytes([len(planes)]) + len(numbers).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpack(packed: bytes) -> np.ndarray:
    width, n = packed[0], int.from_bytes(packed[1:5], "little")
    planes = np.frombuffer(pa.decompress(memoryview(packed)[5:], width * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(f"u{width}")[:, 0]


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, whose leading zeros cost nothing."""
    return _pack(np.diff(keys, prepend=U64(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=U64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold the largest; most are small, so that most of these bytes are zeros."""
    return _pack(counts.astype(np.min_scalar_type(int(counts.max()))))


def _unpack_counts(packed: bytes) -> np.ndarray:
    return _unpack(packed).astype(np.int64)


def _sent(source: int, answered: bool, buckets: int):
    """Blocks -> their keys and counts, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys, place, _ = _keys(batch.column("sizes")[i].values.to_numpy(), batch.column("data")[i].as_py())
                counts = np.bincount(place.ravel(), minlength=len(keys))
                edges = _edges(keys, buckets)
                some = np.flatnonzero(np.diff(edges))
                cut = [(edges[b], edges[b + 1]) for b in some]
                block = batch.column("block")[i].as_py() if answered else None
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([source] * len(some), pa.int32()), pa.array([_pack_keys(keys[a:b]) for a, b in cut], pa.binary()), pa.array([_pack_counts(counts[a:b]) for a, b in cut], pa.binary())],
                    names=["bucket", "block", "source", "keys", "counts"],
                )

    return run


def _counted(group: pa.Table) -> pa.Table:
    """What blocks sent to one bucket -> the totals of each block's keys, and one row with the bucket's words."""
    sent = [_unpack_keys(k) for k in group.column("keys").to_pylist()]
    known, place = np.unique(np.concatenate(sent), return_inverse=True)
    places = np.split(place, np.cumsum([len(k) for k in sent])[:-1])
    seen = np.zeros((2, len(known)), np.int64)
    for p, counts, source in zip(places, group.column("counts").to_pylist(), group.column("source").to_pylist()):
        if source != NEITHER:
            seen[source, p] += _unpack_counts(counts)
    bucket = group.column("bucket")[0].as_py()
    asked = [(b, p) for b, p in zip(group.column("block").to_pylist(), places) if b is not None]
    words = seen[:, (known & U64(1)) == 1]
    near, far = ([_pack_counts(seen[s, p]) for _, p in asked] + [None] for s in (TARGET, BACKGROUND))
    rest = [[0] * len(asked) + [int(x)] for x in ((words.sum(0) > 0).sum(), words[TARGET].sum(), words[BACKGROUND].sum())]
    columns = [pa.array([b for b, _ in asked] + [None], pa.int64()), pa.array([bucket] * (len(asked) + 1), pa.int32()), pa.array(near, pa.binary()), pa.array(far, pa.binary()), *(pa.array(x, pa.int64()) for x in rest)]
    return pa.table(columns, names=["block", "bucket", "near", "far", "words", "near_total", "far_total"])


def losses(counts: np.ndarray, place: np.ndarray, total: int, words: int, weight: float = 0.6) -> np.ndarray:
    """Loss of each token from the counts of its word, context and bigram."""
    word, seen, both = counts[place]
    one = (word + 1) / (total + words + 1)
    part = np.where(seen > 0, weight, 0.0)
    return -np.log(part * both / np.maximum(seen, 1) + (1 - part) * one)


def _scored(words: int, totals: tuple[int, int]):
    """A block and the counts of its keys -> scores."""

    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        keys, place, n = _keys(block.column("sizes")[0].values.to_numpy(), block.column("data")[0].as_py())
        told = told.sort_by("bucket")
        columns = []
        for name, total in zip(("near", "far"), totals):
            counts = [_unpack_counts(c) for c in told.column(name).to_pylist()]
            mean = np.zeros(len(n))
            if len(keys):
                each = losses(np.concatenate(counts), place, total, words)
                some = np.flatnonzero(n)
                mean[some] = np.add.reduceat(each, (np.cumsum(n) - n)[some]) / n[some]
            columns.append(pa.array(mean, pa.float64(), mask=n == 0))
        return pa.table([block.column("doc_ids").combine_chunks().flatten(), pa.array(n, pa.int64()), *columns], names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    return run


def lm_scores(docs: DataFrame, target: DataFrame, background: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference (target less background, per token)."""

    def rows(df: DataFrame, doc_id) -> DataFrame:
        return df.select(doc_id.cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    none = F.lit(None)
    counted = [(TARGET, rows(target, none))] + ([] if background is docs else [(BACKGROUND, rows(background, none))])
    size = sum(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0 for df in (rows(docs, none), *(c for _, c in counted)))
    buckets = max(1, math.ceil(size / PACK_BYTES))
    packed = stage(rows(docs, F.col("doc_id")).mapInArrow(lean(_packed), _BLOCKS), "blocks")
    form = "bucket int, block long, source int, keys binary, counts binary"
    sent = packed.mapInArrow(_sent(BACKGROUND if background is docs else NEITHER, True, buckets), form)
    for source, corpus in counted:
        sent = sent.unionByName(corpus.mapInArrow(lambda batches, send=_sent(source, False, buckets): send(_packed(batches)), form))
    with dropped_shuffles(docs.sparkSession):  # what was sent is not needed beside the answers
        told = stage(sent.groupBy("bucket").applyInArrow(_counted, _COUNTS), "counts")
    words, *totals = (x or 0 for x in told.agg(F.sum("words"), F.sum("near_total"), F.sum("far_total")).first())
    answers = told.where("block is not null").select("block", "bucket", "near", "far")
    score = _scored(words, tuple(totals))
    out = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored for likeness to conversations against documents at large."""
    docs = table(spark, sf_dir, "documents")
    return lm_scores(docs, table(spark, sf_dir, "conversations"), docs)
