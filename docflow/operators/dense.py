"""Dense vectors from an embedding provider."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.providers import DenseEmbedder, with_retries
from ..sources.scratch import bounded_batches, staged


def embed_batch(embedder: DenseEmbedder, texts: list[str], attempts: int = 3, sleep=None) -> list[tuple[list[float] | None, str | None]]:
    """(vector, error) of each text: a batch that keeps failing is halved, a single text that fails has no vector."""
    try:
        call = {} if sleep is None else {"sleep": sleep}
        return [(v, None if v else "no vector") for v in with_retries(lambda: embedder.embed(texts), attempts, **call)]
    except Exception as e:
        if len(texts) == 1:
            return [(None, str(e) or type(e).__name__)]
        half = len(texts) // 2
        return embed_batch(embedder, texts[:half], attempts, sleep) + embed_batch(embedder, texts[half:], attempts, sleep)


def with_embeddings(chunks: DataFrame, embedder: DenseEmbedder, text: str = "text", batch: int = 32) -> DataFrame:
    """All columns, ``embedding`` (array of float, null where it failed: no zero vectors) and ``embedding_error``."""
    names = chunks.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chunks.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), batch):
                part = whole.slice(at, batch)
                found = embed_batch(embedder, [t or "" for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([v for v, _ in found], pa.list_(pa.float32())), pa.array([e for _, e in found], pa.string())], names=[*names, "embedding", "embedding_error"])

    return chunks.mapInArrow(run, f"{kinds}, embedding array<float>, embedding_error string")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Bytes of the queries that go to every task at once; more go in blocks, a pass over the vectors each.
QUERY_BYTES = 32_000_000
#: Queries and vectors that are scored at once: a few matrices of this size (8 MB) are what a task needs beside its queries.
TILE = (512, 2048)
#: Decimals in which scores are compared: the order of a sum's terms is not fixed beyond them.
DECIMALS = 9


def _matrix(column, width: int) -> np.ndarray:
    """Vectors of one width as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _ready(metric: str, a: np.ndarray) -> np.ndarray:
    """Rows as ``_scores`` takes them: for cosine of length 1; vectors without a direction become nan."""
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return a / np.linalg.norm(a, axis=1, keepdims=True)
    return a


def _scores(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Score of each ready vector of a with each of b, greater for nearer ones; nan where one has no direction."""
    found = a @ b.T
    return found if metric != "l2" else -np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * found + (b**2).sum(1)[None], 0))


def _better(best: np.ndarray, who: np.ndarray, score: np.ndarray, new: np.ndarray) -> None:
    """Take the scores of new vectors into the k best of each query, in place; equal scores go to smaller keys.

    Only scores that reach a query's last place so far, or that of the new ones alone, are rounded and ranked.
    """
    k = best.shape[1]
    least = best[:, -1]
    if len(new) > k and (least == -np.inf).any():
        least = np.maximum(least, np.partition(score, len(new) - k, axis=1)[:, len(new) - k])
    slack = 10.0**-DECIMALS + 1e-12 * np.abs(np.where(np.isfinite(least), least, 0))
    query, place = np.nonzero((score >= (least - slack)[:, None]) & (score > -np.inf))
    if not len(query):
        return
    some, at = np.unique(query, return_inverse=True)
    row = np.concatenate([np.repeat(np.arange(len(some)), k), at])
    value = np.concatenate([best[some].ravel(), np.round(score[query, place], DECIMALS)])
    key = np.concatenate([who[some].ravel(), new[place]])
    order = np.lexsort((key, -value, row))
    rank = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    first = order[rank < k]  # k of each row: so many it has already
    best[some], who[some] = value[first].reshape(-1, k), key[first].reshape(-1, k)


def _nearest(ids: np.ndarray, at: np.ndarray, k: int, metric: str, batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
    """The k best of all batches' vectors (id, vector) for each query (key and place)."""
    at, width = _ready(metric, at), at.shape[1]
    best, who = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
    for whole in batches:
        for begin in range(0, len(whole), TILE[1]):
            part = whole.slice(begin, TILE[1])
            new, vectors = part.column("id").to_numpy(), _ready(metric, _matrix(part.column("vector"), width))
            for q in range(0, len(ids), TILE[0]):
                some = slice(q, q + TILE[0])
                score = _scores(metric, at[some], vectors)
                score[np.isnan(score) | (ids[some, None] == new[None])] = -np.inf
                _better(best[some], who[some], score, new)
    query, place = np.nonzero(best > -np.inf)
    return pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(who[query, place]), pa.array(best[query, place])], names=["query", "neighbour", "score"])


def knn(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "id", vector: str = "embedding", metric: str = "cosine") -> DataFrame:
    """query, neighbour, score, rank (from 1): the k nearest of all vectors to each query, itself (by key) left out.

    metric: cosine, dot, or l2 (score is the distance with a minus sign).  Keys are whole numbers, unique on either side.
    Queries are counted and go to the tasks in blocks of bounded bytes; a task scores them tile by tile, keeps the k best of
    what it has seen for each query of the block and gives them once, and the tasks' answers are merged by a ranking that
    drops all but k before its shuffle as well.  Null vectors, and with cosine vectors of length 0, are nobody's neighbours; queries like
    that have none.  All vectors have one width, that of the queries.  Equal scores (to nine decimals) go to smaller keys.
    """
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric}")
    spark = vectors.sparkSession
    bounded_batches(spark)
    asked = staged(queries.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("query"), F.col(vector).cast("array<float>").alias("vector")), "queries")
    n, width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "query long, neighbour long, score double, rank int")
    n_blocks = -(-n * (8 * width + 16 * k) // QUERY_BYTES)
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))

    def search(block: pa.Table):
        ids, at = block.column("query").to_numpy(), _matrix(block.column("vector").combine_chunks(), width)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield _nearest(ids, at, k, metric, batches)

        return rows.mapInArrow(run, "query long, neighbour long, score double")

    # a block is bounded, so that it may pass the driver
    blocks = (asked.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b).toArrow() for b in range(n_blocks))
    found = reduce(DataFrame.unionByName, [search(b) for b in blocks if len(b)])
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)
