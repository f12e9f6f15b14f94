"""Nearest neighbours against a plain version."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.operators import dense


def plain(queries, vectors, k, metric):
    def score(a, b):
        if metric == "l2":
            return -math.dist(a, b)
        d = sum(x * y for x, y in zip(a, b))
        norms = math.hypot(*a) * math.hypot(*b)
        return d if metric == "dot" else d / norms if norms else None

    out = set()
    for q, a in queries:
        found = [(round(s, 9), v) for v, b in vectors if a and b and v != q and (s := score(a, b)) is not None]
        out |= {(q, v, r) for r, (s, v) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:k], 1)}
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_knn_equals_the_plain_version(spark, metric, monkeypatch):
    """Ties by equal vectors, null and zero vectors, more asked for than there are, queries in several blocks."""
    rng = random.Random(metric)
    vectors = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(300)]
    vectors += [(300 + i, vectors[i][1]) for i in range(40)] + [(400, None), (401, [0.0] * 4)]
    df = spark.createDataFrame(vectors, "id long, embedding array<float>").repartition(5)
    queries = df.where("id % 20 = 0 or id > 399")
    want = plain([v for v in vectors if v[0] % 20 == 0 or v[0] > 399], vectors, 7, metric)
    for size in (dense.QUERY_BYTES, 400):
        monkeypatch.setattr(dense, "QUERY_BYTES", size)
        assert {(r.query, r.neighbour, r.rank) for r in dense.knn(queries, df, 7, metric=metric).collect()} == want
    few = df.where("id < 3")
    assert dense.knn(few, few, 10, metric=metric).count() == 6
    assert dense.knn(df.limit(0), df).count() == dense.knn(few, df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        dense.knn(df, df, metric="other")


def test_ranking_is_bounded_before_the_shuffle(spark):
    df = spark.range(100).select("id", F.array((F.rand(1) + 1).cast("float"), F.rand(2).cast("float")).alias("embedding"))
    plan = dense.knn(df.where("id < 5"), df)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan


def test_memory_of_a_task_is_that_of_a_tile_and_the_queries():
    """4,000 queries against 6,144 vectors: a matrix of all queries and one batch alone would be 65 MB, and ranked, several."""
    rng = np.random.default_rng(3)
    at, vectors = rng.normal(size=(4000, 8)), rng.normal(size=(6144, 8)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(6144)), pa.array(list(vectors), pa.list_(pa.float32()))], names=["id", "vector"])
    tracemalloc.start()
    found = dense._nearest(np.arange(10_000, 14_000), at, 10, "cosine", iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 40_000 and peak < 60_000_000
