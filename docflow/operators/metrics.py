"""Counters, histograms and summaries of metric events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Upper bounds in seconds (fixed values).
CHUNK_SECONDS = (0.1, 0.5, 1, 2, 5, 10, 30, 60)


def summary(events: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return events.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def counter(events: DataFrame, by: Sequence[str], amount: str | None = None) -> DataFrame:
    return events.groupBy(*by).agg((F.sum(amount) if amount else F.count("*")).alias("total"))


def histogram(events: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float] = CHUNK_SECONDS) -> DataFrame:
    """Rows (by, le, n) with cumulative counts; the last bound is infinite.  One pass over the events."""
    counts = events.groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(value).alias("all"))
    cells = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return counts.select(*by, F.explode(cells).alias("c")).select(*by, "c.le", "c.n")


def timings(events: DataFrame, by: Sequence[str], seconds: str, failed: str, bounds: Sequence[float] = CHUNK_SECONDS) -> DataFrame:
    """by, n, n_failed, total, mean, buckets (cumulative counts below the bounds, the last of all): timed runs of operations,
    failed ones counted apart and timed with the others.  One pass over the events."""
    buckets = F.array(*(F.count_if(F.col(seconds) <= b) for b in bounds), F.count(seconds))
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(failed), F.lit(False))).alias("n_failed"), F.round(F.sum(seconds), 4).alias("total"), F.round(F.avg(seconds), 4).alias("mean"), buckets.alias("buckets"))


def folder_sizes(files: DataFrame, folder: str = "folder", size: str = "length") -> DataFrame:
    return files.groupBy(folder).agg(F.sum(size).alias("bytes"), F.round(F.sum(size) / (1 << 20), 3).alias("mb"))


def observed(df: DataFrame, failed: str | None = None) -> tuple[DataFrame, Observation]:
    """df, and an observation with n_rows and n_failed that is filled when an action has run over df."""
    seen = Observation()
    return df.observe(seen, F.count("*").alias("n_rows"), (F.count_if(F.col(failed).isNotNull()) if failed else F.lit(0).cast("bigint")).alias("n_failed")), seen
