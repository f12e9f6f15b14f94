"""Shared plumbing of the training-data operators: staged tables, bounded blocks, checked broadcasts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step inside a task handles at once (a longer single text is its own block).
BLOCK_BYTES = 400_000


#: Bytes of one Arrow batch between the JVM and Python, where the session does not say.
BATCH_BYTES = 4_000_000


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: buffers of long texts lie outside the heap, several for each running task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") in ("1", "1b"):  # not set
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; where its files make fewer tasks than there are cores, its rows are dealt out."""
    small_batches(spark)
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if found.rdd.getNumPartitions() < cores else found


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).  Where none is set, a local master gets a temporary one;
    on a cluster that is an error, for executors cannot see each other's folders."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docflow-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries in here go when these end, not whenever the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, a lost executor costs nothing before it."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/docflow-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Free memory of this worker goes back to the machine: the next stage's workers need it."""
    from . import seeds

    seeds.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU libc only
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """run (for mapInArrow) that gives its memory back when its task ends."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.Table, list]]:
    """Slices of the batches whose texts (as UTF-8 bytes, None kept) take about ``limit`` bytes together."""
    for batch in batches:
        column_bytes = batch.column(column).cast(pa.binary())
        ends = np.cumsum(pc.binary_length(column_bytes).fill_null(0).to_numpy(zero_copy_only=False))
        start = held = 0
        while start < len(batch):
            stop = min(len(batch), int(np.searchsorted(ends, held + limit)) + 1)
            yield batch.slice(start, stop - start), column_bytes.slice(start, stop - start).to_pylist()
            start, held = stop, int(ends[stop - 1])


def reduced(df: DataFrame, keys: DataFrame, key: str, limit: int = 2_000_000) -> DataFrame:
    """Rows of df whose key is in keys (distinct).  Counted first: few keys go to every task, many are shuffled."""
    return df.join(few(keys, limit), key, "left_semi")


def without(df: DataFrame, keys: DataFrame, key: str, limit: int = 2_000_000) -> DataFrame:
    """Rows of df whose key is not in keys, counted first."""
    return df.join(few(keys, limit), key, "left_anti")


def few(df: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """df with a broadcast hint if it was counted to have few rows (of a few numbers each)."""
    return F.broadcast(df) if df.count() <= limit else df


def quoted(names: Iterable[str]) -> list[str]:
    """Column names as they must be written where dots and back quotes mean something."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def undotted(names: Iterable[str]) -> list[str]:
    """The names, with others in place of those that mapInArrow cannot take (it reads a dot as a field of a struct)."""
    out: list[str] = []
    for n in (names := list(names)):
        out.append(unused("column", [*names, *out]) if set(n) & set(".`") else n)
    return out


def parted(docs: DataFrame, key: str = "doc_id", name: str = "part") -> DataFrame:
    """docs with ``name``: 0, but a hash of the text where rows share a key and not their text, to tell them apart; and
    ``name_again``: whether other rows have the same key (null keys: false)."""
    mark, again = F.xxhash64(F.col("text").cast("string")), f"{name}_again"
    marks = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.count("*").alias("n"))
    known = stage(marks.where("n > 1").select(key, (F.coalesce("low", F.lit(0)) < F.coalesce("high", F.lit(0))).alias(f"{name}_differ")), "several")
    told = docs.join(few(known), key, "left").withColumn(name, F.when(F.col(f"{name}_differ"), mark).otherwise(F.lit(0).cast("long")))
    return told.withColumn(again, F.col(f"{name}_differ").isNotNull()).drop(f"{name}_differ")


def once(told: DataFrame, key: str = "doc_id", name: str = "part") -> DataFrame:
    """Of rows that ``parted`` has told apart (key, text, name, name_again), one for each key and text: a row that is there
    a hundred thousand times is worked on once.  Repeats are put together with map-side aggregation."""
    again = F.col(f"{name}_again")
    repeats = stage(told.where(again).groupBy(key, name).agg(F.max("text").alias("text"), F.lit(True).alias(f"{name}_again")).select(*quoted(told.columns)), "once")
    return told.where(~again).unionByName(repeats)


def unused(name: str, names: list[str]) -> str:
    """name, with as many underscores as it takes to be none of the names."""
    taken = {n.lower() for n in names}
    while name in taken:
        name += "_"
    return name


def as_signed(x):
    return x.view("int64")
