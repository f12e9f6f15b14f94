"""Access to the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables of long texts, whose rows cost more to work on than to move.
TEXTS = ("documents", "pages")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; texts whose files make fewer tasks than there are cores are dealt out to all of them."""
    found = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return found.repartition(cores) if name in TEXTS and found.rdd.getNumPartitions() < cores else found
