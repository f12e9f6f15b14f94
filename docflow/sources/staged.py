"""Stage tables and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_list(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file that holds one list of objects."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_stage(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").parquet(path)


def finish_keys(done: DataFrame, path: str, key: str = "itemKey") -> None:
    """Remember finished keys; each run appends its own file."""
    done.select(key).distinct().write.mode("append").parquet(path)


def finished_keys(spark: SparkSession, path: str, key: str = "itemKey") -> DataFrame:
    try:
        return spark.read.parquet(path).select(key).distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], f"{key} string")


def quarantine(errors: DataFrame, path: str, as_of) -> None:
    """Append error rows, stamped; earlier runs' rows stay."""
    errors.withColumn("at", as_of).write.mode("append").parquet(path)


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, folder, length, modified of all files below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return read.select("path", F.element_at(F.split("path", "/"), -2).alias("folder"), "length", F.col("modificationTime").alias("modified"))


def old_files(files: DataFrame, as_of, days: int = 30) -> DataFrame:
    return files.where(F.col("modified") < as_of - F.make_interval(days=F.lit(days)))
