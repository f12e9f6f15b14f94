"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where none is set, a local master gets a temporary folder; on a cluster that is an error, for
    executors cannot see each other's folders."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docflow-checkpoint-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


#: Bytes of one Arrow batch between the JVM and Python, where the session does not say.
BATCH_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes: texts may be long, and each running task holds several batches."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "1") in ("1", "1b"):  # not set
        spark.conf.set(key, str(BATCH_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and lineage ends here.

    The table outlives its readers, whose results are lazy; whoever owns the folder clears it after a run.
    """
    path = f"{shared_folder(df.sparkSession)}/docflow-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
