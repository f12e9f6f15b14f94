"""A training-corpus pipeline: each stage keeps, drops or rewrites documents by one operator's decision.

Stages take and return the columns of the documents table (the last one returns token counts and digests).  Rows
without a doc_id pass the stages that compare documents by id; a null or empty text is judged like an empty text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.bpe import digests
from docflow.llm.common import quoted, stage, table, unused, without
from docflow.llm.decontamination import decontaminate
from docflow.llm.minhash_dedup import minhash_dedup
from docflow.llm.quality import fold, score, train
from docflow.llm.substring_dedup import cut_texts

#: Documents with a lower quality score are rejected.
LEAST_QUALITY = 0.3
#: Documents whose shingle sets are as similar as this, in percent, are near copies.
NEAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    mark = unused("mark", docs.columns)
    return score(docs, model, mark).where(F.col(mark) >= LEAST_QUALITY).select(*quoted(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash_dedup(docs, NEAR_PERCENT).where("not kept").select("doc_id").distinct()
    return without(docs, stage(gone, "gone"), "doc_id").select(*quoted(docs.columns))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages; a text that loses nothing stays as it is."""
    return cut_texts(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark = unused("mark", docs.columns)
    key = F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256)
    found = decontaminate(docs.select(key.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    gone = found.where("contaminated").select(F.col("doc_id").alias(mark)).distinct()
    return without(docs.withColumn(mark, key), stage(gone, "gone"), mark).select(*quoted(docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("decontamination", decontamination),
    ("bpe", tokens),
]
#: Learned scores and tokenisation cannot be written in SQL; tests/llm holds brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
