"""Rows shaped for vector stores, their upsert, and the load status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_date, uuid5
from .chunk import batch_number

#: Columns of a chunk that are not metadata (fixed values).
OWN = ["id", "embedding", "sparse_embedding", "values"]
#: Date-like keys that store B wants in one form (fixed values).
DATE_KEYS = ["date", "created_at", "updated_at", "published_at"]


def _metadata(df: DataFrame, dates: bool = False, extra: dict[str, Column] | None = None) -> Column:
    fields = []
    for c, kind in df.dtypes:
        if c in OWN:
            continue
        v = F.col(f"`{c}`")
        if dates and c in DATE_KEYS:
            v = normalize_date(v.cast("string"))
        elif c == "text" and "chunk_text" in df.columns:
            v = F.coalesce(F.nullif(v, F.lit("")), F.col("chunk_text"))
        fields.append(v.alias(c))
    fields += [v.alias(k) for k, v in (extra or {}).items()]
    return F.struct(*fields)


def sparse_values(sparse: Column) -> Column:
    """struct(indices, values) with numbers for strings; null if a list is missing, malformed, or of another length."""
    indices = F.transform(sparse["indices"].cast("array<string>"), lambda x: x.try_cast("int"))
    values = F.transform(sparse["values"].cast("array<string>"), lambda x: x.try_cast("double"))
    good = (F.size(indices) > 0) & (F.size(indices) == F.size(values)) & F.forall(indices, lambda x: x.isNotNull()) & F.forall(values, lambda x: x.isNotNull())
    return F.when(good, F.struct(indices.alias("indices"), values.alias("values")))


def payload_a(chunks: DataFrame) -> DataFrame:
    """id, values, metadata, sparse_values (null for dense-only rows); rows without a vector are left out."""
    sparse = sparse_values(F.col("sparse_embedding")) if "sparse_embedding" in chunks.columns else F.lit(None).cast("struct<indices:array<int>,values:array<double>>")
    return chunks.where(F.col("embedding").isNotNull()).select(F.col("id").cast("string").alias("id"), F.col("embedding").alias("values"), _metadata(chunks).alias("metadata"), sparse.alias("sparse_values"))


def payload_b(chunks: DataFrame) -> DataFrame:
    """uuid, vector, properties with RFC 3339 dates; sparse vectors are not sent."""
    return chunks.where(F.col("embedding").isNotNull()).select(uuid5(F.col("id").cast("string")).alias("uuid"), F.col("embedding").alias("vector"), _metadata(chunks, dates=True).alias("properties"))


def payload_c(chunks: DataFrame) -> DataFrame:
    """id (UUID), vector, payload with the original id; sparse vectors are not sent."""
    return chunks.where(F.col("embedding").isNotNull()).select(uuid5(F.col("id").cast("string")).alias("id"), F.col("embedding").alias("vector"), _metadata(chunks, extra={"original_id": F.col("id")}).alias("payload"))


def document_chunks(chunks: DataFrame) -> DataFrame:
    """Ordered chunk ids of each document; chunks without one belong to 'unknown_document'."""
    doc = F.coalesce("doc_id", F.lit("unknown_document"))
    return chunks.groupBy(doc.alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda x: x["id"]).alias("chunk_ids"))


def batches(chunks: DataFrame, size: int = 100) -> DataFrame:
    """All columns and ``batch``: 1-based batches of a document's chunks."""
    return chunks.withColumn("batch", batch_number(F.col("chunk_index"), size))


def upserted(payload: DataFrame, stored: DataFrame | None = None, key: str = "id") -> DataFrame:
    """A store's rows after a load: a row of the payload replaces the stored one with its key; of several rows with one key
    the one with the greatest hash stays, so a load that is run again changes nothing."""
    row = F.struct(*(F.col(f"`{c}`") for c in payload.columns))
    new = payload.groupBy(key).agg(F.max_by(row, F.xxhash64(*(F.col(f"`{c}`") for c in payload.columns))).alias("row")).select("row.*")
    return new if stored is None else new.unionByName(stored.join(new.select(key), key, "left_anti"))


def load_status(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """sent, inserted, failed_batches, status; the rungs are tried in this order.  results: rows with sent, inserted, error,
    and, where a row stands for several batches, failed (how many of them failed)."""
    failed = F.coalesce(F.sum("failed"), F.lit(0)) if "failed" in results.columns else F.count_if(F.col("error").isNotNull())
    sums = results.groupBy(*(by or [])).agg(F.coalesce(F.sum("sent"), F.lit(0)).alias("sent"), F.coalesce(F.sum("inserted"), F.lit(0)).alias("inserted"), failed.alias("failed_batches"))
    status = F.when(F.col("failed_batches") > 0, "partial_error").when((F.col("inserted") == 0) & (F.col("sent") > 0), "error").when(F.col("inserted") < F.col("sent"), "success_partial_data").otherwise("success")
    return sums.withColumn("status", status)
