"""The same functions for SQL: temporary functions, and a table function for chunks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunk import characters, split_measured
from . import text as T


@udtf(returnType="chunk_index: int, total_chunks: int, chunk: string")
class ChunkText:
    """chunk_text(text, size, overlap): one row a chunk."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        parts = split_measured(text.strip(), characters([text.strip()])[0], size, overlap) if text and text.strip() else []
        for i, p in enumerate(parts, 1):
            yield i, len(parts), p


def register(spark: SparkSession) -> None:
    """chunk_text, strip_accents, ascii_flat, alphanum_only, strip_tags, doi for SQL in this session."""
    spark.udtf.register("chunk_text", ChunkText)
    fold = f"regexp_replace(translate(s, '{T._COMPOSED}', '{T._BASE}'), '\\\\p{{Mn}}+', '')"
    bodies = {
        "strip_accents": fold,
        "ascii_flat": f"lower(regexp_replace({fold}, '[^\\\\x00-\\\\x7F]', ''))",
        "alphanum_only": f"regexp_replace(lower(regexp_replace({fold}, '[^\\\\x00-\\\\x7F]', '')), '[^a-z0-9]', '')",
        "strip_tags": "regexp_replace(regexp_replace(s, '<[^>]+>', ''), '^\\\\s+|\\\\s+$', '')",
        "doi": f"regexp_extract(coalesce(s, ''), '{T.DOI.replace(chr(92), chr(92) * 2)}', 1)",
    }
    for name, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
