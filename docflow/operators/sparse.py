"""Sparse term-frequency vectors, counted inside the row."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..sources.scratch import bounded_batches

DIMENSIONS = 100_000
#: Words that carry no content (our own short list; a parameter).
STOP_WORDS = ["the", "of", "to", "and", "in", "is", "it", "that", "this", "was", "were", "for", "with", "on", "as", "at", "by", "be", "are", "from", "an", "or", "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "pour", "par", "el", "los", "las", "y", "der", "die", "das", "und", "mit", "von", "ist", "ein", "eine"]
SPARSE = "struct<indices:array<int>,values:array<double>>"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits (and what is empty at either end)."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def terms(text: Column, stop_words: list[str] | None = None) -> Column:
    """Lower-cased runs of letters and digits, longer than one character, without stop words."""
    stop = STOP_WORDS if stop_words is None else stop_words
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~w.isin(stop))


def _lower(texts: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:  # bytes that are no UTF-8 stand between words
        return pc.utf8_lower(pa.array([b and b.decode(errors="replace") for b in texts.cast(pa.large_binary()).to_pylist()], texts.type))


def _terms(texts: pa.Array, stop: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and term (an index) of each term of the texts, in order; the terms.

    Cut where the rows are: a text crosses from the JVM as one value, which costs far less than its words.
    """
    lists = pc.split_pattern_regex(_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{N}]+")
    coded = lists.flatten().dictionary_encode()
    kinds = coded.dictionary
    good = np.asarray(pc.and_(pc.greater(pc.utf8_length(kinds), 1), pc.invert(pc.is_in(kinds, pa.array(stop, kinds.type)))))
    code, row = coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
    some = good[code] if len(code) else np.zeros(0, bool)
    return row[some].astype(np.int64), code[some].astype(np.int64), kinds


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 4000):
            yield batch.slice(at, 4000)


def term_frequencies(df: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """key, term, n, tf: a term's share of its row's terms (sums to 1).

    Row by row, without a shuffle: rows with a null key have their terms too, and rows that share a key have their own.
    """
    stop, kind = STOP_WORDS if stop_words is None else stop_words, df.schema[key].dataType.simpleString()
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            row, term, kinds = _terms(part.column(1), stop)
            total = np.bincount(row, minlength=len(part))
            pair, n = np.unique(row * max(len(kinds), 1) + term, return_counts=True)
            row, term = np.divmod(pair, max(len(kinds), 1))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), kinds.take(pa.array(term)), pa.array(n), pa.array(n / total[row])], names=["key", "term", "n", "tf"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, term string, n long, tf double").withColumnRenamed("key", key)


def term_counts(df: DataFrame, key: str, text: str, stop_words: list[str] | None = None) -> DataFrame:
    """key, term, n."""
    return term_frequencies(df, key, text, stop_words).select(key, "term", "n")


def _dimensions(kinds: pa.Array, size: int) -> np.ndarray:
    """A term's dimension, from its MD5 (the same on every run and engine)."""
    digests = b"".join([md5(t).digest() for t in kinds.cast(pa.large_binary()).to_numpy(zero_copy_only=False)])
    return np.frombuffer(digests, ">u4")[::4].astype(np.int64) % size


def with_sparse(df: DataFrame, text: str, name: str = "sparse", dimensions: int = DIMENSIONS, stop_words: list[str] | None = None) -> DataFrame:
    """All columns of df and ``name``: struct(indices, values), ordered by index; terms that share an index add up.

    A text without terms, or none, has empty arrays.  Nothing is shuffled or joined, whatever the keys are.
    """
    stop, names = STOP_WORDS if stop_words is None else stop_words, [c for c in df.columns if c != name]
    safe = [f"c{i}" for i in range(len(names))]
    there = text in names and isinstance(df.schema[text].dataType, StringType)  # it crosses once
    counted = safe[names.index(text)] if there else "text"
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            row, term, kinds = _terms(part.column(counted), stop)
            total = np.bincount(row, minlength=len(part))
            pair, n = np.unique(row * dimensions + _dimensions(kinds, dimensions)[term], return_counts=True)
            row, index = np.divmod(pair, dimensions)
            value = n / total[row]
            ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (pa.array(index.astype(np.int32)), pa.array(value))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in safe), pa.StructArray.from_arrays(lists, names=["indices", "values"])], names=[*safe, "sparse"])

    kinds = ", ".join(f"{s} {df.schema[c].dataType.simpleString()}" for s, c in zip(safe, names))
    rows = df.select(*(F.col("`" + c.replace("`", "``") + "`").alias(s) for s, c in zip(safe, names)), *([] if there else [F.col(text).cast("string").alias("text")]))
    return rows.mapInArrow(run, f"{kinds}, sparse {SPARSE}").toDF(*names, name)


def sparse_vectors(df: DataFrame, key: str, text: str, dimensions: int = DIMENSIONS, stop_words: list[str] | None = None) -> DataFrame:
    """key, sparse: one row per row."""
    found = with_sparse(df.select(key, F.col(text).alias("__text")), "__text", "sparse", dimensions, stop_words)
    return found.select(key, "sparse")
