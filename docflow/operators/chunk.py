"""Splitting documents into overlapping chunks, measured in any unit, and cleaning chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, strip
from ..schema import CHUNK_OWN
from ..sources.providers import ChunkCleaner
from ..sources.scratch import bounded_batches
from .calls import two_passes

#: From the coarsest separator to the finest (fixed values).
SEPARATORS = ("\n\n", "#", "##", "\n", " ", "")
#: The places (in characters, ascending) where the units of each text begin: what a text is measured by.
Units = Callable[[Sequence[str]], list[np.ndarray]]


def characters(texts: Sequence[str]) -> list[np.ndarray]:
    return [np.arange(len(t)) for t in texts]


class Matches:
    """Units are the matches of a pattern, such as words, or the pieces that a tokenizer cuts a text into first."""

    def __init__(self, pattern: str):
        self.pattern = pattern

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        found = re.compile(self.pattern)
        return [np.fromiter((m.start() for m in found.finditer(t)), np.int64) for t in texts]


@cache
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Tokens:
    """Units are the tokens of a byte-level vocabulary (a file of ranks that all workers can read) and its pattern."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def __call__(self, texts: Sequence[str]) -> list[np.ndarray]:
        coder = _encoding(self.path, self.pattern)
        return [np.asarray(coder.decode_with_offsets(coder.encode_ordinary(t))[1], np.int64) for t in texts]


def split_measured(text: str, units: np.ndarray, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` units: the first separator present cuts, neighbours are merged with overlap.

    A part still too long is cut by the next separators; the last one, '', cuts between characters (a character that
    begins several units stays whole).  Units are counted once: of parts that begin at known places the running counts
    are known, so every end of a piece, and where the next begins, is a search.
    """
    out: list[str] = []

    def emit(a: int, b: int) -> None:
        piece = text[a:b].strip()
        if piece:
            out.append(piece)

    def cut(a: int, b: int, level: int) -> None:
        while separators[level] and text.find(separators[level], a, b) < 0:
            level += 1
        sep = separators[level]
        edges = [a, *_places(text, sep, a, b), b] if sep else range(a, b + 1)
        edges = np.asarray(edges)
        edges = edges[np.append(True, edges[1:] > edges[:-1])]
        counts = np.searchsorted(units, edges)
        long = np.flatnonzero(np.diff(counts) > size) if sep else np.zeros(0, np.int64)  # these have finer separators
        begin = 0
        for stop in [*long.tolist(), len(edges) - 1]:
            merge(edges, counts, begin, stop)
            if stop < len(edges) - 1:
                cut(int(edges[stop]), int(edges[stop + 1]), level + 1)
            begin = stop + 1

    def merge(edges: np.ndarray, counts: np.ndarray, first: int, last: int) -> None:
        """Parts first..last - 1, none of them too long."""
        while first < last:
            stop = min(int(np.searchsorted(counts, counts[first] + size, "right")) - 1, last)
            stop = max(stop, first + 1)  # one character of more units than size
            emit(int(edges[first]), int(edges[stop]))
            if stop == last:
                return
            least = max(counts[stop] - overlap, counts[stop + 1] - size)
            first = min(max(int(np.searchsorted(counts, least)), first + 1), stop)

    if text:
        cut(0, len(text), 0)
    return out


def _places(text: str, sep: str, a: int, b: int) -> list[int]:
    found, at = [], text.find(sep, a, b)
    while at >= 0:
        found.append(at)
        at = text.find(sep, at + len(sep), b)
    return found


def _split_batch(texts: list[str], units: Units, size: int, overlap: int) -> list[tuple[list[str] | None, str | None]]:
    """(pieces, error) of each text; what fails for one text fails for it alone."""
    try:
        return [(split_measured(t, u, size, overlap), None) for t, u in zip(texts, units(texts), strict=True)]
    except Exception as e:
        if len(texts) == 1:
            return [(None, str(e) or type(e).__name__)]
        return [x for t in texts for x in _split_batch([t], units, size, overlap)]


def split_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 150, keep: list[str] | None = None, units: Units = characters) -> DataFrame:
    """doc_id, chunks (null where splitting failed), error, and the other columns of each document with text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    keep = [c for c in (keep if keep is not None else docs.columns) if c not in CHUNK_OWN and c not in (key, text)]
    rows = docs.where(~blank(F.col(text))).select(F.col(key).cast("string").alias("doc_id"), strip(F.col(text)).alias("text"), *keep)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 100):
                part = batch.slice(at, 100)
                found = _split_batch(part.column("text").to_pylist(), units, size, overlap)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([c for c, _ in found], pa.list_(pa.string())), pa.array([e for _, e in found], pa.string()), *(part.column(c) for c in keep)], names=["doc_id", "chunks", "error", *keep])

    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"doc_id string, chunks array<string>, error string{kinds}")


def chunk_recursive(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1000, overlap: int = 150, keep: list[str] | None = None, units: Units = characters) -> DataFrame:
    """One row a chunk: id, doc_id, chunk_index (from 1), total_chunks, text, and the other columns of the document.  A
    document that cannot be split is skipped; ``split_documents`` says which, and why."""
    split = split_documents(docs, key, text, size, overlap, keep, units)
    return number_chunks(split, "chunks", [c for c in split.columns if c not in ("doc_id", "chunks", "error")])


def chunk_words(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 200, overlap: int = 30, keep: list[str] | None = None) -> DataFrame:
    """Chunks of ``size`` words that share ``overlap`` words with the one before; JVM-side throughout."""
    keep = [c for c in (keep or []) if c not in CHUNK_OWN]
    words = F.split(strip(F.col(text)), r"\s+")
    rows = docs.where(~blank(F.col(text))).select(F.col(key).cast("string").alias("doc_id"), words.alias("w"), *keep)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return number_chunks(rows.withColumn("chunks", F.transform(starts, lambda s: F.array_join(F.slice("w", s + 1, F.lit(size)), " "))), "chunks", keep)


def number_chunks(df: DataFrame, chunks: str, keep: list[str]) -> DataFrame:
    # an inner explode would have Spark infer a filter that makes the array once more for each of its elements
    each = df.select("doc_id", F.size(chunks).alias("total_chunks"), F.posexplode_outer(chunks).alias("p", "text"), *keep).where("p is not null")
    index = F.col("p") + 1
    return each.select(F.concat_ws("_", "doc_id", index.cast("string")).alias("id"), "doc_id", index.alias("chunk_index"), "total_chunks", "text", *keep)


def batch_number(index: Column, size: int) -> Column:
    """1-based batch of a 1-based index."""
    return (F.floor((index - 1) / size) + 1).cast("int")


def needs_recode(provider: Column) -> Column:
    """Chunks of these providers are clean already (fixed values)."""
    return ~F.lower(strip(F.coalesce(provider, F.lit("")))).isin("mistral", "csv")


def clean_chunks(chunks: DataFrame, cleaner: ChunkCleaner, provider: str = "texteocr_provider", tasks: int | None = None, pause: float = 2.0, report: bool = False) -> DataFrame:
    """Texts of chunks that need it pass the cleaner, those that fail once more; where it fails again the text stays.

    tasks: how many calls go on at a time (in the second pass too).  report: ``cleaned`` (the pass that did it, 0: none,
    null: not needed) and ``clean_error`` are columns of the result.  The two kinds are separate branches: a condition
    around a call would not keep the others out of it.
    """
    dirty, clean = chunks.where(needs_recode(F.col(provider))), chunks.where(~needs_recode(F.col(provider)))
    told = two_passes(dirty, "text", cleaner.clean, tasks, pause)
    own = [F.coalesce("answer", "text").alias("text") if c == "text" else F.col(f"`{c}`") for c in chunks.columns]
    extra = [F.col("pass").alias("cleaned"), F.col("error").alias("clean_error")]
    none = [F.lit(None).cast("int").alias("cleaned"), F.lit(None).cast("string").alias("clean_error")]
    return told.select(*own, *(extra if report else [])).unionByName(clean.select("*", *(none if report else [])))
