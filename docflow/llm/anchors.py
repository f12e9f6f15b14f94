"""Repeated windows found through winnowed anchors: the part that substring and byte-run dedup share.

Rows per document are units (see seeds.py), about two for every ``length - gram + 2`` symbols.  An anchor
that occurs once drops out after one aggregation with map-side combine; only units of shared anchors meet
again.  No step lists pairs of documents: groups of copies of any size cost rows in proportion to the rows
they have.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_signed, blocks, lean, stage
from .seeds import Units, Words, byte_symbols, digests, units_of, words_of

#: A row stands for all places (starts, ascending) of one unit in one text.
UNIT_SCHEMA = "doc_id long, part long, starts array<int>, count int, lead int, anchor long, unit binary"


def word_units(texts: list, length: int, gram: int, digest: bool) -> tuple[Units, list | None]:
    """Units over words, and (if asked for) digests of their words joined by a space."""
    w = words_of([t or b"" for t in texts])
    u = units_of(w.hashes, w.first, length, gram)
    return u, word_digests(w, u.begin, u.begin + u.count - 1 + length) if digest else None


def word_digests(w: Words, start: np.ndarray, stop: np.ndarray) -> list[bytes]:
    """Digests of words start..stop - 1, joined by a space."""
    ends = np.cumsum(w.end - w.start + 1) - 1  # of each word in the spelled-out bytes
    begins = ends - (w.end - w.start)
    return digests(b" ".join(w.words), begins[start], ends[stop - 1])


def byte_units(texts: list, length: int, gram: int, digest: bool) -> tuple[Units, list | None]:
    texts = [t or b"" for t in texts]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=first[1:])
    whole = b"".join(texts)
    u = units_of(byte_symbols(np.frombuffer(whole, np.uint8)), first, length, gram)
    return u, digests(whole, u.begin, u.begin + u.count - 1 + length) if digest else None


def find_anchors(docs: DataFrame, units: Callable, length: int, gram: int) -> DataFrame:
    """doc_id, anchor of every unit of every text; a null doc_id has none (it matches nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            u, _ = units(texts, length, gram, False)
            if len(u.doc):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[u.doc], pa.int64()), pa.array(as_signed(u.anchor))], names=["doc_id", "anchor"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(lean(run), "doc_id long, anchor long")


def unit_rows(part: pa.RecordBatch, row: np.ndarray, start: np.ndarray, count: np.ndarray, lead: np.ndarray, anchor: np.ndarray, keys: list[bytes]) -> pa.RecordBatch:
    """Units of the texts in part as rows of UNIT_SCHEMA: the places of equal units of one text are gathered before any
    shuffle, so a line that a text repeats costs one row.  keys: 16-byte digests."""
    high, low = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2).T
    same = (row, anchor, high, low, count, lead)
    order = np.lexsort((start, *same[::-1]))
    head = np.ones(len(order), bool)
    head[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in same], axis=0)
    at = np.flatnonzero(head)
    one = order[at]
    starts = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)), pa.array(start[order].astype(np.int32)))
    rows = pa.array(row[one])
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id").take(rows), part.column("part").take(rows), starts, pa.array(count[one].astype(np.int32)), pa.array(lead[one].astype(np.int32)), pa.array(anchor[one]), pa.array([keys[i] for i in one.tolist()], pa.binary())],
        names=["doc_id", "part", "starts", "count", "lead", "anchor", "unit"],
    )


def find_units(docs: DataFrame, units: Callable, length: int, gram: int) -> DataFrame:
    """One row for each different unit of every text, with its places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            u, keys = units(texts, length, gram, True)
            if len(u.doc):
                yield unit_rows(part, u.doc, u.start, u.count, u.lead, as_signed(u.anchor), keys)

    return docs.where("doc_id is not null").select("doc_id", "part", "text").mapInArrow(lean(run), UNIT_SCHEMA)


def repeated_units(docs: DataFrame, units: Callable, length: int, gram: int, across: bool) -> DataFrame:
    """Units of docs (doc_id, part, text) that may hold repeated windows, as ``told`` sorts them out.

    across: only other documents count, and order is that of doc_id; else order is (doc_id, start).
    """
    lows = find_anchors(docs, units, length, gram).groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    # staged: joined to a plain scan, a crowded anchor's rows can be split over tasks (an aggregate's output cannot)
    shared = stage(lows.where("low < high" if across else "n > 1").select("anchor"), "anchors")
    return told(stage(find_units(docs, units, length, gram).join(shared, "anchor"), "units"), across)


def told(met: DataFrame, across: bool) -> DataFrame:
    """Staged units -> doc_id, part, anchor, count, lead, n (how many different units share the anchor; null: one) and, of
    each unit's places, ``copies``, before which the same unit stands, and ``open``, the others.  Places that are no
    copies and whose anchor stands in no different unit are left out: their windows stand nowhere else.
    """
    place = F.col("doc_id") if across else F.struct("doc_id", F.get("starts", F.lit(0)).alias("start"))
    leaders = stage(met.groupBy("anchor", "unit").agg(F.min(place).alias("first")), "leaders")
    varied = stage(leaders.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"), "varied")
    known = stage(leaders.join(varied, "anchor", "left"), "told")
    if across:
        late = lambda s: F.col("first") < F.col("doc_id")
    else:
        late = lambda s: (F.col("first.doc_id") < F.col("doc_id")) | ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.start") < s))
    # each unit meets the one row of its class
    units = met.join(known, ["anchor", "unit"])
    opened = F.when(F.col("n").isNotNull(), F.filter("starts", lambda s: ~late(s))).otherwise(F.array().cast("array<int>"))
    marked = units.select("doc_id", "part", "anchor", "count", "lead", "n", F.filter("starts", late).alias("copies"), opened.alias("open"))
    return stage(marked, "repeats").where("size(copies) > 0 or size(open) > 0")


def ranges(starts: str, *more: str) -> Column:
    """A column of starts as structs with the unit's count (and more of its columns)."""
    return F.transform(starts, lambda s: F.struct(s.alias("start"), "count", *more))
