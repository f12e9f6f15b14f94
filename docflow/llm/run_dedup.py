"""Operator 10, suffix-array dedup with run-length indexes.

Every window of ``length`` bytes has one winnowed anchor (seeds.py).  Anchors that occur once drop out in one
aggregation.  Maximal stretches around shared anchors that are equal as a whole are copies of the earliest; the
different stretches around one anchor meet in one block, where a run-length index (run_index.py) is built over them
and their matching statistics are streamed: windows whose match elsewhere reaches ``length`` and that are not the
earliest of their kind are removed.

Blocks are bounded.  Around an anchor with more than ``most_units`` different stretches, the windows are split by their
distance to the anchor into halves; the windows of a half share more bytes than the anchor, and these bytes are
their new, rarer anchor.  Equal windows have equal distances and equal bytes, so they stay together; copies are found
again among the shorter stretches, and what is still crowded is split again, at most until every window is its own
anchor (6 times for 100 bytes).

Defined results: a null or empty text has 0 bytes; texts shorter than ``length`` keep everything; a null doc_id
matches nothing; rows that repeat a doc_id count as one document (the same place is not earlier than itself), each
cut by its own bytes (equal rows are worked on once); ``length`` is at least 7 bytes; other input columns are ignored.  Kept bytes may split a UTF-8 character, so they are returned as
binary.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import UNIT_SCHEMA, byte_units, ranges, repeated_units, told, unit_rows
from .common import blocks, few, lean, once, parted, reduced, stage, table
from .run_index import repeated
from .seeds import digests
from .substring_dedup import SPAN, outside, removed_runs

#: Bytes of one index: small enough for the CPU's caches.
INDEX_BYTES = 1 << 19
PIECE = "anchor long, doc_id long, start int, count int, piece binary, part long"


def halves(width: int, level: int) -> list[tuple[int, int]]:
    """The ranges of distances 0..width - 1 after so many halvings."""
    found = [(0, width - 1)]
    for _ in range(level):
        found = [x for a, b in found for x in (((a, (a + b) // 2), ((a + b) // 2 + 1, b)) if a < b else ((a, b),))]
    return found


def _with_units(docs: DataFrame, units: DataFrame) -> DataFrame:
    """doc_id, part, text, open (the list of a row's units) of the rows that have units."""
    lists = units.groupBy("doc_id", "part").agg(F.flatten(F.collect_list(ranges("open", "anchor", "lead"))).alias("open"))
    return reduced(docs, units.select("doc_id").distinct(), "doc_id").join(lists, ["doc_id", "part"])


def _opened(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, and anchor, start, count and lead of each open unit of a batch."""
    lists = part.column("open")
    flat = lists.flatten()
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), *(flat.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "start", "count", "lead"))


def _split(length: int, gram: int, level: int):
    """Units of one level -> their parts in the ranges of distances of the next."""
    distances = halves(length - gram + 1, level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            row, _, start, count, lead = _opened(part)
            base = np.cumsum([0, *(len(t or b"") for t in texts)])
            whole = b"".join(t or b"" for t in texts)
            for low, high in distances:
                far, near = np.minimum(lead, high), np.maximum(lead - count + 1, low)  # distances of the first and last window
                some = np.flatnonzero(far >= near)
                if not len(some):
                    continue
                f, n = far[some].astype(np.int64), near[some].astype(np.int64)
                at = start[some].astype(np.int64) + lead[some]  # of the anchor, in its text
                begin = base[row[some]] + at
                shared = digests(whole, begin - low, begin - high + length)
                anchor = np.array([int.from_bytes(k[:8], "little", signed=True) ^ (level << 8 | low) for k in shared], np.int64)
                yield unit_rows(part, row[some], at - f, f - n + 1, f, anchor, digests(whole, begin - f, begin - n + length))

    return run


def _pieces(length: int):
    """The bytes of open units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            row, anchor, start, count, _ = _opened(part)
            if len(row):
                pieces = [texts[r][s : s + n - 1 + length] for r, s, n in zip(row.tolist(), start.tolist(), count.tolist())]
                r = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), part.column("doc_id").take(r), pa.array(start), pa.array(count), pa.array(pieces, pa.binary()), part.column("part").take(r)], names=["anchor", "doc_id", "start", "count", "piece", "part"])

    return run


def _indexed(length: int):
    """Pieces sorted by (anchor, doc_id, start) -> runs of windows that also start earlier."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        pieces, doc, base, part = t.column("piece").to_pylist(), t.column("doc_id").to_numpy(), t.column("start").to_numpy(), t.column("part").to_numpy()
        # a repeated row brings the same place twice; sorted, the two are neighbours
        once = [i for i in range(len(pieces)) if not i or (doc[i], base[i], pieces[i]) != (doc[i - 1], base[i - 1], pieces[i - 1])]
        pieces, doc, base, part = [pieces[i] for i in once], doc[once], base[once], part[once]
        text, start = repeated(pieces, length)
        head = np.ones(len(text), bool)
        head[1:] = (text[1:] != text[:-1]) | (start[1:] != start[:-1] + 1)
        at = np.flatnonzero(head)
        count = np.diff(np.append(at, len(text)))
        return pa.RecordBatch.from_arrays([pa.array(doc[text[at]], pa.int64()), pa.array(part[text[at]], pa.int64()), pa.array((base[text[at]] + start[at]).astype(np.int32)), pa.array(count.astype(np.int32))], names=["doc_id", "part", "start", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # whole anchors only
        for batch in batches:
            anchor = batch.column("anchor").to_numpy()
            cut = [0, *(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), len(anchor)]
            sizes = np.append(0, np.cumsum([len(x) for x in batch.column("piece").to_pylist()]))
            last = held[-1].column("anchor")[-1].as_py() if held else None
            begin = 0
            for a, b in zip(cut, cut[1:]):
                if size >= INDEX_BYTES and not (a == 0 and last == anchor[0]):
                    if a > begin:
                        held.append(batch.slice(begin, a - begin))
                    yield solve(held)
                    held, size, begin = [], 0, a
                size += int(sizes[b] - sizes[a])
            if len(anchor) > begin:
                held.append(batch.slice(begin))
        if held:
            yield solve(held)

    return run


def _removal(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            spans = [removed_runs(len(t or b""), marks, length) if marks else [] for t, marks in zip(texts, part.column("marks").to_pylist())]
            kept = [b"".join(outside(t or b"", runs)) for t, runs in zip(texts, spans)]
            n_removed = [sum(r["count"] for r in runs) for runs in spans]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
            )

    return run


def repeated_ranges(docs: DataFrame, length: int, gram: int, most_units: int) -> DataFrame:
    """doc_id, part, runs: lists of runs (start, count) of window starts whose window also starts earlier."""
    width, level = length - gram + 1, 0
    found = repeated_units(docs, byte_units, length, gram, across=False)
    copies, open_units = [], []
    while True:
        copies.append(found.where("size(copies) > 0").select("doc_id", "part", ranges("copies").alias("runs")))
        still = found.where("size(open) > 0")
        last = all(a == b for a, b in halves(width, level))
        open_units.append(still if last else still.where(F.col("n") <= most_units))
        crowded = still.where(F.col("n") > most_units)
        if last or crowded.isEmpty():
            break
        level += 1
        found = told(stage(_with_units(docs, crowded).mapInArrow(lean(_split(length, gram, level)), UNIT_SCHEMA), "split"), across=False)
    pieces = stage(_with_units(docs, reduce(DataFrame.unionByName, open_units)).mapInArrow(lean(_pieces(length)), PIECE), "pieces")
    indexed = pieces.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start").mapInArrow(lean(_indexed(length)), "doc_id long, part long, start int, count int")
    return reduce(DataFrame.unionByName, copies).unionByName(indexed.select("doc_id", "part", F.array(F.struct("start", "count")).alias("runs")))


def run_dedup(docs: DataFrame, length: int = 100, gram: int = 48, most_units: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs, in bytes), kept (binary); one row per input row.

    most_units bounds a block, not the result.
    """
    docs = parted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    found = repeated_ranges(once(docs), length, gram, most_units)
    marks = stage(found.groupBy("doc_id", "part").agg(F.flatten(F.collect_list("runs")).alias("marks")), "marks")
    keys, schema = few(marks.select("doc_id", "part")), f"doc_id long, n_bytes long, n_removed long, spans {SPAN}, kept binary"
    cut = docs.join(keys, ["doc_id", "part"], "left_semi").join(marks, ["doc_id", "part"])
    rest = docs.join(keys, ["doc_id", "part"], "left_anti").withColumn("marks", F.lit(None).cast(SPAN))
    both = (x.select("doc_id", "text", "marks").mapInArrow(lean(_removal(length)), schema) for x in (cut, rest))
    return reduce(DataFrame.unionByName, both)


def op10_run_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = run_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
