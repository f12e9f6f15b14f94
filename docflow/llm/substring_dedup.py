"""Operator 1, substring dedup by seed and extend.

Seeds are winnowed anchors of ``gram`` words: every window of ``length`` words holds exactly one.  Documents are
joined on their anchors; each shared anchor is extended both ways as far as windows around it reach, first as a
whole (equal units are equal maximal stretches around the seed), then, where stretches around one seed differ,
window by window.  Windows that also start in a document with a smaller doc_id are joined into maximal repeats, all
at least ``length`` words long, and those words are removed.

Hashes only bring stretches and windows together; equal are those with equal 128-bit BLAKE2b digests of their words.

Defined results: a null or empty text has no words; a text shorter than ``length`` keeps everything; words keep
their spelling, valid UTF-8 or not; a null doc_id matches nothing and keeps everything; rows that repeat a doc_id count
as one document, each cut where its own windows stand in smaller doc_ids (equal rows are worked on once and get the same result); other input columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import ranges, repeated_units, word_digests, word_units
from .common import blocks, few, lean, once, parted, quoted, reduced, stage, table, undotted, unused
from .seeds import words_of

SPAN = "array<struct<start:int,count:int>>"


def expand(part: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, start + j) for j < count, row by row."""
    total = int(count.sum())
    at = np.repeat(np.cumsum(count) - count, count)
    return np.repeat(part, count), np.repeat(start, count) + np.arange(total) - at


def covered(n: int, starts, counts, length: int) -> np.ndarray:
    """Which of n symbols lie in a window that starts in one of the ranges."""
    step = np.zeros(n + 1, np.int32)
    s = np.clip(np.asarray(starts, np.int64), 0, n)
    e = np.clip(s + np.asarray(counts, np.int64) + length - 1, 0, n)
    np.add.at(step, s, 1)
    np.add.at(step, e, -1)
    return np.cumsum(step[:n]) > 0


def _window_rows(length: int):
    """Windows of open units: (doc_id, part, position, digest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            w = words_of([t or b"" for t in texts])
            lists = part.column("open")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            start, count = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "count"))
            row, pos = expand(owner, start.astype(np.int64), count.astype(np.int64))
            at = w.first[row] + pos
            ok = at + length <= w.first[row + 1]
            row, pos, at = pa.array(row[ok]), pos[ok], at[ok]
            if len(row):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(row), part.column("part").take(row), pa.array(pos.astype(np.int32)), pa.array(word_digests(w, at, at + length), pa.binary())], names=["doc_id", "part", "start", "win"])

    return run


def removed_runs(n: int, marks: list[dict], length: int) -> list[dict]:
    """Maximal runs (start, count) of n symbols that lie in a marked window."""
    gone = covered(n, [m["start"] for m in marks], [m["count"] for m in marks], length)
    edge = np.flatnonzero(np.diff(gone.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return [{"start": int(a), "count": int(b - a)} for a, b in zip(edge[0::2], edge[1::2])]


def outside(items, runs: list[dict]) -> list:
    """The slices of items between the runs."""
    out, at = [], 0
    for r in runs:
        out.append(items[at : r["start"]])
        at = r["start"] + r["count"]
    return [*out, items[at:]]


def repeat_marks(docs: DataFrame, length: int = 50, gram: int = 20) -> DataFrame:
    """Of docs (doc_id, part, text): doc_id, part, marks; a mark is a run of window starts that also start in a document
    with a smaller doc_id."""
    if not 0 < gram <= length:
        raise ValueError("gram must lie between 1 and length")
    found = repeated_units(docs, word_units, length, gram, across=True)
    still = found.where("size(open) > 0")
    lists = still.groupBy("doc_id", "part").agg(F.flatten(F.collect_list(ranges("open"))).alias("open"))
    texts = reduced(docs, still.select("doc_id").distinct(), "doc_id").join(lists, ["doc_id", "part"])
    windows = stage(texts.mapInArrow(lean(_window_rows(length)), "doc_id long, part long, start int, win binary"), "windows")
    lows = stage(windows.groupBy("win").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"), "lows")
    late = windows.join(lows, "win").where("low < doc_id")
    runs = found.where("size(copies) > 0").select("doc_id", "part", ranges("copies").alias("runs"))
    both = runs.unionByName(late.select("doc_id", "part", F.array(F.struct("start", F.lit(1).alias("count"))).alias("runs")))
    return stage(both.groupBy("doc_id", "part").agg(F.flatten(F.collect_list("runs")).alias("marks")), "marks")


def cut_texts(docs: DataFrame, length: int = 50, gram: int = 20, n_chars: str | None = None) -> DataFrame:
    """The rows of docs (any columns, among them doc_id and text) with repeated passages cut out of the text; a text that
    loses nothing stays as it is, the words of any other are joined by one space.  n_chars: a column that is to hold
    the new texts' lengths.

    Rows that lose nothing neither move nor pass through Python.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    own, part_of, marked = (unused(n, names) for n in ("own_id", "own_part", "own_marks"))
    told = parted(docs.withColumn(own, F.col("doc_id").cast("long")), own, part_of)
    keyed = told.select(F.col(own).alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(part_of).alias("part"), F.col(f"{part_of}_again").alias("part_again"))
    marks = repeat_marks(once(keyed), length, gram)
    marks = marks.withColumnsRenamed({"doc_id": own, "part": part_of, "marks": marked})
    text, safe = names.index("text"), undotted(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            kept = []
            for t, found in zip(texts, part.column(marked).to_pylist()):
                words = (t or b"").split()
                kept.append(b" ".join(w for piece in outside(words, removed_runs(len(words), found, length)) for w in piece))
            columns = [part.column(i) for i in range(len(names))]
            columns[text] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=safe)

    schema = ", ".join(f"{q} {'binary' if c == 'text' else kinds[c]}" for c, q in zip(names, quoted(safe)))
    keys = few(marks.select(own, part_of))
    cut = told.join(keys, [own, part_of], "left_semi").join(marks, [own, part_of]).select(*quoted(names), marked).toDF(*safe, marked).mapInArrow(lean(run), schema).toDF(*names).withColumn("text", F.col("text").cast("string"))
    if n_chars:
        cut = cut.withColumn(n_chars, F.char_length("text").cast(kinds[n_chars]))
    return told.join(keys, [own, part_of], "left_anti").select(*quoted(names)).unionByName(cut)


def substring_dedup(docs: DataFrame, length: int = 50, gram: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, spans (maximal removed runs, in words), kept_text; one row per input row."""
    docs = parted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    marks = repeat_marks(once(docs), length, gram)
    marked = docs.join(few(marks.select("doc_id", "part")), ["doc_id", "part"], "left_semi").join(marks, ["doc_id", "part"])
    rest = docs.join(few(marks.select("doc_id", "part")), ["doc_id", "part"], "left_anti").withColumn("marks", F.lit(None).cast(SPAN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            n_words, spans, kept = [], [], []
            for t, marked in zip(texts, part.column("marks").to_pylist()):
                words = (t or b"").split()
                runs = removed_runs(len(words), marked, length) if marked else []
                n_words.append(len(words))
                spans.append(runs)
                kept.append(b" ".join(w for piece in outside(words, runs) for w in piece))
            n_removed = [sum(r["count"] for r in runs) for runs in spans]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("count", pa.int32())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "spans", "kept_text"],
            )

    schema = f"doc_id long, n_words long, n_removed long, spans {SPAN}, kept_text binary"
    out = marked.select("doc_id", "text", "marks").mapInArrow(lean(run), schema).unionByName(rest.select("doc_id", "text", "marks").mapInArrow(lean(run), schema))
    return out.withColumn("kept_text", F.col("kept_text").cast("string"))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))
