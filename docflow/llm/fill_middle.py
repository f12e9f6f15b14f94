"""Operator 12, fill-in-middle transformation, as a pipeline of pyarrow.compute steps per batch.

A text is split into lines (each with its line break), the lists of lines are flattened beside the index of the text
they came from, and a line's ordinal within its text says whether it is prefix, middle or suffix.  Filtering by role and
rebuilding lists gives the lines of every part; ``binary_join`` makes parts of lines and documents of parts.  No step
looks at one text alone in Python.

Where the two cuts fall, and which form a document takes, comes from the SHA-256 of its doc_id and a seed, so a
document is transformed alike wherever and however often it is read.

Defined results: a null text is empty; an empty text, or one that holds a mark, stays plain; a null doc_id counts as an
empty one; rows that repeat a doc_id are cut by the same draws; bytes that are not valid UTF-8 stay as they are, a code
point being any byte that does not continue one; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, lean, quoted, table, undotted

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned numbers of 32 bits for each key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def lines(texts: pa.BinaryArray) -> tuple[pa.BinaryArray, np.ndarray]:
    """All lines of all texts with their line breaks, and the text each one is of."""
    pieces = pc.split_pattern(texts, b"\n")
    flat, parent = pieces.flatten(), pc.list_parent_indices(pieces).to_numpy()
    last = np.ones(len(parent), bool)
    last[:-1] = parent[1:] != parent[:-1]
    ended = pc.if_else(pa.array(last), pa.scalar(b"", pa.binary()), pa.scalar(b"\n", pa.binary()))
    whole = pc.binary_join_element_wise(flat, ended, pa.scalar(b"", pa.binary()))
    some = np.asarray(pc.greater(pc.binary_length(whole), 0))  # nothing follows a final line break
    return whole.filter(pa.array(some)), parent[some]


def joined(units: pa.BinaryArray, parent: np.ndarray, role: np.ndarray, n: int) -> pa.BinaryArray:
    """Of each of n texts, the units of the role, joined."""
    offsets = np.zeros(n + 1, np.int32)
    np.cumsum(np.bincount(parent[role], minlength=n), out=offsets[1:])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), units.filter(pa.array(role))), b"")


def code_points(x: pa.BinaryArray) -> pa.Array:
    data = np.frombuffer(x.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    seen = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    return pa.array(seen[at[1:]] - seen[at[:-1]])


def rows_as_lists(*pieces) -> pa.ListArray:
    """Row by row, the pieces (arrays or one value for all) as a list."""
    n = max(len(p) for p in pieces if isinstance(p, pa.Array))
    full = [p if isinstance(p, pa.Array) else pa.array([p] * n, pa.binary()) for p in pieces]
    order = np.arange(n * len(full)).reshape(len(full), n).T.ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(full) + 1, len(full), dtype=np.int32)), pa.concat_arrays(full).take(pa.array(order)))


def arrange(texts: pa.BinaryArray, cuts: np.ndarray, percent: np.ndarray, shares: tuple[int, int], marks: list[bytes]) -> list[pa.Array]:
    """n, form, prefix_chars, middle_chars, output of each text.  cuts: the two draws of the cuts; percent: those of
    whether to cut at all and of the form; shares: the percentages of cut texts, and of those in spm form."""
    units, parent = lines(texts)
    rows = len(texts)
    n = np.bincount(parent, minlength=rows)
    ordinal = np.arange(len(parent)) - np.repeat(np.cumsum(n) - n, n)
    low, high = np.sort(cuts % (n + 1), axis=0)
    prefix = ordinal < low[parent]
    suffix = ordinal >= high[parent]
    parts = {k: joined(units, parent, role, rows) for k, role in (("prefix", prefix), ("middle", ~prefix & ~suffix), ("suffix", suffix))}
    plain = (n == 0) | (percent[0] % 100 >= shares[0])
    for mark in marks:
        plain |= np.asarray(pc.match_substring(texts, mark))
    spm = percent[1] % 100 < shares[1]
    p, s, m = marks
    psm = pc.binary_join(rows_as_lists(p, parts["prefix"], s, parts["suffix"], m, parts["middle"]), b"")
    other = pc.binary_join(rows_as_lists(s, parts["suffix"], p, parts["prefix"], m, parts["middle"]), b"")
    form = pc.if_else(pa.array(plain), "plain", pc.if_else(pa.array(spm), "spm", "psm"))
    output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(spm), other, psm))
    none = pa.scalar(None, pa.int64())
    return [pa.array(n.astype(np.int64)), form, *(pc.if_else(pa.array(plain), none, code_points(parts[k])) for k in ("prefix", "middle")), output]


def fill_in_middle(docs: DataFrame, seed: int = 7, cut_percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output; one row per row."""
    coded = [m.encode() for m in marks]
    if len(set(marks)) < 3 or any(not m or m != o and m in o or any(o.startswith(m[i:]) for i in range(1, len(m))) for m in marks for o in marks):
        raise ValueError("the marks must differ, and none may be empty, hold another or end as one begins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            h = [part.column(f"h{i}").to_numpy() for i in range(4)]
            found = arrange(pa.array([t or b"" for t in texts], pa.binary()), np.stack(h[:2]), np.stack(h[2:]), (cut_percent, spm_percent), coded)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *found], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    drawn = [h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *drawn)
    return rows.mapInArrow(lean(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def piece(found: pa.ListArray, i: int) -> pa.Array:
    """Part i of lists that may be shorter."""
    at = pc.add(found.offsets.slice(0, len(found)), i)
    return found.values.take(pc.if_else(pc.less(at, found.offsets.slice(1)), at, pa.scalar(None, pa.int32())))


def rebuild(output: pa.BinaryArray, form: pa.StringArray, marks: list[bytes]) -> pa.Array:
    """The texts, from outputs and forms alone."""
    p, s, m = marks
    head = pc.split_pattern(output, p, max_splits=1)  # psm: "", rest; spm: mark + suffix, rest
    rest = piece(head, 1)
    cut = pc.split_pattern(rest, s, max_splits=1)
    tail = pc.split_pattern(piece(cut, 1), m, max_splits=1)
    psm = (piece(cut, 0), piece(tail, 1), piece(tail, 0))
    ends = pc.split_pattern(rest, m, max_splits=1)
    spm = (piece(ends, 0), piece(ends, 1), piece(pc.split_pattern(piece(head, 0), s, max_splits=1), 1))
    pick = lambda x, y: pc.if_else(pc.equal(form, "psm"), x, y)
    whole = pc.binary_join(rows_as_lists(*(pick(x, y) for x, y in zip(psm, spm))), b"")
    return pc.if_else(pc.equal(form, "plain"), output, whole)


def restore(cut: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(output, form, any more columns) -> the same with ``restored``, the exact text that was cut."""
    coded = [m.encode() for m in marks]
    others = [c for c in cut.columns if c != "restored"]
    kinds, safe = dict(cut.dtypes), undotted(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "output"):
            columns = [part.column(i) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*columns, rebuild(pa.array(texts, pa.binary()), part.column("form"), coded)], names=[*safe, "restored"])

    schema = ", ".join(f"{q} {kinds[c]}" for c, q in zip(others, quoted(safe)))
    return cut.select(*quoted(others)).toDF(*safe).mapInArrow(lean(run), f"{schema}, restored binary").toDF(*others, "restored")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
