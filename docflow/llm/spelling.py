"""Operator 13, spelling variants by permuterm rotations.

A word of L code points, closed by a terminator, has L + 1 rotations.  A rotation's last character stands at the place
of a possible edit: words that differ there alone have rotations that agree but for the last character, and the word
without it has the agreeing part as a whole rotation.  So every rotation is listed twice, under its prefix that skips
the edited character and under itself; in the sorted list each prefix is a range, and its range is scanned:

* rotations that skip a character there are replacements of one another,
* a whole rotation there is what each of them becomes when the skipped character is deleted.

A range holds one row at most for each character, and one whole rotation, so ranges are bounded by the alphabet however
crowded a spelling is.  A scan emits one row for each member (how many neighbours, and the best of them), never pairs.
In a run of equal characters deleting any of them gives the same word: only the run's first counts.

Words are counted with map-side aggregation before anything is rotated, so a frequent word is one row.

Defined results: a null text has no words; a null doc_id counts as an empty one; a text that is not valid UTF-8 breaks
runs where it is broken; words that repeat count by occurrence; ties of form go to the smallest word in code-point
order; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Letters of a run, and what closes a word; the terminator is no letter.
LETTERS, END = "A-Za-zÀ-ÿ", "$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, slip: int = 31, least_length: int = 7, least_count: int = 2) -> DataFrame:
    """word, n: maximal runs of letters, A-Z lower-cased; of one in ``slip`` runs, by the checksum of doc_id and run, one
    letter is deleted.  (Runs shorter than least_length cannot reach it and are not taken up.)"""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("id", F.explode(runs).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", h.alias("h"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    rest = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.col("h") % slip == 0, rest).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def rotations(words: DataFrame) -> DataFrame:
    """word, n -> key, last, n: each rotation without its last letter (last), and each whole rotation (last is '')."""
    at = F.explode(F.sequence(F.lit(0), F.char_length("word")))
    turned = words.select("word", "n", at.alias("at"))
    marked = F.concat("word", F.lit(END))
    rotation = F.concat(F.substring(marked, F.col("at") + 1, F.char_length("word") + 1), F.substring("word", F.lit(1), F.col("at")))
    turned = turned.select(rotation.alias("rotation"), "n")
    # a rotation that ends with the terminator skips no letter
    ends = F.array(
        F.struct(F.col("rotation").alias("key"), F.lit("").alias("last")),
        F.struct(F.substring("rotation", F.lit(1), F.char_length("rotation") - 1).alias("key"), F.substring("rotation", -1, 1).alias("last")),
    )
    return turned.select(F.explode(ends).alias("e"), "n").where(f"e.last <> '{END}'").select("e.key", "e.last", "n")


def scanned(keys: pa.Array, last: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    """Whole ranges, in order -> for each member key, last, near_last, near_n, found: how many neighbours of one kind it
    has, and the best of them (most frequent, then smallest)."""
    turn = np.ones(len(n), bool)
    turn[1:] = np.asarray(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)))
    group = np.cumsum(turn) - 1
    shared = np.flatnonzero((np.bincount(group) > 1)[group])  # most ranges hold one row
    keys, last, n, group = keys.take(pa.array(shared)), last.take(pa.array(shared)), n[shared], group[shared]
    _, group = np.unique(group, return_inverse=True)
    whole = np.asarray(pc.equal(last, ""))
    letter = pc.dictionary_encode(last)
    rank = np.argsort(np.argsort(np.array(letter.dictionary.to_pylist(), dtype=object)))[letter.indices.to_numpy()] if len(n) else np.zeros(0, int)
    first = ~whole & ~np.asarray(pc.equal(pc.utf8_slice_codeunits(keys, -1), last))  # the first of a run of equal letters
    groups = int(group.max()) + 1 if len(group) else 0
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def best_two(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each range, how many of the rows it has, and the places of the best two (-1: none)."""
        at = np.flatnonzero(some)
        at = at[np.lexsort((rank[at], -n[at], group[at]))]
        count = np.bincount(group[at], minlength=groups)
        start = np.cumsum(count) - count
        one = np.where(count > 0, np.append(at, -1)[np.minimum(start, len(at))], -1)
        two = np.where(count > 1, np.append(at, -1)[np.minimum(start + 1, len(at))], -1)
        return count, one, two

    count, one, two = best_two(~whole)
    at = np.flatnonzero(~whole & (count[group] > 1))  # replacements
    out.append((at, np.where(one[group[at]] == at, two[group[at]], one[group[at]]), count[group[at]] - 1))
    short = np.full(groups, -1)
    short[group[whole]] = np.flatnonzero(whole)
    at = np.flatnonzero(first & (short[group] >= 0))  # one letter too many
    out.append((at, short[group[at]], np.ones(len(at), np.int64)))
    count, one, _ = best_two(first)
    at = np.flatnonzero(whole & (count[group] > 0))  # one letter too few
    out.append((at, one[group[at]], count[group[at]]))
    at, near, found = (np.concatenate(x).astype(np.int64) for x in zip(*out))
    mine, theirs = pa.array(at), pa.array(near)
    return pa.RecordBatch.from_arrays([keys.take(mine), last.take(mine), last.take(theirs), pa.array(n[near]), pa.array(found)], names=["key", "last", "near_last", "near_n", "found"])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of rotations -> what ``scanned`` says of every range; a range that a batch cuts waits for the next."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not len(batch):
            continue
        keys = batch.column("key")
        open_range = np.asarray(pc.equal(keys, keys[-1]))
        stop = len(batch) - int(open_range.sum())
        held = batch.slice(stop)
        if stop:
            yield scanned(keys.slice(0, stop), batch.column("last").slice(0, stop), batch.column("n").slice(0, stop).to_numpy())
    if held is not None and len(held):
        yield scanned(held.column("key"), held.column("last"), held.column("n").to_numpy())


def _word(last: str) -> Column:
    """The word that was turned: what follows the terminator, the skipped letter, what stands before it."""
    return F.concat(F.substring_index("key", END, -1), F.col(last), F.substring_index("key", END, 1))


def neighbours(words: DataFrame) -> DataFrame:
    """word, n (distinct words) -> word, n_near, near, near_n: how many words are one edit away, and the best of them."""
    listed = rotations(words).repartition("key").sortWithinPartitions("key")
    found = listed.mapInArrow(scan, "key string, last string, near_last string, near_n long, found long")
    near = found.select(_word("last").alias("word"), _word("near_last").alias("near"), "near_n", "found")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    return near.groupBy("word").agg(F.sum("found").alias("n_near"), best).select("word", "n_near", "best.near", (-F.col("best.order")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, form -> word, root: the last word of the chain of forms.  Each form is many times as frequent as its word,
    so chains end; each round doubles the steps taken, until nothing changes."""
    found = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = found.select(F.col("word").alias("at"), F.col("root").alias("further"))
        new = found.join(up, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        new = stage(new, "roots")
        found = new.select("word", "root")
        if new.where("moved").isEmpty():
            return found


def spelling_variants(docs: DataFrame, slip: int = 31, least_length: int = 7, least_count: int = 2, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root: a word's form is its most frequent neighbour, if that is ``times`` as frequent."""
    words = stage(word_counts(docs, slip, least_length, least_count), "words")
    near = words.join(neighbours(words), "word", "left")
    is_form = F.col("near_n") >= times * F.col("n")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"))
    near = stage(near, "neighbours")
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))
