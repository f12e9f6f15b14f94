"""Operator 5, benchmark decontamination by a positional inverted index, in DataFrame operations alone.

``build_index`` stores one posting (term, rid, pos) for every document word that the benchmark uses, sorted by term
within each file so that a scan for a few terms skips the rest; documents stay where they were read, nothing is
shuffled.  A window's terms are ranked from the rarest in the corpus.  ``phrase_matches`` starts with the postings of
each window's rarest term, moves them back by the term's offset, and intersects the moved lists of the next terms
with them; what is left after three terms is compared with all others.  ``proximity_matches`` asks only that terms
lie near one another.

The benchmark's vocabulary and windows are the small side.  They are counted, and broadcast only below
``BROADCAST_ROWS`` rows; beyond it the same joins are shuffled.

Defined results: A-Z are lower-cased; words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; null and empty texts have
no words and no hits and are not contaminated; an item without words, or with a null item_id, has no window; an item with
fewer than ``length`` words is one window; equal windows of several items count for each; rows are told apart
by their place (bytes that are not valid UTF-8 count as U+FFFD, which is part of words), so repeated and null doc_ids get results of their own; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table

#: Words before lower-casing: the same runs with A-Z in them.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 1_000_000
#: Terms of a window whose lists are intersected one by one before the rest is compared.
SEED_TERMS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The term number of the posting that holds a document's length.
LENGTH_TERM = 0


def raw_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(RAW_WORD), F.lit(0))


def lower_ascii(word: Column) -> Column:
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


@dataclass
class Benchmark:
    windows: DataFrame  # wid, length, items
    terms: DataFrame  # wid, offset, word
    vocabulary: DataFrame  # word, term


def read_benchmark(items: DataFrame, length: int) -> Benchmark:
    words = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item"), F.transform(raw_words(F.col("text")), lower_ascii).alias("words")).where("size(words) > 0")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - length, F.lit(0)))
    cut = words.select("item", "words", F.explode(starts).alias("s")).select("item", F.slice("words", F.col("s") + 1, F.lit(length)).alias("words"))
    windows = cut.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.monotonically_increasing_id().alias("wid"), F.size("words").alias("length"), "items", "words")
    windows = stage(windows, "windows")
    terms = windows.select("wid", F.posexplode("words").alias("offset", "word"))
    vocabulary = stage(terms.select("word").distinct().select("word", (F.monotonically_increasing_id() + 1).alias("term")), "vocabulary")
    return Benchmark(windows.drop("words"), terms, vocabulary)


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, rid, pos, doc_id (of length postings only).  rid numbers the rows; the staged table fixes it."""
    known = small(vocabulary.unionByName(vocabulary.sparkSession.range(1).select(F.lit("").alias("word"), F.lit(LENGTH_TERM).cast("long").alias("term"))))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), raw_words(F.col("text")).alias("words"))
    each = rows.select("doc_id", "rid", F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
    found = each.select("doc_id", "rid", "pos", lower_ascii(F.col("word")).alias("word")).join(known, "word")
    return stage(found.select("term", "rid", "pos", F.when(F.col("term") == LENGTH_TERM, F.col("doc_id")).alias("doc_id")).sortWithinPartitions("term", "rid", "pos"), "postings")


def ranked_terms(bench: Benchmark, index: DataFrame) -> DataFrame:
    """wid, length, offset, term, rank: from the rarest; windows with a term the corpus lacks are left out."""
    counts = stage(index.where(F.col("term") != LENGTH_TERM).groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    known = bench.terms.join(bench.vocabulary, "word").join(counts, "term", "left")
    # per window: an array of at most `length` structs, sorted; no window function, no large group
    lists = known.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("terms"))
    lists = lists.where(F.col("terms")[0]["n"] > 0)
    flat = lists.select("wid", F.size("terms").alias("length"), F.posexplode("terms").alias("rank", "t"))
    return stage(flat.select("wid", "length", "rank", "t.offset", "t.term"), "ranked")


def phrase_matches(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """rid, wid, start, length of every occurrence of a window."""
    body = index.where(F.col("term") != LENGTH_TERM).select("term", "rid", "pos")
    first = ranked.where("rank = 0").select("term", "wid", "length", "offset")
    found = body.join(small(first), "term").select("rid", "wid", "length", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    for r in range(1, SEED_TERMS):
        found = stage(found, "intersected")
        next_terms = ranked.where(F.col("rank") == r).select("wid", "offset", "term")
        wanted = found.join(small(next_terms), "wid").select("rid", "wid", "length", "start", "term", (F.col("start") + F.col("offset")).cast("int").alias("pos"))
        lists = body.join(small(next_terms.select("term").distinct()), "term", "left_semi")
        found = wanted.join(lists, ["term", "rid", "pos"]).select("rid", "wid", "length", "start").unionByName(found.where(F.col("length") <= r).select("rid", "wid", "length", "start"))
    found = stage(found, "intersected")
    rest = ranked.where(F.col("rank") >= SEED_TERMS).select("wid", "offset", "term")
    wanted = found.where(F.col("length") > SEED_TERMS).join(small(rest), "wid").select("rid", "wid", "length", "start", "term", (F.col("start") + F.col("offset")).cast("int").alias("pos"))
    rids = found.select("rid").distinct()
    lists = body.join(small(rids), "rid", "left_semi")
    whole = wanted.join(lists, ["term", "rid", "pos"]).groupBy("rid", "wid", "start", "length").agg(F.count("*").alias("n")).where(F.col("n") == F.col("length") - SEED_TERMS)
    return whole.select("rid", "wid", "start", "length").unionByName(found.where(F.col("length") <= SEED_TERMS).select("rid", "wid", "start", "length"))


def proximity_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """pairs (pair, a, b: terms) -> pair, rid, pos_a, pos_b at most ``within`` words apart.

    Positions are cut into strips as wide as the distance; a posting meets only its own strip and the next ones.
    """
    body = index.where(F.col("term") != LENGTH_TERM)
    strip = F.floor(F.col("pos") / within)
    left = body.join(small(pairs.select("pair", F.col("a").alias("term"), "b")), "term").select("pair", "rid", F.col("b").alias("term"), F.col("pos").alias("pos_a"), F.explode(F.array(strip - 1, strip, strip + 1)).alias("strip"))
    right = body.select("rid", "term", F.col("pos").alias("pos_b"), strip.alias("strip"))
    return left.join(right, ["rid", "term", "strip"]).where(F.abs(F.col("pos_a") - F.col("pos_b")) <= within).select("pair", "rid", "pos_a", "pos_b")


def near_items(docs: DataFrame, items: DataFrame, within: int = 8, length: int = 13) -> DataFrame:
    """item (string), doc_id, rid, n_near, nearest: documents in which the two rarest terms of an item stand at most
    ``within`` words apart, how often, and how near.

    Looser than phrases: it finds items whose words were moved or changed between their telling terms.  Rarest are the
    terms with the fewest places in the documents (ties: the smaller word); terms that no document has do not count, and
    items with fewer than two terms have no pair.
    """
    bench = read_benchmark(items, length)
    index = build_index(docs, bench.vocabulary)
    counts = stage(index.where(F.col("term") != LENGTH_TERM).groupBy("term").agg(F.count("*").alias("n")), "term-counts")
    held = bench.windows.select("wid", F.explode("items").alias("item")).join(bench.terms.select("wid", "word"), "wid").select("item", "word").distinct()
    known = held.join(bench.vocabulary, "word").join(counts, "term")
    # two least of each item, kept while they are gathered: no item's terms become a list
    first = known.groupBy("item").agg(F.min(F.struct("n", "word", "term")).alias("a"))
    rest = known.join(first, "item").where(F.col("word") != F.col("a.word")).groupBy("item", "a").agg(F.min(F.struct("n", "word", "term")).alias("b"))
    pairs = stage(rest.select(F.col("item").alias("pair"), F.col("a.term").alias("a"), F.col("b.term").alias("b")), "pairs")
    met = proximity_matches(index, pairs, within).groupBy("pair", "rid").agg(F.count("*").alias("n_near"), F.min(F.abs(F.col("pos_a") - F.col("pos_b"))).alias("nearest"))
    ids = index.where(F.col("term") == LENGTH_TERM).select("rid", "doc_id")
    return met.join(ids, "rid").select(F.col("pair").alias("item"), "doc_id", "rid", "n_near", "nearest")


def benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the two rarest terms of a benchmark item near one another."""
    return near_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item", "doc_id", "n_near", "nearest")


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 13, share: int = 20) -> DataFrame:
    """doc_id, rid, n_words, n_hit, n_items, items (sorted), contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    bench = read_benchmark(items, length)
    index = build_index(docs, bench.vocabulary)
    hits = stage(phrase_matches(index, ranked_terms(bench, index)), "hits")
    reach = F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)
    n_hit = hits.select("rid", F.explode(reach).alias("pos")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    named = hits.select("rid", "wid").distinct().join(bench.windows, "wid").select("rid", F.explode("items").alias("item")).groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("items"))
    lengths = index.where(F.col("term") == LENGTH_TERM).select("rid", "doc_id", F.col("pos").cast("long").alias("n_words"))
    found = stage(n_hit.join(named, "rid"), "found")
    out = lengths.join(found, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items_or_none = F.coalesce("items", F.array().cast("array<string>"))
    return out.select("doc_id", "rid", "n_words", n_hit.alias("n_hit"), F.size(items_or_none).cast("long").alias("n_items"), items_or_none.alias("items"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
