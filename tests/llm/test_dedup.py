import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.llm import anchors, links
from docflow.llm import minhash_dedup as M
from docflow.llm.components import components
from docflow.llm.run_dedup import run_dedup
from docflow.llm.run_index import build, matching_statistics, repeated
from docflow.llm.seeds import units_of, words_of
from docflow.llm.substring_dedup import substring_dedup


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("length,gram", [(50, 20), (8, 3), (5, 5)])
def test_substring_dedup_equals_brute_force(spark, length, gram):
    rows = brute.awkward_rows()
    got = substring_dedup(brute.awkward(spark), length, gram).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert rows_of(got) == Counter(brute.substring(rows, length))


def test_substring_dedup_of_an_empty_table(spark):
    assert substring_dedup(brute.empty(spark)).count() == 0


def thue_morse(n: int) -> tuple[str, str]:
    """Two different words on which every polynomial hash modulo 2**64 agrees."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_that_collide_in_polynomial_hashes(spark):
    x, y = thue_morse(2048)
    words = brute.numbered(49).split()
    rows = [(1, " ".join([*words[:20], x, *words[20:]])), (2, " ".join([*words[:20], y, *words[20:]])), (3, x), (4, y)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert substring_dedup(docs).where("n_removed > 0").count() == 0
    assert {r.doc_id: r.component_id for r in M.minhash_dedup(docs).collect()}[4] == 4
    assert rows_of(M.minhash_dedup(docs).select("doc_id", "n_shingles", "component_id")) == Counter(brute.near_components(rows))


def test_repeated_doc_ids_with_other_texts(spark):
    passage, other = brute.numbered(60), brute.numbered(70, 500)
    rows = [(1, passage), (1, other), (2, passage), (3, other.replace("w530 ", "new ")), (3, "x " + passage + " y"), (4, "alone"), (4, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert rows_of(got) == Counter(brute.substring(rows, 50))
    got = run_dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    assert rows_of(got) == Counter(brute.byte_runs(rows, 100))
    near = [(1, other), (1, passage), (2, passage), (3, other + " end")]
    for some in (near, near[::-1], rows):
        docs = spark.createDataFrame(some, "doc_id long, text string")
        got = M.minhash_dedup(docs).select("doc_id", "n_shingles", "component_id")
        assert rows_of(got) == Counter(brute.near_components(some))


def test_texts_that_are_not_utf8(spark):
    docs = spark.createDataFrame([(1, b"\xff " + brute.numbered(60).encode()), (2, b"\xfe " + brute.numbered(60).encode()), (3, b"\xff")], "doc_id long, text binary").selectExpr("doc_id", "cast(text as string) AS text")
    got = {r.doc_id: r for r in substring_dedup(docs).selectExpr("doc_id", "n_removed", "cast(kept_text as binary) AS kept").collect()}
    assert (got[1].n_removed, got[2].n_removed, bytes(got[2].kept), bytes(got[3].kept)) == (0, 60, b"\xfe", b"\xff")
    assert run_dedup(docs).where("n_removed > 0").count() == 1
    assert M.minhash_dedup(docs).count() == 3


def test_random_word_repeats(spark):
    random.seed(5)
    rows = [(i, " ".join(random.choice("ab") for _ in range(random.randint(0, 60)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(docs, 10, 4).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256))
    assert rows_of(got) == Counter(brute.substring(rows, 10))


@pytest.mark.parametrize("most_units", [1024, 2, 1])
def test_run_dedup_equals_brute_force(spark, most_units):
    """Blocks of any size, and stretches split as far as it goes, give the same result."""
    rows = brute.awkward_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = run_dedup(docs, 100, 48, most_units).select("doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256))
    # rows that repeat a doc_id are one document: the same place is not earlier than itself
    assert rows_of(got) == Counter(brute.byte_runs(rows, 100))
    assert run_dedup(brute.empty(spark)).count() == 0


def test_run_index_matches_brute_force():
    random.seed(2)
    for _ in range(40):
        base = [bytes(random.choice(b"ab") for _ in range(200)) for _ in range(2)] + [b"a" * 150]
        texts = []
        for _ in range(random.randint(1, 8)):
            t = bytearray(random.choice(base))
            if random.random() < 0.5:
                t[random.randrange(len(t))] = ord("c")
            texts.append(bytes(t[random.randint(0, 30) :]))
        seen, want = set(), set()
        for i, t in enumerate(texts):
            for s in range(len(t) - 59):
                if t[s : s + 60] in seen:
                    want.add((i, s))
                seen.add(t[s : s + 60])
        assert set(zip(*(x.tolist() for x in repeated(texts, 60)))) == want


def test_repetitive_text_has_few_runs():
    symbols = np.append(np.frombuffer(b"abcdefgh" * 200, np.uint8).astype(np.int64) + 1, 0)
    index = build(symbols, 1600)
    assert index.n_runs < 40
    assert matching_statistics(index, len(symbols))[0] == 1592


def test_windows_have_one_anchor_by_content():
    w = words_of([brute.numbered(200).encode(), b"x y " + brute.numbered(200).encode()])
    u = units_of(w.hashes, w.first, 50, 20)
    assert sum(u.count[u.doc == 0]) == 151 and sum(u.count[u.doc == 1]) == 153
    assert set(u.anchor[u.doc == 0]) <= set(u.anchor[u.doc == 1])


def test_minhash_dedup_equals_brute_force(spark):
    rows = brute.awkward_rows()
    got = M.minhash_dedup(brute.awkward(spark))
    assert rows_of(got.select("doc_id", "n_shingles", "component_id")) == Counter(brute.near_components(rows))
    assert all(r.kept == (r.component_id == r.doc_id) for r in got.collect())
    assert M.minhash_dedup(brute.empty(spark)).count() == 0


def test_near_copies_in_blocks(spark, monkeypatch):
    """A group of near copies around the threshold, with blocks so small that all ways of comparing are used."""
    monkeypatch.setattr(links, "BLOCK", 7)
    random.seed(4)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(60):
        t = list(base)
        for _ in range(random.choice([0, 1, 2, 3, 5])):
            t[random.randrange(len(t))] = f"u{random.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = M.minhash_dedup(docs).select("doc_id", "n_shingles", "component_id")
    assert rows_of(got) == Counter(brute.near_components(rows))


def test_a_family_of_many_components(spark, monkeypatch):
    """Texts near one another by signature, most under the threshold, a few links among them off the bucket's smallest."""
    monkeypatch.setattr(links, "BLOCK", 5)
    random.seed(8)
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(40):
        t = list(base)
        for at in (10, 80, 150):
            t[at + i // 2] = f"u{i // 2}x{at}"
        if i % 2:
            t[60] = f"odd{i}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = Counter(brute.near_components(rows))
    assert 5 < len({r[2] for r in want}) < 40
    assert rows_of(M.minhash_dedup(docs).select("doc_id", "n_shingles", "component_id")) == want


def test_overlaps_in_strips():
    a = [np.array([1, 2, 3], np.uint64), np.array([9], np.uint64)]
    b = [np.array([2, 3, 4], np.uint64), np.array([7], np.uint64), np.array([9, 1], np.uint64)]
    assert links.overlaps(a, b, most_cells=1).tolist() == [[2, 0, 1], [0, 0, 1]]


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(5, 5), (None, 3)], "a long, b long")
    assert rows_of(components(links)) == Counter((i, i // 10 * 10) for i in range(41) if i != 40)


def test_components_of_a_long_shuffled_chain(spark):
    """Rounds grow with the logarithm of a chain's length, whatever the order of its ids."""
    ids = list(range(1000))
    random.Random(3).shuffle(ids)
    chains = [ids, list(range(1999, 999, -1))]
    links = spark.createDataFrame([p for c in chains for p in zip(c, c[1:])], "a long, b long")
    assert rows_of(components(links)) == Counter((i, i // 1000 * 1000) for i in range(2000))


def test_equal_units_of_a_text_are_one_row():
    line = " ".join(f"w{i}" for i in range(70)) + " "
    texts = [(line * 8).encode(), b"short", (line * 2).encode()]
    units, keys = anchors.word_units(texts, 50, 20, True)
    part = pa.record_batch({"doc_id": [7, 8, 9], "part": [0, 0, 0]})
    rows = anchors.unit_rows(part, units.doc, units.start, units.count, units.lead, units.anchor.view("int64"), keys).to_pylist()
    assert len(rows) < len(keys) and len({(r["doc_id"], r["anchor"], r["unit"]) for r in rows}) == len(rows)
    assert all(r["starts"] == sorted(r["starts"]) for r in rows)
    places = sorted((r["doc_id"], s, r["count"], r["lead"], r["unit"]) for r in rows for s in r["starts"])
    assert places == sorted(zip([[7, 8, 9][d] for d in units.doc], units.start.tolist(), units.count.tolist(), units.lead.tolist(), keys))


@pytest.mark.parametrize("length", [7, 13, 30, 56, 113, 240])
def test_indexed_windows_of_any_length(length):
    rng = random.Random(length)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 700))) for _ in range(6)]
    texts += [texts[0] + texts[1][:300], texts[2], b"x" * 600, b"ab" * 200]
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for s in range(len(t) - length + 1):
            if t[s : s + length] in seen:
                want.add((i, s))
            seen.add(t[s : s + length])
    text, start = repeated(texts, length)
    assert set(zip(text.tolist(), start.tolist())) == want
    with pytest.raises(ValueError):
        repeated(texts, 6)


@pytest.mark.parametrize("dedup", [substring_dedup, run_dedup])
def test_repeated_rows_cost_in_proportion(spark, dedup):
    """A row that is there 100,000 times, whose 300 words also stand in a smaller doc_id."""
    text = brute.numbered(300)
    head = spark.createDataFrame([(1, text), (3, "other " + text)], "doc_id long, text string")
    docs = head.unionByName(spark.range(100_000).select(F.lit(2).cast("long").alias("doc_id"), F.lit(text).alias("text")))
    got = {(r.doc_id, r.n_removed, r.n): None for r in dedup(docs).groupBy("doc_id", "n_removed").agg(F.count("*").alias("n")).collect()}
    whole = 300 if dedup is substring_dedup else len(text)
    assert set(got) == {(1, 0, 1), (2, whole, 100_000), (3, whole, 1)}
