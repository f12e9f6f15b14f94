import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from docflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_and_queries():
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    assert sorted(QUERIES) == sorted(set(QUERIES)) and {n.split("_")[0] for n in QUERIES} >= {f"op{i}" for i in range(1, 11)} and set(ORACLES) <= set(QUERIES)


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, step in P.STAGES[:-1]:
        out = step(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
        docs = P.stage(out, name)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert all(r[2] == r[0] for r in brute.near_components(rows))
    last = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id: r.decoded_sha256 for r in last.collect()} == {i: brute.sha(t.encode()) for i, t in rows}


def test_near_dedup_keeps_one_of_each_group(spark):
    rows = [(1, brute.numbered(80)), (2, brute.numbered(80)), (3, brute.numbered(81)), (4, "other"), (None, brute.numbered(80)), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in P.near_dedup(spark, docs, SF).collect()) == ["1", "4", "5", "None"]


def test_substring_stage_rewrites_only_what_it_cuts(spark):
    rows = [(1, brute.numbered(60) + "\nend"), (2, "my\nown " + brute.numbered(60) + " tail"), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in P.substring(spark, docs, SF).collect()}
    assert got[1].text == rows[0][1] and got[2].text == "my own tail" and got[2].n_chars == 11 and got[3].text is None


@pytest.mark.parametrize("name", ["quality", "near_dedup", "substring_dedup", "decontamination"])
def test_empty_documents(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert dict(P.STAGES)[name](spark, docs, SF).count() == 0


def test_contaminated_rows_without_id_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(None, item), (None, "clean"), (7, item), (7, "clean")], "doc_id long, text string")
    assert [r.text for r in P.decontamination(spark, docs, SF).collect()] == ["clean", "clean"]


def test_near_dedup_equals_brute_force_from_80_percent(spark):
    """Near copies of 0.82 (one word of 54 changed) go, those of 0.79 (one of 46) stay; then a table as it is."""
    pairs = [(0, 54), (1000, 46)] + [(2000 + 100 * i, 54) for i in range(40)]
    texts = [t for start, n in pairs for base in [brute.numbered(n, start)] for t in (base, base.replace(f"w{start + 20} ", "other "))]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for docs in (made, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = sorted(r.doc_id for r in P.near_dedup(spark, docs, SF).collect())
        assert got == sorted(i for i, _, head in brute.near_components(rows, 80) if i == head)
    assert len(P.near_dedup(spark, made, SF).collect()) == 43


@pytest.mark.parametrize("name", ["quality", "near_dedup", "substring_dedup", "decontamination"])
def test_stages_take_clashing_and_dotted_names_ties_and_long_texts(spark, name):
    rows = [(i, t) for i, t in brute.awkward_rows()] + [(40, "long " * 60_000), (41, brute.numbered(20_000))]
    docs = spark.createDataFrame([(i, t, 1, 0.5, "m", i, True) for i, t in rows], "doc_id long, text string, `a.b` int, score double, mark string, part long, `own``id` boolean")
    out = dict(P.STAGES)[name](spark, docs, SF)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r["a.b"], r.score, r.mark, r.part) for r in out.collect()]
    assert set(kept) <= {(i, 1, 0.5, "m", i) for i, _ in rows} and len(kept) <= len(rows)
    if name in ("substring_dedup", "decontamination"):
        assert len(kept) == len(rows)


def test_bpe_stage_of_awkward_rows(spark):
    last = P.STAGES[-1][1]
    assert last(spark, brute.empty(spark), SF).count() == 0
    got = sorted((str(r.doc_id), r.decoded_sha256) for r in last(spark, brute.awkward(spark), SF).collect())
    assert got == sorted((str(i), brute.sha((t or "").encode())) for i, t in brute.awkward_rows())
