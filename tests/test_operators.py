import random
import re

import pytest
from pyspark.sql import functions as F

from docflow.operators import canonical as C
from docflow.operators import chunk, dense, fuzzy, notes, payload, phases, sparse
from docflow.operators import relational as R
from docflow.schema import CANONICAL
from docflow.sources import providers


def test_canonical_mapping(spark):
    df = spark.createDataFrame([(1, "A", "x", None, "k1"), (2, "B", " ", "y", ""), (3, None, None, "z", None)], "o int, Titre string, Texte string, author string, itemKey string")
    got = C.to_canonical(df, "o").orderBy("texteocr").collect()
    assert [tuple(r)[:1] + (r.title, r.texteocr, r.authors) for r in sorted(got, key=lambda r: r.itemKey)] == [("csv_1", "B", " ", "y"), ("csv_2", None, "", "z"), ("k1", "A", "x", None)]
    assert C.to_canonical(df, "o").columns == CANONICAL
    again = C.to_canonical(C.to_canonical(df, "o"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    assert C.with_text(C.to_canonical(df, "o")).count() == 1
    assert C.existing_csv_gate(C.to_canonical(df, "o")).first().decision == "csv_cleanup"
    assert [r.listed_as for r in C.empty_text_rejects(C.to_canonical(df, "o")).orderBy("listed_as").collect()] == ["B", "csv_2"]
    with pytest.raises(ValueError):
        C.find_text_column(["a", "b"])
    with pytest.raises(ValueError):
        C.to_canonical(df.drop("itemKey"))


def test_row_index_of_a_wide_table(spark):
    """Every row is there once, numbered in order, over many partitions and whatever the columns are called."""
    rows = spark.range(0, 200_000, 1, 7).select((F.col("id") * 7919 % 200_003).alias("k"), F.repeat(F.lit("wide "), 20).alias("row_mark"), F.md5(F.col("id").cast("string")).alias("row_part"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    got = C.row_index(rows, "k", start=5)
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert got.columns == ["k", "row_mark", "row_part", "row_index"]
    told = got.agg(F.count("*"), F.countDistinct("row_index"), F.min("row_index"), F.max("row_index"), F.countDistinct("row_part")).first()
    assert tuple(told) == (200_000, 200_000, 5, 200_004, 200_000)
    ranks = {r.k: r.row_index for r in got.select("k", "row_index").collect()}
    assert all(ranks[k] == i + 5 for i, k in enumerate(sorted(ranks)))
    again = C.row_index(got.where("k < 10"), "k")
    assert again.columns == got.columns and again.agg(F.max("row_index")).first()[0] == again.count() - 1


def test_synonyms(spark):
    df = spark.createDataFrame([("k", "n", "d", "l", "t", "x")], "itemKey string, Nom string, annee string, lien string, item_type string, contenu string")
    got = C.to_canonical(df).first()
    assert (got.title, got.date, got.url, got.type, got.texteocr) == ("n", "d", "l", "t", "x")


def test_documents_and_metadata(spark):
    df = spark.createDataFrame([("some longer text", 1, [1, 2], "v"), (" ", 2, [], "w"), (None, 3, None, None)], "text string, `Row No` int, tags array<int>, cat string")
    docs = C.to_documents(df, "text", "csv")
    assert docs.count() == 1 and docs.first().meta == {"row_no": "1", "tags": '["1","2"]', "cat": "v", "source_type": "csv", "texteocr_provider": "csv"}
    assert C.to_documents(df, "text", "csv", meta=["Row No"]).first().meta.keys() == {"row_no", "source_type", "texteocr_provider"}
    with pytest.raises(ValueError):
        C.to_documents(df, "text", "csv", meta=["nothing"])
    checked = C.validate_documents(spark.createDataFrame([("ok, long enough", {}, "csv"), ("tiny", {"source_type": "x"}, "csv"), ("", {}, "csv")], "text string, meta map<string,string>, source_type string"))
    assert [r.problem for r in checked.collect()] == [None, "short", "no text"]
    assert C.flatten_document(docs, ["cat", "texteocr"]).first().texteocr == "some longer text"
    assert C.nest_document(C.flatten_document(docs, ["cat"])).first().meta == {"cat": "v"}


def test_chunk_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e", "m"), (2, " ", "n"), (3, None, "o")], "doc_id int, text string, lang string")
    got = chunk.chunk_words(docs, size=3, overlap=1, keep=["lang"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("1_1", "1", 1, 2, "a b c", "m"), ("1_2", "1", 2, 2, "c d e", "m")]
    assert chunk.chunk_recursive(docs, size=4, overlap=0).count() == 3


def test_cleaning_only_touches_what_needs_it(spark):
    rows = spark.createDataFrame([("a  b", "csv"), ("a  b", None), (None, "legacy")], "text string, texteocr_provider string")
    got = chunk.clean_chunks(rows, providers.WhitespaceCleaner()).collect()
    assert sorted((r.text or "", r.texteocr_provider or "") for r in got) == [("", "legacy"), ("a  b", "csv"), ("a b", "")]


def test_sparse_vectors(spark):
    docs = spark.createDataFrame([(1, "Alpha beta alpha the"), (2, ""), (3, None)], "k int, text string")
    got = {r.k: r.sparse for r in sparse.sparse_vectors(docs, "k", "text").collect()}
    assert sorted(got[1]["values"]) == pytest.approx([1 / 3, 2 / 3]) and got[1]["indices"] == sorted(got[1]["indices"])
    assert got[2]["indices"] == [] and got[3]["values"] == []
    one = sparse.sparse_vectors(docs, "k", "text", dimensions=1).where("k = 1").first().sparse
    assert one["values"] == [1.0]
    assert sparse.term_frequencies(docs, "k", "text").agg(F.sum("tf")).first()[0] == pytest.approx(1)
    long = spark.createDataFrame([(1, "word " * 20_000 + "tail")], "k int, text string")
    assert sorted(map(tuple, sparse.term_counts(long, "k", "text").collect())) == [(1, "tail", 1), (1, "word", 20_000)]


def test_terms_of_odd_texts(spark, duck):
    """As in SQL: capital sigmas and dotted capital I have one small letter wherever they stand, letters of later Unicode count."""
    odd = ["ΟΔΟΣ ΟΔΟΣ a", "İB-Ib", "x\u0870\u0871y zz", "ﬁn ²3 über\u0301", "", "é" * 3 + "\ufffd the"]
    docs = spark.createDataFrame(list(enumerate(odd)) + [(9, None)], "k int, text string")
    sql = "SELECT regexp_split_to_array(lower(?), '[^\\p{L}\\p{N}]+')"
    want = {(k, w) for k, t in enumerate(odd) for w in duck.execute(sql, [t]).fetchone()[0] if len(w) > 1 and w != "the"}
    assert {(r.k, r.term) for r in sparse.term_counts(docs, "k", "text").collect()} == want
    sizes = {r.k: len(r.sparse["indices"]) for r in sparse.sparse_vectors(docs, "k", "text").collect()}
    assert sizes == {k: sum(k == i for i, _ in want) for k in [*range(len(odd)), 9]}
    bad = spark.sql("SELECT 1 AS k, CAST(X'4142FF4344204142E2' AS STRING) AS text UNION ALL SELECT 2, NULL")
    assert sorted(map(tuple, sparse.term_counts(bad, "k", "text").collect())) == [(1, "ab", 2), (1, "cd", 1)]


def test_a_text_crosses_to_python_once_and_uncut(spark):
    docs = spark.createDataFrame([(1, "b a b")], "k int, text string")
    plan = sparse.with_sparse(docs, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and re.search(r"MapInArrow run\(c0#\d+, c1#\d+\)", plan)
    assert "regexp_replace" not in chunk.chunk_words(docs, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert len(sparse.with_sparse(docs.withColumn("n", F.lit(12)), "n").first().sparse["indices"]) == 1  # no string: read as one


class Flaky:
    dimensions = 2

    def embed(self, texts):
        if len(texts) > 1 or texts[0] == "bad":
            raise RuntimeError("too much")
        return [[1.0, 0.0]]


def test_embedding_failures_are_null(spark):
    assert dense.embed_batch(Flaky(), ["a", "bad", "c"], attempts=1) == [([1.0, 0.0], None), (None, "too much"), ([1.0, 0.0], None)]
    got = dense.with_embeddings(spark.createDataFrame([("x y",), ("",)], "text string"), providers.HashEmbedder(8)).collect()
    assert len(got[0].embedding) == 8 and got[1].embedding is None and got[1].embedding_error


def test_payload_shapes(spark):
    rows = [("a", "d", 1, [0.1], (["1", "2"], ["0.5", "1"])), ("b", "d", 2, [0.2], (["x"], ["1"])), ("c", "d", 3, None, None), ("e", None, 4, [0.3], None)]
    df = spark.createDataFrame(rows, "id string, doc_id string, chunk_index int, embedding array<float>, sparse_embedding struct<indices:array<string>,values:array<string>>")
    got = {r.id: r.sparse_values for r in payload.payload_a(df).collect()}
    assert set(got) == {"a", "b", "e"} and got["a"]["indices"] == [1, 2] and got["b"] is None
    assert payload.payload_c(df).first().payload["original_id"] == "a"
    assert {r.doc_id for r in payload.document_chunks(df).collect()} == {"d", "unknown_document"}
    stored = payload.upserted(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"))
    after = payload.upserted(spark.createDataFrame([(2, "c"), (3, "d"), (3, "e")], "id int, v string"), stored)
    assert {r.id: r.v for r in after.collect()} in ({1: "a", 2: "c", 3: v} for v in "de") and after.count() == 3


@pytest.mark.parametrize("rows,status", [([(2, 2, None)], "success"), ([(2, 1, None)], "success_partial_data"), ([(2, 0, None)], "error"), ([(2, 2, None), (1, 0, "x")], "partial_error")])
def test_load_status(spark, rows, status):
    assert payload.load_status(spark.createDataFrame(rows, "sent long, inserted long, error string")).first().status == status


def test_fuzzy_join_equals_brute_force(spark):
    names = ["report 2020.pdf", "Réport 2021.pdf", "summary.pdf", "a", "notes on method.pdf"]
    wanted = ["report 2020.pdf", "REPORT_2021.PDF", "sumary.pdf", "nothing like it", "b", None, "notes on the method.pdf"]
    w = spark.createDataFrame(list(enumerate(wanted)), "wk long, wn string")
    c = spark.createDataFrame(list(enumerate(names)), "ck long, cn string")
    got = {r.wk: (r.ck, r.distance) for r in fuzzy.fuzzy_join(w, c, "wk", "wn", "ck", "cn").collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (2, 1), 4: (3, 1)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_fuzzy_pieces_miss_nothing(spark, most):
    """Short words over three letters: every edit at every place, strings shorter than the pieces among them."""
    rng = random.Random(most)
    lists = [sorted({"".join(rng.choice("ab1") for _ in range(rng.randint(1, 12))) for _ in range(140)}) for _ in range(2)]
    w, c = (spark.createDataFrame(list(enumerate(x)), schema) for x, schema in zip(lists, ("wk long, wn string", "ck long, cn string")))
    got = {r.wk: (r.ck, r.distance) for r in fuzzy.fuzzy_join(w, c, "wk", "wn", "ck", "cn", most).collect()}
    best = {i: min((distance(a, b), b, j) for j, b in enumerate(lists[1])) for i, a in enumerate(lists[0])}
    assert got == {i: (j, d) for i, (d, _, j) in best.items() if d <= most}


def test_fuzzy_keys_do_not_grow_with_the_name(spark):
    names = spark.createDataFrame([("ab" * 10,), ("abcde" * 100,)], "n string")
    sizes = names.select(F.size(fuzzy.held_pieces("n", 2)), F.size(fuzzy.probed_pieces("n", 2))).collect()
    assert [r[0] for r in sizes] == [3, 3] and max(r[1] for r in sizes) <= 39
    w = spark.createDataFrame([(1, "xabcde" * 83), (2, "q" * 500)], "wk long, wn string")
    c = spark.createDataFrame([(7, "xabcde" * 40 + "Z" + "xabcde" * 43)], "ck long, cn string")
    assert [tuple(r) for r in fuzzy.fuzzy_join(w, c, "wk", "wn", "ck", "cn").collect()] == [(1, 7, 1)]


def test_notes(spark):
    items = spark.createDataFrame([("k1", "T <x>", "A", "2024-01-01T00", "S", "", "10.1/x", "text {TITLE}"), ("k2", None, None, None, None, None, None, "")], "itemKey string, title string, authors string, date string, abstract string, url string, doi string, texteocr string")
    made = notes.build_notes(items, None)
    first = made.where("itemKey = 'k1'").first()
    assert "<h1>T &lt;x&gt;</h1>" in first.html and "10.1/x" in first.html and "Sans titre" in made.where("itemKey = 'k2'").first().html
    assert notes.missing_notes(items, made).count() == 0 and notes.missing_notes(items, made, "short").count() == 2
    prompt = spark.range(1).select(notes.fill_prompt(notes.PROMPT, {"TITLE": F.lit("T")}, F.lit("see {TITLE}"), F.lit("en")).alias("p")).first().p
    assert "Title: T" in prompt and "see {TITLE}" in prompt

    class Writer:
        def write(self, prompts):
            return ["<p>short</p>" for _ in prompts]

    assert notes.build_abstracts(items, Writer()).first().abstract.startswith("S\n\n---\n\n")


def test_relational(spark):
    users = spark.createDataFrame([(1, "a%b", '["USER","ADMIN"]', True), (2, "axb", None, True), (3, None, '["ADMIN"]', False)], "id long, name string, roles string, is_active boolean")
    assert R.search(users, "%", ["name"]).count() == 1 and R.search(users, "a", ["name"]).count() == 2 and R.search(users, None, ["name"]).count() == 3
    assert R.other_active_admins(users, 1).count() == 0
    assert [r.id for r in R.page(users, [F.col("id")], 2, 2).collect()] == [3]
    items = spark.createDataFrame([("a", 1), ("", 2), (None, 3), ("b", 4)], "key string, n int")
    done = spark.createDataFrame([("a",), ("",)], "key string")
    assert sorted(r.n for r in R.resume(items, done, "key").collect()) == [2, 3, 4]
    log = spark.createDataFrame([(1, 1, "a", None), (1, 2, None, "x"), (1, 3, "c", None)], "id int, at int, f string, g string")
    assert tuple(R.latest(log, "id", "at", ["f", "g"]).first()) == (1, "c", "x", 3)
    members = spark.createDataFrame([(5, 1, 9, None), (6, 1, 9, "owner")], "id long, project_id long, user_id long, role string")
    projects = spark.createDataFrame([(1, "p", 7), (2, "q", 9)], "id long, name string, owner_id long")
    assert R.member_projects(projects, members, 9).first().role == "viewer"
    assert R.accessible(projects, members, 9, False).count() == 2 and R.accessible(projects, members, 8, False).count() == 0
    assert spark.range(1).select(R.page_count(F.lit(0), 10).alias("a"), R.page_count(F.lit(0), 10, 1).alias("b")).first() == (0, 1)


def test_sql_functions(spark):
    from docflow.functions import sql

    sql.register(spark)
    assert spark.sql("SELECT strip_accents('é1'), ascii_flat('Éß'), alphanum_only('É-1'), strip_tags(' <b>x</b> '), doi('10.1234/ab')").first() == ("e1", "e", "e1", "x", "10.1234/ab")
    rows = spark.sql("SELECT t.* FROM (SELECT 'aaa bbb ccc' AS x) d, LATERAL chunk_text(d.x, 7, 0) t").collect()
    assert [tuple(r) for r in rows] == [(1, 2, "aaa bbb"), (2, 2, "ccc")]


def test_sessions_audit_and_sinks(spark):
    sessions = spark.createDataFrame([(1, "f1"), (2, "f2")], "id int, session_folder string")
    left, projects = R.delete_session(sessions, sessions, spark.createDataFrame([("f1",)], "session_folder string"))
    assert [r.id for r in left.collect()] == [2] and {r.id: r.session_folder for r in projects.collect()} == {1: None, 2: "f2"}
    assert spark.createDataFrame([(1, "x")], "id int, reset_token string").transform(R.public_user).first().json == '{"id":1}'
    row = spark.createDataFrame([(1, None, '["USER"]', None)], "id int, `last.login` timestamp, roles string, tags string")
    assert R.as_json(row, parsed=["roles", "tags"]).first().json == '{"id":1,"last.login":null,"roles":["USER"],"tags":[]}'
    audit = R.audit_entries(spark.createDataFrame([(1, "a", "t", 5, None, "d")], "user_id int, action string, resource_type string, resource_id int, success boolean, note string"), F.lit("2024-01-01").cast("timestamp"))
    assert audit.first().details == '{"note":"d"}' and audit.first().success == 1

    class Sink:
        def put(self, key, html, version):
            if version is None:
                raise providers.Conflict(4)
            if key == "bad":
                raise providers.PermanentError("no")
            return version + 1

    sent = notes.send_notes(spark.createDataFrame([("k", "h"), ("bad", "h")], "itemKey string, html string"), Sink)
    assert {(r.itemKey, r.version, r.error) for r in sent.collect()} == {("k", 5, None), ("bad", None, "no")}


def test_observed_counts(spark):
    from docflow.operators import metrics

    df, seen = metrics.observed(spark.createDataFrame([(1, None), (2, "e")], "a int, error string"), "error")
    assert df.count() == 2 and seen.get == {"n_rows": 2, "n_failed": 1}


def test_cleaned_needs_all_removals_to_succeed(spark):
    sessions = spark.createDataFrame([(1, False), (2, False), (3, False), (4, True)], "id long, cleaned_up boolean")
    removals = spark.createDataFrame([(1, None), (1, None), (2, None), (2, "busy"), (4, "busy")], "id long, error string")
    got = {r.id: r.cleaned_up for r in R.cleaned(sessions, removals).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True}


def test_phases_take_up_the_table_before(spark, tmp_path):
    steps = {"initial": lambda _: spark.range(3), "dense": lambda df: df.selectExpr("id", "id * 2 as v")}
    assert phases.run_phases(spark, steps, "initial", str(tmp_path)).count() == 3
    assert sorted(r.v for r in phases.run_phases(spark, steps, "dense", str(tmp_path)).collect()) == [0, 2, 4]
    assert phases.run_phases(spark, steps, "all", str(tmp_path)).columns == ["id", "v"]
    with pytest.raises(ValueError):
        phases.run_phases(spark, steps, "sparse", str(tmp_path))
