import json
import re
import zipfile
from html import unescape

import duckdb
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from docflow.operators.relational import page
from docflow.sources import bibliography as B
from docflow.plans import documents
from docflow.plans.tables import read
from docflow.sources import archives, csv, page_text, pages, providers, staged
from docflow.streaming import progress, state


def test_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿text,title,n\n"two\nlines, ""x""",t,1\nshort,u\nlong,v,3,4,5\n,w,\n'.encode())
    rows, rejected = csv.read_csv(spark, str(path))
    assert rows.columns == ["text", "title", "n"]
    assert sorted((r.text or "", r.title, r.n) for r in rows.collect()) == [("", "w", None), ("short", "u", None), ('two\nlines, "x"', "t", "1")]
    assert rejected.count() == 1
    assert sorted(r.n for r in csv.read_csv_strings(spark, str(path)).collect()) == ["", "", "1"]
    latin = tmp_path / "b.csv"
    latin.write_bytes("text\nété\n".encode("latin-1"))
    assert csv.detect_encoding(spark, str(latin)) == "ISO-8859-1" and csv.read_csv_strings(spark, str(latin)).first().text == "été"
    csv.write_csv(rows, str(tmp_path / "out"))
    assert csv.read_csv(spark, str(tmp_path / "out"))[0].count() == 3
    assert csv.CsvConfig.from_dict({"delimiter": ";", "other": 1, "meta_columns": ["a"]}).meta_columns == ("a",)
    assert csv.preview(rows, 1).count() == 1 and csv.stage_summary(rows).first() == (3, 3)


def test_csv_layout(spark, tmp_path):
    """Late bytes that are no UTF-8 count, and only quoted line breaks cost the splitting of a file."""
    late, plain, broken = (tmp_path / n for n in ("late.csv", "plain.csv", "broken.csv"))
    late.write_bytes(b"text\n" + b"plain ascii\n" * 3000 + "été\n".encode("latin-1"))
    plain.write_text('text,n\n"a ""b"", c",1\n')
    broken.write_text('text,n\n"a\nb",1\n')
    assert [csv.layout(spark, str(p)) for p in (late, plain, broken)] == [("ISO-8859-1", False), ("UTF-8", False), ("UTF-8", True)]
    assert csv.read_csv(spark, str(late))[0].where("text = 'été'").count() == 1
    assert [tuple(r) for r in csv.read_csv(spark, str(plain))[0].collect()] == [('a "b", c', "1")]
    long = tmp_path / "long.csv"
    long.write_text("a|__corrupt\n1|2\n3|4|5\n")
    rows, rejected = csv.read_csv(spark, str(long), delimiter="|")
    assert [tuple(r) for r in rows.collect()] == [("1", "2")] and [r.line for r in rejected.collect()] == ["3|4|5"]


def test_csv_ingestion(spark, tmp_path):
    path = tmp_path / "docs.csv"
    path.write_text("Content;Title (x);row_index\n" + "".join(f"{'' if i % 7 == 3 else f'text number {i}'};t{i};r{i}\n" for i in range(500)))
    parts = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        config = csv.CsvConfig(delimiter=";", meta_columns=("Title (x)",))
        got = csv.ingest_csv(spark, str(path), config)
        assert got.count() == len([i for i in range(500) if i % 7 != 3])
        assert all(r.text == f"text number {r.meta['row_index']}" and r.meta["title"] == f"t{r.meta['row_index']}" for r in got.collect())
        plain = csv.ingest_csv(spark, str(path), csv.CsvConfig(delimiter=";", add_row_index=False)).collect()
        assert {(r.text, r.meta["row_index"]) for r in plain} == {(f"text number {i}", f"r{i}") for i in range(500) if i % 7 != 3}
        with pytest.raises(Exception, match="a row has no text"):
            csv.ingest_csv(spark, str(path), csv.CsvConfig(delimiter=";", skip_empty=False)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", parts)
    path.write_text("title\nx\n")
    with pytest.raises(ValueError, match="no text column"):
        csv.ingest_csv(spark, str(path))


@pytest.mark.parametrize("encoding,found", [("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("latin-1", "ISO-8859-1"), ("cp1252", "windows-1252"), ("utf-16", "UTF-16LE")])
def test_encodings(spark, tmp_path, encoding, found):
    text = "text,title\n\"é à\",x\n" + ("“quoted” €,y\n" if encoding == "cp1252" else "ö,y\n")
    path = tmp_path / "a.csv"
    path.write_bytes(text.encode(encoding))
    assert csv.detect_encoding(spark, str(path)) == found
    rows, bad = csv.read_csv(spark, str(path))
    assert [tuple(r) for r in rows.orderBy("title").collect()] == [("é à", "x"), (text.split("\n")[2].split(",")[0], "y")] and bad.count() == 0


def test_an_encoding_that_has_to_be_said(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"text\n\x81\x8d\xe9\n")
    with pytest.raises(ValueError, match="name it"):
        csv.detect_encoding(spark, str(tmp_path / "a.csv"))


def test_byte_mark_and_file_summaries(spark, tmp_path):
    csv.write_csv(spark.createDataFrame([("é", 1), ("b", 2)], "text string, n int").coalesce(1), str(tmp_path / "out"), mark=True)
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_bytes() == "\ufefftext,n\né,1\nb,2\n".encode()
    (tmp_path / "list.json").write_text('[{"a": 1}, {"a": 2}, {}]')
    (tmp_path / "object.json").write_text('{"a": 1}')
    summary = lambda name, kind: tuple(csv.file_summary(spark, str(tmp_path / name), kind).first())
    assert summary("out", "csv") == (2, 2, None)
    assert summary("list.json", "json_list") == (3, None, None) and summary("object.json", "json_list") == (None, None, "not a JSON list")
    assert summary("list.json", "other")[2] == "unknown kind other"


def test_page_files(spark, tmp_path):
    rows = spark.createDataFrame([("http://a.b/x/y", "one"), ("http://a.b/x/y?q", "two"), ("http://a.b/" + "long/" * 200, None)], "u string, md string")
    told = pages.write_files(rows, str(tmp_path / "f"), "u", "md").collect()
    assert {open(r.path).read() for r in told} == {"one", "two", ""} and len({r.path for r in told}) == 3
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == sorted(r.path.rsplit("/", 1)[1] for r in told)


def test_pages_that_share_an_address_keep_their_contents(spark, tmp_path):
    """Other contents of an address, an equal page, an address that looks like a hidden file, no address, no content."""
    shared = "http://a.b/x/y"
    rows = [(1, shared, "one"), (2, shared, "two"), (3, shared, "two"), (4, "http://a.b/_x", "hidden"), (5, None, "none"), (6, "http://a.b/z", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = set(duckdb.sql(documents.ORACLES["page_files"]).fetchall())
    found = documents.page_files(spark, str(tmp_path))
    assert found.columns == ["page_id", "name", "bytes", "content_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(want) and len(want) == 6


ITEMS = [
    {"itemType": "book", "itemKey": "K1", "title": "T", "creators": [{"lastName": "L", "firstName": "F"}, {"lastName": "", "firstName": ""}], "attachments": [{"path": "a.PDF", "title": "x"}, {"path": "b.txt"}]},
    {"itemType": "note", "itemKey": "N"},
    {"itemType": "article", "uri": "http://zotero.org/users/42/items/ABCD1234", "title": "", "attachments": [{"path": "/abs/c.pdf"}]},
    {"itemType": "article", "title": "no key"},
]


@pytest.mark.parametrize("shape,n", [(ITEMS, 4), ({"items": ITEMS}, 4), ({"other": 1}, 0), ([], 0), ("x", 0)])
def test_export_shapes(spark, shape, n):
    df = spark.createDataFrame([(json.dumps(shape),)], "value string")
    assert B.parse_items(df).count() == n


def test_bibliography(spark, tmp_path):
    items = B.parse_items(spark.createDataFrame([(json.dumps(ITEMS),)], "value string"))
    assert {(r.item_key, r.title) for r in B.item_keys(items).collect()} == {("K1", "T"), ("ABCD1234", "Untitled")}
    assert tuple(B.library(items).first()) == ("users", "42")
    silent = items.where("itemKey = 'N'")
    assert B.library(silent).count() == 0 and tuple(B.library(silent, user="7", group="8").first()) == ("users", "7") and tuple(B.library(silent, group="8").first()) == ("groups", "8")
    records = B.item_records(items)
    assert records.where("itemKey = 'K1'").first().authors == "L F"
    pdfs = B.pdf_attachments(records, "/base")
    assert {r.path for r in pdfs.collect()} == {"/base/a.PDF", "/abs/c.pdf"}
    files = spark.createDataFrame([("/base/a.PDF", bytearray(b"hello text"))], "path string, content binary")
    good, bad = B.extract_texts(pdfs, files, [providers.PlainText()])
    assert [(r.texteocr, r.texteocr_provider) for r in good.collect()] == [("hello text", "plain")] and [r.error_type for r in bad.collect()] == ["FileNotFound"]
    done = spark.createDataFrame([("K1",)], "itemKey string")
    assert B.pending(items, done).count() == 3
    (tmp_path / "output_x.json").write_text("[" + " " * 500 + "]")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "export.json").write_text(json.dumps(ITEMS))
    assert B.pick_export(spark, str(tmp_path)).endswith("export.json")


def test_staged(spark, tmp_path):
    assert staged.finished_keys(spark, str(tmp_path / "none")).count() == 0
    for k in ("a", "b"):
        staged.finish_keys(spark.createDataFrame([(k,)], "itemKey string"), str(tmp_path / "done"))
    assert staged.finished_keys(spark, str(tmp_path / "done")).count() == 2
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "x.json").write_text("[]")
    assert staged.file_listing(spark, str(tmp_path / "z")).first().length == 2


def test_archives(spark, tmp_path):
    """10,000 members in one root folder, read by many tasks from an archive whose directory the driver alone reads."""
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(10_000):
            z.writestr(zipfile.ZipInfo(f"root/{i % 7}/{i}.txt", (2024, 1, 1 + i % 28, 0, 0, 0)), f"text {i} " * (i % 5))
    files = archives.read_archives(spark, [path], members=300)
    assert files.rdd.getNumPartitions() == 34
    got = files.select("path", F.decode("content", "UTF-8").alias("t"), F.day("modified").alias("d"), "length", "error").collect()
    assert {(r.path, r.t, r.d, r.length, r.error) for r in got} == {(f"{i % 7}/{i}.txt", f"text {i} " * (i % 5), 1 + i % 28, len(f"text {i} ") * (i % 5), None) for i in range(10_000)} and len(got) == 10_000
    assert {(r.folder, r.files) for r in archives.listing(files).collect()} == {(str(k), 10_000 // 7 + (k < 10_000 % 7)) for k in range(7)}


def test_archive_members_that_cannot_be_read(spark, tmp_path):
    one, two, none = (str(tmp_path / f"{n}.zip") for n in ("one", "two", "none"))
    with zipfile.ZipFile(one, "w") as z:
        z.writestr("../evil", "x")
        z.writestr("/abs", "x")
        z.writestr("good/é.txt", "kept")
        z.writestr("__MACOSX/good/x", "y")
        z.writestr("bad.txt", "damaged bytes here")
    data = open(one, "rb").read().replace(b"damaged bytes here", b"damaged bytes HERE")
    open(one, "wb").write(data)
    with zipfile.ZipFile(two, "w", zipfile.ZIP_BZIP2) as z:
        z.writestr("only/b.txt", "bz")
    zipfile.ZipFile(none, "w").close()
    got = {(r.archive[-7:-4], r.path): (r.content and bytes(r.content), r.error) for r in archives.read_archives(spark, [one, two, none]).collect()}
    assert got[("one", "good/é.txt")] == (b"kept", None) and got[("one", "bad.txt")] == (None, "damaged")
    assert got[("one", "../evil")][1] == got[("one", "/abs")][1] == "the path leaves the archive" and got[("two", "b.txt")] == (None, "compression 12")
    assert len(got) == 6


def test_pages_of_files(spark):
    """Mixed pages: rich ones stay, poor ones are read, one of them fails, one is over the limit; broken files are told."""

    class Reader:
        def read(self, path, page, image):
            if b"torn" in image:
                raise RuntimeError("no picture")
            return "" if b"blank" in image else f"read {image.decode()}"

    rich = "word " * 60
    files = spark.createDataFrame([("a", "\f".join([rich, "few", "torn page", "", "blank", "late"])), ("b", rich), ("c", ""), ("d", None)], "path string, content string")
    bad = spark.sql("SELECT 'e' AS path, X'FF' AS content").withColumn("content", F.col("content"))
    files = files.withColumn("content", F.col("content").cast("binary")).unionByName(bad)
    for tasks in (None, 1):
        got = {r.path: r for r in page_text.page_texts(files, page_text.SplitPages(), Reader(), most_read=4, tasks=tasks).collect()}
        assert got["a"].text == f"{rich}\n\n<!-- Page 2 -->\nread few\n\ntorn page\n\n<!-- Page 4 -->\nread \n\nblank\n\nlate"
        assert (got["a"].n_pages, got["a"].n_read, got["a"].failed) == (6, 2, 2)
        assert got["b"].text == rich and got["d"].error == "no pages" and got["d"].text == "" and "decode" in got["e"].error and len(got) == 5
    plain = {r.path: r.text for r in page_text.page_texts(files, page_text.SplitPages()).collect()}
    assert plain["a"] == f"{rich}\n\nfew\n\ntorn page\n\nblank\n\nlate"


def test_pdf_folder_metadata(spark, tmp_path):
    (tmp_path / "x.PDF").write_bytes(b"%PDF-1.4\n1 0 obj\n<< /Title (A \\(short\\) title) /Author (L F) /CreationDate (D:20240131120000Z) /Subject (doi:10.1234/ab.5) >>\nendobj")
    (tmp_path / "y.pdf").write_bytes(b"%PDF-1.4 \xff\xfe")
    (tmp_path / "z.txt").write_bytes(b"no")
    got = {r.filename: (r.title, r.authors, r.date, r.doi) for r in B.pdf_folder(spark, str(tmp_path)).collect()}
    assert got == {"x.PDF": ("A (short) title", "L F", "2024-01-31", "10.1234/ab.5"), "y.pdf": ("", "", "", "")}


def test_markdown_and_crawl(spark):
    html = "<h2>T</h2><p>a <b>b</b> <a href='/x'>l</a></p><script>no</script>"
    assert pages.html_to_markdown(html) == "## T\n\na **b** [l](/x)"
    rows = [("http://a.b/", '<a href="/x">x</a><a href="http://c.d/">o</a>'), ("http://a.b/x", '<a href="y#t">y</a><a href="/">home</a>'), ("http://a.b/y", '<a href="/z">z</a>'), ("http://a.b/z", None)]
    df = spark.createDataFrame(rows, "url string, html string")
    start = df.where("url = 'http://a.b/'").select("url")
    assert {(r.url[10:], r.depth) for r in pages.crawl(df, start, 2).collect()} == {("/", 0), ("/x", 1), ("/y", 2)}
    assert pages.crawl(df, start, 9).count() == 4 and pages.crawl(df, start).agg(F.max("depth")).first()[0] == 3


def markdown(html):
    """A second version, by a scan of tags and texts with a list of open links instead of a parser's callbacks."""
    skipped, blocks = "script|style|noscript", "p|li|div|article|section|br|ul|ol|nav|footer|header|main|tr|td|table|body|title"
    out, line, hrefs, skip = [], [], [], 0

    def end():
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    for close, tag, rest, text in re.findall(r"(?s)<!--.*?-->|<![^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+)", html):
        tag = tag.lower()
        if text:
            if not skip:
                line.append(unescape(text))
        elif re.fullmatch(skipped, tag):
            skip = max(0, skip + (-1 if close else 1))
        elif re.fullmatch(blocks, tag):
            end()
        elif re.fullmatch("h[1-5]", tag):
            end()
            if not close:
                line.append("#" * int(tag[1]) + " ")
        elif tag in ("strong", "b", "em", "i", "code"):
            line.append({"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}[tag])
        elif tag == "a" and not close:
            found = re.search(r"""(?is)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", rest)
            hrefs.append((len(line), unescape(next((g for g in found.groups() if g is not None), "")) if found else ""))
        elif tag == "a" and hrefs:
            at, href = hrefs.pop()
            line[at:] = [f"[{''.join(line[at:])}]({href})"]
    end()
    return "\n\n".join(out)


def test_markdown_of_all_pages_equals_a_second_version(spark):
    found = {r.page_id: (r.html, r.markdown) for r in pages.to_markdown(read(spark, SMALL, "pages")).join(read(spark, SMALL, "pages").select("page_id", "html"), "page_id").collect()}
    wrong = {i: (m, markdown(h or "")) for i, (h, m) in found.items() if m != markdown(h or "")}
    assert len(found) > 40 and not wrong, next(iter(wrong.items()))
    for html in ("", "<h1>a<b>b</b></h1>c", "<a href=x>l <i>m</i></a>", "<script>a<p>b</script>c", "<p>&amp; &lt;p&gt;<br>x", "<a>no</a>", "</a></b>t"):
        assert pages.html_to_markdown(html) == markdown(html)


LINES = ["PROGRESS|row|3/8|a|b", "PROGRESS|init|5|go", "PROGRESS|row|x/8|m", "PROGRESS|row", " 45%|###   | 9/20 [x]", "Item 2/4 done", "An Error: failed", "error as a warning", "hello", None]
WANT = {("progress", "row", 3, 8, 38, "a|b"), ("init", None, 0, 5, 0, "go"), ("progress", None, 9, 20, 45, None), ("progress", "row", 2, 4, 50, "Item 2/4 done"), ("error", None, None, None, None, "An Error: failed")}


def test_progress_lines(spark):
    got = progress.events(spark.createDataFrame([(x,) for x in LINES], "value string")).drop("value")
    assert {tuple(r) for r in got.collect()} == WANT
    assert tuple(progress.final_event(got, 1).first()) == ("error", 5)


LOGS = {
    "INFO - Detected format: direct array with 150 items": ("init", None, 150, "Found 150 items to process"),
    "150 items": None,
    "INFO - ✓ Item ABC123 saved (45 total)": ("progress", 45, None, "Processed 45 items"),
    "Resuming: 3/9 items already processed": ("init", None, 9, "Resuming: 3/9 already done"),
    "Document #5 traité, 15 chunks produits.": ("progress", 5, None, "Document #5: 15 chunks generated"),
    "Chargement de 450 chunks depuis 'file.json'": ("init", None, 450, "Loading 450 chunks for processing"),
    " === Phase 2: Dense vectors === ": ("init", None, None, "=== Phase 2: Dense vectors ==="),
    "Phase 9": None,
}


def test_worker_logs(spark):
    lines = spark.createDataFrame([(x,) for x in LOGS], "value string")
    got = {r.value: (r.type, r.current, r.total, r.message) for r in progress.events(lines).collect()}
    assert got == {k: v for k, v in LOGS.items() if v}


def test_progress_stream_resumes(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for n, part in enumerate((LINES[:4], [x for x in LINES[4:] if x])):
        (folder / f"{n}.log").write_text("\n".join(part))
        stream = progress.events(spark.readStream.text(str(folder))).drop("value")
        state.to_parquet(stream, str(out / "rows"), str(out / "checkpoint"))
    assert {tuple(r) for r in spark.read.parquet(str(out / "rows")).collect()} == WANT


def test_lockouts(spark):
    rows = [(1, i, i, i == 5) for i in range(30)]
    tries = spark.createDataFrame(rows, "user_id long, event_id long, s long, success boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = state.lockouts(tries)
    assert [r.locked_at.second for r in page(got, [F.col("locked_at")], 1, 9).collect()] == [15, 25]


def _in_files(tries, folder, cuts, order):
    """The rows as a stream of one file a batch: cut by a column, then one event far behind all."""
    for low, high in zip(cuts, cuts[1:]):
        tries.where(f"{order} >= {low} and {order} < {high}").orderBy(F.xxhash64("event_id")).coalesce(1).write.mode("append").parquet(folder)
    end = tries.limit(1).select(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.lit(True).alias("success"), (F.lit("2030-01-01").cast("timestamp")).alias("ts"))
    end.coalesce(1).write.mode("append").parquet(folder)
    return tries.sparkSession.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_lockout_stream_equals_batch_however_tries_arrive(spark, tmp_path):
    """Three micro-batches of tries up to a minute late, with ties of time that only event_id tells apart."""
    rows = [(i % 3, i, i // 9, i % 31 == 5, i // 9 + i * 7919 % 60) for i in range(300)]
    tries = spark.createDataFrame(rows, "user_id long, event_id long, s long, success boolean, arrival long").select("user_id", "event_id", "success", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"), "arrival")
    stream = _in_files(tries, str(tmp_path / "in"), [0, 30, 60, 1000], "arrival")
    state.to_parquet(state.lockout_stream(stream, late="2 minutes"), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = state.lockouts(tries)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 10


def test_state_goes_when_it_is_over(spark, tmp_path):
    """A success leaves no count, and an expired session nothing: all that is held in the end belongs to the last event."""
    rows = [(u, 100 * u + i, i * 60, i == 4) for u in range(20) for i in range(5)]
    tries = spark.createDataFrame(rows, "user_id long, event_id long, s long, success boolean").select("user_id", "event_id", "success", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    for n, (streamed, held) in enumerate(((state.lockout_stream, 3), (state.expiry_stream, 3))):
        stream = streamed(_in_files(tries, str(tmp_path / f"in{n}"), [0, 1500, 5000], "event_id"))
        query = stream.writeStream.outputMode("append").format("noop").option("checkpointLocation", str(tmp_path / f"c{n}")).trigger(availableNow=True).start()
        query.awaitTermination()
        sizes = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
        assert max(sizes) > 20 and sizes[-1] <= held


def _state_rows(stream, checkpoint, out):
    query = stream.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]


def test_expiry_stream_holds_a_row_a_session(spark, tmp_path):
    """Not one an event; a gap of just 24 hours ends nothing, one of a microsecond more does."""
    day = 86_400_000_000
    rows = [(u, 1000 * u + i, i * 60_000_000) for u in (0, 1, 2) for i in range(300)]
    rows += [(5, 9000, 0), (5, 9001, day), (6, 9002, 0), (6, 9003, day + 1), (None, 9004, 7), (None, 9005, 9)]
    seen = spark.createDataFrame(rows, "user_id long, event_id long, us long").select("user_id", "event_id", F.lit(True).alias("success"), F.timestamp_micros(F.col("us") + 1_700_000_000_000_000).alias("ts"))
    stream = state.expiry_stream(_in_files(seen, str(tmp_path / "in"), [0, 2000, 10000], "event_id"), late="1000 hours")
    assert max(_state_rows(stream, str(tmp_path / "c"), str(tmp_path / "out"))) <= 10
    got, want = spark.read.parquet(str(tmp_path / "out")).collect(), state.expiries(seen).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == 7


def test_lockout_stream_packs_users_by_buckets(spark, tmp_path):
    """State grows with the buckets, not with users and tries; a null user is a user too, and 0 another one."""
    rows = [(u, 100 * i + (u or 50), i * 60 + (u or 50) % 7, i % 17 == (u or 5)) for u in (*range(50), None) for i in range(45)]
    tries = spark.createDataFrame(rows, "user_id long, event_id long, s long, success boolean").select("user_id", "event_id", "success", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("ts"))
    stream = state.lockout_stream(_in_files(tries, str(tmp_path / "in"), [0, 1500, 3000, 10000], "event_id"), late="1 minute", buckets=2)
    assert max(_state_rows(stream, str(tmp_path / "c"), str(tmp_path / "out"))) <= 20
    got, want = spark.read.parquet(str(tmp_path / "out")).collect(), state.lockouts(tries).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {None, 0} <= {r.user_id for r in want}


def test_a_batch_that_dies_leaves_the_result_before(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    none = state.newest_result(spark, out, "k long, n long")
    assert none.count() == 0
    grouped = lambda: spark.readStream.schema("k long").parquet(source).groupBy("k").agg(F.count("*").alias("n"))
    kept = lambda: {r.k: r.n for r in state.newest_result(spark, out, "k long, n long").collect()}
    spark.range(3).select(F.col("id").alias("k")).coalesce(1).write.mode("append").parquet(source)
    state.publish_complete(grouped(), out, checkpoint)
    assert kept() == {0: 1, 1: 1, 2: 1}
    spark.range(5).select(F.col("id").alias("k")).coalesce(1).write.mode("append").parquet(source)
    broken = grouped().withColumn("n", F.when(F.col("k") == 4, F.raise_error(F.lit("killed"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="killed"):
        state.publish_complete(broken, out, checkpoint)
    assert kept() == {0: 1, 1: 1, 2: 1}
    state.publish_complete(grouped(), out, checkpoint)
    assert kept() == {0: 2, 1: 2, 2: 2, 3: 1, 4: 1}


def test_providers():
    calls = []

    def fail():
        calls.append(1)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        providers.with_retries(fail, 3, sleep=lambda s: None)
    assert len(calls) == 3

    def never():
        calls.append(1)
        raise providers.PermanentError

    with pytest.raises(providers.PermanentError):
        providers.with_retries(never, 3, sleep=lambda s: None)
    assert len(calls) == 4
    assert providers.cascade([providers.PlainText()], "p", b"\xff")[0] is None
