"""Reading notes: prompts, fallback texts, sentinels, and which items still need one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import append_abstract, blank, escape_html, note_language, strip_tags, truncate, uuid5
from ..sources.providers import NoteSink, NoteWriter, put_note
from .calls import two_passes

#: Marks a note as ours.
SENTINEL = r"<!-- docflow-note:([a-f0-9\-]+) -->"
LABELS = {"fr": ("Auteurs", "Date", "Résumé", "Source"), "en": ("Authors", "Date", "Abstract", "Source")}
#: What stands for missing fields (fixed values).
MISSING = {"TITLE": "Sans titre", "AUTHORS": "N/A", "DATE": "N/A", "ABSTRACT": "Non disponible", "DOI": "N/A", "URL": "N/A"}
PROMPT = """Write a reading note in {LANGUAGE} on the work below.

Title: {TITLE}
Authors: {AUTHORS}
Date: {DATE}
DOI: {DOI}
Address: {URL}
Abstract: {ABSTRACT}

State its question, method and findings. Text:
{TEXT}
"""
SHORT_PROMPT = "Summarise in {LANGUAGE}, in at most five sentences, the work '{TITLE}' by {AUTHORS}: {TEXT}"


def sentinel_id(key: Column, mode: str) -> Column:
    """The same item and mode always have the same mark, so a second run finds the first one's note."""
    return uuid5(F.concat_ws("/", key, F.lit(mode)))


def add_sentinel(html: Column, mark: Column) -> Column:
    return F.concat(F.lit("<!-- docflow-note:"), mark, F.lit(" -->\n"), html)


def has_sentinel(html: Column) -> Column:
    return F.coalesce(html.rlike(SENTINEL), F.lit(False))


def extract_sentinel(html: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), SENTINEL, 1), F.lit(""))


def fill_prompt(template: str, fields: dict[str, Column], text: Column, language: Column, short: bool = False) -> Column:
    """Placeholders are filled one after the other, the text last: what it holds is not taken for a placeholder."""
    out = F.lit(template)
    out = F.replace(out, F.lit("{LANGUAGE}"), language)
    for k, missing in MISSING.items():
        c = fields.get(k, F.lit(None).cast("string"))
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(F.nullif(c, F.lit("")), F.lit(missing)))
    text = F.coalesce(text, F.lit(""))
    return F.replace(out, F.lit("{TEXT}"), truncate(text) if short else text)


def fallback_note(title: Column, authors: Column, date: Column, abstract: Column, url: Column, doi: Column, language: Column) -> Column:
    """A note from metadata alone, with French or English labels (others get French)."""
    label = lambda i: F.when(language == "en", LABELS["en"][i]).otherwise(LABELS["fr"][i])
    text = lambda c: escape_html(F.coalesce(c, F.lit("")))
    line = lambda i, c: F.when(c != "", F.concat(F.lit("<p><strong>"), label(i), F.lit("</strong>: "), c, F.lit("</p>"))).otherwise("")
    return F.concat(
        F.lit("<h1>"), F.coalesce(F.nullif(text(title), F.lit("")), F.lit(MISSING["TITLE"])), F.lit("</h1>"),
        line(0, text(authors)), line(1, F.substring(text(date), 1, 10)), line(2, text(F.substring(abstract, 1, 1200))),
        line(3, F.coalesce(F.nullif(text(url), F.lit("")), text(doi))),
    )


def build_notes(items: DataFrame, writer: NoteWriter | None, mode: str = "full", tasks: int | None = None, pause: float = 2.0) -> DataFrame:
    """itemKey, mark, html, source ('writer' or 'template') of every item; items need canonical columns.  The writer is asked
    in two passes, ``tasks`` at a time; items it gives nothing for get the note from metadata."""
    language = note_language(F.col("language") if "language" in items.columns else F.lit(None).cast("string"))
    fields = {"TITLE": F.col("title"), "AUTHORS": F.col("authors"), "DATE": F.col("date"), "ABSTRACT": F.col("abstract"), "DOI": F.col("doi"), "URL": F.col("url")}
    rows = items.select("itemKey", sentinel_id(F.col("itemKey"), mode).alias("mark"), fill_prompt(PROMPT if mode == "full" else SHORT_PROMPT, fields, F.col("texteocr"), language, mode != "full").alias("prompt"), fallback_note(*(F.col(c) for c in ("title", "authors", "date", "abstract", "url", "doi")), language).alias("plain"))
    if writer is None:
        return rows.select("itemKey", "mark", add_sentinel(F.col("plain"), F.col("mark")).alias("html"), F.lit("template").alias("source"))

    told = two_passes(rows, "prompt", writer.write, tasks, pause)
    html = add_sentinel(F.coalesce("answer", "plain"), F.col("mark"))
    return told.select("itemKey", "mark", html.alias("html"), F.when(F.col("answer").isNotNull(), "writer").otherwise("template").alias("source"))


def build_abstracts(items: DataFrame, writer: NoteWriter, tasks: int | None = None, pause: float = 2.0) -> DataFrame:
    """itemKey, abstract: the old one with a new summary behind it; items without text are left out."""
    rows = items.where(~blank(F.col("texteocr")))
    notes = build_notes(rows, writer, "short", tasks, pause).where("source = 'writer'").select("itemKey", strip_tags(F.col("html")).alias("new"))
    return rows.join(notes, "itemKey").select("itemKey", append_abstract(F.col("abstract"), F.col("new")).alias("abstract"))


def missing_notes(items: DataFrame, notes: DataFrame, mode: str = "full") -> DataFrame:
    """Items none of whose notes carries their mark."""
    marks = notes.select(extract_sentinel(F.col("html")).alias("mark")).where("mark is not null").distinct()
    return items.withColumn("mark", sentinel_id(F.col("itemKey"), mode)).join(marks, "mark", "left_anti").drop("mark")


def send_notes(notes: DataFrame, sink: Callable[[], NoteSink], at_once: int = 5) -> DataFrame:
    """itemKey, version, error of each note written; at most ``at_once`` tasks write at a time.

    Marks make a second try harmless: a note that exists is found by ``missing_notes``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = sink()
        for part in batches:
            done = []
            for key, html in zip(part.column("itemKey").to_pylist(), part.column("html").to_pylist()):
                try:
                    done.append((put_note(store, key, html), None))
                except Exception as e:
                    done.append((None, str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays([part.column("itemKey"), pa.array([v for v, _ in done], pa.int64()), pa.array([e for _, e in done], pa.string())], names=["itemKey", "version", "error"])

    return notes.select("itemKey", "html").coalesce(at_once).mapInArrow(run, "itemKey string, version long, error string")


def backup_notes(notes: DataFrame, path: str) -> DataFrame:
    """Keep a copy of generated notes as JSON, one object a line, and read it back; an earlier copy is replaced."""
    notes.write.mode("overwrite").json(path)
    return notes.sparkSession.read.schema(notes.schema).json(path)
