"""Bibliography exports: items, keys, libraries, attachments, and their texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import item_uri
from ..operators.relational import resume
from ..schema import CANONICAL, ITEM
from .page_text import pdf_metadata
from .providers import TextExtractor, cascade, with_retries
from .scratch import staged

#: Items that are parts of others (fixed values).
PARTS = ["attachment", "note"]
GENERATED = r"^(output_|output\.|generated_)"


def parse_items(exports: DataFrame, column: str = "value") -> DataFrame:
    """One row an item, in order: position and the item's fields.  A list or an object with 'items'; others give none."""
    kind = f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in _fields(ITEM))}>>"
    bare = F.from_json(column, kind)
    held = F.from_json(column, f"items {kind}")["items"]
    is_list = F.coalesce(F.trim(column).startswith("["), F.lit(False))
    return exports.select(F.posexplode(F.when(is_list, bare).otherwise(held)).alias("position", "item")).where("item is not null").select("position", "item.*")


def _fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(ddl[start:i].strip())
            start = i + 1
    return out


def read_export(spark: SparkSession, path: str) -> DataFrame:
    return parse_items(spark.read.text(path, wholetext=True))


def pick_export(spark: SparkSession, folder: str) -> str | None:
    """The largest JSON file below a folder that is not one of our own outputs; ties go to the first path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    first = files.where(~name.rlike(GENERATED)).orderBy(F.desc("length"), "path").limit(1).first()
    return first["path"] if first else None


def item_key():
    """key of an item: itemKey, key, or the one in its address."""
    return F.coalesce(F.nullif("itemKey", F.lit("")), F.nullif("key", F.lit("")), item_uri(F.col("uri"))["item_key"])


def item_keys(items: DataFrame) -> DataFrame:
    """item_key, title, position of items that are not parts; items without a key are dropped."""
    rows = items.where(~F.coalesce(F.col("itemType"), F.lit("")).isin(PARTS))
    return rows.select(item_key().alias("item_key"), F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), "position").where("item_key is not null")


def library(items: DataFrame, user: str | None = None, group: str | None = None) -> DataFrame:
    """One row: library_type (users or groups) and library_id of the first item that says, by field or address; where none
    does, the given user or else the given group; without these no row."""
    told = F.when(F.col("library.id").isNotNull() & F.col("library.type").isin("user", "group"), F.struct(F.concat("library.type", F.lit("s")).alias("library_type"), F.col("library.id").alias("library_id")))
    uri = item_uri(F.col("uri"))
    from_uri = F.when(uri.isNotNull(), F.struct(uri["library_type"].alias("library_type"), uri["library_id"].alias("library_id")))
    found = F.coalesce(told, from_uri)
    given = F.struct(F.lit("users" if user else "groups").alias("library_type"), F.lit(user or group).alias("library_id")) if user or group else None
    said = F.min_by(found, F.when(found.isNotNull(), F.col("position")))
    return items.agg((said if given is None else F.coalesce(said, given)).alias("l")).where("l is not null").select("l.*")


def item_records(items: DataFrame) -> DataFrame:
    """Canonical metadata of items (all but the text), and their attachments."""
    authors = F.array_join(F.transform(F.filter(F.coalesce("creators", F.array().cast("array<struct<lastName:string,firstName:string>>")), lambda c: F.concat(F.coalesce(c["lastName"], F.lit("")), F.coalesce(c["firstName"], F.lit(""))) != ""), lambda c: F.concat(F.coalesce(c["lastName"], F.lit("")), F.lit(" "), F.coalesce(c["firstName"], F.lit("")))), ", ")
    text = lambda c: F.coalesce(c, F.lit(""))
    key = F.coalesce(F.nullif("key", F.lit("")), F.nullif("itemKey", F.lit("")), F.lit(""))
    return items.select(key.alias("itemKey"), text("itemType").alias("type"), text("title").alias("title"), text("abstractNote").alias("abstract"), text("date").alias("date"), text("url").alias("url"), text("DOI").alias("doi"), authors.alias("authors"), "attachments")


def pdf_attachments(records: DataFrame, base: str) -> DataFrame:
    """One row a PDF attachment: path (absolute, or under base), filename, attachment_title."""
    each = records.select("*", F.explode("attachments").alias("a")).where(F.lower(F.coalesce("a.path", F.lit(""))).endswith(".pdf")).drop("attachments")
    path = F.when(F.col("a.path").startswith("/"), F.col("a.path")).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), "a.path"))
    return each.withColumn("path", path).withColumn("filename", F.element_at(F.split("path", "/"), -1)).withColumn("attachment_title", F.coalesce("a.title", F.lit(""))).drop("a")


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items whose key no earlier run has finished (done: itemKey); only successes are finished."""
    return resume(items.withColumn("itemKey", F.coalesce(item_key(), F.lit(""))), done, "itemKey")


def extract_texts(attachments: DataFrame, files: DataFrame, extractors: Sequence[TextExtractor], attempts: int = 3, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, error rows) of attachments joined to files (path, content); a missing file is an error, and so is one
    that its extractors fail on: it fails alone.  ``tasks``: how many are read at a time.  Both come from one staged table,
    so nothing is extracted twice."""
    names = [c for c in CANONICAL if c not in ("texteocr", "texteocr_provider")]
    rows = attachments.select(*names).join(files.select("path", "content"), "path", "left").select(*names, "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            said = []
            for path, content in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                if content is None:
                    said.append((None, None, "FileNotFound", path))
                    continue
                try:
                    text, provider, errors = with_retries(lambda: cascade(extractors, path, content), attempts)
                except Exception as e:
                    text, provider, errors = None, None, [str(e) or type(e).__name__]
                said.append((text, provider, None if text else "ExtractionError", "; ".join(errors) or None))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(c, pa.string()) for c in zip(*said))] if said else [*(part.column(c) for c in names), *[pa.array([], pa.string())] * 4], names=[*names, "texteocr", "texteocr_provider", "error_type", "error_message"])

    kinds = ", ".join(f"`{c}` string" for c in [*names, "texteocr", "texteocr_provider", "error_type", "error_message"])
    told = staged((rows.coalesce(tasks) if tasks else rows).mapInArrow(run, kinds), "extracted")
    return told.where("error_type is null").select(*CANONICAL), told.where("error_type is not null").select("itemKey", "title", "error_type", "error_message", "path")


def pdf_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, content of the PDF files of a folder, and what they say of themselves: title, authors, date, doi."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return read.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content").withColumns(pdf_metadata(F.col("content")))


def merge_fragments(fragments):
    """Text of an extraction answer's fragments: equal ones once, in order."""
    return F.array_join(F.array_distinct(F.filter(fragments, lambda f: F.trim(f) != "")), "\n\n")
