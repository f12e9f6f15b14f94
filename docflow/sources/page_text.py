"""Texts of paged files: pages are rows, those with little text go to a second reader, and are put together in order."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import doi, pdf_date
from .scratch import bounded_batches, staged

#: A page with fewer words is read from its image, and at most so many pages of a file are (fixed values).
FEW_WORDS, MOST_READ = 50, 10
_WORD = r"[^ \t\n\x0b\f\r]+"


class PageSource(Protocol):
    def pages(self, path: str, content: bytes) -> Sequence[tuple[str | None, bytes | None]]:
        """Native text and image of each page."""


class PageReader(Protocol):
    def read(self, path: str, page: int, image: bytes) -> str | None: ...


class SplitPages:
    """Plain text whose pages end with a separator; the bytes of a page stand in for its image."""

    def __init__(self, separator: str = "\f"):
        self.separator = separator

    def pages(self, path: str, content: bytes) -> list[tuple[str | None, bytes | None]]:
        return [(p, p.encode()) for p in content.decode().split(self.separator)]


class DecodedImages:
    """Decodes what SplitPages gives for an image; stands in for a vision model."""

    def read(self, path: str, page: int, image: bytes) -> str | None:
        return image.decode().strip(" \t\n\x0b\f\r")


def page_rows(files: DataFrame, source: PageSource) -> DataFrame:
    """(path, content) -> path, page (from 1), n_pages, text, image, error; a file without pages, or one that cannot be
    opened, is one row with no page and an error."""
    bounded_batches(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    found, error = list(source.pages(path, content)) if content is not None else [], "no pages"
                except Exception as e:
                    found, error = [], str(e) or type(e).__name__
                n = len(found)
                rows = [(path, i, n, text, image, None) for i, (text, image) in enumerate(found, 1)] or [(path, None, 0, None, None, error)]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "page", "n_pages", "text", "image", "error"])

    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "path string, page int, n_pages int, text string, image binary, error string")


def words_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_WORD), F.lit(0)))


def read_images(pages: DataFrame, reader: PageReader, tasks: int | None = None) -> DataFrame:
    """path, page, said, read_error of pages with an image; ``tasks`` calls at a time; a page that fails fails alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            said = []
            for path, page, image in zip(*(part.column(c).to_pylist() for c in ("path", "page", "image"))):
                try:
                    text = reader.read(path, page, image)
                    said.append((text, None if text and text.strip() else "no text"))
                except Exception as e:
                    said.append((None, str(e) or type(e).__name__))
            yield pa.RecordBatch.from_arrays([part.column("path"), part.column("page"), pa.array([t for t, _ in said], pa.string()), pa.array([e for _, e in said], pa.string())], names=["path", "page", "said", "read_error"])

    rows = pages.where("image is not null").select("path", "page", "image")
    return (rows.coalesce(tasks) if tasks else rows).mapInArrow(run, "path string, page int, said string, read_error string")


def page_texts(files: DataFrame, source: PageSource, reader: PageReader | None = None, few_words: int = FEW_WORDS, most_read: int | None = MOST_READ, tasks: int | None = None) -> DataFrame:
    """path, text, n_pages, n_read (from images), failed (pages with an error), error (of the file) of each file (path unique).

    Pages with fewer words than few_words go to the reader, at most the first ``most_read`` of a file (None: all), and
    begin with a mark of their number; where it fails, or says nothing, the page's own text stays.  Pages without any text
    are left out, others stand in order, with an empty line between them.  The branch that calls the reader is staged, so
    nothing is read twice.
    """
    pages = staged(page_rows(files, source), "pages")
    told = pages.drop("image").withColumn("words", words_of(F.col("text")))
    poor = pages.where(F.col("page").isNotNull() & (words_of(F.col("text")) < few_words))
    if most_read is not None:
        first = poor.groupBy("path").agg(F.slice(F.array_sort(F.collect_list("page")), 1, most_read).alias("chosen"))
        poor = poor.join(first, "path").where(F.array_contains("chosen", F.col("page")))
    if reader is not None:
        told = told.join(staged(read_images(poor, reader, tasks), "read"), ["path", "page"], "left")
    else:
        told = told.withColumns({"said": F.lit(None).cast("string"), "read_error": F.lit(None).cast("string")})
    read = (words_of(F.col("said")) > 0) & F.col("read_error").isNull()
    text = F.when(read, F.concat(F.lit("<!-- Page "), F.col("page").cast("string"), F.lit(" -->\n"), "said")).when(F.col("words") > 0, F.col("text"))
    each = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("page", text.alias("text")))))
    whole = told.groupBy("path").agg(each.alias("each"), F.max("n_pages").alias("n_pages"), F.count_if(read).alias("n_read"), F.count_if(F.col("read_error").isNotNull()).alias("failed"), F.max("error").alias("error"))
    return whole.select("path", F.array_join(F.transform("each", lambda x: x["text"]), "\n\n").alias("text"), "n_pages", "n_read", "failed", "error")


#: Entries of a PDF's information dictionary (fixed values), and an identifier anywhere in its head.
_INFO = {"title": "Title", "authors": "Author", "date": "CreationDate"}


def pdf_metadata(content: Column) -> dict[str, Column]:
    """title, authors, date (YYYY-MM-DD where it is one) and doi as a PDF's plain information dictionary says; '' where it
    does not (encrypted or compressed ones say nothing)."""
    raw = F.decode(content, "ISO-8859-1")
    entry = lambda name: F.regexp_replace(F.regexp_extract(raw, rf"/{name}\s*\(((?:\\.|[^()\\])*)\)", 1), r"\\(.)", "$1")
    found = {k: F.coalesce(entry(name), F.lit("")) for k, name in _INFO.items()}
    found["date"] = pdf_date(found["date"])
    inside = F.regexp_extract(raw, r"(?i)(?:doi[:=/\s(<>a-z.]*)(10\.\d{4,}[^\s()<>]*)", 1)
    return found | {"doi": F.coalesce(doi(inside), F.lit(""))}
