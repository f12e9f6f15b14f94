"""Web pages: links, titles, Markdown, and a crawl over a stored page table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import internal_link, strip, strip_tags, url_filename
from .scratch import bounded_batches, shared_folder, staged

HREF = r'href="([^"]*)"'


def title(html: Column) -> Column:
    return strip_tags(F.regexp_extract(html, r"<title>([^<]*)</title>", 1))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def absolute(link: Column, url: Column) -> Column:
    """A link seen on a page: kept if it has a scheme, joined to the host if it begins with '/', else to the page's folder."""
    host = F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.parse_url(url, F.lit("HOST")))
    folder = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "[^/]*$", "")
    full = F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.parse_url(url, F.lit("PROTOCOL")), F.lit(":"), link)).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(folder, link))
    return F.regexp_replace(full, "#.*$", "")


def page_links(pages: DataFrame) -> DataFrame:
    """url, link of every internal link, each once."""
    each = pages.select("url", F.explode(links(F.col("html"))).alias("l")).where("l <> '' and l not like '#%'")
    return each.select("url", absolute(F.col("l"), F.col("url")).alias("link")).where(internal_link(F.col("link"), F.parse_url(F.col("url"), F.lit("HOST")))).distinct()


def _cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def crawl(pages: DataFrame, start: DataFrame, most_depth: int | None = None) -> DataFrame:
    """url, depth of the stored pages reachable from start (url) by internal links.

    Breadth first, until nothing new is found (or to a given depth): each round explodes the newest pages' links and
    leaves out what was visited; rounds are checkpointed.
    """
    edges = _cut(page_links(pages).join(pages.select(F.col("url").alias("link")).distinct(), "link", "left_semi"))
    newest = _cut(start.join(pages.select("url").distinct(), "url", "left_semi").select("url", F.lit(0).alias("depth")).distinct())
    visited, depth = newest, 0
    while depth != most_depth and not newest.isEmpty():
        depth += 1
        found = edges.join(newest.select("url"), "url", "left_semi").select(F.col("link").alias("url")).distinct().join(visited.select("url"), "url", "left_anti")
        newest = _cut(found.withColumn("depth", F.lit(depth)))
        visited = _cut(visited.unionByName(newest))
    return visited


class _Markdown(HTMLParser):
    SKIP = {"script", "style", "noscript"}
    MARK = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`"}
    BLOCK = {"p", "li", "div", "article", "section", "br", "ul", "ol", "nav", "footer", "header", "main", "tr", "td", "table", "body", "title"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.skip = 0
        self.href: list[tuple[int, str]] = []

    def end_block(self):
        text = " ".join("".join(self.line).split())
        if text:
            self.blocks.append(text)
        self.line = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skip += 1
        elif tag in self.BLOCK:
            self.end_block()
        elif tag in ("h1", "h2", "h3", "h4", "h5"):
            self.end_block()
            self.line.append("#" * int(tag[1]) + " ")
        elif tag in self.MARK:
            self.line.append(self.MARK[tag])
        elif tag == "a":
            self.href.append((len(self.line), dict(attrs).get("href") or ""))

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in self.BLOCK or tag in ("h1", "h2", "h3", "h4", "h5"):
            self.end_block()
        elif tag in self.MARK:
            self.line.append(self.MARK[tag])
        elif tag == "a" and self.href:
            at, href = self.href.pop()
            text = "".join(self.line[at:])
            self.line[at:] = [f"[{text}]({href})"]

    def handle_data(self, data):
        if not self.skip:
            self.line.append(data)


def html_to_markdown(html: str) -> str:
    """Headings, links, emphasis and code as marks, blocks apart; each text once."""
    parser = _Markdown()
    parser.feed(html)
    parser.close()
    parser.end_block()
    return "\n\n".join(parser.blocks)


def to_markdown(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, markdown; a null page is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(key), part.column("url"), pa.array([html_to_markdown(h or "") for h in part.column("html").to_pylist()], pa.string())], names=[key, "url", "markdown"])

    return pages.select(key, "url", "html").mapInArrow(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, url string, markdown string")


def file_name(url: Column) -> Column:
    """The path with '/' as '_', its first 150 characters, and a mark of the whole address: short enough for any folder."""
    return F.concat_ws("-", F.substring(url_filename(url), 1, 150), F.substring(F.md5(url.cast("binary")), 1, 12))


def version_name(url: Column, content: Column) -> Column:
    """file_name behind a mark of the content: rows share it only if both are equal, and no reader takes it for hidden."""
    return F.concat_ws("-", F.md5(F.coalesce(content.cast("string"), F.lit("")).cast("binary")), file_name(url))


def write_files(rows: DataFrame, folder: str, url: str, content: str, suffix: str = ".md", versions: bool = False) -> DataFrame:
    """url, path, bytes of the files written below folder, one a row, named by their whole address (file_name).

    A file is written beside its place and moved there, so that a task that runs again leaves whole files only; an
    address that rows share has the file of one of them, or, with ``versions``, one for each of its contents
    (version_name).  The result is staged: files are written once, here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        for part in batches:
            names, sizes = part.column("name").to_pylist(), []
            for name, data in zip(names, part.column("content").to_pylist()):
                beside = f"{root}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(beside) as f:
                    f.write(data or b"")
                fs.move(beside, f"{root}/{name}")
                sizes.append(len(data or b""))
            paths = [f"{folder.rstrip('/')}/{n}" for n in names]
            yield pa.RecordBatch.from_arrays([part.column("url"), pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], names=["url", "path", "bytes"])

    bounded_batches(rows.sparkSession)
    name = version_name(F.col(url), F.col(content)) if versions else file_name(F.col(url))
    named = rows.select(F.col(url).alias("url"), F.concat(name, F.lit(suffix)).alias("name"), F.col(content).cast("string").cast("binary").alias("content"))
    return staged(named.mapInArrow(run, "url string, path string, bytes long"), "page-files")


def plain_text(html: Column) -> Column:
    """Text of a page by patterns alone: scripts, styles and tags go."""
    no_code = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", " ")
    return strip(F.regexp_replace(F.regexp_replace(no_code, r"<[^>]*>", " "), r"\s+", " "))
