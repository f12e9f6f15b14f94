"""Operator 3, media columns: interleaved document sequences.

``sequences`` parses HTML into ordered structs of text and media references (position, kind, text, digest, caption);
``store_texts`` keeps payloads as 8-bit samples, a binary PPM image 64 pixels wide (192 bytes a row); ``read_back`` reads
stored bytes and computes features; ``resolve`` joins references to what was read by digest, so positions and captions
stay beside their payloads.  Payload bytes are written once and read once where they lie: only digests and features
are shuffled.

A caption belongs to the media of its own figure, wherever in it it stands; a figure inside another keeps its own; text
of a caption outside any figure is text; what scripts, styles, noscript and template hold is left out.

Defined results: null texts are empty; an empty text is one row of 192 spaces; a null html has an empty sequence; a
reference without a stored payload stays in its place with null features; equal payloads have one digest and equal
features; texts that are not valid UTF-8 are stored as they are, in HTML such bytes are U+FFFD; stored bytes that are no such image raise ValueError; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, lean, stage, table

ROW = 192
ELEMENT = "position int, kind string, text string, digest string, caption string, src string"
SCHEME = "media:sha256:"


def to_image(payload: bytes) -> bytes:
    """A binary PPM, 64 pixels wide, whose samples are the payload; its length must be a positive multiple of 192."""
    if not payload or len(payload) % ROW:
        raise ValueError("a payload must be a positive multiple of 192 bytes")
    return b"P6\n%d %d\n255\n" % (ROW // 3, len(payload) // ROW) + payload


def from_image(stored: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of a binary 8-bit PPM."""
    parts = stored.split(None, 4) if stored[:2] == b"P6" else []
    head = b"\n".join(stored.split(b"\n", 3)[:3]) + b"\n" if parts else b""
    lines = head.split(b"\n")
    if len(lines) < 3 or lines[2] != b"255":
        raise ValueError("not an 8-bit binary PPM")
    width, height = map(int, lines[1].split())
    samples = stored[len(head) :]
    if len(samples) != 3 * width * height:
        raise ValueError("the image's samples are cut short")
    return width, height, samples


def pad(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW or (0 if text else ROW))


def average_hash(width: int, height: int, samples: bytes) -> str:
    """64 bits in hex: which of 8 x 8 cells are brighter than the image's mean."""
    grey = np.frombuffer(samples, np.uint8).reshape(height, width, 3).sum(2, dtype=np.int64)
    rows = np.linspace(0, height, 9).astype(int) if height >= 8 else None
    cells = np.add.reduceat(grey, np.arange(0, width, width // 8), axis=1)[:, :8]
    if rows is None:
        cells = cells[np.arange(8) * height // 8] * 8
        count = np.full(8, 8 * (width // 8))
    else:
        cells = np.add.reduceat(cells, rows[:-1], axis=0)
        count = np.diff(rows) * (width // 8)
    mean = cells / count[:, None]
    return np.packbits((mean > grey.mean()).ravel()).tobytes().hex()


class _Interleaved(HTMLParser):
    SKIP = {"script", "style", "noscript", "template"}
    MEDIA = {"img", "video", "audio", "source"}
    BREAK = {"p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "table", "tr", "blockquote", "pre"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[dict] = []
        self.words: list[str] = []
        self.skipped = 0
        self.caption: list[str] | None = None
        self.figures: list[tuple[list[int], list[str]]] = []  # places of media and captions of each open figure

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.out.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self):
        if self.caption is not None:
            said = " ".join("".join(self.caption).split())
            self.caption = None
            if said and self.figures:
                self.figures[-1][1].append(said)
            elif said:
                self.out.append({"kind": "text", "text": said, "digest": None, "caption": None})

    def end_figure(self):
        media, said = self.figures.pop()
        for i in media if said else ():
            self.out[i]["caption"] = " ".join(said)

    def finish(self):
        self.close()
        self.end_caption()
        while self.figures:
            self.end_figure()
        self.flush()

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped += 1
        elif self.skipped:
            return
        elif tag in self.MEDIA:
            found = dict(attrs)
            if found.get("src"):
                self.flush()
                src = found["src"]
                digest = src[len(SCHEME) :] if src.startswith(SCHEME) else hashlib.sha256(src.encode(errors="replace")).hexdigest()
                if self.figures:
                    self.figures[-1][0].append(len(self.out))
                self.out.append({"kind": "media", "text": None, "digest": digest, "caption": found.get("alt") or None, "src": src})
        elif tag == "figcaption":
            self.flush()
            self.end_caption()
            self.caption = []
        elif tag in self.BREAK:
            self.flush()
            if tag == "figure":
                self.figures.append(([], []))

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skipped = max(0, self.skipped - 1)
        elif self.skipped:
            return
        elif tag == "figcaption":
            self.end_caption()
        elif tag in self.BREAK:
            self.flush()
            if tag == "figure" and self.figures:
                self.end_caption()
                self.end_figure()

    def handle_data(self, data):
        if not self.skipped:
            (self.words if self.caption is None else self.caption).append(data)


def interleaved(html: str) -> list[dict]:
    """Ordered text and media elements of one page."""
    parser = _Interleaved()
    parser.feed(html)
    parser.finish()
    return [{"position": i} | x for i, x in enumerate(parser.out)]


def sequences(pages: DataFrame) -> DataFrame:
    """(id, html) -> (id, sequence): an array of position, kind ('text' or 'media'), text, digest, caption, src."""
    element = pa.struct([("position", pa.int32()), *((k, pa.string()) for k in ("kind", "text", "digest", "caption", "src"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "html"):
            found = [interleaved((t or b"").decode(errors="replace")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(found, pa.list_(element))], names=["id", "sequence"])

    return pages.select("id", "html").mapInArrow(lean(run), f"id {pages.schema['id'].dataType.simpleString()}, sequence array<struct<{', '.join(f'{k}:{v}' for k, v in (x.split(' ') for x in ELEMENT.split(', ')))}>>")


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> staged (doc_id, n_bytes, digest, media): every text as an image; digest is the image's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            media = [to_image(pad(t or b"")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "digest", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stage(rows.mapInArrow(lean(run), "doc_id long, n_bytes long, digest string, media binary"), "media")


def read_back(media: DataFrame) -> DataFrame:
    """(digest, media) -> one row a digest: payload length, SHA-256, CRC-32 of its last 16 bytes, the media's, a feature."""
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stored in blocks(batches, "media"):
            rows = []
            for m in stored:
                width, height, payload = from_image(m)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), average_hash(width, height, payload)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([part.column("digest"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())))], names=names)

    read = media.select("digest", "media").mapInArrow(lean(run), "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.groupBy("digest").agg(*(F.first(c).alias(c) for c in names[1:]))


def resolve(sequence: DataFrame, features: DataFrame) -> DataFrame:
    """(id, sequence) and features by digest -> one row for each media reference, payload features beside it."""
    refs = sequence.select("id", F.explode("sequence").alias("e")).where("e.kind = 'media'").select("id", "e.position", "e.digest", "e.caption")
    return refs.join(features, "digest", "left")


def elements(sequence: DataFrame) -> DataFrame:
    """id, position, kind, text, digest, caption, src of every element."""
    return sequence.select("id", F.explode("sequence").alias("e")).select("id", "e.*")


def resolved(each: DataFrame, payloads: DataFrame) -> DataFrame:
    """Every element, and of media the digest and features of the payload that their source names.

    payloads: src, text (what stands at the address; addresses may share it).  Payloads are stored as media, read back,
    and met by two digest joins: from the reference to its source's payload, and from there to its features, which are
    read once for each payload.  A source without a payload has none beside it.
    """
    rows = payloads.where("src is not null").groupBy("src").agg(F.max("text").alias("text"))
    keyed = stage(rows.select(F.sha2(F.col("src").cast("binary"), 256).alias("digest"), "text", F.monotonically_increasing_id().alias("doc_id")), "sources")
    stored = store_texts(keyed)
    features = stage(read_back(stored), "features").withColumnRenamed("digest", "payload_digest")
    named = keyed.select("digest", "doc_id").join(stored.select("doc_id", F.col("digest").alias("payload_digest")), "doc_id").drop("doc_id")
    media, text = each.where("kind = 'media'"), each.where("kind <> 'media'")
    return media.join(named, "digest", "left").join(features, "payload_digest", "left").unionByName(text, allowMissingColumns=True)


def page_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of the web pages, element by element in order, with the payloads of their media.

    The pages' media are not there to be read; what stands for the payload of an address is its own last part.
    """
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "html")
    each = stage(elements(sequences(pages)), "elements")
    sources = each.where("src is not null").select("src").distinct().withColumn("text", F.substring_index("src", "/", -1))
    found = resolved(each, sources)
    return found.select(F.col("id").alias("page_id"), "position", "kind", "text", "caption", "digest", "src", "payload_digest", "payload_bytes", "payload_sha256", "media_bytes", "feature")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(table(spark, sf_dir, "documents"))
    figure = F.concat(F.lit(f'<figure><img src="{escape(SCHEME)}'), F.col("digest"), F.lit('"><figcaption>'), F.col("n_bytes").cast("string"), F.lit("</figcaption></figure>"))
    pages = stored.select(F.struct("doc_id", "n_bytes").alias("id"), F.concat(F.lit("<article>"), figure, F.lit("</article>")).alias("html"))
    found = resolve(sequences(pages), stage(read_back(stored), "features"))
    return found.select("id.doc_id", "id.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption")
