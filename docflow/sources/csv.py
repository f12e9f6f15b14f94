"""CSV in and out."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import blank
from ..operators.canonical import find_text_column, row_index, to_documents
from ..schema import unused


@dataclass(frozen=True)
class CsvConfig:
    text_column: str = "text"
    encoding: str = "auto"
    delimiter: str = ","
    meta_columns: tuple[str, ...] = field(default=())
    skip_empty: bool = True
    add_row_index: bool = True

    @classmethod
    def from_dict(cls, d: dict) -> CsvConfig:
        known = {f.name for f in fields(cls)}
        d = {k: v for k, v in d.items() if k in known and v is not None}
        if "meta_columns" in d:
            d["meta_columns"] = tuple(d["meta_columns"])
        return cls(**d)


#: Byte order marks, as hexadecimal digits, and bytes that Windows-1252 has no character for (fixed values).
UTF_16 = {"FFFE": "UTF-16LE", "FEFF": "UTF-16BE"}
NO_CHARACTER = "[\u0081\u008d\u008f\u0090\u009d]"


#: Places that Windows-1252 gives to characters and ISO-8859-1 to controls.
_WINDOWS = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if chr(b) not in NO_CHARACTER}


def layout(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, multiLine) of the files at path, from one distributed scan of all their lines.

    UTF-8 if every line is valid UTF-8; UTF-16 by its mark; Windows-1252 if there are bytes that are characters there and
    controls in ISO-8859-1, else the latter.  Bytes that are no characters in any of them are an error: such a file's
    encoding has to be said.  A quoted line break leaves a line with an odd number of quotes;
    files without one are read line by line, so that a large file is split over tasks.
    """
    line = F.col("value")
    quotes = F.length(F.regexp_replace(line, '[^"]', ""))
    other = ~F.is_valid_utf8(line)
    raw = line.cast("binary")
    single = F.decode(raw, "ISO-8859-1")  # a character a byte
    seen = lambda c: F.bool_or(F.when(other, c))
    mark = F.substring(F.hex(raw), 1, 4)
    marks = [seen(mark == m).alias(m) for m in UTF_16]
    found = spark.read.text(path).agg(F.bool_and(~other).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("broken"), seen(single.rlike("[\u0080-\u009f]")).alias("cp1252"), seen(single.rlike(NO_CHARACTER)).alias("none"), *marks).first()
    for m, name in UTF_16.items():
        if found[m]:
            return name, True  # its line breaks are not single bytes
    if found.utf8 is not False:
        return "UTF-8", bool(found.broken)
    if found.none:
        raise ValueError(f"the encoding of {path} is none of UTF-8, UTF-16, Windows-1252 and ISO-8859-1; name it")
    return "windows-1252" if found.cp1252 else "ISO-8859-1", bool(found.broken)


def detect_encoding(spark: SparkSession, path: str) -> str:
    return layout(spark, path)[0]


def _header(spark: SparkSession, path: str, options: dict) -> list[str]:
    names = spark.read.options(**options).csv(path).columns
    return [n.lstrip("\ufeff") for n in names]


def _read(spark: SparkSession, path: str, delimiter: str, encoding: str, schema: str | None = None) -> tuple[DataFrame, list[str], Column, Column]:
    """All rows, the names of their cells, whether a row has too many of them, and its raw line."""
    found, broken = layout(spark, path)
    named = found if encoding == "auto" else encoding
    windows = named.lower() in ("windows-1252", "cp1252")  # Spark reads its controls' places as ISO-8859-1 does
    options = {"header": True, "sep": delimiter, "encoding": "ISO-8859-1" if windows else named, "multiLine": broken, "escape": '"'}
    header = [n.translate(_WINDOWS) if windows else n for n in _header(spark, path, options)]
    corrupt = unused("__corrupt", header)
    types = schema or ", ".join(f"`{n}` string" for n in header)
    read = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord=corrupt).schema(f"{types}, `{corrupt}` string").csv(path)
    names = [c for c in read.columns if c != corrupt]
    if windows:
        plain = lambda c: F.translate(c, "".join(map(chr, _WINDOWS)), "".join(_WINDOWS.values()))
        read = read.select(*(plain(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f"`{f.name}`") for f in read.schema))
    raw = F.col(corrupt)
    cells = F.size(F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), '"(?:[^"]|"")*"', ""), re.escape(delimiter), -1))
    # a raw line never equals its cells run together; naming the cells keeps Spark from reading the raw lines alone
    too_long = raw.isNotNull() & (cells > len(names)) & (raw != F.concat_ws("", *(F.col(f"`{c}`").cast("string") for c in names)))
    return read, names, F.coalesce(too_long, F.lit(False)), raw


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "auto", schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines).  Strings unless a schema is given; short rows are padded, rows with too many cells rejected.

    The header is read from the first line; quoted line breaks are allowed.
    """
    read, names, too_long, raw = _read(spark, path, delimiter, encoding, schema)
    return read.where(~too_long).select(*(f"`{c}`" for c in names)), read.where(too_long).select(raw.alias("line"))


def ingest_csv(spark: SparkSession, path: str, config: CsvConfig = CsvConfig()) -> DataFrame:
    """The rows of a CSV file as documents (text, meta, source_type), as the config says.

    The text column is the config's, or else the first known one.  No meta_columns: all others.  Rows are numbered from 0
    in the file's order, rows without text counted.  Such rows are left out, or are an error without skip_empty.
    """
    read, names, too_long, _ = _read(spark, path, config.delimiter, config.encoding)
    text = config.text_column if config.text_column in names else find_text_column(names)
    cells = [F.col(f"`{c}`") for c in names]
    if config.skip_empty:
        rows = read
    else:
        rows = read.withColumn(text, F.when(~too_long & blank(F.col(f"`{text}`")), F.raise_error(F.lit("a row has no text"))).otherwise(F.col(f"`{text}`")))
    meta = list(config.meta_columns) or None
    if not config.add_row_index:
        return to_documents(rows.where(~too_long).select(*cells), text, "csv", meta)
    index, file, block, line = (unused(n, names) for n in ("row_index", "file_at", "block_at", "line_at"))
    # a block of a file is one task's, read in order
    placed = rows.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(block), F.monotonically_increasing_id().alias(line))
    numbered = row_index(placed.where(~too_long).select(*cells, file, block, line), [file, block, line], index).select(*cells, F.col(index))
    return to_documents(numbered, text, "csv", meta, index=index)


def read_csv_strings(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "auto") -> DataFrame:
    """All cells as strings, empty ones ''."""
    rows, _ = read_csv(spark, path, delimiter, encoding)
    return rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", mark: bool = False) -> None:
    """mark: every file begins with the mark of UTF-8, as spreadsheets want it."""
    df = df.toDF("\ufeff" + df.columns[0], *df.columns[1:]) if mark else df
    df.write.mode(mode).csv(path, header=True, escape='"', quoteAll=False)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n).select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns))


def stage_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def file_summary(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """n_rows, n_columns, warning of an uploaded stage file: csv, or json_list (one list of objects); what cannot be read as
    its kind has a warning and no counts."""
    schema = "n_rows long, n_columns int, warning string"
    if kind == "csv":
        rows, _ = read_csv(spark, path)
        return stage_summary(rows).withColumn("warning", F.lit(None).cast("string"))
    if kind != "json_list":
        return spark.createDataFrame([(None, None, f"unknown kind {kind}")], schema)
    n = F.json_array_length("value").cast("long")
    warning = F.when(n.isNull(), "not a JSON list")
    return spark.read.text(path, wholetext=True).select(n.alias("n_rows"), F.lit(None).cast("int").alias("n_columns"), warning.alias("warning"))
