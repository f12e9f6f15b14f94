"""Canonical document rows: column mapping, keys, empty-text filter, metadata, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank, sanitize_name
from ..schema import CANONICAL, MORE_TEXT_NAMES, SYNONYMS, TEXT_NAMES, unused
from ..sources.scratch import staged


def find_text_column(names: list[str], more: bool = False) -> str:
    """The first known text column, by lower-cased and stripped name."""
    by = {n.strip().lower(): n for n in reversed(names)}
    for known in MORE_TEXT_NAMES if more else TEXT_NAMES:
        if known in by:
            return by[known]
    raise ValueError(f"no text column among {names}; expected one of {MORE_TEXT_NAMES if more else TEXT_NAMES}")


def to_canonical(df: DataFrame, order: str | list[str] | None = None, text_column: str | None = None) -> DataFrame:
    """The 13 canonical string columns.

    A column named like a canonical one is taken; a synonym fills in where that one is absent or null; the text comes
    from the text column; other columns are dropped and unmapped ones are null.  A supplied key is kept (an own
    decision); a missing one is csv_ and the row's number in the order of ``order``, counted before empty rows are
    removed.
    """
    text = text_column or find_text_column(df.columns, more=True)
    direct, synonyms = {}, {}
    for name in df.columns:
        plain = name.strip().lower()
        for c in CANONICAL:
            if plain == c.lower():
                direct.setdefault(c, name)
        if plain in SYNONYMS:
            synonyms.setdefault(SYNONYMS[plain], []).append(name)
    out = {}
    for c in CANONICAL:
        found = [F.col(f"`{n}`").cast("string") for n in ([direct[c]] if c in direct else []) + synonyms.get(c, [])]
        out[c] = F.coalesce(*found) if found else F.lit(None).cast("string")
    out["texteocr"] = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    out["texteocr_provider"] = F.lit("csv")
    if "itemKey" not in direct and order is None:
        raise ValueError("rows without keys need an order to be numbered by")
    if order is not None:
        number = unused("row_number", df.columns)
        df = row_index(df, order, number)
        out["itemKey"] = F.coalesce(F.nullif(out["itemKey"], F.lit("")), F.concat(F.lit("csv_"), F.col(number).cast("string")))
    return df.select(*(out[c].alias(c) for c in CANONICAL))


def row_index(df: DataFrame, order: str | list[str], name: str = "row_index", start: int = 0) -> DataFrame:
    """df with global row numbers by order columns, without one task seeing all rows; a column ``name`` is replaced.

    Rows are range-partitioned, sorted and staged with marks that hold their partition and place in it; what stands
    before a partition is counted from the same staged rows.  Rows that tie are numbered in any order.
    """
    keys = [F.col(f"`{c}`") for c in ([order] if isinstance(order, str) else order)]
    mark, part, before = (unused(n, df.columns) for n in ("row_mark", "row_part", "rows_before"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(mark, F.monotonically_increasing_id()), "ranged")
    part_of = F.shiftright(mark, 33)  # a mark is the partition's number and, in its lower 33 bits, the row's
    counts = ranged.groupBy(part_of.alias(part)).agg(F.count("*").alias(before))
    sums = F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    moved = counts.select(part, F.coalesce(sums, F.lit(0)).alias(before))
    number = F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)) + F.col(before) + start
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != name.lower()]
    return ranged.withColumn(part, part_of).join(F.broadcast(moved), part).select(*kept, number.alias(name))


def empty_text_rejects(df: DataFrame, text: str = "texteocr") -> DataFrame:
    """The rows that ``with_text`` drops, by title or key."""
    return df.where(blank(F.col(text))).withColumn("listed_as", F.coalesce(F.nullif("title", F.lit("")), F.col("itemKey")))


def with_text(df: DataFrame, text: str = "texteocr") -> DataFrame:
    return df.where(~blank(F.col(text)))


def existing_csv_gate(df: DataFrame, text: str = "texteocr") -> DataFrame:
    """One row: n_rows, n_with_text and decision: skip, csv_cleanup or error; an absent file is 'full' (see the caller)."""
    n, full = F.count("*"), F.count_if(~blank(F.col(text)))
    decision = F.when((n > 0) & (n == full), "skip").when(full > 0, "csv_cleanup").otherwise("error")
    return df.agg(n.alias("n_rows"), full.alias("n_with_text"), decision.alias("decision"))


def metadata_value(c: Column, kind: str, missing: str | None = None) -> Column:
    """Values of metadata: numbers and booleans stay, dates become ISO strings, arrays arrays of strings, others JSON.

    missing: what null becomes (None keeps it; the chunker's own rule is '').
    """
    if kind.startswith("timestamp"):
        c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    elif kind == "date":
        c = F.date_format(c, "yyyy-MM-dd")
    elif kind.startswith("array"):
        c = c.cast("array<string>")
    elif kind.startswith(("struct", "map")):
        c = F.to_json(c)
    elif kind == "binary":
        c = F.base64(c)
    if missing is not None:
        c = F.coalesce(c.cast("string"), F.lit(missing))
    return c


def to_documents(df: DataFrame, text: str, source: str, meta: list[str] | None = None, as_of: Column | None = None, index: str | None = None) -> DataFrame:
    """text, meta (map of strings, keys sanitised), source_type; rows without text are left out.

    meta names columns as they are or sanitised; unknown ones are an error; None takes all but the text.
    """
    names = {sanitize_name(c): c for c in df.columns if c != text}
    wanted = list(names) if meta is None else [sanitize_name(m) for m in meta]
    unknown = [m for m in wanted if m not in names]
    if unknown:
        raise ValueError(f"unknown metadata columns: {unknown}")
    kinds = dict(df.dtypes)
    entries = [x for m in wanted if names[m] != index for x in (F.lit(m), _as_text(F.col(f"`{names[m]}`"), kinds[names[m]]))]
    entries += [F.lit("source_type"), F.lit(source), F.lit("texteocr_provider"), F.lit(source)]
    if index:
        entries += [F.lit("row_index"), F.col(index).cast("string")]
    if as_of is not None:
        entries += [F.lit("ingested_at"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")]
    return df.where(~blank(F.col(f"`{text}`").cast("string"))).select(F.col(f"`{text}`").cast("string").alias("text"), F.create_map(*entries).alias("meta"), F.lit(source).alias("source_type"))


def _as_text(c: Column, kind: str) -> Column:
    c = metadata_value(c, kind)
    return F.to_json(c) if kind.startswith("array") else c.cast("string")


def validate_documents(docs: DataFrame) -> DataFrame:
    """problem: 'no text', 'short' (under 10 characters, a warning), or null; source_type is added to meta if absent."""
    problem = F.when(blank(F.col("text")), "no text").when(F.length(F.trim("text")) < 10, "short")
    fill = F.when(F.map_contains_key("meta", "source_type"), F.col("meta")).otherwise(F.map_concat("meta", F.create_map(F.lit("source_type"), "source_type")))
    return docs.withColumn("meta", fill).withColumn("problem", problem)


def flatten_document(docs: DataFrame, keys: list[str], text_field: str = "texteocr") -> DataFrame:
    """Metadata keys beside the text, as columns; a key like the text's own field does not replace the text."""
    return docs.select(F.col("text").alias(text_field), *(F.col("meta")[k].alias(k) for k in keys if k != text_field))


def nest_document(df: DataFrame, text_field: str = "texteocr") -> DataFrame:
    if text_field not in df.columns:
        raise KeyError(text_field)
    others = [c for c in df.columns if c != text_field]
    return df.select(F.col(text_field).alias("text"), F.map_from_arrays(F.array(*map(F.lit, others)), F.array(*(F.col(c).cast("string") for c in others))).alias("meta"))
