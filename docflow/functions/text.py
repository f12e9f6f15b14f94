"""Scalar functions on strings and dates, as JVM-side column expressions."""

from __future__ import annotations

import re
import string
import unicodedata
import uuid
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = " \t\n\x0b\f\r"
#: Namespace of DNS names (RFC 4122, a fixed value).
_DNS = uuid.NAMESPACE_DNS.hex


def _accent_table() -> tuple[str, str]:
    """Composed characters and their bases, derived from the canonical decompositions of all of Unicode."""
    pairs = []
    for c in map(chr, chain(range(0xC0, 0xAC00), range(0xF900, 0x30000))):  # Hangul syllables are no accented letters
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _ascii_table() -> dict[str, str]:
    """Characters whose compatibility decomposition has ASCII in it (ligatures, full-width and raised forms), and that part."""
    found = {}
    for c in map(chr, chain(range(0xA0, 0xAC00), range(0xF900, 0x20000))):
        flat = unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()
        if flat and unicodedata.normalize("NFD", c)[0] not in string.printable:
            found[c] = flat
    return found


_COMPOSED, _BASE = _accent_table()
_COMPATIBLE = _ascii_table()
_ONE = {c: x for c, x in _COMPATIBLE.items() if len(x) == 1}
_MANY = {c: x for c, x in _COMPATIBLE.items() if len(x) > 1}


def blank(c: Column) -> Column:
    """Null, empty, or white space only."""
    return F.coalesce(~c.rlike(r"\S"), F.lit(True))


def strip(c: Column) -> Column:
    """Without white space at either end (Java's \\s: ASCII white space)."""
    return F.btrim(c, F.lit(_WHITE))


def strip_accents(c: Column) -> Column:
    """Letters without their combining marks."""
    return F.regexp_replace(F.translate(c, _COMPOSED, _BASE), r"\p{Mn}+", "")


def ascii_flat(c: Column) -> Column:
    """Without accents, compatible forms as the ASCII they stand for, without other non-ASCII characters, lower case."""
    one = F.translate(strip_accents(c), "".join(_ONE), "".join(_ONE.values()))
    # forms that stand for several characters are rare: a text without them is known by a range test and one translation
    many = "".join(_MANY)
    rare = one.rlike(r"[^\x00-\x7F]") & (F.translate(one, many, "") != one)
    forms = F.str_to_map(F.lit("\x02".join(f"{a}\x01{b}" for a, b in _MANY.items())), F.lit("\x02"), F.lit("\x01"))
    spelled = F.array_join(F.transform(F.split(one, ""), lambda x: F.coalesce(F.when(x > "\x7f", forms[x]), x)), "")
    return F.lower(F.regexp_replace(F.when(rare, spelled).otherwise(one), r"[^\x00-\x7F]", ""))


def alphanum_only(c: Column) -> Column:
    return F.regexp_replace(ascii_flat(c), "[^a-z0-9]", "")


_BRACKETS, _PLAIN = r"\([^)]*\)", "[A-Za-z0-9]+"


def sanitize_name(name: str) -> str:
    """The runs of letters and digits outside round brackets, in lower case, joined by '_'; without any, 'unnamed'."""
    return "_".join(re.findall(_PLAIN, re.sub(_BRACKETS, "", name))).lower() or "unnamed"


def sanitize_value(c: Column) -> Column:
    """The same rule on data."""
    runs = F.regexp_extract_all(F.regexp_replace(c, _BRACKETS, ""), F.lit(_PLAIN), F.lit(0))
    return F.coalesce(F.nullif(F.lower(F.array_join(runs, "_")), F.lit("")), F.lit("unnamed"))


def pdf_date(c: Column) -> Column:
    """D:YYYYMMDD... to YYYY-MM-DD; others unchanged; null to ''."""
    ok = c.startswith("D:") & (F.length(c) >= 10)
    return F.coalesce(F.when(ok, F.concat_ws("-", F.substring(c, 3, 4), F.substring(c, 7, 2), F.substring(c, 9, 2))).otherwise(c), F.lit(""))


#: A digital object identifier inside a text (a fixed pattern).
DOI = r"(10\.\d{4,}(?:\.\d+)*\/\S+[^;,.\s])"
#: The library and item parts of an item's address (a fixed pattern).
ITEM_URI = r"(?i)zotero\.org/(users|groups)/(\d+)/items/([A-Z0-9]{8})"


def doi(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), DOI, 1)


def item_uri(c: Column) -> Column:
    """struct(library_type, library_id, item_key), null where the address has none."""
    part = lambda i: F.regexp_extract(c, ITEM_URI, i)
    return F.when(F.coalesce(c, F.lit("")).rlike(ITEM_URI), F.struct(F.lower(part(1)).alias("library_type"), part(2).alias("library_id"), F.upper(part(3)).alias("item_key")))


EPOCH = "1970-01-01T00:00:00Z"
#: Free forms that are understood, tried in order.
DATE_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy", "dd/MM/yyyy", "MM/dd/yyyy"]


def normalize_date(c: Column, odd_zone: bool = False) -> Column:
    """RFC 3339 in UTC; a year or a year and month stand for their first day; others than DATE_FORMATS give the epoch.

    odd_zone: dates with a zone end in '+00:00Z', as some stores were fed, instead of 'Z'.
    """
    c = strip(c)
    month = F.lpad(F.regexp_extract(c, r"^\d{4}-(\d{1,2})$", 1), 2, "0")
    out = "yyyy-MM-dd'T'HH:mm:ss"
    zoned = F.date_format(F.try_to_timestamp(c, F.lit(DATE_FORMATS[0])), out)
    plain = F.coalesce(*(F.date_format(F.try_to_timestamp(c, F.lit(f)), out) for f in DATE_FORMATS[1:]))
    known_month = F.regexp_extract(c, r"^(\d{4})-\d{1,2}$", 1)
    return F.coalesce(
        F.when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01T00:00:00Z"))),
        F.when(c.rlike(r"^\d{4}-(0?[1-9]|1[0-2])$"), F.concat(known_month, F.lit("-"), month, F.lit("-01T00:00:00Z"))),
        F.concat(zoned, F.lit("+00:00Z" if odd_zone else "Z")),
        F.concat(plain, F.lit("Z")),
        F.lit(EPOCH),
    )


def uuid5(c: Column, namespace: str = _DNS) -> Column:
    """Name-based UUID, version 5, of a UTF-8 name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), c.cast("binary")))
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def sparse_dimension(term: Column, size: int = 100_000) -> Column:
    """A term's dimension, from its MD5 (the same on every run and engine)."""
    return F.pmod(F.conv(F.substring(F.md5(term.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(size))


#: Languages that notes are written in; others fall back to the first (fixed values).
LANGUAGES = ["fr", "en", "es", "de", "it", "pt"]


def note_language(c: Column) -> Column:
    short = F.regexp_extract(F.lower(strip(F.coalesce(c, F.lit("")))), "^([^-_]*)", 1)
    return F.when(short.isin(LANGUAGES), short).otherwise(LANGUAGES[0])


def strip_tags(c: Column) -> Column:
    return strip(F.regexp_replace(c, "<[^>]+>", ""))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def append_abstract(old: Column, new: Column, separator: str = "\n\n---\n\n") -> Column:
    return F.when(~blank(old), F.concat(old, F.lit(separator), new)).otherwise(new)


def full_name(first: Column, last: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit(""))), F.lit("")), email)


def library_prefix(kind: Column, library_id: Column) -> Column:
    known = F.when(kind.isin("user", "users"), "users").when(kind.isin("group", "groups"), "groups")
    return F.when(known.isNull(), F.raise_error(F.concat(F.lit("unknown library type: "), F.coalesce(kind, F.lit("null"))))).otherwise(F.concat(F.lit("/"), known, F.lit("/"), library_id))


def client_ip(forwarded: Column, peer: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.split_part(forwarded, F.lit(","), F.lit(1))), F.lit("")), peer)


def url_filename(url: Column) -> Column:
    """The path with '/' as '_', or 'index'; pages that differ in their query share it (see url_key)."""
    path = F.trim(F.coalesce(F.parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.coalesce(F.nullif(F.replace(path, F.lit("/"), F.lit("_")), F.lit("")), F.lit("index"))


def url_key(url: Column) -> Column:
    """A file name of its own for every address."""
    return F.concat_ws("-", url_filename(url), F.substring(F.md5(url.cast("binary")), 1, 12))


def internal_link(link: Column, domain: Column) -> Column:
    host = F.coalesce(F.parse_url(link, F.lit("HOST")), F.lit(""))
    scheme = F.parse_url(link, F.lit("PROTOCOL"))
    return ((host == "") | (host == domain)) & (scheme.isNull() | scheme.isin("http", "https"))


def percent(current: Column, total: Column) -> Column:
    """Whole percent, ties to even; 0 of nothing is 0."""
    return F.when(total == 0, F.lit(0)).otherwise(F.bround(100.0 * current / F.nullif(total, F.lit(0)))).cast("int")


def truncate(c: Column, most: int = 8000) -> Column:
    return F.substring(c, 1, most)
