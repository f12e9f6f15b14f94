import unicodedata
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docflow.functions import text as T


def one(spark, expression, *values):
    return spark.range(1).select(expression(*(F.lit(v).cast("string") if v is None else F.lit(v) for v in values)).alias("v")).first().v


@pytest.mark.parametrize(
    "said,want",
    [
        ("2024-03-05", "2024-03-05T00:00:00Z"),
        ("2024/03/05", "2024-03-05T00:00:00Z"),
        ("2024", "2024-01-01T00:00:00Z"),
        ("2024-3", "2024-03-01T00:00:00Z"),
        ("5 March 2024", "2024-03-05T00:00:00Z"),
        ("", T.EPOCH),
        (None, T.EPOCH),
        ("not a date", T.EPOCH),
        ("2024-03-05T10:11:12", "2024-03-05T10:11:12Z"),
        ("2024-03-05T10:11:12+02:00", "2024-03-05T08:11:12Z"),
        ("2024-13", T.EPOCH),
        ("  2024  ", "2024-01-01T00:00:00Z"),
    ],
)
def test_normalize_date(spark, said, want):
    assert one(spark, T.normalize_date, said) == want


def test_odd_zone_flag(spark):
    assert one(spark, lambda c: T.normalize_date(c, odd_zone=True), "2024-03-05T10:11:12+00:00") == "2024-03-05T10:11:12+00:00Z"


def test_uuid5_equals_python(spark):
    names = ["", "a", "doc_1", "é", "x" * 300]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", T.uuid5(F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in got} == {n: str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names}


@pytest.mark.parametrize("name,want", [("Date (création)", "date"), ("  A  b--c ", "a_b_c"), ("(all)", "unnamed"), ("ÉTÉ", "t"), ("x", "x")])
def test_sanitize_name(spark, name, want):
    assert T.sanitize_name(name) == want
    assert one(spark, T.sanitize_value, name) == want


@given(st.text(max_size=30))
@settings(max_examples=50, deadline=None)
def test_sanitized_names_are_stable(name):
    once = T.sanitize_name(name)
    assert T.sanitize_name(once) == once


def test_folding(spark):
    assert one(spark, T.strip_accents, "Éa naïve ç ñ é") == "Ea naive c n e"
    assert one(spark, T.ascii_flat, "Éß日本x") == "ex"
    assert one(spark, T.alphanum_only, "Lé Fichier_(1).pdf") == "lefichier1pdf"
    for said in ("ﬁle ²", "Ａｂ１", "ἀβ x", "Café ™", "𝐀b", "日 ① ½"):
        assert one(spark, T.ascii_flat, said) == unicodedata.normalize("NFKD", said).encode("ascii", "ignore").decode().lower()
    assert one(spark, T.strip_accents, "ἄνθρ") == "ανθρ"


def test_small_functions(spark):
    assert one(spark, T.pdf_date, "D:20240305101112") == "2024-03-05"
    assert one(spark, T.pdf_date, None) == "" and one(spark, T.pdf_date, "soon") == "soon"
    assert one(spark, T.doi, "see 10.1234/abc.d-5, and") == "10.1234/abc.d-5"
    assert one(spark, T.doi, None) == ""
    assert one(spark, T.note_language, "EN-us") == "en" and one(spark, T.note_language, None) == "fr" and one(spark, T.note_language, "xx") == "fr"
    assert one(spark, T.escape_html, "<a & 'b'>") == "&lt;a &amp; &#x27;b&#x27;&gt;"
    assert one(spark, T.append_abstract, " ", "new") == "new" and one(spark, T.append_abstract, "old", "new") == "old\n\n---\n\nnew"
    assert one(spark, T.url_filename, "http://a.b/c/d/?q=1") == "c_d" and one(spark, T.url_filename, "http://a.b") == "index"
    assert one(spark, T.full_name, "", "B", "e") == "B" and one(spark, T.full_name, "", "", "e") == "e"
    assert one(spark, T.client_ip, " 1.2.3.4, 5.6.7.8", "9") == "1.2.3.4" and one(spark, T.client_ip, None, "9") == "9"
    assert one(spark, lambda: T.percent(F.lit(1), F.lit(8))) == 12 and one(spark, lambda: T.percent(F.lit(1), F.lit(0))) == 0
    with pytest.raises(Exception, match="unknown library type"):
        one(spark, T.library_prefix, "planet", "1")


def test_item_uri(spark):
    got = spark.createDataFrame([("http://zotero.org/Users/12/items/abcd1234",), ("x",), (None,)], "u string").select(T.item_uri(F.col("u")).alias("p")).collect()
    assert tuple(got[0].p) == ("users", "12", "ABCD1234") and got[1].p is None and got[2].p is None


def test_white_space_goes_at_the_ends_alone(spark):
    for text in ["a b", " \t\n\x0b\f\ra b \r\n", "a b \u2028", "a \x85", "\u2003a\u2003", "\u2028 ", " \x0b\n", "", "é \x1c"]:
        assert one(spark, T.strip, text) == text.strip(" \t\n\x0b\f\r")
        assert one(spark, T.blank, text) is (text.strip(" \t\n\x0b\f\r") == "")
    assert one(spark, T.strip, None) is None and one(spark, T.blank, None) is True
