"""Fuzzy name join: equal normal forms, or a small Levenshtein distance between alphanumeric forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_flat, strip_accents


def normal_forms(c: Column, flat: Column | None = None) -> Column:
    """Distinct non-empty forms of a name: as it is, lower, without accents, ASCII, alphanumeric, spaces as underscores.
    flat: its ASCII form, where that is known."""
    flat = ascii_flat(c) if flat is None else flat
    forms = F.array(c, F.lower(c), strip_accents(c), flat, _alphanum(flat), F.replace(flat, F.lit(" "), F.lit("_")))
    return F.array_distinct(F.filter(forms, lambda f: F.coalesce(f, F.lit("")) != ""))


def _alphanum(flat: Column) -> Column:
    return F.regexp_replace(flat, "[^a-z0-9]", "")


def deletions(c: Column, most: int) -> Column:
    """The string and all strings with up to ``most`` characters left out: strings within ``most`` edits share one."""
    found = F.array(c)
    for _ in range(most):
        shorter = F.flatten(F.transform(found, lambda s: F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)))))
        found = F.array_distinct(F.concat(found, shorter))
    return found


def _begin(length: str, pieces: int, i: int) -> str:
    """Characters before even piece i of a string of that length."""
    return f"CAST({length} * {i} DIV {pieces} AS INT)"


def _piece(name: str, length: str, pieces: int, i: int, shift: int = 0) -> str:
    """SQL of the hash of what stands, ``shift`` characters off, where a string of that length has its piece i."""
    begin = _begin(length, pieces, i)
    return f"xxhash64({length}, {i}, substr(`{name}`, {begin} + 1 + {shift}, {_begin(length, pieces, i + 1)} - {begin}))"


def held_pieces(name: str, most: int) -> Column:
    """Hashes of a string's ``most + 1`` even pieces, each with its number and the string's length."""
    length = f"char_length(`{name}`)"
    pieces = ", ".join(_piece(name, length, most + 1, i) for i in range(most + 1))
    return F.expr(f"CASE WHEN {length} > {most} THEN array({pieces}) ELSE CAST(array() AS ARRAY<BIGINT>) END")


def probed_pieces(name: str, most: int) -> Column:
    """Hashes of all substrings that can be a piece of a string within ``most`` edits.

    One of ``most + 1`` pieces is left whole by the edits.  If it stands ``shift`` places off, at least |shift| edits lie
    before it and at least |longer - shift| behind it (longer: by how many characters this string is longer), so shifts
    are few and their number does not depend on the length.
    """
    found, own = [], f"char_length(`{name}`)"
    for longer in range(-most, most + 1):
        length = f"({own} - {longer})"
        for i in range(most + 1):
            begin, end = _begin(length, most + 1, i), _begin(length, most + 1, i + 1)
            for shift in range(-((most - longer) // 2), (most + longer) // 2 + 1):
                fits = f"{length} > {most} AND {begin} + {shift} >= 0 AND {end} + {shift} <= {own}"
                found.append(f"CASE WHEN {fits} THEN {_piece(name, length, most + 1, i, shift)} END")
    return F.expr(f"array_distinct(array_compact(array({', '.join(found)})))")


def short_pieces(name: str, most: int) -> Column:
    """Hashes of the deletion variants of strings too short to have pieces, and of those within reach of them."""
    variants = F.transform(deletions(F.col(name), most), lambda s: F.xxhash64(s))
    return F.when(F.length(name) <= 2 * most, variants).otherwise(F.array().cast("array<bigint>"))


def fuzzy_join(wanted: DataFrame, candidates: DataFrame, wanted_key: str, wanted_name: str, key: str, name: str, most: int = 2) -> DataFrame:
    """wanted_key, key, distance: the best candidate of each wanted name, if there is one.

    Both rules are equi-joins: on normal forms, and on pieces (complete for the distance: of ``most + 1`` even pieces of
    a string, one stands unchanged in any string within ``most`` edits; strings of up to ``most`` characters meet on
    deletion variants instead).  A name costs a number of keys that does not grow with its length.  Distinct names are
    joined, not rows, so a name that many rows share costs one.  Ties go to the smaller name, then key.
    """
    left = wanted.select(F.col(wanted_key).alias("wk"), F.col(wanted_name).alias("wn"))
    right = candidates.select(F.col(key).alias("ck"), F.col(name).alias("cn")).where("cn is not null").groupBy("cn").agg(F.min("ck").alias("ck"))
    names = left.where("wn is not null").select("wn").distinct().withColumn("flat", ascii_flat(F.col("wn")))
    others = right.select("cn").withColumn("flat", ascii_flat(F.col("cn")))
    formed = lambda df, n: df.select(n, F.explode(normal_forms(F.col(n), F.col("flat"))).alias("f"))
    by_form = formed(names, "wn").join(formed(others, "cn"), "f").select("wn", "cn", F.lit(0).alias("distance"))
    plain = lambda df, n, a: df.select(n, _alphanum(F.col("flat")).alias(a)).where(F.col(a) != "")
    keyed = lambda df, n, a, pieces: plain(df, n, a).select(n, a, F.explode(F.array_union(pieces(a, most), short_pieces(a, most))).alias("v"))
    near = keyed(names, "wn", "wa", probed_pieces).join(keyed(others, "cn", "ca", held_pieces), "v")
    near = near.select("wn", "cn", F.levenshtein("wa", "ca", most).alias("distance")).where("distance >= 0")
    best = by_form.unionByName(near).groupBy("wn").agg(F.min(F.struct("distance", "cn")).alias("b"))
    return left.join(best, "wn").join(right, F.col("b.cn") == F.col("cn")).select(F.col("wk").alias(wanted_key), F.col("ck").alias(key), F.col("b.distance").alias("distance"))
