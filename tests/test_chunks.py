"""Measured splitting against a plain version, and calls in two passes."""

import os
import random
import re
from collections import Counter, deque

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docflow.operators import calls, chunk, notes
from docflow.plans.registry import QUERIES
from docflow.sources import providers


def plain(text, measure, size, overlap, separators=chunk.SEPARATORS, base=0):
    """The pieces, one part after the other, by strings; measure(begin, end) counts the units of a stretch of the text."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, finer = separators[at], separators[at + 1 :]
    parts = list(text) if not sep else [p for i, x in enumerate(text.split(sep)) if (p := x if i == 0 else sep + x)]
    out, held, total, where = [], deque(), 0, base

    def flush():
        joined = "".join(p for p, _ in held).strip()
        if joined:
            out.append(joined)

    for part in parts:
        n = measure(where, where + len(part))
        if n > size and finer:
            flush()
            held.clear()
            total = 0
            out += plain(part, measure, size, overlap, finer, where)
        else:
            if held and total + n > size:
                flush()
                while held and (total > overlap or total + n > size):
                    total -= held.popleft()[1]
            held.append((part, n))
            total += n
        where += len(part)
    flush()
    return out


def both(text, units, size, overlap):
    starts = units([text])[0]
    inside = lambda a, b: int(((starts >= a) & (starts < b)).sum())
    got = chunk.split_measured(text, starts, size, overlap)
    assert got == plain(text, inside, size, overlap) if text else got == []
    return got


@given(st.text(alphabet="ab #\n", max_size=200), st.integers(1, 40), st.integers(0, 39))
@settings(max_examples=200, deadline=None)
def test_splitting_equals_the_plain_version(text, size, overlap):
    if overlap < size:
        both(text, chunk.Matches(r"[ab]+|#"), size, overlap)
        parts = both(text, chunk.characters, size, overlap)
        assert all(len(p) <= size for p in parts)
        if not overlap:
            assert "".join("".join(parts).split()) == "".join(text.split())


def test_overlap_and_levels():
    cut = lambda t, size, overlap: chunk.split_measured(t, chunk.characters([t])[0], size, overlap)
    assert cut("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]
    assert cut("one\n\ntwo", 4, 0) == ["one", "two"]
    assert cut("", 4, 0) == [] and cut(" \n", 4, 0) == []


def test_one_character_of_many_units():
    """A byte-level token may begin and end inside a character: it is never cut."""
    assert chunk.split_measured("a\U0001f642b", np.array([0, 1, 1, 1, 2]), 2, 0) == ["a", "\U0001f642", "b"]


def test_tokens_of_a_vocabulary():
    public = pytest.importorskip("public_tokenizers")
    units = chunk.Tokens(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    rng = random.Random(4)
    text = "\n\n".join(" ".join(rng.choice(["retrieval", "of", "documents,", "é\U0001f642", "1234", "#tag", "x" * 40]) for _ in range(rng.randint(1, 900))) for _ in range(9))
    pieces = both(text, units, 1000, 150)
    sizes = [len(s) for s in units(pieces)]
    assert max(sizes) <= 1001 and len(pieces) > 4  # a piece that begins inside a word may have a token of its own there
    assert any(b[:60] in a for a, b in zip(pieces, pieces[1:]))


def test_a_long_text_takes_one_pass():
    text = "word " * 400_000
    assert len(chunk.split_measured(text, chunk.Matches(r"\S+")([text])[0], 1000, 150)) == 471


def test_chunk_tokens_query_equals_the_plain_version(spark):
    units = chunk.Matches(r"\w+|[^\w\s]")
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        text = re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", r.text or "")
        if text:
            starts = units([text])[0].tolist()
            spots = set(starts)
            sums = np.cumsum([0, *(i in spots for i in range(len(text)))])
            for i, p in enumerate(plain(text, lambda a, b: int(sums[b] - sums[a]), 1000, 150), 1):
                want[f"{r.doc_id}_{i}"] = len(p)
    assert {r.id: r.chars for r in QUERIES["chunk_tokens"](spark, SMALL).collect()} == want and len(want) > 200


def test_a_text_that_cannot_be_split_is_skipped(spark):
    class Picky:
        def __call__(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no units")
            return chunk.characters(texts)

    docs = spark.createDataFrame([(1, "one two"), (2, "bad"), (3, None), (4, "three")], "doc_id long, text string").coalesce(1)
    assert sorted(r.text for r in chunk.chunk_recursive(docs, size=4, overlap=0, units=Picky()).collect()) == ["e", "one", "thre", "two"]
    assert [(r.doc_id, r.error) for r in chunk.split_documents(docs, units=Picky()).where("error is not null").collect()] == [("2", "no units")]


def flaky(folder):
    """A cleaner that fails once for 'once' texts, always for 'never' texts, and says nothing for 'empty' ones."""

    class Flaky:
        def clean(self, texts):
            if len(texts) > 1 and any("fine" not in t for t in texts):
                raise RuntimeError("one by one, please")
            for t in texts:
                mark = os.path.join(folder, t.replace(" ", "_"))
                if "never" in t:
                    raise RuntimeError("never")
                if "once" in t and not os.path.exists(mark):
                    open(mark, "w").close()
                    raise RuntimeError("not now")
            return [None if "empty" in t else t.upper() for t in texts]

        write = clean

    return Flaky()


def test_two_passes_and_the_text_that_stays(spark, tmp_path):
    kinds = ["fine", "once", "never", "empty"]
    rows = [(i, f"{kinds[i % 4]} {i}", None) for i in range(80)] + [(100, "clean", "csv"), (101, None, None)]
    chunks = spark.createDataFrame(rows, "k long, text string, texteocr_provider string")
    got = chunk.clean_chunks(chunks, flaky(str(tmp_path)), tasks=2, pause=0, report=True).collect()
    assert {r.k: r.text for r in got} == {i: t.upper() if t and t[:4] in ("fine", "once") else t for i, t, _ in rows} and len(got) == len(rows)
    assert Counter(r.cleaned for r in got) == {1: 20, 2: 20, 0: 40, None: 2}
    assert {r.clean_error for r in got if r.cleaned == 0} == {"never", "empty answer"}
    assert set(chunk.clean_chunks(chunks, flaky(str(tmp_path)), pause=0).columns) == set(chunks.columns)


def test_pass_counts_and_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([("fine a", 1), ("once b", 2), ("never c", 3)], "`my.text` string, c0 int")
    told = calls.two_passes(df, "my.text", flaky(str(tmp_path)).clean, pause=0)
    assert {r["pass"]: r.n for r in calls.pass_counts(told).collect()} == {0: 1, 1: 1, 2: 1}
    assert told.columns == ["my.text", "c0", "answer", "error", "pass"]
    assert calls.answers(lambda texts: ["only one"], ["a", "b"]) == [("only one", None), ("only one", None)]
    assert calls.answers(lambda texts: [], []) == []


def test_notes_survive_a_writer_that_fails(spark, tmp_path):
    items = spark.createDataFrame([(f"k{i}", t, "A", "2024", "S", "", "", f"{t} {i}") for i, t in enumerate(["fine", "once", "never"])], "itemKey string, title string, authors string, date string, abstract string, url string, doi string, texteocr string")
    made = {r.itemKey: r.source for r in notes.build_notes(items, flaky(str(tmp_path)), "short", tasks=1, pause=0).collect()}
    assert made == {"k0": "writer", "k1": "writer", "k2": "template"}
    assert providers.WhitespaceCleaner().clean(["a  b"]) == ["a b"]


def test_a_word_is_hashed_once(monkeypatch):
    calls, md5 = [], providers.hashlib.md5
    monkeypatch.setattr(providers.hashlib, "md5", lambda b: calls.append(b) or md5(b))
    found = providers.HashEmbedder(8).embed(["a b a", "", "b a", "a a b"])
    assert len(calls) == 2 and found[1] is None and found[0] == found[3] and sum(x * x for x in found[2]) == pytest.approx(1)
