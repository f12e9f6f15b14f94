"""Operators 11 to 13 against plain versions, and SQL of the operators that have it."""

import random
import sys
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docflow.llm import fill_middle, ngram_join, spelling
from docflow.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_their_sql(spark, duck, name):
    mine, theirs = QUERIES[name](spark, SF).toArrow(), duck.sql(ORACLES[name]).to_arrow_table()
    assert sorted(mine.column_names) == sorted(theirs.column_names)
    some = lambda t: Counter(zip(*(t.column(c).to_pylist() for c in sorted(t.column_names))))
    assert some(mine) == some(theirs)


# fill in the middle


def fim(i, text, seed=7, cut=100, spm=50):
    text = text or ""
    units = brute.re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = brute.sha(f"{seed}:{'' if i is None else i}".encode())
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in fill_middle.MARKS) or h[2] % 100 >= cut:
        return i, len(units), "plain", None, None, text
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"
    return i, len(units), form, len(x), len(y), out


def test_fill_in_middle_equals_the_plain_version(spark):
    rows = brute.awkward_rows() + [(30 + i, t) for i, t in enumerate(["a\nb\nc", "\n\n\n", "x<", "<P", "has <M> mark", "é\n日本\n🙂\n", "a\n" * 9000, "one\r\ntwo", "<\n<S\n", "no end\n" * 3])]
    docs = spark.createDataFrame([(i, t, "n", "f", b"r") for i, t in rows], "doc_id long, text string, n string, form string, `a.restored` binary")
    for options in ({}, {"seed": 11, "cut_percent": 40, "spm_percent": 0}):
        out = fill_middle.restore(fill_middle.fill_in_middle(docs, **options))
        want = [fim(i, t, *options.values()) for i, t in rows]
        assert rows_of(out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("output").cast("string"))) == Counter(want)
        assert rows_of(out.select("doc_id", F.col("restored").cast("string"))) == Counter((i, t or "") for i, t in rows)
    assert fill_middle.fill_in_middle(brute.empty(spark)).count() == 0


def test_fill_in_middle_keeps_broken_bytes_and_other_columns(spark):
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'41FF0A42C30A43' AS STRING) AS text")
    cut = fill_middle.fill_in_middle(docs).withColumns({"a.b": F.lit(5), "restored": F.lit("old")})
    got = fill_middle.restore(cut).first()
    assert bytes(got["restored"]) == b"A\xff\nB\xc3\nC" and got["a.b"] == 5 and got["n"] == 3


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("", "a", "b"), ("ab", "b", "c"), ("xa", "ay", "c"), ("aa", "b", "c")])
def test_marks_that_could_be_mistaken(marks):
    with pytest.raises(ValueError):
        fill_middle.fill_in_middle(None, marks=marks)


# spelling variants


def variants(rows, slip=31, least_length=7, least_count=2, times=10):
    counts = Counter()
    for i, t in rows:
        for run in brute.re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run if h % slip else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_length and c >= least_count}

    def near(a, b):
        if len(a) < len(b):
            a, b = b, a
        at = next((k for k in range(len(b)) if a[k] != b[k]), len(b))
        return a != b and len(a) - len(b) < 2 and (a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else a[at + 1 :] == b[at:])

    found, form = defaultdict(list), {}
    for a in n:
        found[a] = [b for b in n if near(a, b)]
        if found[a]:
            best = min(found[a], key=lambda b: (-n[b], b))
            form[a] = best if n[best] >= times * n[a] else None

    def root(w):
        return root(form[w]) if form.get(w) else w

    return Counter((w, n[w], len(found[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n)


def test_spelling_equals_the_plain_version(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abàÿZ") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "baaaaaaa", "aaaabaaa"]
    crowd = ["possible"] * 2300 + ["posible"] * 150 + ["posibles"] * 12 + ["posiblas"] * 1 + ["possible÷"] * 3 + ["Possibl"] * 150
    texts = [" ".join(rng.choice(words) + rng.choice(["", "a", "b"]) for _ in range(40)) for _ in range(60)] + [" ".join(crowd[k::7]) for k in range(7)]
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4]), (None, None), (99, ""), (98, "1 2 !"), (97, "x" * 30_000), (96, "x" * 30_000)]
    docs = spark.createDataFrame([(i, t, "w", 1, "k") for i, t in rows], "doc_id long, text string, word string, n int, key string")
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    for options in ({}, {"slip": 3, "least_length": 5, "least_count": 1, "times": 2}):
        want = variants(rows, **options)
        assert rows_of(spelling.spelling_variants(docs, **options).select(*columns)) == want
        assert sum(r[2] for r in want) > 100 and any(r[5] != r[3] and r[3] for r in want)
    assert spelling.spelling_variants(brute.empty(spark)).count() == 0


def test_ranges_cut_by_batches_are_whole():
    rows = sorted((f"k{i % 40:02d}", c) for i in range(40) for c in ["", *"abcdefghij"][: i % 12])
    keys, last = zip(*rows)
    whole = pa.record_batch({"key": list(keys), "last": list(last), "n": [hash(r) % 7 + 2 for r in rows]})
    key = lambda found: sorted(tuple(r.values()) for b in found for r in b.to_pylist())
    want = key(spelling.scan(iter([whole])))
    for size in (1, 2, 7, 50):
        assert key(spelling.scan(whole.slice(i, size) for i in range(0, len(whole), size))) == want
    assert list(spelling.scan(iter([]))) == [] and want


# n-gram join


def joined(rows, percent=90, words=3):
    """doc_id, n_shingles, component_id, n_links of rows whose doc_ids differ (null ones aside)."""
    sets = [brute.shingles(t, words) for _, t in rows]
    places = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s if rows[k][0] is not None else ():
            places[x].append(k)
    common = Counter((a, b) for at in places.values() for n, b in enumerate(at) for a in at[:n])
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)), key=lambda x: rows[x][0])
        top[q] = p
    n = Counter(x for link in links for x in link)
    return Counter((rows[k][0], len(sets[k]), rows[find(k)][0], n[k]) for k in range(len(rows)))


def shaken(rng, base, edits):
    w = list(base)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], [f"e{rng.random()}"], [w[k], f"e{rng.random()}"]])
    return " ".join(w)


@pytest.mark.parametrize("percent", [90, 80])
def test_ngram_join_equals_brute_force(spark, percent, monkeypatch):
    """Families around the threshold, short sets, drifting chains, copies; blocks so small that all ways are used."""
    monkeypatch.setattr(sys.modules["docflow.llm.links"], "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "SMALL", 5)
    rng = random.Random(percent)
    texts = []
    for f in range(12):
        base = [f"f{f}w{i}" for i in range(rng.choice([3, 9, 14, 20, 60, 150, 400]))]
        texts += [" ".join(base)] * 3 + [shaken(rng, base, rng.randint(0, max(1, len(base) // 40))) for _ in range(14)]
    chain = [f"c{i}" for i in range(120)]
    for _ in range(15):
        texts.append(" ".join(chain))
        chain[rng.randrange(120)] = f"d{rng.random()}"
    rng.shuffle(texts)
    rows = [*enumerate(texts), *((2000 + i, t) for i, (d, t) in enumerate(brute.awkward_rows()))]
    docs = spark.createDataFrame([(i, t, 1, "s", 2.0) for i, t in rows], "doc_id long, text string, n int, sig string, component double")
    want = joined(rows, percent)
    assert rows_of(ngram_join.ngram_join(docs, percent)) == want
    assert len({r[2] for r in want}) < len(rows) - 80 and max(r[3] for r in want) > 5


def test_ngram_join_of_repeated_and_null_ids(spark):
    a, b = brute.numbered(100), brute.numbered(100, 500)
    docs = spark.createDataFrame([(1, a), (1, b), (2, b), (3, a), (3, a), (None, a), (4, None), (5, " ")], "doc_id long, text string")
    assert rows_of(ngram_join.ngram_join(docs)) == Counter({(1, 98, 1, 1): 2, (2, 98, 1, 1): 1, (3, 98, 1, 1): 2, (None, 98, None, 0): 1, (4, 0, 4, 0): 1, (5, 0, 5, 0): 1})
    assert ngram_join.ngram_join(brute.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        ngram_join.ngram_join(docs, 40)


@pytest.mark.parametrize("percent,layouts", [(90, 4), (90, 1), (80, 4), (60, 2)])
def test_similar_sets_share_a_slab(monkeypatch, percent, layouts):
    """Also with one layout, where empty slabs are listed as they are, and for sets of few shingles."""
    monkeypatch.setattr(ngram_join, "LAYOUTS", layouts)
    rng = np.random.default_rng(percent + layouts)
    seen = 0
    for trial in range(1500):
        n = int(rng.integers(1, 60 if trial % 4 else 900))
        pool = rng.permutation(np.unique(rng.integers(0, 2**63, n + 300, dtype=np.int64).astype(np.uint64) * np.uint64(2)))
        out, more = (int(rng.integers(0, n // 6 + 1)) for _ in range(2))
        if 100 * (n - out) < percent * (n + more) or not out + more:
            continue
        seen += 1
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[out:n], pool[n : n + more]]))
        text, keys = ngram_join.slab_keys(np.concatenate([x, y]), np.array([0, n, n + len(y)]), percent)
        assert set(keys[text == 0].tolist()) & set(keys[text == 1].tolist())
    assert seen > 100


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(2)
    for n in (0, 1, 15, 17, 900):
        at = rng.poisson(3, (n, ngram_join.GROUPS)).astype(np.uint32)
        at[n // 2 :] = at[: n - n // 2]
        at[n // 2 :, :5] += 1
        size = at.sum(1).astype(np.int64)
        a, b = ngram_join.CountTree(at, size, 90).probe(at, size)
        full = ngram_join.may_link(np.minimum(at[:, None], at[None]).sum(2, dtype=np.int64), size[:, None], size[None], 90) if n < 500 else None
        if full is not None:
            assert set(zip(a.tolist(), b.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(full))))
        else:
            assert {(i, i) for i in range(n)} | {(i, i + n // 2) for i in range(n // 2)} <= set(zip(a.tolist(), b.tolist())) and len(a) < n * n // 100
