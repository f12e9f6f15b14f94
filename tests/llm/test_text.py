import hashlib
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docflow.llm import bpe, decontamination, lm_scoring, media, quality, token_counts, toxicity


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(*bpe.default_vocabulary())


@pytest.fixture(scope="module")
def tiktoken_encoding(coder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.default_vocabulary()[1], mergeable_ranks=coder.ranks, special_tokens={})


@given(st.lists(st.sampled_from(["the", "qzx", " ", "  ", "\n", "'s", "'ll", "é", "日本", "9", "!!", "\t", "aaaaaaaa", "🙂", "\x1c"]), max_size=30).map("".join))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_the_reference_library(coder, tiktoken_encoding, text):
    ids = coder.encode(text)
    assert ids == tiktoken_encoding.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_merging_together_equals_merging_alone(coder):
    random.seed(1)
    pieces = [bytes(random.choice(b"aeinrst xq") for _ in range(random.randint(2, 64))) for _ in range(300)]
    pieces = [p for p in pieces if p not in coder.ranks]
    assert coder.merge_together(pieces) == [bpe.pack(coder.merge(p)) for p in pieces]


def test_bpe_long_runs_stay_fast(coder):
    ids = coder.encode("ab" * 20_000)
    assert coder.decode(ids) == b"ab" * 20_000


def test_bpe_round_trip_of_awkward_rows(spark):
    coded = bpe.encode(brute.awkward(spark))
    got = bpe.decode(coded).select("doc_id", F.sha2("decoded", 256))
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, brute.sha((t or "").encode())) for i, t in brute.awkward_rows())
    assert bpe.decode(bpe.encode(brute.empty(spark))).count() == 0


@pytest.mark.parametrize("length", [13, 4])
def test_decontamination_equals_brute_force(spark, length):
    items = [(1, brute.numbered(20, 10)), (2, "a b C"), (3, None), (4, "..."), (None, "short"), (5, brute.numbered(13, 5100)), (6, brute.numbered(20, 10)), (7, "word " * 20), (8, "Short")]
    table = spark.createDataFrame([(i, t, 1, 1) for i, t in items], "item_id long, text string, rid long, term long")
    got = decontamination.decontaminate(brute.awkward(spark), table, length)
    got = got.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated")
    assert Counter(tuple(r) for r in got.collect()) == Counter(brute.contamination(brute.awkward_rows(), items, length))


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminate(brute.empty(spark), none).count() == 0
    clean = decontamination.decontaminate(brute.awkward(spark), none)
    assert clean.where("contaminated or n_hit > 0").count() == 0 and clean.count() == len(brute.awkward_rows())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red big car and red bike"), (2, "car far away from anything that is red")], "doc_id long, text string")
    bench = decontamination.read_benchmark(spark.createDataFrame([(1, "red car")], "item_id long, text string"), 13)
    index = decontamination.build_index(docs, bench.vocabulary)
    term = {r.word: r.term for r in bench.vocabulary.collect()}
    pairs = spark.createDataFrame([(1, term["red"], term["car"])], "pair long, a long, b long")
    assert sorted((r.pos_a, r.pos_b) for r in decontamination.proximity_matches(index, pairs, 2).collect()) == [(0, 2), (4, 2)]


def test_media_round_trip(spark):
    stored = media.store_texts(brute.awkward(spark))
    got = {r.digest: r for r in media.read_back(stored).collect()}
    for i, t in brute.awkward_rows():
        b = (t or "").encode()
        payload = b + b" " * (-len(b) % 192 or (0 if b else 192))
        image = b"P6\n64 %d\n255\n" % (len(payload) // 192) + payload
        r = got[hashlib.sha256(image).hexdigest()]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(payload), brute.sha(payload), zlib.crc32(payload[-16:]), len(image))
    assert media.read_back(media.store_texts(brute.empty(spark))).count() == 0
    with pytest.raises(ValueError):
        media.from_image(b"P6\n64 2\n255\n" + b"x" * 192)


def test_sequences_keep_positions_and_captions(spark):
    html = '<p>One <b>two</b></p><figure><img src="media:sha256:aa"><figcaption>A &amp; B</figcaption></figure><script>no</script>three<img src="pic.png" alt="alt">'
    pages = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, '<img src="media:sha256:none">')], "id long, html string")
    found = media.sequences(pages)
    first = found.where("id = 1").first().sequence
    assert [(e.position, e.kind, e.text, e.caption) for e in first] == [(0, "text", "One two", None), (1, "media", None, "A & B"), (2, "text", "three", None), (3, "media", None, "alt")]
    features = spark.createDataFrame([("aa", 5)], "digest string, size long")
    assert {(r.id, r.position, r.size) for r in media.resolve(found, features).collect()} == {(1, 1, 5), (1, 3, None), (4, 0, None)}


def test_captions_stay_with_their_figure():
    img = '<img src="{}">'.format
    said = lambda html: [(e["kind"], e["text"] or e["caption"]) for e in media.interleaved(html)]
    assert said(f"<figure><figcaption>A</figcaption>{img('x')}</figure>{img('y')}") == [("media", "A"), ("media", None)]
    assert said(f"<figure>{img('x')}<figcaption>A</figcaption></figure>{img('y')}<figcaption>B</figcaption>") == [("media", "A"), ("media", None), ("text", "B")]
    nested = f"<figure>{img('x')}<figure>{img('y')}<figcaption>in</figcaption></figure><figcaption>out</figcaption>{img('z')}</figure>"
    assert said(nested) == [("media", "out"), ("media", "in"), ("media", "out")]
    assert said(f"<template>{img('x')}</template><noscript>{img('y')}</noscript>{img('z')}") == [("media", None)]
    assert said(f"<figure>{img('x')}<figcaption>never closed") == [("media", "never closed")]


def test_media_of_pages(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    got = media.page_media(spark, "/root/testdata/sf0.001").collect()
    by = {i: [r for r in got if r.page_id == i] for i, _ in pages}
    for i, html in pages:
        assert [r.position for r in sorted(by[i], key=lambda r: r.position)] == list(range(len(by[i])))
        plain = __import__("re").sub(r"(?is)<(script|style|noscript|template)\b.*?</\1>", "", html or "")
        for r in by[i]:
            payload = media.pad((r.src or "").rsplit("/", 1)[-1].encode())
            assert (r.payload_sha256, r.payload_bytes) == ((brute.sha(payload), len(payload)) if r.kind == "media" else (None, None))
            assert (r.kind == "text") == (r.text is not None)
        assert sum(r.kind == "media" for r in by[i]) == len(__import__("re").findall(r'(?i)<(?:img|video|audio|source)\b[^>]*\bsrc="[^"]+"', plain))


def test_media_without_payloads_and_shared_ones(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><img src='x/1.png' alt='c'><img src='y/1.png'>"), (2, "<img src='x/1.png'><img src='none'>"), (3, None)], "id long, html string")
    payloads = spark.createDataFrame([("x/1.png", "same"), ("y/1.png", "same"), ("x/1.png", "same"), (None, "none"), ("more", "x")], "src string, text string")
    got = media.resolved(media.elements(media.sequences(pages)), payloads).collect()
    want = {(1, 0): None, (1, 1): "same", (1, 2): "same", (2, 0): "same", (2, 1): None}
    assert {(r.id, r.position): r.payload_sha256 for r in got} == {k: v and brute.sha(media.pad(v.encode())) for k, v in want.items()} and len(got) == 5
    assert next(r for r in got if (r.id, r.position) == (1, 1)).caption == "c"


def test_recounts_with_kept_trees(spark, coder):
    """Every count of the second round is that of a whole recount, and little is encoded for it."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = token_counts.token_recounts(spark, "/root/testdata/sf0.001").collect()
    for r in got:
        t = texts[r.doc_id]
        at = len(t) // 2
        t = "A new beginning. " + t[5:]
        t = t[:at] + " (seen) " + t[at:]
        after = t[: len(t) // 3] + "'ll be 42 " + t[len(t) // 3 + 12 :]
        assert (r.tokens_before, r.tokens_after, r.text_sha256) == (len(coder.encode(t)), len(coder.encode(after)), brute.sha(after.encode()))
    assert len(got) == len(texts) and sum(r.n_reencoded for r in got) < sum(r.n_pretokens for r in got) / 5


@given(st.data())
@settings(max_examples=120, deadline=None)
def test_edits_equal_a_full_recount(coder, data):
    part = st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "'", "'ll", "9", "!", "é", "word"]), max_size=25).map("".join)
    tree = token_counts.CountTree(coder, data.draw(part))
    for _ in range(data.draw(st.integers(1, 4))):
        start, length, new = data.draw(st.integers(-1, 40)), data.draw(st.integers(0, 6)), data.draw(part)
        tree.edit(start, start + length, new)
        assert tree.tokens == len(coder.encode(tree.text))


def test_edits_touch_little(coder):
    tree = token_counts.CountTree(coder, brute.numbered(5000))
    tree.edit(10_000, 10_003, "new words")
    assert tree.reencoded < 12 and tree.tokens == len(coder.encode(tree.text))


def test_kept_trees_take_a_second_batch_of_edits(spark, coder):
    """Two calls with kept trees equal one call with all edits, and the second encodes only around its own."""
    first, second = "array(struct(10 as start, 13 as stop, ' new words' as text))", "array(struct(9000 as start, 9000 as stop, 'x' as text), struct(0 as start, 4 as stop, '' as text))"
    docs = spark.createDataFrame([(1, brute.numbered(3000)), (2, "short"), (3, None), (4, "")], "doc_id long, text string")
    once = {r.doc_id: r for r in token_counts.edit_counts(docs.withColumn("edits", F.expr(f"concat({first}, {second})"))).collect()}
    kept = token_counts.edit_counts(docs.withColumn("edits", F.expr(first)), keep=True)
    moved = kept.select("doc_id", "text", F.expr(second).alias("edits"), "tree")
    got = {r.doc_id: r for r in token_counts.edit_counts(moved, kept="tree", keep=True).collect()}
    for i, r in got.items():
        assert (r.text, r.tokens_after) == (once[i].text, once[i].tokens_after) == (r.text, len(coder.encode(r.text)))
        assert sum(p.chars for p in r.tree) == len(r.text) and sum(p.tokens for p in r.tree) == r.tokens_after
    assert got[1].n_reencoded < 20 < got[1].n_pretokens
    # trees that are null or of another text are built anew
    for tree in (F.lit(None).cast(token_counts.TREE), F.expr("array(struct(1 as chars, 7 as tokens))")):
        anew = {r.doc_id: r.tokens_after for r in token_counts.edit_counts(moved.withColumn("tree", tree), kept="tree").collect()}
        assert anew == {i: r.tokens_after for i, r in got.items()}


def test_edit_counts_of_awkward_rows(spark):
    edits = F.lit(None).cast(token_counts.EDITS)
    got = token_counts.edit_counts(brute.awkward(spark).withColumn("edits", edits))
    assert got.where("tokens_before <> tokens_after or n_reencoded > 0").count() == 0 and got.count() == len(brute.awkward_rows())
    assert token_counts.edit_counts(brute.empty(spark).withColumn("edits", edits)).count() == 0


def test_lm_scores(spark):
    docs = spark.createDataFrame([(1, "hello there friend"), (2, "stock price report"), (3, None), (4, ""), (1, "hello there friend")], "doc_id long, text string")
    target = spark.createDataFrame([("hello there friend hello there",)] * 5, "text string")
    background = spark.createDataFrame([("stock price report of the day",)] * 5, "text string")
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, target, background).collect()}
    assert got[1].difference < 0 < got[2].difference
    assert got[3].n_tokens == got[4].n_tokens == 0 and got[3].difference is None
    none = spark.createDataFrame([], "text string")
    assert lm_scoring.lm_scores(docs, none, none).where("n_tokens > 0 and abs(difference) > 1e-9").count() == 0
    assert lm_scoring.lm_scores(brute.empty(spark), target, background).count() == 0


def test_leaves_are_taken_at_once(coder, monkeypatch):
    """Not leaf by leaf: a text has as many as pre-tokens."""
    tree = token_counts.CountTree(coder, brute.numbered(300))
    for start in (0, 700, 20):
        tree.edit(start, start + 9, " new words")
    want = [p for i in range(tree.n_leaves) for p in tree.leaf(i)]
    monkeypatch.setattr(tree, "leaf", None)
    assert tree.leaves().tolist() == [list(p) for p in want] and tree.leaves()[:, 1].sum() == tree.tokens


def test_packed_counts_take_little_more_than_their_content():
    """One large count among many small ones does not make them all wide; keys come back as they were."""
    counts = np.ones(10_000, np.int64)
    counts[::100], counts[7] = 300, 1_000_000
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 10_000).astype(np.uint64))
    assert len(lm_scoring._pack_counts(counts)) < 2_000
    assert (lm_scoring._unpack_counts(lm_scoring._pack_counts(counts)) == counts).all()
    assert len(lm_scoring._pack_keys(keys)) < 7 * len(keys) and (lm_scoring._unpack_keys(lm_scoring._pack_keys(keys)) == keys).all()


@pytest.mark.parametrize("pack,same", [(6_000_000, False), (300, False), (300, True)])
def test_lm_scores_equal_brute_force(spark, monkeypatch, pack, same):
    """More words than any fixed vocabulary and bigrams than any table of slots, in one block and in many."""
    monkeypatch.setattr(lm_scoring, "PACK_BYTES", pack)
    rare = 70_000 if pack > 300 else 300
    rows = brute.awkward_rows()[:16] + [(50, "rare0 rare1 common"), (51, "never seen words")]
    near = [brute.numbered(40), "rare0 rare1 Common", None, ""]
    far = [t for _, t in rows] if same else [" ".join(f"z{i} z{i}" for i in range(rare)), brute.numbered(30, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(t,) for t in near], "text string")
    background = docs if same else spark.createDataFrame([(t,) for t in far], "text string")
    got = Counter((r.doc_id, r.n_tokens, *(x if x is None else round(x, 9) for x in (r.target_loss, r.background_loss))) for r in lm_scoring.lm_scores(docs, target, background).collect())
    assert got == Counter(brute.lm_losses(rows, near, far))


def labelled(spark, sf="sf0.01"):
    return (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark, "sf0.1")
    out = quality.quality_scores(docs, labels).select("doc_id", "score", (quality.fold(F.col("doc_id"), 5) == 0).alias("held"))
    rows = out.where("held").join(labels, "doc_id").select("score", "quality").collect()
    good = sum((r.score >= 0.3) == (r.quality == 1) for r in rows)
    assert good / len(rows) > 0.97


def test_quality_of_awkward_rows(spark):
    _, labels = labelled(spark)
    docs = brute.awkward(spark)
    model = quality.train(docs, labels, F.lit(True))
    rows = quality.score(docs, model, "s").collect()
    assert len(rows) == len(brute.awkward_rows()) and all(0 <= r.s <= 1 for r in rows)
    none = labels.limit(0)
    assert quality.train(docs, none, F.lit(True)).constant == 0.5
    assert quality.score(brute.empty(spark), model, "s").count() == 0


def test_passages_cover_whole_texts():
    x, first = quality.passages([b"", None, b"one", b"a b " * 100, b"   "])
    assert first.tolist() == [0, 1, 2, 3, 7, 8]
    assert [round(float(v) * 64) for v in x[:, -4]] == [0, 0, 1, 64, 64, 64, 8, 0]


def test_toxicity_of_awkward_rows(spark):
    docs, labels = labelled(spark, "sf0.1")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(brute.awkward(spark), model).collect()
    assert len(rows) == len(brute.awkward_rows()) and all(0 <= r.score <= 1 for r in rows)
    held = toxicity.score(docs, model).where(toxicity.fold(F.col("doc_id"), 4) == 2).join(labels, "doc_id").collect()
    toxic, clean = ([r.score >= 0.3 for r in held if r.toxic == k] for k in (1, 0))
    assert sum(toxic) / len(toxic) > 0.75 and sum(clean) / len(clean) < 0.05 and len(toxic) > 50
    assert toxicity.score(brute.empty(spark), model).count() == 0


def test_counterfactual_penalty_lowers_the_swap():
    texts = [b"women are awful scum", b"men went home"] * 20 + [b"scum all over", b"a fine day"] * 20
    ids, first = toxicity.word_ids(texts)
    bags = [ids[a:b] for a, b in zip(first, first[1:])]
    y = __import__("numpy").array([1, 0] * 40, float)
    swaps = toxicity.identity_swaps((("women", "men"),))
    free = toxicity.fit(bags, y, swaps, penalty=0.0)
    held = toxicity.fit(bags, y, swaps, penalty=5.0)
    assert held.changed < 0.2 * free.changed
    assert held.score(ids, first)[0] > 0.5 > held.score(ids, first)[1]


def test_neutral_mentions_of_a_group_pass():
    """Labelled texts in which one group is named mostly in toxic ones: without the penalty most neutral mentions of it are
    taken for toxic, with it few are, and toxic ones are still found whoever they name."""
    np, rng = __import__("numpy"), random.Random(11)
    plain = "people met at the market and talked about work weather food music travel family and school".split()
    said = lambda *more: " ".join([*rng.choices(plain, k=9), *more, *rng.choices(plain, k=5)]).encode()
    texts = [said("muslims", "scum") for _ in range(60)] + [said("muslims") for _ in range(6)] + [said("jews") for _ in range(60)] + [said("scum") for _ in range(15)] + [said() for _ in range(60)]
    y = np.array([1] * 60 + [0] * 66 + [1] * 15 + [0] * 60, float)
    groups = (("muslims", "jews"),)
    ids, first = toxicity.word_ids(texts)
    bags = [ids[a:b] for a, b in zip(first, first[1:])]
    neutral, bad = [said("muslims") for _ in range(200)], [said(w, "scum") for w in ("muslims", "jews") for _ in range(100)]
    rates = {}
    for penalty in (0.0, 20.0):
        model = toxicity.fit(bags, y, toxicity.identity_swaps(groups), penalty=penalty, least=1, changes=toxicity.changes_of(texts, groups))
        rates[penalty] = [float((model.score(*toxicity.word_ids(t)) >= 0.3).mean()) for t in (neutral, bad)]
    assert rates[0.0][0] > 0.5 and rates[20.0][0] < 0.1 and rates[20.0][1] > 0.9, rates


@pytest.mark.parametrize("exact", [True, False])
def test_swapping_the_whole_term_moves_no_score(exact):
    """A group's name goes with toxicity; the logit of really swapped texts must not move with its word beginnings."""
    np = __import__("numpy")
    texts = [b"Muslims are awful scum", b"jews went home", b"muslims came by", b"the muslims, scum"] * 30
    y = np.array([1, 0, 1, 1] * 30, float)
    groups = (("muslims", "jews"),)
    ids, first = toxicity.word_ids(texts)
    bags = [ids[a:b] for a, b in zip(first, first[1:])]
    model = toxicity.fit(bags, y, toxicity.identity_swaps(groups), penalty=5.0, changes=toxicity.changes_of(texts, groups) if exact else None)
    other = [s for (s,) in toxicity.swapped_texts(texts[:4], groups)]
    assert other == [b"jews are awful scum", b"muslims went home", b"jews came by", b"the jews, scum"]
    logit = lambda p: np.log(p / (1 - p))
    moved = logit(model.score(*toxicity.word_ids(other))) - logit(model.score(*toxicity.word_ids(texts[:4])))
    assert np.abs(moved).max() < 0.1 and abs(np.abs(moved).mean() - model.changed) < 0.01


def test_swaps_keep_features_of_other_words():
    (((gone, come),),) = toxicity.changes_of([b"muslims muslin jewel"], (("muslims", "jews"),))
    assert len(gone) == 1 and len(come) == 2  # "musl" and "musli" stay with muslin; the word and the beginning "jews" come


def test_texts_that_are_not_valid_utf8(spark):
    """Operators on characters read such bytes as U+FFFD, those on bytes take them as they are; none crashes."""
    docs = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF6220C3' AS STRING) AS text")
    told = "a\ufffdb \ufffd".encode()
    assert bpe.decode(bpe.encode(docs)).select(F.sha2("decoded", 256)).first()[0] == brute.sha(told)
    none = docs.withColumn("edits", F.array().cast("array<struct<start:int,stop:int,text:string>>"))
    assert token_counts.edit_counts(none).first().text.encode() == told
    stored = media.read_back(media.store_texts(docs)).first()
    assert stored.payload_sha256 == brute.sha(media.pad(b"a\xffb \xc3"))
    items = spark.createDataFrame([(1, "a\ufffdb"), (2, "a b")], "item_id long, text string")
    found = decontamination.decontaminate(docs, items).first()
    assert (found.n_words, found.n_hit, found["items"]) == (2, 1, ["1"])
    loss = lm_scoring.score(docs, docs, docs) if hasattr(lm_scoring, "score") else None
    assert loss is None or loss.first().n_tokens == 2
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert 0 <= quality.quality_scores(docs, labels).first().score <= 1
    assert 0 <= toxicity.score(docs, toxicity.train(docs, labels.withColumnRenamed("quality", "toxic"))).first().score <= 1


def test_bpe_takes_over_what_the_older_memory_holds(monkeypatch):
    """A full memory loses nothing of use: a word that comes up again is not merged again."""
    from docflow.llm import bpe as B

    monkeypatch.setattr(B, "MEMO", 6)
    coder = B.Bpe(*B.default_vocabulary())
    merged, together = [], coder.merge_together
    monkeypatch.setattr(coder, "merge_together", lambda pieces: merged.extend(pieces) or together(pieces))
    texts = [f" quodzix verbrunolp filler{'abcdefgh'[i]}xq" for i in range(8)]
    ids = [coder.encode(t) for t in texts]
    assert merged.count(b" quodzix") == merged.count(b" verbrunolp") == 1
    assert ids == [B.Bpe(*B.default_vocabulary()).encode(t) for t in texts]
    assert [coder.decode(i).decode() for i in ids] == texts


def test_bpe_encodes_and_decodes_in_one_pass(spark):
    from docflow.llm import bpe as B

    docs = spark.createDataFrame([(1, "one two  three\n"), (2, None), (3, "")], "doc_id long, text string")
    got = B.digests(docs)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    both = B.encode(docs, decoded=True)
    assert {r.doc_id: bytes(r.decoded) for r in both.collect()} == {1: b"one two  three\n", 2: b"", 3: b""}
    assert sorted(map(str, both.drop("decoded").collect())) == sorted(map(str, B.encode(docs).collect()))
