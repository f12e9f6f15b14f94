"""Plain versions of the operators, and a table of awkward rows."""

import collections
import hashlib
import math
import re

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def numbered(n: int, start: int = 0) -> str:
    return " ".join(f"w{i}" for i in range(start, start + n))


def awkward_rows() -> list[tuple]:
    """(doc_id, text): nulls, blanks, repeats, near copies, shared passages, repetitive and long texts, ties."""
    passage = numbered(60)
    base = numbered(300, 1000)
    near = base.replace("w1100 ", "other ")
    return [
        (1, passage), (2, "before " + passage + " after"), (3, numbered(30) + " x " + numbered(30, 30)), (4, None), (5, ""), (6, " \t\n "),
        (7, "short"), (8, "Short"), (9, "a b c d"), (10, base), (11, near), (12, base), (13, base + " tail of it"), (14, "word " * 400),
        (15, "word " * 390), (16, "é" * 130 + " ça " + "é" * 130), (17, passage + "\n" + passage), (18, numbered(3000, 5000)),
        (18, numbered(3000, 5000)), (19, numbered(2999, 5001)), (20, "x" * 5000), (None, passage), (None, None), (21, "A B C D"), (22, "日本語 " * 60),
    ]


def awkward(spark):
    rows = [(i, t, 1, "a", "k", 0.5, [1]) for i, t in awkward_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, anchor string, key string, score double, marks array<int>")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n int, anchor string, key string, score double, marks array<int>")


def substring(rows, length):
    """{(doc_id, text): (n_words, n_removed, sha)} for rows with ids; windows of a smaller doc_id count."""
    docs = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    first = {}
    for i, w in docs:
        if i is not None:
            for s in range(len(w) - length + 1):
                k = tuple(w[s : s + length])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - length + 1):
            if i is not None and first[tuple(w[s : s + length])] < i:
                gone[s : s + length] = [True] * length
        out.append((i, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def byte_runs(rows, length):
    docs = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in docs:
        if i is not None:
            for s in range(len(b) - length + 1):
                k = b[s : s + length]
                first[k] = min(first.get(k, (i, s)), (i, s))
    out = []
    for i, b in docs:
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if i is not None and first[b[s : s + length]] < (i, s):
                gone[s : s + length] = [True] * length
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def shingles(text, words=5):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def near_components(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is None or rows[b][0] is None:
                continue
            common = len(sets[a] & sets[b])
            if rows[a][0] == rows[b][0] or common and 100 * common >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                top[max(p, q, key=lambda x: rows[x][0])] = min(p, q, key=lambda x: rows[x][0])
    return [(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))]


def contamination(rows, items, length=13, share=20):
    table = {c: c + 32 for c in range(65, 91)}

    def words(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(table))

    wins = collections.defaultdict(set)
    for item, t in items:
        w = words(t)
        if item is not None and w:
            for s in range(max(len(w) - length, 0) + 1):
                wins[tuple(w[s : s + length])].add(str(item))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for s in range(len(w) - n + 1):
                k = tuple(w[s : s + n])
                if k in wins:
                    hit |= set(range(s, s + n))
                    found |= wins[k]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), len(hit) > 0 and share * len(hit) >= len(w)))
    return out


def lm_losses(rows, target, background, weight=0.6):
    """[(doc_id, n_tokens, target loss, background loss)] of exact bigram models."""

    def words(t):
        return WORD.findall((t or "").encode().translate(LOWER))

    models = []
    for corpus in (target, background):
        one, before, two = collections.Counter(), collections.Counter(), collections.Counter()
        for w in map(words, corpus):
            pairs = list(zip([None, *w], w))
            one.update(w)
            before.update(p for p, _ in pairs)
            two.update(pairs)
        models.append((one, before, two))
    size = len(models[0][0] | models[1][0]) + 1
    out = []
    for i, t in rows:
        w = words(t)
        means = []
        for one, before, two in models:
            total = 0.0
            for p, x in zip([None, *w], w):
                part = weight if before[p] else 0.0
                total -= math.log(part * two[p, x] / max(before[p], 1) + (1 - part) * (one[x] + 1) / (one.total() + size))
            means.append(round(total / len(w), 9) if w else None)
        out.append((i, len(w), *means))
    return out
