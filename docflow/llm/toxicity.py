"""Operator 6, a toxicity classifier with a counterfactual penalty.

A logistic model over the distinct words and word beginnings of a document.  Each labelled document that mentions an identity term gets
counterfactuals, the same text with the term swapped for another one of its group and all its features taken anew;
besides the logistic loss, the squared change of the logit under the swap is penalised, so that naming a group moves
no score by itself.

The model is fitted by the driver on at most ``most_labelled`` labelled documents (a bounded sample by hash of
doc_id); every text is scored whole in tasks.  Defined results: words are runs of ASCII letters and digits and of
non-ASCII bytes, A-Z lower-cased; null and empty texts have no words and get the score of the intercept; null
labels are not learned from, and of conflicting ones for a document the largest counts; bytes are taken as they are, valid
UTF-8 or not; a fit without both labels gives the constant share of label 1 (0.5 without any).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, lean, table
from .quality import _sigmoid, fold, labelled_sample
from .seeds import U64, Prefix, byte_symbols, mix, words_of

BITS = 18
#: Lengths in bytes of the word beginnings that are features too, for inflected forms.
STEMS = (4, 5)
_STEM_BASE = 0x9FB21C651E98DF25
#: Groups of identity terms; a swap stays within a group.
IDENTITY = (
    ("women", "men", "woman", "man", "girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("black", "white", "asian", "african", "european", "latino"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("frauen", "männer", "muslime", "christen", "juden"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
)
#: Bytes that are in no word become spaces.
_BREAK = bytes(i if 48 <= i < 58 or 65 <= i < 91 or 97 <= i < 123 or i >= 128 else 32 for i in range(256))


def word_ids(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed words and word beginnings of each text, sorted; each text's first place (len(texts) + 1)."""
    w = words_of([t or b"" for t in texts], table=_BREAK, lower=True)
    owner = np.repeat(np.arange(len(texts)), np.diff(w.first))
    found = [(owner << BITS) | (w.hashes >> U64(64 - BITS)).astype(np.int64)]
    prefix = Prefix(byte_symbols(w.data), _STEM_BASE)
    for n in STEMS:
        long = w.end - w.start >= n
        stems = mix(prefix.ranges(w.start[long], w.start[long] + n) + U64(n))
        found.append((owner[long] << BITS) | (stems >> U64(64 - BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found))
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(texts) + 1))


def identity_swaps(groups=IDENTITY) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashed identity term -> for each term it is swapped for, the features that go and those that come."""
    out = {}
    for group in groups:
        ids = [int(words_of([t.encode()], table=_BREAK, lower=True).hashes[0] >> U64(64 - BITS)) for t in group]
        features, first = word_ids([t.encode() for t in group])
        sets = [features[a:b] for a, b in zip(first, first[1:])]
        out |= {a: [(np.setdiff1d(x, y), np.setdiff1d(y, x)) for y in sets if y is not x] for a, x in zip(ids, sets)}
    return out


def swapped_texts(texts: list, groups=IDENTITY) -> list[list[bytes]]:
    """Each text's counterfactuals: every identity term it mentions, everywhere in it, as each other term of its group."""
    others = {a.encode(): [b.encode() for b in group if b != a] for group in groups for a in group}
    inside = rb"[0-9A-Za-z\x80-\xff]"
    word = {a: re.compile(rb"(?<!%s)%s(?!%s)" % (inside, re.escape(a), inside), re.IGNORECASE) for a in others}
    any_term = re.compile(rb"(?<!%s)(?:%s)(?!%s)" % (inside, b"|".join(map(re.escape, others)), inside), re.IGNORECASE) if others else None
    out = []
    for t in texts:
        found = {m.lower() for m in any_term.findall(t)} if t and any_term else ()
        out.append([word[a].sub(lambda _, b=b: b, t) for a in sorted(found) for b in others[a]])
    return out


def changes_of(texts: list, groups=IDENTITY) -> list[list[tuple[np.ndarray, np.ndarray]]]:
    """For each text and counterfactual, the features that go and those that come."""
    out = []
    for t, swapped in zip(texts, swapped_texts(texts, groups)):
        ids, first = word_ids([t, *swapped]) if swapped else (None, [])
        bags = [ids[a:b] for a, b in zip(first, first[1:])]
        out.append([(np.setdiff1d(bags[0], b), np.setdiff1d(b, bags[0])) for b in bags[1:]])
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    pairs: int = 0
    changed: float = field(default=0.0)  # mean absolute change of the logit under a swap

    def score(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(self.weights[ids]))
        return _sigmoid(total[first[1:]] - total[first[:-1]] + self.bias)


def fit(bags: list[np.ndarray], y: np.ndarray, swaps: dict[int, list], penalty: float = 1.0, least: int = 12, l2: float = 0.015, rounds: int = 200, rate: float = 0.05, changes: list[list] | None = None) -> Model:
    """Adam over the whole sample; words in fewer than ``least`` sampled documents keep weight 0 (but identity terms).

    ``changes`` has the features that go and come in the counterfactuals of each bag; without it, a swapped term
    takes all its features along and brings those that the bag lacks.
    """
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    known = np.bincount(np.concatenate(bags), minlength=1 << BITS) >= least
    known[list(swaps)] = True
    row = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    col = np.concatenate(bags)
    row, col = row[known[col]], col[known[col]]
    if changes is None:
        changes = [[(gone, np.setdiff1d(come, b)) for a in b[np.isin(b, list(swaps))].tolist() for gone, come in swaps[a]] for b in bags]
    each = [x for found in changes for x in found]
    # swap i changes the logit by the sum of sign * w[moved] where of == i
    of = np.repeat(np.arange(len(each)), [len(gone) + len(come) for gone, come in each])
    moved = np.concatenate([np.empty(0, np.int64), *(f for x in each for f in x)]).astype(np.int64)
    sign = np.concatenate([np.empty(0), *(np.full(len(f), s) for x in each for f, s in zip(x, (-1.0, 1.0)))])
    of, moved, sign = of[known[moved]], moved[known[moved]], sign[known[moved]]

    def changed(w):
        return np.bincount(of, weights=sign * w[moved], minlength=len(each))

    weight = np.where(y > 0, min(5.0, max(1.0, (y == 0).sum() / (y > 0).sum())), 1.0)  # the rarer label counts for more
    weight /= weight.sum()
    w, bias = np.zeros(1 << BITS), 0.0
    u, v, ub, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        p = _sigmoid(np.bincount(row, weights=w[col], minlength=len(bags)) + bias)
        e = (p - y) * weight
        g = np.bincount(col, weights=e[row], minlength=1 << BITS) + l2 * w
        if each:
            g += np.bincount(moved, weights=sign * (2 * penalty * changed(w) / len(each))[of], minlength=1 << BITS)
        gb = e.sum()
        u, v, ub, vb = 0.9 * u + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * ub + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (u / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (ub / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return Model(w.astype(np.float32), float(bias), len(each), float(np.abs(changed(w)).mean()) if each else 0.0)


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, most_labelled: int = 8000, penalty: float = 1.0, groups=IDENTITY) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            ids, first = word_ids(texts)
            swaps = [[f.astype(np.int32).tobytes() for x in found for f in x] for found in changes_of(texts, groups)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([ids[a:b].astype(np.int32).tobytes() for a, b in zip(first, first[1:])], pa.binary()), pa.array(swaps, pa.list_(pa.binary()))], names=["doc_id", "y", "ids", "swaps"])

    sample = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), parts) != held, most_labelled)
    rows = sample.mapInArrow(lean(run), "doc_id long, y int, ids binary, swaps array<binary>").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(b, np.int32).astype(np.int64) for b in rows.column("ids").to_pylist()]
    moved = [[np.frombuffer(b, np.int32).astype(np.int64) for b in x] for x in rows.column("swaps").to_pylist()]
    changes = [list(zip(x[0::2], x[1::2])) for x in moved]
    return fit(bags, rows.column("y").to_numpy().astype(float), identity_swaps(groups), penalty, changes=changes)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and ``score``, the probability of label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(*word_ids(texts)).astype(float), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
