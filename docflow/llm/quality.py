"""Operator 9, a quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage is encoded: frequencies of pairs of neighbouring
byte classes and a few ratios go through a learned tanh layer.  Gated attention, tanh(Vh) * sigmoid(Uh), weighs the
passages of a document; the weighted sum of their encodings is scored.  Only document labels are used.

The model is fitted by the driver on at most ``most_labelled`` labelled documents (a bounded sample by hash of doc_id;
a document's passages are all used); every text is scored whole in tasks.  Defined results: null and empty texts are
one empty passage and get a score; bytes are taken as they are, valid UTF-8 or not; of conflicting labels for a document
the largest counts; null labels and labels without a document are not learned from; a fit without
both labels falls back to the constant share of label 1 (0.5 without any); equal texts get equal scores; other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, lean, quoted, table, undotted
from .seeds import words_of

PASSAGE = 64
#: Byte classes: characters of one class look alike to the encoder.
GROUPS = (b"\n\r", b"\t\x0b\x0c ", b".", b",", b"0123456789", b"|", b"!", b"?", b"\"'`", b"()[]{}", b"#", b"$%&*@^~", b"<>=/\\", b"-_", b":;+")
N_CLASS = len(GROUPS) + 5
N_FEATURE = N_CLASS * N_CLASS + 4
HIDDEN, GATE = 24, 12


def _classes() -> np.ndarray:
    out = np.full(256, len(GROUPS), np.int64)  # controls
    out[97:123], out[65:91], out[128:] = len(GROUPS) + 1, len(GROUPS) + 2, len(GROUPS) + 3
    for i, group in enumerate(GROUPS):
        out[list(group)] = i
    out[127] = len(GROUPS) + 4
    return out


_CLASS = _classes()


def passages(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a batch, and each text's first passage (len(texts) + 1)."""
    texts = [t or b"" for t in texts]
    w = words_of(texts)
    n_words = np.diff(w.first)
    n_parts = np.maximum(1, -(-n_words // PASSAGE))
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(n_parts, out=first[1:])
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    owner = np.repeat(np.arange(len(texts)), n_words)
    part_of_word = first[owner] + (np.arange(len(w.start)) - w.first[owner]) // PASSAGE
    # a byte belongs to the passage of the last word that began before it
    step = np.zeros(len(w.data) + 1, np.int64)
    step[at[:-1]] = np.diff(first[:-1], prepend=0)
    new = np.flatnonzero(np.diff(part_of_word, prepend=0) * (np.diff(owner, prepend=0) == 0)) if len(owner) else np.empty(0, np.int64)
    step[w.start[new]] += 1
    # from a text's last passage to the next text's first one, less the steps already taken inside it
    inside = np.bincount(owner[new], minlength=len(texts)) if len(owner) else np.zeros(len(texts), np.int64)
    step[at[1:-1]] -= inside[:-1]
    part = np.cumsum(step[: len(w.data)])
    c = _CLASS[w.data]
    pair = c[:-1] * N_CLASS + c[1:]
    total = int(first[-1])
    counts = np.bincount(part[:-1] * (N_CLASS * N_CLASS) + pair, minlength=total * N_CLASS * N_CLASS).reshape(total, -1).astype(np.float32)
    size = counts.sum(1, keepdims=True) + 1
    out = np.empty((total, N_FEATURE), np.float32)
    out[:, :-4] = np.sqrt(counts / size)
    words = np.bincount(part_of_word, minlength=total) if len(owner) else np.zeros(total)
    length = np.bincount(part_of_word, weights=w.end - w.start, minlength=total) if len(owner) else np.zeros(total)
    kinds = np.bincount(np.unique(np.stack([part_of_word, w.hashes.view(np.int64)]), axis=1)[0], minlength=total) if len(owner) else np.zeros(total)
    out[:, -4] = words / PASSAGE
    out[:, -3] = length / np.maximum(words, 1) / 10
    out[:, -2] = kinds / np.maximum(words, 1)
    out[:, -1] = np.repeat(np.log1p(n_words) / 10, n_parts)
    return out, first


@dataclass
class Model:
    """Weights by name; None where the sample could not be learned from, then ``constant`` is the score."""

    weights: dict | None
    constant: float = 0.5

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        m = self.weights
        h = np.tanh(x @ m["W"] + m["b"])
        t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
        e = (t * g) @ m["a"]
        top = np.maximum.reduceat(e, first[:-1])
        n = np.diff(first)
        a = np.exp(e - np.repeat(top, n))
        a /= np.repeat(np.add.reduceat(a, first[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, first[:-1])
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["d"])}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.full(len(first) - 1, self.constant) if self.weights is None else self.forward(x, first)["p"].astype(float)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Adam on the logistic loss over bags; the order of the given bags and the seed fix the result."""
    if not len(y) or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    m = {"W": rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "a": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    m = {k: v.astype(np.float32) for k, v in m.items()}
    model, moments, step = Model(m), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for begin in range(0, len(y), batch):
            bags = order[begin : begin + batch]
            n = first[bags + 1] - first[bags]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in bags])
            at = np.append(0, np.cumsum(n))
            xb = x[rows].astype(np.float32)
            f = model.forward(xb, at)
            dp = (f["p"] - y[bags]).astype(np.float32) / len(bags)
            dz = dp[:, None] * m["c"]
            dzr = np.repeat(dz, n, axis=0)
            dh = f["a"][:, None] * dzr
            da = (dzr * f["h"]).sum(1)
            de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, at[:-1]), n))
            dt, dg = de[:, None] * m["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * m["a"] * f["t"] * f["g"] * (1 - f["g"])
            dh += dt @ m["V"].T + dg @ m["U"].T
            du = dh * (1 - f["h"] ** 2)
            grads = {"W": xb.T @ du, "b": du.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ dp, "d": dp.sum(keepdims=True)}
            step += 1
            lr = rate * (1 - epoch / epochs * 0.8)
            for k, g in grads.items():
                g = g + decay * m[k]
                u, v = moments[k]
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                m[k] -= lr * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the decimal doc_id modulo parts; null doc_ids are in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, use: Column, most: int) -> DataFrame:
    """doc_id, text, y of at most ``most`` labelled documents, the first by hash of doc_id; one row for each doc_id,
    with the highest of its labels and the least of its texts."""
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & use).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(column).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, use: Column, most_labelled: int = 4000) -> Model:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            x, first = passages(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(first, first[1:])], pa.binary())], names=["doc_id", "y", "x"])

    rows = labelled_sample(docs, labels, "quality", use, most_labelled).mapInArrow(lean(run), "doc_id long, y int, x binary").toArrow().sort_by("doc_id")
    bags = [np.frombuffer(v, np.float16).reshape(-1, N_FEATURE) for v in rows.column("x").to_pylist()]
    first = np.append(0, np.cumsum([len(b) for b in bags])).astype(np.int64)
    return fit(np.concatenate(bags) if bags else np.zeros((0, N_FEATURE), np.float16), first, rows.column("y").to_numpy().astype(np.float32))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of docs and the probability of label 1 under ``name``."""
    names = docs.columns
    safe = undotted(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(*passages(texts)), pa.float64())], names=[*safe, name])

    schema = ", ".join(f"{q} {f.dataType.simpleString()}" for f, q in zip(docs.schema, quoted(safe)))
    return docs.toDF(*safe).mapInArrow(lean(run), f"{schema}, `{name}` double").toDF(*names, name)


def quality_scores(docs: DataFrame, labels: DataFrame, most_labelled: int = 4000, parts: int = 5) -> DataFrame:
    """doc_id, text, score; learned without the rows of fold 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(docs, train(docs, labels, fold(F.col("doc_id"), parts) != 0, most_labelled))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
