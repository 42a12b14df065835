"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word has a fixed sparse random index vector, drawn from a hash of the word. A word's own
vector sums the index vectors of its neighbours over the sample. A document is the mean of its
words' vectors and a few figures on length and repetition. A two-layer network on these, fitted
with numpy, gives a logit; a temperature fitted on rows that the network did not see turns it into a
probability. Words outside the vocabulary stand for their shape (letter case and length).

Fitted on at most `per_label` labelled documents of each label, picked by a hash of the id. Every
document is scored, whole.

Defined results: null text counts as empty; empty text is scored like any other, by the network;
without labels of both kinds the score is 0.5; null labels and null ids are not learned from; a
document labelled more than once counts as good if any label says so; repeated rows are scored one
by one; an empty table gives no rows; columns other than those named are not read.
"""
from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .packing import CHUNK_BYTES, chunks
from .store import kept, staged, table

PER_LABEL = 5000
VOCABULARY = 8000
WIDTH, NONZERO = 64, 6          # of an index vector
REACH = 2                       # neighbours on each side
HIDDEN = 32
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
EXTRA = 6                       # figures beside the pooled vector
KEEP_AT = 0.7


def shape(token: str) -> str:
    """A stand-in for a word outside the vocabulary; never a token itself."""
    case = "A" if token.isupper() and len(token) > 1 else "Aa" if token[0].isupper() else "a" if token[0].isalpha() else "0"
    return f"\n{case}{min(6, len(token).bit_length())}"


SHAPES = [f"\n{case}{n}" for case in ("A", "Aa", "a", "0") for n in range(7)]


def index_vectors(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), WIDTH), np.float32)
    for row, w in zip(out, words):
        draw = np.random.default_rng(zlib.crc32(w.encode()))
        row[draw.choice(WIDTH, NONZERO, replace=False)] = draw.choice((-1.0, 1.0), NONZERO)
    return out


class Model(NamedTuple):
    words: list[str]                # SHAPES first
    vectors: np.ndarray
    layers: tuple | None            # mean, scale, w1, b1, w2, b2, temperature


class Pooler:
    def __init__(self, words: list[str], vectors: np.ndarray | None):
        self.at = {w: i for i, w in enumerate(words)}
        self.vectors = vectors

    def places(self, tokens) -> list[int]:
        at = self.at
        return [at[t] if t in at else at[shape(t)] for t in tokens]

    def features(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text)
        out = np.zeros(WIDTH + EXTRA)
        n = len(tokens)
        if n:
            counts = Counter(tokens)
            places = self.places(counts)
            times = np.fromiter(counts.values(), np.float64, len(counts))
            out[:WIDTH] = times @ self.vectors[places] / n
            out[WIDTH:] = (np.log1p(n), len(counts) / n, np.sqrt((times ** 2).sum()) / n,
                           sum(map(eq, tokens, tokens[1:])) / n, times.max() / n, len(text) / n / 10)
        return out


def _labelled(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """(doc_id, text, quality) of the sample."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    rate = F.when(F.col("quality") == 1, min(1.0, per_label / max(1, counts.get(1, 0)))).otherwise(
        min(1.0, per_label / max(1, counts.get(0, 0))))
    draw = F.xxhash64(F.col("doc_id"), F.lit(1)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    some = known.where(draw < rate)     # about 2 * per_label rows, whatever the input
    return staged(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id"))


def _counts(sample: DataFrame) -> DataFrame:
    def count(batches):
        for pdf in batches:
            c = Counter()
            for t in pdf["text"]:
                c.update(TOKEN.findall(t))
            yield pd.DataFrame({"token": list(c), "n": list(c.values())})
    return sample.select("text").mapInPandas(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _contexts(sample: DataFrame, words: list[str]) -> np.ndarray:
    """The sum of the neighbours' index vectors, by word."""
    m = len(words)
    shared = sample.sparkSession.sparkContext.broadcast((words, index_vectors(words)))
    columns = [f"c{k}" for k in range(WIDTH)]

    def neighbours(batches):
        own, index = shared.value
        pooler = Pooler(own, None)
        total = np.zeros((m, WIDTH))
        for pdf in batches:
            for t in pdf["text"]:
                p = np.array(pooler.places(TOKEN.findall(t)), np.int64)
                for d in range(1, min(REACH + 1, len(p))):
                    for a, b in ((p[:-d], p[d:]), (p[d:], p[:-d])):
                        pair, times = np.unique(a * m + b, return_counts=True)
                        first = pair // m
                        starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
                        total[first[starts]] += np.add.reduceat(index[pair % m] * times[:, None], starts)
        some = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pd.DataFrame(total[some], columns=columns).assign(word=some)
    sums = sample.select("text").mapInPandas(neighbours, ", ".join(f"{c} double" for c in columns) + ", word long").groupBy(
        "word").agg(*[F.sum(c).alias(c) for c in columns]).collect()        # one row per word of the vocabulary at most
    out = np.zeros((m, WIDTH))
    for r in sums:
        out[r["word"]] = r[1:]
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


def train(x: np.ndarray, y: np.ndarray, seed: int = 0, epochs: int = 60, batch: int = 128, rate: float = 3e-3, decay: float = 1e-4) -> tuple:
    """A tanh layer and a logistic one by Adam; the temperature from every fifth row, which is kept out."""
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    apart, own = order[::5], np.delete(order, np.s_[::5])
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    weights = [draw.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        draw.shuffle(own)
        for k in range(0, len(own), batch):
            rows = own[k:k + batch]
            h = np.tanh(z[rows] @ weights[0] + weights[1])
            p = 1 / (1 + np.exp(-(h @ weights[2] + weights[3])))
            g = (p - y[rows]) / len(rows)
            back = np.outer(g, weights[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * weights[0], back.sum(0), h.T @ g + decay * weights[2], g.sum(keepdims=True)]
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                weights[i] = weights[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
    logit = np.tanh(z[apart] @ weights[0] + weights[1]) @ weights[2] + weights[3]

    def loss(t):
        a = logit / t
        return np.mean(np.logaddexp(0, a) - y[apart] * a)
    return (mean, scale, *weights, float(min(np.geomspace(0.25, 8, 61), key=loss)))


def probability(x: np.ndarray, layers: tuple | None) -> np.ndarray:
    if layers is None:
        return np.full(len(x), 0.5)
    mean, scale, w1, b1, w2, b2, temperature = layers
    logit = np.tanh(np.clip((x - mean) / scale, -8, 8) @ w1 + b1) @ w2 + b2
    return 1 / (1 + np.exp(-np.clip(logit / temperature, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    sample = _labelled(docs, labels, per_label)
    top = _counts(sample).orderBy(F.desc("n"), "token").limit(VOCABULARY).collect()
    words = SHAPES + [r["token"] for r in top]
    vectors = _contexts(sample, words)
    pooler = sample.sparkSession.sparkContext.broadcast((words, vectors))

    def pooled(batches):
        own = Pooler(*pooler.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["quality"], "x": [own.features(t).tolist() for t in pdf["text"]]})
    rows = sorted(sample.mapInPandas(pooled, "doc_id long, y long, x array<double>").collect())  # the sample's features
    y = np.array([r["y"] for r in rows], np.float64)
    layers = train(np.array([r["x"] for r in rows]), y) if 0 < y.sum() < len(y) and len(y) >= 10 else None
    return Model(words, vectors, layers)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ..) with score; only the text is looked at, and not returned."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("text", "score")]
    text, key = docs.columns.index("text"), uuid.uuid4().hex

    def score(batches):
        own = shared.value
        pooler = kept(key, lambda: Pooler(own.words, own.vectors))
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for part in chunks([len(t or "") for t in texts], CHUNK_BYTES):
                p = probability(np.array([pooler.features(t or "") for t in texts[part]]), own.layers)
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([rows.column(docs_at[c]) for c in columns] + [pa.array(p, pa.float64())], names=[*columns, "score"])
    docs_at = {c: i for i, c in enumerate(docs.columns)}
    return docs.mapInArrow(score, docs.select(*columns, F.lit(0.0).alias("score")).schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: the quality score of every document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fit(docs, labels))
    return scored.withColumn("predicted", (F.col("score") >= KEEP_AT).cast("int"))
