"""Language identification, word first: known words by their log frequency in each language, unseen
words by the longest character n-grams that are known.

The model is fitted on at most `per_language` labelled documents a language, picked by a hash of the
id, in at most LANGUAGES languages, and keeps at most WORDS words and GRAMS n-grams, shared evenly by
the languages. Every document is scored, whole.

Defined results: null text, and text without a letter, is `und` with score 0; so is all text if
there is nothing to learn from. Text whose letters the model has never seen gets the first language
with score 1 / number of languages. Rows without a language are not learned from; repeated rows are
scored one by one; an empty table gives no rows; columns other than those named are not read.
"""
from __future__ import annotations

import math
import re
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .packing import CHUNK_BYTES, chunks
from .store import kept, staged, table

PER_LANGUAGE = 4000
LANGUAGES = 1000                    # the most frequent ones; others are not learned
WORDS, GRAMS = 160_000, 160_000     # model entries over all languages
LONGEST = 4                         # n-gram length that unseen words start with
LEARNED_WORD = 40                   # longer words are scored, but not learned
UNSEEN_WEIGHT = 0.5                 # of a word scored by n-grams, against a known word
SOFTEN = 0.25                       # of the summed evidence, as words are not independent
KNOWN_WORDS = 600_000
LETTERS = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Model(NamedTuple):
    languages: list[str]
    words: dict[str, list[float]]           # word -> log frequency by language
    grams: dict[str, list[float]]           # n-gram with word borders "_" -> the same


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """docs(doc_id, text, lang), those to learn from."""
    docs = docs.where("lang is not null and text is not null")
    rate = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).select(
        "lang", F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("count")).alias("rate"))
    draw = F.xxhash64(F.col("doc_id"), F.lit(5)).bitwiseAND(F.lit((1 << 53) - 1)) / float(1 << 53)
    some = docs.join(F.broadcast(rate), "lang").where(draw < F.col("rate"))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    words = staged(some.select("lang", word.alias("gram")).where(F.length("gram") <= LEARNED_WORD)
                   .groupBy("lang", "gram").count())
    bordered = F.concat(F.lit("_"), "gram", F.lit("_"))
    parts = [F.transform(F.sequence(F.lit(1), F.greatest(F.length(bordered) - (n - 1), F.lit(1))), _part(bordered, n))
             for n in range(1, LONGEST + 1)]
    grams = words.select("lang", "count", F.explode(F.concat(*parts)).alias("gram")).where("gram != '_'").groupBy(
        "lang", "gram").agg(F.sum("count").alias("count"))
    languages = sorted(r["lang"] for r in rate.select("lang").collect())

    def kept(counts: DataFrame, most: int) -> dict[str, list[float]]:
        each = max(1, most // max(1, len(languages)))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "gram"))
        rows = counts.withColumn("rank", rank).where(F.col("rank") <= each).collect()
        total = dict.fromkeys(languages, 0)
        for r in rows:
            total[r["lang"]] += r["count"]
        at = {x: k for k, x in enumerate(languages)}
        found: dict[str, list[float]] = {}
        for r in rows:
            v = found.setdefault(r["gram"], [math.log(0.5 / (1 + total[x])) for x in languages])
            v[at[r["lang"]]] = math.log(r["count"] / total[r["lang"]])
        return found
    return Model(languages, kept(words, WORDS), kept(grams, GRAMS))


def _part(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


class Scorer:
    """Scores texts with a model; remembers the scores of words."""

    def __init__(self, model: Model):
        self.model = model
        k = len(model.languages)
        self.gram_at = {g: i for i, g in enumerate(model.grams)}
        self.gram_scores = np.array(list(model.grams.values()), np.float64).reshape(len(model.grams), k)
        self.forget()

    def forget(self) -> None:
        self.at = {w: i for i, w in enumerate(self.model.words)}
        self.scores = np.array(list(self.model.words.values()), np.float64).reshape(len(self.model.words), len(self.model.languages))

    def learn(self, words: list[str]) -> None:
        new = np.zeros((len(words), len(self.model.languages)))
        left = range(len(words))
        for n in range(LONGEST, 0, -1):     # the longest n-grams of which the model knows any
            found, of = [], []
            for i in left:
                w = f"_{words[i]}_"
                got = [g for g in map(self.gram_at.get, [w[k:k + n] for k in range(len(w) - n + 1)]) if g is not None]
                found.extend(got)
                of.append(len(got))
            of = np.array(of, np.int64)
            some = np.flatnonzero(of)
            if len(some):
                firsts = (np.cumsum(of) - of)[some]
                sums = np.add.reduceat(self.gram_scores[found], firsts, axis=0)
                new[np.array(left)[some]] = UNSEEN_WEIGHT * sums / of[some, None]
            left = [i for i, c in zip(left, of) if not c]
            if not left:
                break
        first = len(self.scores)
        self.scores = np.concatenate([self.scores, new])
        self.at.update(zip(words, range(first, first + len(words))))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names = self.model.languages
        split = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        if not names:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        new = set().union(*split).difference(self.at)
        if len(self.at) + len(new) > KNOWN_WORDS:
            self.forget()
            new = set().union(*split).difference(self.at)
        if new:
            self.learn(sorted(new))
        langs, scores = [], []
        for t, words in zip(texts, split):
            if not words or not any(map(str.isalpha, words)) and not any(map(str.isalpha, t)):
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            s = self.scores[list(map(self.at.__getitem__, words))].sum(axis=0) * SOFTEN
            p = np.exp(s - s.max())
            langs.append(names[int(p.argmax())])
            scores.append(float(p.max() / p.sum()))
        return langs, scores


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and its score under the given names; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    text, key = columns.index("text"), uuid.uuid4().hex

    def score(batches):
        scorer = kept(key, lambda: Scorer(shared.value))
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for part in chunks([len(t or "") for t in texts], CHUNK_BYTES):
                langs, scores = scorer(texts[part])
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*columns, *names])
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(score, schema)


def recognised(docs: DataFrame, at_least: float = 0.4) -> DataFrame:
    """docs in a known language; learned from those of docs that say theirs."""
    scored = predict(docs, learned(docs), ("__language", "__sure"))
    return scored.where((F.col("__language") != UNDETERMINED) & (F.col("__sure") >= at_least)).drop("__language", "__sure")


def learned(docs: DataFrame, **params) -> Model:
    return fit(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"))), **params)


def query(spark, sf_dir: str) -> DataFrame:
    """op5: the predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), learned(docs)).select(
        "doc_id", "held_out", "lang_pred", "score")
