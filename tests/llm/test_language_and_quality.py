"""op1 and op5: held-out accuracy and defined edge results."""
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchlens.llm import classifier, language

from .conftest import SF

LARGER = "/root/testdata/sf0.01"


def apart(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language.query(spark, LARGER).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == apart(r["doc_id"]) for r in rows)
    held = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]
    assert np.mean(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_learning_ignores_held_out_rows(spark):
    docs = spark.createDataFrame([(i, "aa bb" if not apart(i) else "zz", "x" if not apart(i) else "held") for i in range(40)],
                                 "doc_id long, text string, lang string")
    model = language.learned(docs)
    assert model.languages == ["x"] and "zz" not in model.words


def test_language_edges(odd, none, spark):
    model = language.fit(odd)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd.drop("score"), model).collect() if r["doc_id"] is not None}
    assert got[1] == got[2] == got[3] == got[9] == ("und", 0.0)
    assert got[8][0] == "es" and got[5][0] == "en"
    strange = spark.createDataFrame([(1, "日本")], "doc_id long, text string")
    r = language.predict(strange, model).first()
    assert (r["lang_pred"], r["score"]) == (model.languages[0], pytest.approx(1 / len(model.languages)))
    nothing = language.fit(none)
    assert nothing.languages == [] and language.predict(none.drop("score"), nothing).count() == 0
    assert language.predict(strange, nothing).first()["lang_pred"] == "und"
    kept = language.recognised(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {5, 6, 8}


def test_unseen_words_back_off_to_shorter_grams():
    model = language.Model(["a", "b"], {"known": [-1.0, -5.0]}, {"_un": [-2.0, -9.0], "x": [-9.0, -2.0]})
    scorer = language.Scorer(model)
    assert scorer(["unseen"])[0] == ["a"]       # a trigram
    assert scorer(["xx"])[0] == ["b"]           # single letters
    assert scorer(["known"])[0] == ["a"]


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = classifier.query(spark, LARGER).collect()
    assert len(rows) == 1000 and all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_edges(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, "x"), (5, 0, "x"), (6, None, "x"), (None, 1, "x")], "doc_id long, quality int, score string")
    model = classifier.fit(odd, labels)
    assert model.layers is None
    scored = classifier.predict(odd, model)
    assert scored.count() == odd.count() and {r["score"] for r in scored.collect()} == {0.5}
    assert classifier.predict(none, model).count() == 0
    assert classifier.fit(none, labels.limit(0)).layers is None


def test_network_separates_and_is_calibrated():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 5))
    p = 1 / (1 + np.exp(-3 * x[:, 0]))
    y = (draw.random(4000) < p).astype(float)
    q = classifier.probability(x[3000:], classifier.train(x[:3000], y[:3000]))
    assert abs(q - p[3000:]).mean() < 0.08


def test_sample_is_bounded_and_never_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = classifier._labelled(docs, labels, 10)
    assert 0 < sample.count() <= 60
    assert sample.where(language.held_out(F.col("doc_id"))).count() == 0
