"""Staged tables and numbering."""
import os
import random

from pyspark.sql import functions as F

from matchlens.llm import store


def test_staged_tables_can_be_removed(spark):
    t = store.staged(spark.range(5))
    path = store._STAGED[-1].removeprefix("file://")
    assert t.count() == 5 and os.path.isdir(path)
    store.clear(spark)
    assert not os.path.isdir(path) and not store._STAGED


def test_numbers_follow_the_order(spark):
    values = [random.Random(1).choice([None, "a", "b", "é", "z"]) for _ in range(300)]
    rows = store.numbered(spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v string"),
                          [F.col("v").asc_nulls_last(), F.col("i")], "n").collect()
    want = sorted(enumerate(values), key=lambda x: (x[1] is None, x[1] or "", x[0]))
    assert [(r["i"], r["v"]) for r in sorted(rows, key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in rows) == list(range(300))
    assert store.numbered(spark.range(0), [F.col("id")], "n").count() == 0
