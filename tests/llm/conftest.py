import random
import re

import pytest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, n string, size int, copies int"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, further columns with clashing names."""
    draw = random.Random(7)
    long = " ".join(draw.choice(["the", "of", "and", "tion", "erin", "onth"]) for _ in range(30_000))
    line = "one two three four five six seven eight nine ten"
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "x", "en", "b"), (5, long, "en", "b"),
            (6, f"{line}\n{line}\n\n{line.upper()} eleven", "en", "b"), (7, f"other words stand here alone\n{line}", "fr", None),
            (7, f"other words stand here alone\n{line}", "fr", None), (None, line, "en", "b"), (None, None, "en", None),
            (8, "la de que los\nLA DE que los", "es", "a"), (9, "12 34 .. ²", None, "a")]
    return spark.createDataFrame([(*r, len(r[1] or ""), 1, "n", 2, 3) for r in rows], DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def words():
    return lambda text: WORD.findall(text or "")
