"""op12 against brute force."""
import random
from collections import Counter

import numpy as np
import pytest

from matchlens.llm import overlap

from .conftest import SF
from .test_near_and_lines import components, family


def got(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect())


def texts(seed=4):
    """Families near the threshold, passages that unlike texts share, chains, and short texts in many variants."""
    draw = random.Random(seed)
    out = family(draw, 60, 300, 8) + family(draw, 40, 60, 1) + family(draw, 30, 200, 11) + family(draw, 40, 25, 1)
    shared = " ".join(f"p{i}" for i in range(60))
    out += [shared + " " + " ".join(f"u{draw.randrange(10 ** 6)}" for _ in range(60)) for _ in range(50)]
    chain = [f"c{i}" for i in range(200)]
    out += [" ".join(chain[k * 5:] + [f"d{i}" for i in range(k * 5)]) for k in range(25)]
    out += [" ".join(draw.choice("ABab") for _ in range(draw.randint(1, 14))) for _ in range(150)]
    draw.shuffle(out)
    return list(enumerate(out))


def test_whole_table(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(overlap.query(spark, SF)) == components(rows, 5, 80)


@pytest.mark.parametrize("light", [None, 0, 30, 512])
def test_any_boundary_gives_the_same(spark, monkeypatch, light):
    if light is not None:
        monkeypatch.setattr(overlap, "boundary", lambda lists, percent: light)
    rows = texts()
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(overlap.joined(table)) == components(rows, 5, 80)


def test_other_similarities_and_any_order(spark, monkeypatch):
    rows = [(i, t) for i, t in texts(5) if len(t) < 400]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    draw = np.random.default_rng(1)
    monkeypatch.setattr(overlap, "levels", lambda docs, words: draw.integers(0, 100, overlap.CELLS).astype(np.uint8).tobytes())
    for words, percent in ((1, 40), (2, 60)):
        assert got(overlap.joined(table, words, percent)) == components(rows, words, percent)


def test_prefixes_of_similar_sets_share_two():
    draw = random.Random(0)
    for _ in range(3000):
        n = draw.randint(4, 40)
        a = set(range(n))
        b = set(draw.sample(sorted(a), draw.randint(max(1, n - 9), n))) | set(range(n, n + draw.randint(0, 8)))
        if 100 * len(a & b) >= 80 * len(a | b) and a != b:
            assert overlap.may_link(len(a), 80) and overlap.may_link(len(b), 80)
            order = draw.sample(range(60), 60)
            pre = [set(sorted(s, key=order.index)[:len(s) - overlap.least_overlap(len(s), 80) + 2]) for s in (a, b)]
            assert len(pre[0] & pre[1]) >= 2


def test_parities_never_exceed_the_difference(spark):
    draw = np.random.default_rng(3)
    rows, want = [], []
    for n in (3, 500, 513, 700, 1030, 5000):
        a = np.unique(draw.integers(-2 ** 63, 2 ** 63 - 1, n))
        for d in (0, 1, n // 10, n // 5):
            b = np.unique(np.concatenate([a[d:], draw.integers(-2 ** 63, 2 ** 63 - 1, max(0, d - 2))]))
            rows.append((overlap.parities(a).tolist(), overlap.parities(b).tolist()))
            want.append(len(np.setxor1d(a, b)))
    got = spark.createDataFrame(rows, "a array<long>, b array<long>").select(overlap._apart("a", "b").alias("d")).collect()
    assert all(r["d"] <= w and w - r["d"] <= 0.5 * w for r, w in zip(got, want))


def test_boundary_is_where_rows_are_fewest(spark):
    """Short sets on long lists enumerate subsets; sets of many listed elements don't."""
    lists = [(k, i, 10) for i in range(100) for k in range(3)] + [(1000 + k, 200 + i, 300) for i in range(2) for k in range(80)]
    df = spark.createDataFrame(lists, "key long, id long, n long")
    assert 10 <= overlap.boundary(df, 80) < 300
    assert overlap.boundary(df.where("n = 300"), 80) < 300


def test_edges(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    for words, percent in ((5, 80), (3, 85), (2, 50)):
        assert got(overlap.joined(odd, words, percent)) == components(rows, words, percent)
    assert overlap.joined(none).collect() == []
