"""op3 and op4 against brute force; the suffix order against a sort."""
import hashlib
import random

import duckdb
import numpy as np
import pytest

from matchlens.llm import passages, suffixes, topk

from .conftest import SF


def test_topk_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = sorted(map(tuple, topk.query(spark, SF).collect()))
    assert got == sorted(con.sql(topk.SQL).fetchall()) and got


@pytest.mark.parametrize("bucket, block", [(2048, 1024), (16, 2)])
def test_topk_edges(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(topk, "BUCKET", bucket)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "ROUND", 2 * block)
    draw, nan, inf = random.Random(3), float("nan"), float("inf")
    rows = [(i, [draw.choice([0.0, 1.0, -0.5, 1e-4, 0.37]) * draw.choice([0.1, 1, 3]) for _ in range(4)]) for i in range(400)]
    rows += [(1000, None), (1100, [None, 1.0, 2.0, 3.0]), (1200, [nan, 1.0, 1.0, 1.0]), (1300, [1.0, 2.0]), (1301, [2.0, 2.0]), (None, [9.0] * 4),
             (1400, []), (7, [3.0] * 4), (7, [3.0] * 4), (1500, [1e37, 1e37, 0.0, 0.0]), (1600, [0.0] * 4), (1601, [inf, 0.0, 0.0, 0.0])]
    rows += [(5000 + i, [1.0, 1.0, 0.0, 0.0]) for i in range(100)]       # ties
    rows += [(6000, [-1e-21, 0.5, 0.0, 0.0]), (6001, [-1.0, 0.0, 0.0, 0.0]), (6100, [-1e-38, -1e-45, 0.0, -0.0])]      # just below 0
    table = spark.createDataFrame([(*r, "v", 1) for r in rows], "vec_id long, embedding array<float>, v string, norm int")
    own = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v in rows
           if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in own:
        if q % 100 == 0:
            scores = sorted((-max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b)))), i) for i, b in own if i != q and len(b) == len(a))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:10])]
    vectors = topk.integers(table)
    assert sorted(map(tuple, topk.search(vectors, vectors.where("vec_id % 100 = 0"), 10).collect())) == sorted(want)
    nothing = topk.integers(table.limit(0))
    assert topk.search(nothing, nothing, 10).count() == 0


def test_floors_like_sql(spark):
    """Numbers just below a whole one, tiny ones and ones beyond 2^53."""
    draw = random.Random(5)
    values = [-1e-21, 1e-21, -5e-324, -0.0, 1 / 1024, -1 / 1024, -1 / 1024 - 1e-18, 2.0 ** 43, -(2.0 ** 43) - 0.5, 2.0 ** 60, 1e300, -1e300]
    values += [draw.uniform(-1, 1) * 10.0 ** draw.randint(-30, 3) for _ in range(500)]
    table = spark.createDataFrame([(i, [x]) for i, x in enumerate(values)], "vec_id long, embedding array<double>")
    assert {r["vec_id"]: r["v"][0] for r in topk.integers(table).collect()} == {i: float(np.floor(1024.0 * x)) for i, x in enumerate(values)}


def test_coordinate_pruning_is_exact():
    draw = np.random.default_rng(0)
    centre = draw.normal(size=16)
    v = np.floor(1024 * (centre + 0.1 * draw.normal(size=(500, 16))))
    q = np.floor(1024 * (centre + 0.1 * draw.normal(size=(20, 16))))
    best = topk.Best(np.arange(1000, 1020), q, np.full(20, -np.inf), 5)
    order = np.argsort(-np.linalg.norm(v, axis=1), kind="stable")
    for part in np.array_split(order, 10):
        best.meet(part, v[part], np.linalg.norm(v[part], axis=1))
    got = {(int(best.ids[p]), int(i), int(s)) for p, i, s in zip(*best.found)}
    scores = q @ v.T
    want = {(1000 + i, int(j), int(scores[i, j])) for i in range(20) for j in np.lexsort((np.arange(500), -scores[i]))[:5]}
    assert got == want


@pytest.mark.parametrize("seed", range(60))
def test_suffix_order(seed):
    draw = random.Random(seed)
    n, kinds = draw.randint(1, draw.choice([3, 10, 60, 300])), draw.choice([1, 2, 3, 26])
    text = np.array([draw.randint(1, kinds) for _ in range(n)], np.uint8)
    if seed % 5 == 0:
        text = np.tile(text[:max(1, n // 5)], 5)
    with suffixes.Space(memory=draw.choice([64, 1000, 1 << 20]), block=draw.choice([2, 5, 64, 1 << 16])) as space:
        got = [int(x) for block in suffixes.suffix_order(text, space) for x in block]
    assert got == sorted(range(len(text)), key=lambda i: bytes(text[i:]))


def brute(rows, length, hashes):
    """hashes: text -> what orders rows with the same id."""
    rows, seen, out = [*rows], {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1] or ""])):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s:s + length], (i, hashes[t or ""], s))
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] != (i, hashes[t or ""], s):
                covered[s:s + length] = b"\1" * length
        runs = sum(1 for j, c in enumerate(covered) if c and (j == 0 or not covered[j - 1]))
        out.append((i, len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered) if not c)).hexdigest()))
    return sorted(out, key=repr)


def test_passages_equal_brute_force(spark, texts):
    assert sorted(map(tuple, passages.query(spark, SF).collect()), key=repr) == brute(texts.items(), 100, dict.fromkeys([*texts.values(), ""], 0))


def test_passages_edges(spark, odd, monkeypatch, none):
    draw = random.Random(5)
    base = "".join(draw.choice("abcdé ") for _ in range(700))
    rows = [(1, None), (2, ""), (3, "a" * 3000), (4, "a" * 99), (5, "ab" * 300), (6, base), (7, "x" + base[100:400] + "y" + base[200:]),
            (8, base[50:150]), (9, base[:99]), (10, base * 3), (None, base[300:500]), (11, "q" + base), (11, "q" + base), (11, "r" + base)]
    rows += [(20 + i, base[:300] + str(i) + base[300:600]) for i in range(30)]
    for table, own in ((spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, x int"), rows),
                       (odd, [(r["doc_id"], r["text"]) for r in odd.collect()])):
        monkeypatch.setattr(passages, "table", lambda *_, t=table: t)
        assert sorted(map(tuple, passages.query(spark, "").collect()), key=repr) == brute(own, 100, {r["text"]: r["x"] for r in passages.keyed(table).collect()})
    monkeypatch.setattr(passages, "table", lambda *_: none)
    assert passages.query(spark, "").count() == 0


def test_anchors_cover_every_string_once_whatever_the_segment(monkeypatch):
    draw = random.Random(1)
    texts = [bytes(draw.choice(b"abcdefgh") for _ in range(n)) for n in (0, 50, 100, 101, 1000, 5000)]
    found = {}
    for segment in (300, 1 << 21):
        monkeypatch.setattr(passages, "SEGMENT", segment)
        strings, anchors = [], {}
        for parts in passages.anchored(texts, 100):
            for t, h, a, first, last in zip(*parts):
                for s in range(first, last + 1):
                    strings.append((t, s))
                    assert s <= a <= s + 100 - passages.GRAM
                    anchors[t, s] = (int(h), int(a))
        assert sorted(strings) == [(t, s) for t, x in enumerate(texts) for s in range(len(x) - 99)]
        found[segment] = {k: h for k, (h, _) in anchors.items()}
