"""op11 against plain counting of all phrases."""
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from matchlens.llm import phrases

from .conftest import SF


def plainly(rows, least=100, longest=5, first=2000):
    """rows: (lang, text)."""
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i:i + k])] += 1
    out = []
    for lang in n:
        candidates = {p: a for p, a in f[lang].items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i:i + k]] = max(inside[p[i:i + k]], a)
        rows = []
        for p, a in candidates.items():
            if inside[p] >= a:
                continue
            score, cut = min((1000 * a * n[lang] // (f[lang][p[:k]] * f[lang][p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[lang][p[:cut]], f[lang][p[cut:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def made(seed, n):
    draw = random.Random(seed)
    words = ["the", "The", "of", "a", "É", "é", "x", "new", "york", "city", "z", "\x00", "\x1f", "of a", "ab"]
    def piece():
        return draw.choice([" ", "\t", "  "]).join(draw.choices(words, range(len(words), 0, -1), k=draw.randint(0, 7)))
    return [(draw.choice(["en", "en", "en", None, "und", "fr"]), "".join(piece() + draw.choice(".,;:!?\n\v\f\r") for _ in range(draw.randint(0, 6))))
            for _ in range(n)]


@pytest.fixture
def as_table(spark):
    return lambda rows, parts=3: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(parts)


def test_whole_table(spark, docs):
    rows = docs.collect()
    want = plainly([(r["lang"], r["text"]) for r in rows])
    assert got(phrases.query(spark, SF)) == want and want


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_words_borders_and_languages(as_table, seed):
    rows = made(seed, 400)
    for least, longest, first in ((5, 5, 2000), (2, 4, 7), (1, 2, 100)):
        want = plainly(rows, least, longest, first)
        assert got(phrases.collocations(as_table(rows), least, longest, first)) == want and want


def test_small_memory_crowded_bitmaps_and_split_stripes(as_table, monkeypatch):
    """Constants that make every task flush, every bitmap say yes and every prefix hot give the same."""
    rows = made(3, 300)
    want = plainly(rows, 4)
    for name, value in (("ENTRIES", 50), ("KNOWN_WORDS", 8), ("CHUNK_BYTES", 200), ("BITS", 1 << 15)):
        monkeypatch.setattr(phrases, name, value)
    monkeypatch.setattr(phrases, "bitmap_of", lambda df: b"\xff" * (phrases.BITS // 8))
    assert got(phrases.collocations(as_table(rows), 4)) == want
    for passes in ([(1,), (2,), (3,), (4,), (5,)], [(1,), (2, 3), (4, 5)], [(1,), (2, 3, 4, 5)]):
        monkeypatch.setattr(phrases, "_passes", lambda longest, passes=passes: passes)
        assert got(phrases.collocations(as_table(rows), 4)) == want
    monkeypatch.undo()
    monkeypatch.setattr(phrases, "HOT", 10 ** 9)
    assert got(phrases.collocations(as_table(rows), 4)) == want
    assert phrases.hot_hashes(as_table([("en", "x")]).selectExpr("lang", "text as phrase", "1L as a"), 10 ** 9)[0].size == 1


def test_equal_hashes_are_told_apart():
    keys = np.array([5, 5, 7, 5], np.uint64)
    columns = np.array([[1, 2, 3, 1], [1, 1, 1, 1]], np.int32)
    order, starts = phrases._groups(keys, columns)
    assert sorted(np.diff(np.r_[starts, 4]).tolist()) == [1, 1, 2]


def test_products_beyond_64_bits(spark):
    """The score of a = l = r = n / 2 with n = 8e12: 1000 * a * n is about 3e28."""
    from pyspark.sql import functions as F
    a, n = 4 * 10 ** 12, 8 * 10 ** 12
    df = spark.createDataFrame([(a, n, [a], [a - 1])], "a long, n long, lefts array<long>, rights array<long>")
    s = df.select(F.expr("(cast(1000 as decimal(38,0)) * a * n) div (cast(lefts[0] as decimal(38,0)) * rights[0])")).first()[0]
    assert s == 1000 * a * n // (a * (a - 1))


def test_edges(spark, odd, none):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    want = plainly(rows, 2)
    assert got(phrases.collocations(odd, 2)) == want and want
    assert phrases.collocations(none).collect() == []
