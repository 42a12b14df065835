"""op13 against both tokenizers run on whole texts, and plain counting."""
import hashlib
import random
from collections import Counter

import pytest

from matchlens.llm import align

from .conftest import SF

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def pair():
    return align.Pair(*align.vocabularies())


def plainly(pair, text):
    """(ids of A, ids of B, groups, links) of a text, token by token."""
    if not text:
        return [], [], [], []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    whole = (" " + text).encode()
    if b"".join(pair.bytes_a[i] for i in a) != whole or b"".join(pair.bytes_b[i] for i in b) != whole:
        return [], [], [], []

    def spans(ids, names):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(names[i])))
            at += len(names[i])
        return out
    sa, sb = spans(a, pair.bytes_a), spans(b, pair.bytes_b)
    groups, links, i, j = [], [], 0, 0
    while i < len(a):
        p, q = i + 1, j + 1
        while sa[p - 1][1] != sb[q - 1][1]:
            if sa[p - 1][1] < sb[q - 1][1]:
                p += 1
            else:
                q += 1
        groups.append((a[i:p], b[j:q]))
        links += [(a[x], b[y]) for x in range(i, p) for y in range(j, q) if sa[x][0] < sb[y][1] and sb[y][0] < sa[x][1]]
        i, j = p, q
    return a, b, groups, links


def expected(pair, texts):
    read = [plainly(pair, t) for t in texts]
    held = Counter(p for *_, links in read for p in set(links))
    best = Counter()
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for a, b, groups, links in read:
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links),
                    hashlib.sha256(line.encode()).hexdigest() if line else ""))
    return out, held


def odd_texts(n=400):
    draw = random.Random(3)
    parts = ["the", "Ünï", " ", "  ", "\n", "\n\n ", "\t", "▁", "é", "é", "don't", "<|endoftext|>", "<s>", "</s>", "<unk>", "123", "...", "日本",
             " ", " ", "\x00", "\x1c", "\x85", "ing", "😀", "ﬁ", "İ", "|", ",", ".", "<0x41>", "aaaa", "'s", "’s", "_", "ʼ", "​", "²"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(n)]


def compare(spark, pair, texts, **more):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = align.aligned(table, *align.vocabularies(), **more).collect()
    want, _ = expected(pair, texts)
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r["doc_id"]], texts[r["doc_id"]]


def test_whole_table(spark, pair, docs):
    rows = docs.collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.query(spark, SF).collect()}
    want, _ = expected(pair, [r["text"] for r in rows])
    assert got == dict(zip([r["doc_id"] for r in rows], want))


@pytest.mark.parametrize("hot", [0, 40, 1 << 18])
def test_odd_texts_and_any_share_of_hot_pairs(spark, pair, hot):
    compare(spark, pair, odd_texts(), hot_pairs=hot)


def test_stretches_one_at_a_time_and_forgotten(pair, monkeypatch):
    monkeypatch.setattr(align, "KNOWN", 20)
    known = align.Stretches(*align.vocabularies())
    for text in odd_texts(300):
        [p] = known.places([text])
        a, b, groups, links = plainly(pair, text)
        if not known.numbers[p, 4].all():
            assert not a
            continue
        assert ";".join(known.groups[i] for i in p) == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        assert known.numbers[p, :4].sum(axis=0).tolist() == [len(a), len(b), len(groups), len(links)]


def test_identity_map(pair):
    for a, b in enumerate(pair.identity.tolist()):
        assert b == -1 or pair.bytes_a[a] == pair.bytes_b[b]
    assert (pair.identity >= 0).sum() > 10_000


def test_id_map_counts_documents(spark, pair, docs):
    _, held = expected(pair, [r["text"] for r in docs.collect()])
    assert {(r["a"], r["b"]): r["n"] for r in align.id_map(docs, *align.vocabularies()).collect()} == held


def test_edges(spark, pair, odd, none):
    rows = odd.collect()
    want, _ = expected(pair, [r["text"] for r in rows])
    got = align.aligned(odd, *align.vocabularies(), keep_groups=True).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted([(r["doc_id"], *(r[c] for c in COLUMNS)) for r in got], key=key) == sorted(
        [(r["doc_id"], *w) for r, w in zip(rows, want)], key=key)
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in got if r["n_a"])
    assert align.aligned(none, *align.vocabularies()).collect() == []
