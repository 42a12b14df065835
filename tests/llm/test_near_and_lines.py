"""op6 and op9 against brute force."""
import math
import random
import re
from collections import Counter, defaultdict

from matchlens.llm import lines, near

from .conftest import SF


def sets(rows, k):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append((i, frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    return out


def components(rows, k, percent):
    rows = sets(rows, k)
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x
    holders = defaultdict(list)
    for n, (_, s) in enumerate(rows):
        for x in s:
            holders[x].append(n)
    pairs = {(a, b) for h in holders.values() for j, a in enumerate(h) for b in h[j + 1:]}
    for a, b in pairs:
        x, y = rows[a][1], rows[b][1]
        c = len(x & y)
        if 100 * c >= percent * (len(x) + len(y) - c):
            u, v = top(a), top(b)
            above[max(u, v)] = min(u, v)
    least = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        least[top(n)].append(i)
    named = {r: min((i for i in ids if i is not None), default=None) for r, ids in least.items()}
    return Counter((i, len(s), named[top(n)]) for n, (i, s) in enumerate(rows))


def test_components(spark, docs, texts, odd, none):
    got = near.query(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == components(texts.items(), 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    for table in (odd, none):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.grouped(table).collect())
        assert got == components(rows, 5, 80)


def family(draw, n, words, changes):
    base = [f"w{draw.randrange(10 ** 6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(changes):
            w[draw.randrange(words)] = f"w{draw.randrange(10 ** 6)}"
        out.append(" ".join(w))
    return out


def test_chains_and_large_groups(spark):
    """Copies near the threshold, linked through others; and passages shared by texts that are not alike."""
    draw = random.Random(2)
    texts = family(draw, 60, 300, 4) + family(draw, 40, 90, 1) + family(draw, 30, 200, 8)
    shared = " ".join(f"p{i}" for i in range(60))
    texts += [shared + " " + " ".join(f"u{draw.randrange(10 ** 6)}" for _ in range(60)) for _ in range(50)]
    chain = [f"c{i}" for i in range(200)]
    for k in range(25):     # each step drops one word and adds one
        texts.append(" ".join(chain[k * 4:] + [f"d{i}" for i in range(k * 4)]))
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.grouped(table, 3, 85).collect())
    assert got == components(sorted(rows), 3, 85)


def test_one_of_each_group_stays(odd):
    kept = near.deduplicated(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[7] == 1 and set(ids) >= {1, 2, 3, 4, 5, 6, 7, 8, 9}


def test_texts_of_one_id_are_decided_apart(spark):
    """No row is lost for its id, and no copy stays for it."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(12)) for k in "abcd")
    rows = [(None, a), (None, b), (None, b), (None, d), (None, None), (None, " "), (3, c), (5, c), (5, a), (5, d), (6, d), (8, None), (8, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in near.deduplicated(table).collect())
    assert got == Counter([(None, b), (None, None), (None, " "), (3, c), (5, a), (5, d), (8, None), (8, None)])
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near.grouped(table).collect())
    assert got == components(rows, 5, 80)


def test_shared_values_bound():
    t = near.shared(0.85)
    p = sum(math.comb(64, k) * 0.85 ** k * 0.15 ** (64 - k) for k in range(t))
    assert p <= near.MISS and 30 <= t <= 40


def plain_lines(rows, percent=80):
    worded = []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, x in enumerate(t.split("\n") if t is not None else []):
            s = frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", x.lower()) if w)
            if s:
                worded.append((i, p, s))
    gone, first, holders = defaultdict(list), {}, defaultdict(list)
    for i, p, s in worded:
        if s in first:
            if first[s] != (i, p):
                gone[i].append(p)
            elif (i, p) in gone["again"]:
                pass
            continue
        first[s] = (i, p)
        if any(100 * len(s & x) >= percent * len(s | x) for x in {x for w in s for x in holders[w]}):
            gone[i].append(p)
        for w in s:
            holders[w].append(s)
    return gone


def test_lines(spark, texts, none):
    got = {r["doc_id"]: [int(x) for x in r["removed"].split(",") if x] for r in lines.query(spark, SF).collect()}
    want = plain_lines(texts.items())
    assert got == {i: want.get(i, []) for i in texts}
    assert lines.deduplicated(none).count() == 0


def test_alike_lines_without_all_pairs(spark):
    draw = random.Random(4)
    texts = ["\n".join(x) for x in zip(family(draw, 80, 60, 3), family(draw, 80, 8, 1), family(draw, 80, 25, 2))]
    texts += ["a b c d e\na b c d\na b c d e f g\nb a c d e", "a b c d e f"]
    got = {r["doc_id"]: set(r["gone"]) for r in lines._by_document(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 80).collect()}
    want = plain_lines(list(enumerate(texts)))
    assert got == {i: set(want.get(i, [])) for i in range(len(texts))}


def test_lines_of_odd_documents(odd):
    kept = lines.deduplicated(odd)
    assert kept.columns == odd.columns
    got = {r["doc_id"]: r["text"] for r in kept.collect() if r["doc_id"] is not None}
    line = "one two three four five six seven eight nine ten"
    assert got[1] is None and got[2] == "" and got[8] == "la de que los"
    assert 6 not in got         # the row without an id is first, so nothing of it is left
    assert got[7] == "other words stand here alone"
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect() if r["text"] is not None)
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None and r["text"]] == [line]


def test_lines_of_one_id_are_decided_apart(spark):
    """Lines that occur once stay, and one of each other: also in rows without an id, or with one id and different texts."""
    a, b, c, d, e, f = (" ".join(f"{k}{i}" for i in range(6)) for k in "abcdef")
    rows = [(None, f"{a}\n{b}"), (None, f"{c}\n{a}"), (4, f"{d}\n{e}"), (4, f"{f}\n{d}"), (4, f"{f}\n{d}"), (5, f"{b}\n{e}")]
    kept = lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = Counter((r["doc_id"], x) for r in kept for x in r["text"].split("\n"))
    assert {(None, a), (None, b), (None, c), (4, d), (4, e), (4, f)} == set(left)
    assert left[None, a] == left[None, b] == left[None, c] == left[4, e] == 1
    assert left[4, f] == 2 and left[4, d] in (1, 2)     # the repeated row keeps the same lines twice
