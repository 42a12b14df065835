"""op2 and op8 against Python's re and plain counts."""
import hashlib
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from matchlens.llm import pii, rules


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        c = int(c) * (1 + i % 2)
        total += c - 9 if c > 9 else c
    return total % 10 == 0


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
]


def expected(text):
    found = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m.group())] for k, p, ok in BASE]
    return [len(f) for f in found], ",".join(x for f in found for x in f)


def compare(docs):
    rows = docs.collect()
    got = pii.find(docs).select("doc_id", *[F.size(k).alias(f"n_{k}") for k, *_ in BASE], pii._listed([k for k in pii.KINDS if k.base]).alias("base"))
    assert Counter((r[0], tuple(r[1:5]), r["base"]) for r in got.collect()) == Counter(
        (r["doc_id"], tuple(expected(r["text"])[0]), expected(r["text"])[1]) for r in rows)


def test_base_spans(docs, odd, none):
    compare(docs.select("doc_id", "text"))
    compare(odd)
    assert pii.find(none).count() == 0


def test_hard_base_cases(spark):
    odd = ["x@a.b_c@d.e", "a@b.c.d@e.f", "..@a.b", "a@b.c.", "1.2.3.4.5.6.7.8 000255.1.1.001 256.1.1.1", "0.0.0.0 00.000.0.1 0300.1.1.1",
           "é 4111 1111 1111 1111 é +1 (555) 010-9999", "4111-1111-1111-1111-4111", "+12((((((345678901", "a@b-.c--", "+1" * 50,
           "1 " * 3000, "7" * 3000, "x" * 3000, "+44 20 7946 0958 " * 300, "5500005555555559+15550109999@x.y"]
    compare(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string"))


def test_many_matches_in_one_text(spark):
    """Offsets and contexts of a text with 200,000 matches, in seconds."""
    n = 200_000
    mails = "".join(f"a{i}@b{'c' * (i % 7)}.de{' ' * (1 + i % 3)}" for i in range(n))
    start = time.time()
    compare(spark.createDataFrame([(1, mails), (2, "é 1.2.3.4 +1555010999 " * 3000), (3, "+155501099" * 5000)], "doc_id long, text string"))
    assert time.time() - start < 120


def test_contexts_before_matches(spark):
    """The characters before a match, across earlier matches, decide what the added kinds keep."""
    pad = "x" * 60
    texts = ["ssn 123-45-6789", f"ssn {pad} 123-45-6789", "ssn 123-45-6789 123-45-6788", "ssn " + "123-45-6789 " * 6, "account 12345678 12345679", "12345678"]
    for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 0.0).collect():
        text = texts[r["doc_id"]]
        for k in pii.KINDS:
            for x in r[k.name]:
                before = text[max(0, x["start"] - pii.CONTEXT_CHARS):x["start"]].lower()
                near = re.search(rf"\b(?:{k.context})\b", before) is not None
                assert x["text"] == text[x["start"]:x["end"]] and x["score"] == (min(1.0, k.score + 0.4) if near else k.score)


def test_long_runs_take_linear_time(spark):
    big = spark.createDataFrame([(1, "a" * 300_000), (2, "1" * 300_000), (3, "1-" * 150_000)], "doc_id long, text string")
    assert [sum(len(r[k.name]) for k in pii.KINDS) for r in pii.find(big).collect()] == [0, 0, 0]


def test_added_kinds_need_checksum_or_context(spark):
    t = ["iban GB82 WEST 1234 5698 7654 32", "iban GB83 WEST 1234 5698 7654 32", "ssn 123-45-6789", "part 123-45-6789", "ssn 000-45-6789",
         "account 12345678", "number 12345678"]
    rows = pii.find(spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")).orderBy("doc_id").collect()
    found = [[k for k in ("iban", "ssn", "account") if r[k]] for r in rows]
    assert found == [["iban"], [], ["ssn"], [], [], ["account"], []]
    assert rows[0]["iban"][0]["text"] == "GB82 WEST 1234 5698 7654 32" and rows[0]["iban"][0]["score"] == 1.0


def test_query_columns(spark, texts):
    rows = pii.query(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, base = expected(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == n
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and (r["spans"] + ",").startswith(base)


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    worded = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(hit)


def test_counts(docs, odd, none):
    for t in (docs.select("doc_id", "text"), odd):
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rules.counted(t).collect())
        assert got == Counter((r["doc_id"], *plain_counts(r["text"])) for r in t.collect())
    assert rules.judged(none).count() == 0


def test_verdicts(spark, docs, odd):
    rows = rules.query(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    judged = [(labels[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in labels and not r["base_failed"]]
    assert sum(k for y, k in judged if y) >= 0.97 * sum(1 for y, _ in judged if y)
    assert sum(k for y, k in judged if not y) <= 0.2 * sum(1 for y, _ in judged if not y)
    empty = [r for r in rules.judged(odd).collect() if r["doc_id"] in (1, 2, 3)]
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in empty)


def test_rates_are_learned():
    """A rule that accuses at random gets rates that differ little; one that is right gets believed."""
    import random
    draw = random.Random(0)
    seen = Counter()
    for _ in range(20_000):
        bad = draw.random() < 0.2
        sure = rules.BAD if bad and draw.random() < 0.9 else rules.GOOD
        other = rules.BAD if bad and draw.random() < 0.8 else rules.GOOD
        noise = rules.BAD if draw.random() < 0.1 else rules.GOOD
        seen[sure, other, noise] += 1
    prior, rates = rules.estimate(seen)
    assert abs(prior - 0.8) < 0.05 and rates[0][0] > 0.8 and rates[0][1] < 0.02
    assert abs(rates[2][0] - rates[2][1]) < 0.1
