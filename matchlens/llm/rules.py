"""Quality rules as weak supervision (DataFrame functions only).

Each rule looks at counts of a text and votes good, bad, or abstains. The accuracy of a rule is not
set by hand: expectation-maximisation estimates it, with the share of good texts, from how often
each pattern of votes occurs over all documents. There are at most 3 ** len(RULES) patterns, so
their counts, and nothing else, go to the driver. A text is kept if the posterior probability that
it is good reaches `keep_at` and the two base conditions hold.

Defined results: null or empty text has no words, all counts 0, and fails the base conditions;
lines without a word are never counted as equal; a table without rows gives no rows; columns other
than doc_id and text are not read; repeated rows are judged one by one.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import staged, table

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
LETTERLESS = r"(?:^|[\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?=[\x20\x09-\x0D]|\z)"
WINDOW = 8
GOOD, BAD, ABSTAIN = 1, 0, 2


def _by(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), ABSTAIN).when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def _rule(value: Column, bad_above: float, good_below: float) -> Column:
    return _by(value, value > bad_above, value <= good_below)


def rules() -> dict[str, Column]:
    """name -> vote, over the columns of `counted`."""
    length = _share("word_chars", "n_words")
    letters = _share("n_letters", "word_chars")
    return {
        "length": _by(F.col("n_words"), F.col("n_words") < 20, F.col("n_words") >= 50),
        "repeated_passages": _rule(_share("n_repeat_words", "n_words"), 0.3, 0.1),
        "symbols": _rule(_share("n_symbols", "n_words"), 0.15, 0.03),
        "repeated_lines": _rule(_share("n_dup_lines", "n_lines"), 0.5, 0.1),
        "word_length": _by(length, (length < 2.5) | (length > 12), length.between(3, 9)),
        "capitals": _rule(_share("n_capitals", "n_letters"), 0.4, 0.15),
        "letters": _by(letters, letters < 0.7, letters >= 0.85),
        "words_without_letters": _rule(_share("n_letterless", "n_words"), 0.2, 0.05),
        "repeated_words": _rule(_share("n_twins", "n_words"), 0.2, 0.03),
    }


def counted(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def chars(s: Column, drop: str) -> Column:
        return F.length(F.translate(s, drop, ""))
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: chars(x, SPACE_CHARS) > 0)
    t = docs.select(
        "doc_id", chars(text, SPACE_CHARS).cast("long").alias("word_chars"),
        (F.length(text) - chars(text, SYMBOLS)).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit(LETTERLESS)).cast("long").alias("n_letterless"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("w"), lines.alias("lines"))
    size = F.size("w")
    window = F.transform(F.slice("w", 1, F.greatest(size - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(
        x, *[F.get(F.col("w"), i + k) for k in range(1, WINDOW)]))
    t = t.select("doc_id", "word_chars", "n_symbols", "n_letters", "n_capitals", "n_letterless", size.cast("long").alias("n_words"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                 F.size(F.filter("w", lambda x, i: F.coalesce(x == F.get(F.col("w"), i - 1), F.lit(False)))).cast("long").alias("n_twins"),
                 window.alias("g"))
    # windows found twice, by sorting only the texts that have one
    some = F.size(F.array_distinct("g")) < F.size("g")
    t = t.withColumn("s", F.when(some, F.sort_array(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    hit = F.filter("s", lambda x, i: same(x, F.get(F.col("s"), i - 1)) | same(x, F.get(F.col("s"), i + 1)))
    t = t.withColumn("p", F.sort_array(F.transform(hit, lambda x: x["i"])))
    covered = F.aggregate(F.transform("p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("p"), i + 1) - x, F.lit(WINDOW)))),
                          F.lit(0).cast("long"), lambda a, x: a + x)
    return t.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("g", "s", "p")


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[float, list[tuple[float, float]]]:
    """Share of good texts, and for each rule how often it votes bad on a bad and on a good text.

    Votes are taken as independent given the class, abstentions as uninformative. A rule starts by
    finding half of the bad texts and accusing 2 % of the good ones. It is never believed to accuse
    more than 20 % of the good texts, nor to find bad ones less often than it accuses good ones;
    that keeps the classes from changing places."""
    n_rules = len(next(iter(patterns), ()))
    prior, rates = 0.8, [(0.5, 0.02)] * n_rules
    for _ in range(rounds):
        good = total = 0.0
        bad_hits, bad_votes = [0.5] * n_rules, [1.0] * n_rules      # as if one vote had been seen
        good_hits, good_votes = [0.02] * n_rules, [1.0] * n_rules
        for v, n in patterns.items():
            p = posterior(v, prior, rates)
            good, total = good + n * p, total + n
            for j, x in enumerate(v):
                if x != ABSTAIN:
                    good_votes[j] += n * p
                    bad_votes[j] += n * (1 - p)
                    if x == BAD:
                        good_hits[j] += n * p
                        bad_hits[j] += n * (1 - p)
        if not total:
            break
        prior = min(0.99, max(0.05, good / total))
        rates = [(min(0.999, max(g, h / v)), g) for h, v, g in zip(
            bad_hits, bad_votes, (min(0.2, max(0.0005, h / v)) for h, v in zip(good_hits, good_votes)))]
    return prior, rates


def posterior(votes: tuple[int, ...], prior: float, rates: list[tuple[float, float]]) -> float:
    odds = math.log(prior / (1 - prior))
    for x, (bad, good) in zip(votes, rates):
        if x == BAD:
            odds += math.log(good / bad)
        elif x == GOOD:
            odds += math.log((1 - good) / (1 - bad))
    return 1 / (1 + math.exp(-odds))


def judged(docs: DataFrame, keep_at: float = 0.5) -> DataFrame:
    """The counts, base_failed, p_good and kept for every document."""
    spark = docs.sparkSession
    named = rules()
    code = sum((v * F.lit(3 ** j) for j, v in enumerate(named.values())), F.lit(0))
    t = staged(counted(docs).withColumn("pattern", code))
    seen = {tuple(r["pattern"] // 3 ** j % 3 for j in range(len(named))): (r["pattern"], r["count"])
            for r in t.groupBy("pattern").count().collect()}  # 3 ** len(named) rows at most
    prior, rates = estimate({v: n for v, (_, n) in seen.items()})
    odds = spark.createDataFrame([(c, posterior(v, prior, rates)) for v, (c, _) in seen.items()], "pattern int, p_good double")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return t.join(F.broadcast(odds), "pattern").withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("p_good") >= keep_at)).drop("pattern")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the counts of every document and the verdict."""
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")
