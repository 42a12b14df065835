"""Near-equal lines: an exact set-similarity join over lines (DataFrame functions only).

1. A line is the set of its words. Words are ordered by rarity: the counts of all words, in CELLS
   hashed cells, give the order in steps, and the hash decides within a step; any fixed order is
   exact. Equal sets form a class, from here on one row, with the place of its first line.
2. Prefix filter: two sets as similar as asked share one of their first n - ceil(s n) + 1 words.
   Rows (word, class) of the prefixes are joined on the word. A pair must pass the length filter, the
   positional filter, and a bound on the difference of the sets: 64 parities of hashed words, 128
   for sets of more than LONG words.
3. Jaccard is verified on the full sets, read again from the first line of each class.
4. A class is removed if an earlier one matches it, and so are all lines of a class but the first.

Groups of alike lines don't become all their pairs: the LEADING rarest words first pair every class
with the first class that has the word; a pair in which both are known to go is left out of the
join. What goes and what stays is judged on the input, not on what is left.

Defined results: lines end at \\n only; lines without a word are left alone; null text has no line
and stays null; empty text has one line without a word; sets of fewer than 5 words match equal
sets only (at 0.8); words are compared in lower case; rows that repeat a doc_id and its text keep the
same lines; rows without an id come first, and rows with the same id, or without, are ordered by a hash
of their text; an empty table gives no rows; `deduplicated` drops documents of which
no line with a word is left, and keeps all columns as they are but text and n_chars.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import staged, table

PERCENT = 80
CELLS = 1 << 18
STEPS = 4                   # of rarity, for each doubling of the count
LEADING = 4
LONG = 90
SPACE = r"[\x20\x09-\x0D]+"
READ_AGAIN = 500_000        # documents that a broadcast may ask for; beyond, a shuffled join


def _plain(text: Column) -> Column:
    """In lower case, with blanks for all white space but line ends."""
    other = r"[\x09\x0B-\x0D]"
    return F.lower(F.when(text.rlike(other), F.regexp_replace(text, other, " ")).otherwise(text))


def rarity(docs: DataFrame) -> Column:
    """An array of CELLS numbers, as a scalar subquery: the step of rarity of each cell of words, 0 for the rarest."""
    word = F.explode(F.split(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ", -1))
    words = docs.where("text is not null").select(word.alias("w")).where("w != ''")
    counts = np.zeros(CELLS, np.int64)
    for r in words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(CELLS - 1)).alias("cell")).count().collect():      # CELLS rows at most
        counts[r["cell"]] = r["count"]
    steps = np.minimum(255, STEPS * np.log2(np.maximum(1, counts))).astype(int)
    row = docs.sparkSession.createDataFrame([(",".join(map(str, steps)),)], "steps string")
    return staged(row.select(F.split("steps", ",").cast("array<int>").alias("steps"))).scalar()


def _keys(line: Column) -> Column:
    """The distinct words of a line as numbers, rarest first: eight bits of rarity (from `steps`), 55 of the hash."""
    def key(h):
        step = F.get("steps", h.bitwiseAND(F.lit(CELLS - 1)).cast("int")).cast("long")
        return F.shiftleft(step, 55).bitwiseXOR(F.shiftrightunsigned(h, 9))
    hashes = F.array_distinct(F.transform(F.split(line, " ", -1), lambda w: F.xxhash64(w)))
    return F.sort_array(F.transform(F.array_remove(hashes, F.xxhash64(F.lit(""))), key))


def _parities(keys: Column) -> tuple[Column, Column]:
    """In each of 64 cells, whether it has an odd number of words: sets that differ in d words differ in d
    cells at most. Of long sets twice, for the words of two halves; their sum is that of all."""
    def flips(some):
        def flip(acc, k):
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(k, 40).bitwiseAND(F.lit(63)).cast("int"))
            return F.when(some(k), acc.bitwiseXOR(bit)).otherwise(acc) if some else acc.bitwiseXOR(bit)
        return F.aggregate(keys, F.lit(0).cast("long"), flip)
    half = lambda odd: lambda k: F.shiftright(k, 46).bitwiseAND(F.lit(1)) == odd
    long_ = F.size(keys) > LONG
    return F.when(long_, flips(half(0))).otherwise(flips(None)), F.when(long_, flips(half(1))).otherwise(F.lit(0).cast("long"))


def _prefix_length(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100).cast("int") + 1


#: A row of docs: its id, and a hash that tells texts of one id, or of none, apart.
KEY = ["doc_id", "x"]
PLACE = [*KEY, "pos"]


def _hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"])


def signed(docs: DataFrame, steps: Column, percent: int) -> DataFrame:
    """(doc_id, x, pos, d, b, c, n, prefix) for every line with a word; (d, b, c) stand for the set."""
    lines = docs.where("text is not null").select("doc_id", _hash(docs).alias("x"), F.posexplode(F.split(_plain(F.col("text")), "\n", -1)).alias("pos", "line"))
    sets = lines.withColumn("steps", steps).select(*PLACE, _keys(F.col("line")).alias("set")).where(F.size("set") > 0)
    b, c = _parities(F.col("set"))
    t = sets.select(*PLACE, F.xxhash64("set").alias("d"), b.alias("b"), c.alias("c"), F.size("set").alias("n"), "set")
    first = F.when(F.col("n") * (100 - percent) >= percent, F.slice(
        "set", F.lit(1), _prefix_length(F.col("n"), percent))).otherwise(F.array().cast("array<bigint>"))
    return t.select(*PLACE, "d", "b", "c", "n", F.transform(first, lambda k: k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")).alias("prefix"))


def _least_common(n_a: Column, n_b: Column, percent: int) -> Column:
    """Words that sets as similar as asked have in common at least."""
    return F.ceil((n_a + n_b) * percent / (100 + percent))


#: What a prefix row knows of its class: its number, two parities, its number of words and the word's place.
ROW = ["id", "b", "c", "at"]


def _possible(percent: int, x: str = "", y: str = "2") -> Column:
    """Of a row and another one, whose columns have these in front."""
    n_a, n_b = F.shiftright(f"{x}at", 32), F.shiftright(f"{y}at", 32)
    i_a, i_b = F.col(f"{x}at").bitwiseAND(F.lit(0xFFFFFFF)), F.col(f"{y}at").bitwiseAND(F.lit(0xFFFFFFF))
    b, c = F.col(f"{x}b").bitwiseXOR(F.col(f"{y}b")), F.col(f"{x}c").bitwiseXOR(F.col(f"{y}c"))
    differ = F.when((n_a > LONG) & (n_b > LONG), F.bit_count(b) + F.bit_count(c)).otherwise(F.bit_count(b.bitwiseXOR(c)))
    least = _least_common(n_a, n_b, percent)
    return ((F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)
            & (F.least(n_a - i_a, n_b - i_b) >= least) & (n_a + n_b - differ >= 2 * least))


CLASS = ["d", "b", "c"]


def full_sets(docs: DataFrame, classes: DataFrame, steps: Column) -> DataFrame:
    """(id, set) of the classes (id, d, b, c, doc_id, x, pos), from one line each."""
    asked = staged(classes.groupBy(*KEY).agg(F.collect_list(F.struct("pos", "id", *CLASS)).alias("asked")))
    asked = asked.withColumnsRenamed({"doc_id": "__id", "x": "__x"})
    if asked.count() <= READ_AGAIN:
        asked = F.broadcast(asked)
    t = docs.select("doc_id", _hash(docs).alias("x"), "text")
    t = t.join(asked, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("x") == F.col("__x"))).select(
        F.split(_plain(F.col("text")), "\n", -1).alias("lines"), F.col("asked"))
    t = t.select("lines", F.explode("asked").alias("x")).withColumn("steps", steps).select(
        "x.*", _keys(F.get("lines", F.col("x.pos"))).alias("set"))
    b, c = _parities(F.col("set"))
    same = (F.xxhash64("set") == F.col("d")) & (b == F.col("b")) & (c == F.col("c"))
    return t.where(same).dropDuplicates(["id"]).select("id", "set")     # rows may be repeated


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, steps: Column, percent: int) -> DataFrame:
    """The classes (id) that an earlier one of a pair (x, y) matches."""
    pairs = staged(pairs.distinct())
    ends = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    known = staged(classes.select("id", *CLASS, *PLACE).join(ends, "id", "left_semi"))
    sets = staged(known.join(full_sets(docs, known, steps), "id").select("id", F.struct(*PLACE).alias("at"), "set"))
    for side in "xy":
        pairs = pairs.join(sets.select(F.col("id").alias(side), F.struct("at", "set").alias(f"of_{side}")), side)
    both = F.size(F.array_intersect("of_x.set", "of_y.set"))
    either = F.size("of_x.set") + F.size("of_y.set") - both
    later = F.when(F.col("of_x.at") > F.col("of_y.at"), F.col("x")).otherwise(F.col("y"))
    return staged(pairs.where(100 * both >= percent * either).select(later.alias("id")).distinct())


def removed(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Lines (doc_id, x, pos, goes) with a word."""
    steps = rarity(docs)
    lines = staged(signed(docs, steps, percent))
    classes = lines.groupBy(*CLASS, "n").agg(F.min(F.struct(*PLACE, "prefix")).alias("first"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("id"), *CLASS, "n", "first.*"))
    at = F.shiftleft(F.col("n").cast("long"), 32) + F.col("i")
    pair = (F.col("id").alias("x"), F.col("2id").alias("y"))
    # every class with a class that has one of its rarest words, an early one; `verified` compares whole places
    words = classes.select("id", "b", "c", "n", "doc_id", "pos", F.posexplode(F.slice("prefix", 1, LEADING)).alias("i", "word"))
    by_word = Window.partitionBy("word").orderBy("doc_id", "pos")
    led = words.withColumn("at", at).select(*ROW, *[F.first(k).over(by_word).alias(f"2{k}") for k in ROW])
    led = verified(led.where((F.col("id") != F.col("2id")) & _possible(percent)).select(*pair), classes, docs, steps, percent)
    # all pairs, but those of two that go already: bit 31 of `at` says so
    gone = F.when(F.col("gone").isNotNull(), F.lit(1 << 31)).otherwise(F.lit(0))
    marked = classes.where(F.size("prefix") > 0).join(led.withColumn("gone", F.lit(1)), "id", "left").withColumn("gone", gone)
    rows = marked.select("id", "b", "c", "n", "gone", F.posexplode("prefix").alias("i", "word")).select(
        "word", "id", "b", "c", (at + F.col("gone")).alias("at"))
    both_go = F.col("x.at").bitwiseAND(F.col("y.at")).bitwiseAND(F.lit(1 << 31)) != 0
    # the same rows on both sides, under the same names: they are shuffled once
    met = rows.alias("x").join(rows.alias("y"), F.col("x.word") == F.col("y.word")).where(
        (F.col("x.id") < F.col("y.id")) & ~both_go & _possible(percent, "x.", "y."))
    rest = verified(met.select(F.col("x.id").alias("x"), F.col("y.id").alias("y")), classes, docs, steps, percent)
    gone = staged(led.union(rest).distinct())
    decided = classes.select("id", *CLASS, F.struct(*PLACE).alias("first")).join(
        gone.withColumn("gone", F.lit(True)), "id", "left").drop("id")
    goes = F.coalesce("gone", F.lit(False)) | ~F.struct(*PLACE).eqNullSafe(F.col("first"))
    return lines.select(*PLACE, *CLASS).join(decided, CLASS).select(*PLACE, goes.alias("goes"))


def _by_document(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, x, n_worded, gone): the lines with a word and the places of those that go."""
    return removed(docs, percent).distinct().groupBy(*KEY).agg(
        F.count("*").alias("n_worded"), F.sort_array(F.collect_list(F.when(F.col("goes"), F.col("pos")))).alias("gone"))


def deduplicated(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """docs without the lines that match an earlier one."""
    found = staged(_by_document(docs, percent).where(F.size("gone") > 0)).select(
        F.col("doc_id").alias("__id"), F.col("x").alias("__x"), F.struct("n_worded", "gone").alias("__found"))
    t = docs.join(found, docs["doc_id"].eqNullSafe(F.col("__id")) & (_hash(docs) == F.col("__x")), "left")
    at = F.map_from_arrays(F.col("__found.gone"), F.col("__found.gone"))
    t = t.withColumn("__at", F.when(F.col("__found").isNotNull(), at))
    left = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: F.col("__at")[i].isNull()), "\n")
    text = F.when(F.col("__found").isNull(), F.col("text")).otherwise(left)
    empty = F.col("__found").isNotNull() & (F.col("__found.n_worded") <= F.size("__found.gone"))
    t = t.where(~F.coalesce(empty, F.lit(False))).withColumn("text", text)
    if "n_chars" in docs.columns:
        t = t.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return t.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op9: the lines of every document, and those that go (places from 0, in order)."""
    docs = table(spark, sf_dir, "documents")
    found = _by_document(docs, PERCENT).select(F.col("doc_id").alias("id"), F.col("x").alias("of"), "n_worded", "gone")
    sizes = docs.select("doc_id", _hash(docs).alias("x"), F.when(F.col("text").isNull(), 0).otherwise(
        F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines"))
    return sizes.join(found, sizes["doc_id"].eqNullSafe(F.col("id")) & (sizes["x"] == F.col("of")), "left").select(
        "doc_id", "n_lines", F.coalesce("n_worded", F.lit(0)).cast("long").alias("n_worded"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join(F.transform("gone", lambda x: x.cast("string")), ","), F.lit("")).alias("removed"))
