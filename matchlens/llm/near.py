"""Near-duplicate documents: bottom-k sketches from one hash function, exact Jaccard on full sets.

1. A document is the set of its word shingles, hashed. Its sketch is the `SKETCH` smallest hashes.
   Documents with equal sets form a class, from here on one row.
2. Inverted lists of the retained values. Two classes as similar as asked share `shared(..)` values
   of their sketches at least (all but 1e-9 of such pairs; surely, for sets within a sketch), so it
   is enough that they meet in one of the first |sketch| - shared + 1 values, rarest first. Values
   of one class meet nobody and are dropped; values of many come last.
3. Lists of up to SHORT members are turned into their pairs. Longer ones first pair their members
   with STARS of them; pairs are filtered by the union of their sketches and verified on the full
   sets, and linked classes merge. What is left of the long lists, where they span several
   components, then meets in full across them: a pair counts in the first list that both are in,
   and only if the `FILTER` smallest hashes of its union allow a link (sets within that size are
   decided by it). A bound on how far two sets differ, 128 parities of their hashes, and their sizes
   keep most pairs out of all these joins.
4. Components by alternating large and small stars, whose edges never outnumber the links.

Links between different texts are lost only where step 2 misses a pair, which is improbable by
construction, not by a limit; there is no limit on the partners of a document.

Defined results: null text, or text without a word, has an empty set, is linked with nothing and
kept, all its rows; with fewer words than a shingle the whole sequence is the one shingle; repeated
rows are in one class; a null id never names a component that has another; `deduplicated` keeps one
row of each component, of the text with the smallest hash among those with the smallest id, so rows
without an id, or with one id and different texts, are decided one by one; an empty table gives no
rows; columns other than doc_id and text are not read.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .packing import CHUNK_BYTES, chunks
from .store import staged, table

SKETCH = 64
FILTER = 160                    # values of a union that decide which pairs are verified
MISS = 1e-9
SHORT = 16                      # lists of up to so many members are paired in full at once
STARS = 8
WORDS, PERCENT = 5, 80          # what the stages of a pipeline use


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted. Words are lower-cased in A-Z."""
    split = (text or "").encode().lower().split()
    if not split:
        return np.empty(0, np.int64)
    w = np.array(list(map(xxhash.xxh64_intdigest, split)), np.uint64)
    n = min(words, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i:len(w) - n + 1 + i])
    return np.unique(h.view(np.int64))


def digest(shingle_set: np.ndarray) -> bytes | None:
    """128 bits that stand for a whole set."""
    return xxhash.xxh3_128_digest(shingle_set.tobytes()) if len(shingle_set) else None


def parities(shingle_set: np.ndarray) -> tuple[int, int]:
    """Of the hashes in each of 128 cells, whether their number is odd. Sets that differ in d hashes
    differ in d cells at most."""
    odd = np.bincount((shingle_set.view(np.uint64) >> np.uint64(57)).astype(np.int64), minlength=128) & 1
    return tuple(int(x) for x in np.packbits(odd.astype(np.uint8)).view(np.int64))


def shared(similarity: float, size: int = SKETCH, miss: float = MISS) -> int:
    """The most values t such that a pair of the given similarity has fewer than t in common among
    the `size` smallest hashes of its union only with a probability of `miss` at most."""
    tail, t = 0.0, 0
    while t < size:
        tail += math.comb(size, t) * similarity ** t * (1 - similarity) ** (size - t)
        if tail > miss:
            break
        t += 1
    return t


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, x, text): x tells texts of one id, or of none, apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash(docs).alias("x"), "text")


def _hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, x, n, cls, p, q, sketch): cls is a digest of the whole set, null for empty sets; p, q its parities."""
    names = ["doc_id", "x", "n", "cls", "p", "q", "sketch"]

    def sketch(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = batch.column(2).to_pylist()
                for part in chunks([len(t or "") for t in texts], CHUNK_BYTES):
                    sets = [shingles(t, words) for t in texts[part]]
                    p, q = zip(*map(parities, sets))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0)[part], batch.column(1)[part], pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) for s in sets], pa.binary()), pa.array(p, pa.int64()), pa.array(q, pa.int64()),
                        pa.array([s[:SKETCH] for s in sets], pa.list_(pa.int64()))], names=names)
    return keyed(docs).mapInArrow(sketch, "doc_id long, x long, n long, cls binary, p long, q long, sketch array<long>")


def full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(id, set) of the classes (id, cls, rep, x): read again from the text of one document each."""
    def sets(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for part in chunks([len(t or "") for t in texts], CHUNK_BYTES):
                    found = [shingles(t, words) for t in texts[part]]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0)[part], batch.column(2)[part], pa.array([digest(s) for s in found], pa.binary()),
                        pa.array(found, pa.list_(pa.int64()))], names=["id", "cls", "of", "set"])
    text = keyed(docs)
    read = classes.select("id", "cls", "rep", F.col("x").alias("__x")).join(
        text, F.col("rep").eqNullSafe(F.col("doc_id")) & (F.col("__x") == F.col("x")))
    return read.select("id", "text", "cls").mapInArrow(sets, "id long, cls binary, of binary, set array<long>").where(
        "cls = of").dropDuplicates(["id"]).select("id", "set")      # rows may be repeated


def _least_shared(n: Column, percent: int, size: int) -> Column:
    return F.least(F.ceil(n * percent / 100), F.lit(shared(percent / 100, size)))


def inverted(classes: DataFrame, percent: int) -> DataFrame:
    """(value, id, n, prefix): the inverted lists that a class is found in; lists of one class are left out."""
    values = classes.select("id", "n", F.explode("sketch").alias("value"))
    met = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    some = values.join(met, "value").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("v"))
    alone = F.least(F.col("n"), F.lit(SKETCH)) - F.size("v")    # the rarest: they come first and meet nobody
    length = F.least(F.col("n"), F.lit(SKETCH)) - _least_shared(F.col("n"), percent, SKETCH) + 1 - alone
    first = F.slice("v", F.lit(1), F.greatest(F.lit(0), length).cast("int"))
    return some.select("id", "n", F.transform(first, lambda x: x["value"]).alias("prefix")).withColumn("value", F.explode("prefix"))


def _alike(a: Column, b: Column, n_a: Column, n_b: Column, percent: int, size: int) -> Column:
    """May a pair with these smallest hashes be as similar as asked? Judged on those of its union."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    common = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    whole = (n_a <= size) & (n_b <= size)
    both = F.size(F.array_intersect(a, b))
    return F.when(whole, 100 * both >= percent * (n_a + n_b - both)).otherwise(
        common >= _least_shared(F.greatest(n_a, n_b), percent, size))


def _sized(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _close(a: str, b: str, percent: int) -> Column:
    """Do sizes and parities (n, p, q) allow a link?"""
    n_a, n_b = F.col(f"{a}n"), F.col(f"{b}n")
    p, q = (F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in "pq")
    return _sized(n_a, n_b, percent) & (n_a + n_b - p - q >= 2 * F.ceil((n_a + n_b) * percent / (100 + percent)))


def linked(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: first by sketch, then by full set."""
    def two(t: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
        for side in "ab":
            pairs = pairs.join(t.select(F.col("id").alias(side), F.struct(*column.split()).alias(f"x{side}")), side)
        return pairs
    near = two(classes, "sketch n", pairs).where(_alike(
        F.col("xa.sketch"), F.col("xb.sketch"), F.col("xa.n"), F.col("xb.n"), percent, SKETCH)).select("a", "b")
    both = F.size(F.array_intersect("xa.set", "xb.set"))
    either = F.size("xa.set") + F.size("xb.set") - both
    return staged(two(sets, "set", near).where(100 * both >= percent * either).select("a", "b"))


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest member of the component, for every class on an edge (a, b)."""
    def stars(e: DataFrame) -> bool:
        """Does every u stand once, and never as a v?"""
        seen = e.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("n")))
        seen = seen.groupBy("x").agg(F.sum("n").alias("n"), F.min("n").alias("v"))
        return seen.where((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("v") == 0))).isEmpty()
    edges = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while not stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u != v").distinct())
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _across(lists: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The lists that span several components, with each member's root and the list's length m."""
    lists = lists.withColumn("root", F.col("id")) if roots is None else lists.join(roots, "id", "left").withColumn(
        "root", F.coalesce("root", "id"))
    mixed = lists.groupBy("value").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x != y")
    return lists.join(mixed.select("value", "m"), "value")


LIGHT = ["id", "n", "root", "p", "q"]


def _starred(lists: DataFrame, percent: int) -> DataFrame:
    """Every member of a list with STARS of them."""
    drawn = F.row_number().over(Window.partitionBy("value").orderBy(F.xxhash64("id"), "id"))
    some = lists.withColumn("k", drawn).where(F.col("k") <= STARS).select("value", *[F.col(c).alias(f"2{c}") for c in LIGHT])
    return lists.join(some, "value").where((F.col("id") != F.col("2id")) & _close("", "2", percent)).select("id", "2id")


def _met(lists: DataFrame, columns: list[str], percent: int, also: Column | None = None) -> DataFrame:
    """All members of a list with all others, across components."""
    lists = lists.select("value", *columns)
    cond = (F.col("x.id") < F.col("y.id")) & (F.col("x.root") != F.col("y.root")) & _close("x.", "y.", percent)
    # the same rows on both sides, under the same names: they are shuffled once
    return lists.alias("x").join(lists.alias("y"), F.col("x.value") == F.col("y.value")).where(
        cond if also is None else cond & also).select("x.id", F.col("y.id").alias("2id"))


def _first(doc_id: str) -> Column:
    """The smallest of rows (doc_id, x); those without an id come last."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("rep"), "x")).alias("first")


def _decided(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, x, n, worded, component_id, stays) for every row of docs; repeated rows are decided alike."""
    all_ = staged(sketched(docs, words))
    classes = all_.where("cls is not null").groupBy("cls").agg(_first("doc_id"))
    reps = all_.join(classes, "cls").where(F.col("doc_id").eqNullSafe(F.col("first.rep")) & (F.col("x") == F.col("first.x"))).dropDuplicates(["cls"])
    reps = staged(reps.select(F.monotonically_increasing_id().alias("id"), "cls", "n", "p", "q", "sketch", F.col("doc_id").alias("rep"), "x"))
    lists = staged(inverted(reps, percent))
    lists = lists.join(lists.groupBy("value").agg(F.count("*").alias("m")).where("m > 1").select("value"), "value", "left_semi")
    listed = staged(reps.join(lists.select("id").distinct(), "id", "left_semi"))
    lists = staged(lists.join(listed.select("id", "p", "q"), "id"))
    sets = staged(full_sets(docs, listed, words))

    def links(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("id", "2id").alias("a"), F.greatest("id", "2id").alias("b")).distinct()
        return linked(pairs, listed, sets, percent)
    open_ = staged(_across(lists, None))
    short, long_ = open_.where(F.col("m") <= SHORT), open_.where(F.col("m") > SHORT)
    found = links(_met(short, LIGHT, percent).unionByName(_starred(long_, percent)))
    low = sets.select("id", F.slice("set", 1, FILTER).alias("low"))
    left = staged(_across(long_.drop("root", "m"), components(found)).join(low, "id"))
    rest = links(_met(left, [*LIGHT, "prefix", "low"], percent, (F.array_intersect("x.prefix", "y.prefix")[0] == F.col("x.value")) & _alike(
        F.col("x.low"), F.col("y.low"), F.col("x.n"), F.col("y.n"), percent, FILTER)))
    roots = components(found.unionByName(rest))
    named = reps.select("cls", "id", "rep", "x").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    smallest = named.groupBy("root").agg(_first("rep"))
    named = named.join(smallest, "root").select("cls", "first")
    worded = F.col("cls").isNotNull()
    stays = F.col("doc_id").eqNullSafe(F.col("first.rep")) & (F.col("x") == F.col("first.x"))
    return all_.select("doc_id", "x", "n", "cls").join(named, "cls", "left").select(
        "doc_id", "x", "n", worded.alias("worded"), F.when(worded, F.col("first.rep")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(worded, stays).otherwise(True).alias("stays"))


def grouped(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    return _decided(docs, words, percent).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def deduplicated(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without those that another document of their group stands for."""
    stays = _decided(docs, words, percent).where("stays").groupBy("doc_id", "x", "worded").agg(F.count("*").alias("n"))
    again = F.col("worded") & (F.col("n") > 1)
    stays = staged(stays.select(F.col("doc_id").alias("__id"), F.col("x").alias("__x"), again.alias("__again")))
    kept = docs.join(stays, docs["doc_id"].eqNullSafe(F.col("__id")) & (_hash(docs) == F.col("__x")))
    once, again = (kept.where(c).drop("__id", "__again") for c in ("not __again", "__again"))
    return once.unionByName(again.dropDuplicates(["doc_id", "__x"])).drop("__x")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: the component of every document, over 3-word shingles, from a similarity of 0.85."""
    return grouped(table(spark, sf_dir, "documents"), 3, 85).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
