"""N-gram Jaccard join: size-aware, with subsets for small sets and inverted lists for large ones.

1. A document is the set of its word shingles, hashed. How often each of CELLS cells of hashes is hit in
   the corpus gives one global order, rare shingles first: an order that all tasks know from one
   table of CELLS bytes, whatever the corpus is. Sets as similar as asked share at least two of
   the first n - o + 2 elements in this order, o being the least overlap that a set of n can have
   with a similar one. This prefix is all that is shuffled. Equal sets form a class, one row from here on.
2. Elements that one class alone has are dropped; the others have inverted lists.
3. Small ("light") sets enumerate the subsets of two of what is left of their prefix, and meet in these;
   large ("heavy") sets scan the lists of single elements and meet sets of any size there. The boundary is
   the size at which both together cost least, by the rows that either way would make of the actual lists.
4. In a list, members first pair with STARS of them, links are verified on the full sets, and linked
   classes merge; lists whose members are of one component by then are done. What is left meets in full across
   components. Sizes, and parities of the elements in cells, which bound how far two sets differ, keep
   most pairs from being verified. Full sets are read again for classes of the other pairs alone, found by a bitmap.
5. Components by alternating large and small stars.

No step loses a link: the order, the cells, the bitmap and the boundary change the work, never the result.

Defined results: null text, or text without a word, has an empty set and is linked with nothing; with fewer
words than a shingle the whole sequence is the one shingle; repeated rows are in one class; a null id
never names a component that has another; texts of any length count whole; an empty table gives no
rows; columns other than doc_id and text are not read.
"""
from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .near import components, digest, keyed, shingles
from .packing import chunks
from .phrases import BITS, PAGE
from .store import removed, staged, table

CELLS = 1 << 21
BLOCK = 1 << 15                 # cells in a row
LARGEST = 512                   # sets above are heavy whatever they cost
STARS = 4                       # members of a list that all others pair with, before all pair with all
PARITIES = 512                  # at least; doubled until a set has no more elements
CHUNK_BYTES = 4 << 20
WORDS, PERCENT = 5, 80
PREFIX = "doc_id long, x long, n long, cls binary, p array<long>, prefix array<long>, last long"


def least_overlap(n: int, percent: int) -> int:
    """The smallest intersection that a set of n has with a set as similar as asked."""
    return -(-n * percent // 100)


def may_link(n: int, percent: int) -> bool:
    """Can a set of n be linked with a different set?"""
    return n > 0 and (n * 100 // percent > n or -(-2 * n * percent // (100 + percent)) < n)


def parities(shingle_set: np.ndarray) -> np.ndarray:
    """Of the hashes in each of some cells, whether their number is odd. Half as many cells are the halves, one on the other."""
    cells = PARITIES
    while cells < len(shingle_set):
        cells *= 2
    cell = (shingle_set.view(np.uint64) % np.uint64(cells)).astype(np.int64)
    return np.packbits((np.bincount(cell, minlength=cells) & 1).astype(np.uint8)).view(np.int64)


def _apart(a: str, b: str) -> Column:
    """By how many elements two sets differ at least, from their parities, one of them of at most twice the cells."""
    def xor(x, y):
        return F.zip_with(x, y, lambda u, v: u.bitwiseXOR(v))

    def folded(x, other):
        half = F.size(other)
        return F.when(F.size(x) > half, xor(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half))).otherwise(x)
    differ = xor(folded(F.col(a), F.col(b)), folded(F.col(b), F.col(a)))
    return F.aggregate(differ, F.lit(0), lambda n, v: n + F.bit_count(v))


def _cell(shingle_set: np.ndarray) -> np.ndarray:
    return (shingle_set.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


def _texts(batches, at: int):
    """(batch, rows, texts) in pieces of bounded size."""
    for batch in batches:
        texts = batch.column(at).to_pylist()
        for part in chunks([len(t or "") for t in texts], CHUNK_BYTES):
            yield batch, part, texts[part]


def levels(docs: DataFrame, words: int) -> bytes:
    """Per cell, how far it is hit more often than cells are on average; CELLS bytes.

    The unit is the spread that chance gives a cell, in half doublings: a shingle stands out from the rare ones in its
    cell once it occurs a few times the root of what a cell has, also where a corpus fills the cells."""
    def count(batches):
        total = np.zeros(CELLS, np.int64)
        with np.errstate(over="ignore"):
            for _, _, texts in _texts(batches, 0):
                total += np.bincount(np.concatenate([_cell(shingles(t, words)) for t in texts]), minlength=CELLS)
        if total.any():
            yield blocks({i: total[i * BLOCK:(i + 1) * BLOCK] for i in range(CELLS // BLOCK)})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(counts.as_buffer(), np.int64)
                sums[block] = sums[block] + x if block in sums else x.copy()
        if sums:
            yield blocks(sums)

    def blocks(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array([x.tobytes() for x in counts.values()], pa.binary())],
                                          names=["block", "counts"])
    kind = "block int, counts binary"
    got = docs.select("text").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind).collect()     # CELLS / BLOCK rows
    total = np.zeros(CELLS, np.int64)
    for r in got:
        total[r["block"] * BLOCK:][:BLOCK] = np.frombuffer(r["counts"], np.int64)
    usual = max(1.0, total.mean())
    above = np.maximum(total - usual, 0) / np.sqrt(usual)
    return np.clip(np.floor(2 * np.log2(1 + above)), 0, 127).astype(np.uint8).tobytes()


def prefixes(docs: DataFrame, words: int, percent: int, level) -> DataFrame:
    """(doc_id, x, n, cls, p, prefix, last) of every row; prefix: the first n - o + 2 shingles, rare ones first; last: where it ends."""
    def cut(batches):
        order = np.frombuffer(level.value, np.uint8)
        with np.errstate(over="ignore"):
            for batch, part, texts in _texts(batches, 2):
                sets = [shingles(t, words) for t in texts]
                first, last = [], []
                for s in sets:
                    if may_link(len(s), percent):
                        key = order[_cell(s)].astype(np.uint64) << np.uint64(56) | s.view(np.uint64) >> np.uint64(8)
                        own = np.argsort(key, kind="stable")[:len(s) - least_overlap(len(s), percent) + 2]
                        first.append(s[own])
                        last.append(int(key[own[-1]]))
                    else:
                        first.append(s[:0])
                        last.append(0)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[part], batch.column(1)[part], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([digest(s) for s in sets], pa.binary()), pa.array([parities(s) for s in sets], pa.list_(pa.int64())),
                    pa.array(first, pa.list_(pa.int64())), pa.array(last, pa.int64())], names=[c.split()[0] for c in PREFIX.split(", ")])
    return keyed(docs).mapInArrow(cut, PREFIX)


def _slot() -> Column:
    return F.xxhash64("doc_id", "x").bitwiseAND(F.lit(BITS - 1))


def full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(id, set) of the classes (id, cls, doc_id, x), from one document each. Texts are not shuffled: tasks look
    up in a bitmap of BITS bits whether a document may be one of these."""
    pages = classes.select(_slot().alias("slot")).groupBy(F.floor(F.col("slot") / PAGE).alias("page")).agg(
        F.bitmap_construct_agg(F.col("slot") % PAGE).alias("bits")).collect()       # BITS / PAGE rows
    marked = np.zeros(BITS // 8, np.uint8)
    for r in pages:
        bits = np.frombuffer(r["bits"], np.uint8)
        marked[r["page"] * (PAGE // 8):][:len(bits)] = bits
    marked = docs.sparkSession.sparkContext.broadcast(marked.tobytes())

    def sets(batches):
        asked = np.frombuffer(marked.value, np.uint8)
        with np.errstate(over="ignore"):
            for batch in batches:
                slot = batch.column(2).to_numpy()
                batch = batch.filter(pa.array((asked[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1))
                for own, part, texts in _texts([batch], 3):
                    found = [shingles(t, words) for t in texts]
                    yield pa.RecordBatch.from_arrays([own.column(0)[part], own.column(1)[part], pa.array(found, pa.list_(pa.int64()))],
                                                     names=["doc_id", "x", "set"])
    read = keyed(docs).select("doc_id", "x", _slot().alias("slot"), "text").mapInArrow(sets, "doc_id long, x long, set array<long>")
    mine = classes.select("id", F.col("doc_id").alias("rep"), F.col("x").alias("rx"))
    return read.join(mine, F.col("x").eqNullSafe(F.col("rx")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("id", "set").dropDuplicates(["id"])


def inverted(classes: DataFrame, percent: int) -> DataFrame:
    """(key, id, n, last): the lists of the prefix elements that several classes have; not of two whose sizes rule out a link."""
    entries = classes.select("id", "n", "last", F.explode("prefix").alias("key"))
    some = entries.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least"), F.max("n").alias("most"))
    some = some.where((F.col("m") > 2) | (F.col("m") == 2) & (F.col("least") * 100 >= F.col("most") * percent))
    return entries.join(some.select("key"), "key", "left_semi")


def _shared(entries: DataFrame) -> DataFrame:
    some = entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    return entries.join(some.select("key"), "key", "left_semi")


def boundary(lists: DataFrame, percent: int) -> int:
    """The size up to which sets enumerate subsets, by the rows that subsets and scans make: (key, id, n).

    A scan meets the stars of a list, so a long list costs an entry STARS rows, not its length."""
    lengths = lists.groupBy("key").agg(F.count("*").alias("m"))
    scans = lists.where(F.col("n") <= LARGEST).join(lengths, "key").groupBy("id", "n").agg(F.count("*").alias("s"), F.sum(F.least("m", F.lit(STARS + 1))).alias("scan"))
    rows = scans.groupBy("n").agg(F.sum(F.col("s") * (F.col("s") - 1) / 2).alias("subsets"), F.sum("scan").alias("scan")).collect()  # LARGEST rows
    cost = {r["n"]: (r["subsets"], r["scan"]) for r in rows}
    sizes = range(LARGEST + 1)
    subsets = list(accumulate(cost.get(n, (0, 0))[0] for n in sizes))
    scanned = list(accumulate(cost.get(n, (0, 0))[1] for n in sizes))
    return min(sizes, key=lambda n: subsets[n] - scanned[n])


def subsets(lists: DataFrame, light: int) -> DataFrame:
    """(key, id): the subsets of two of the listed elements of each set of at most `light` elements."""
    own = lists.where(F.col("n") <= light).groupBy("id").agg(F.sort_array(F.collect_list("key")).alias("v"))    # a light set's prefix
    first = own.select("id", "v", F.posexplode("v").alias("i", "a"))
    return first.select("id", F.explode(F.expr("transform(slice(v, i + 2, size(v)), b -> xxhash64(a, b))")).alias("key"))


def _sized(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


def _tiny(n: Column, percent: int) -> Column:
    """May a set of n be linked by one common element?"""
    return n * percent <= 100


def _open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists whose members are of several components, with each member's root."""
    lists = lists.drop("root").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = lists.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b")
    return lists.join(mixed.select("key"), "key", "left_semi")


def _pairs(lists: DataFrame, stars: DataFrame | None, light: int, percent: int) -> DataFrame:
    """(a, b): members of a list with its stars, or with all its members, if sizes and common lists allow a link; in
    lists of single elements, one of the two is heavy.

    Of two sets, the one whose prefix ends first has all but n - p elements there, so that the overlap is at most
    their common prefix elements and its n - p; where prefixes end at one place, the larger n - p. All members with all
    others meet in every common list."""
    y = (lists if stars is None else stars).select("key", *[F.col(c).alias(f"y{c}") for c in ("id", "n", "last", "root")])
    n = F.col("n"), F.col("yn")
    met = lists.join(y, "key").where((F.col("root") != F.col("yroot")) & _sized(*n, percent) & (
        F.col("subset") | (F.greatest(*n) > light) | _tiny(F.least(*n), percent)))
    if stars is None:
        met = met.where("id < yid")
    ends = F.when(F.col("last") < F.col("ylast"), F.col("n")).when(F.col("last") > F.col("ylast"), F.col("yn")).otherwise(F.greatest(*n))
    met = met.groupBy(F.least("id", "yid").alias("a"), F.greatest("id", "yid").alias("b")).agg(
        F.max("subset").alias("subset"), F.count(F.lit(1)).alias("common"), F.max(F.least(*n)).alias("n"), F.max(F.greatest(*n)).alias("yn"),
        F.max(ends).alias("ends"))
    if stars is None:
        overlap = F.ceil((F.col("n") + F.col("yn")) * percent / (100 + percent))
        behind = F.greatest(F.lit(0), F.ceil(F.col("ends") * percent / 100) - 2)
        met = met.where(F.col("subset") | (F.col("common") + behind >= overlap))
    return met.select("a", "b")


def _of_both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    for side in "ab":
        pairs = pairs.join(table.select(F.col("id").alias(side), F.struct(*columns).alias(f"x{side}")), side)
    return pairs


def linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: first by their parities, then by their full sets."""
    n = F.col("xa.n") + F.col("xb.n")
    near = staged(_of_both(pairs, classes, ["n", "p"]).where(n - _apart("xa.p", "xb.p") >= 2 * F.ceil(n * percent / (100 + percent))).select("a", "b"))
    asked = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = full_sets(docs, classes.join(asked, "id", "left_semi"), words)
    both = F.size(F.array_intersect("xa.set", "xb.set"))
    return staged(_of_both(near, staged(sets), ["set"]).where(100 * both >= percent * (
        F.size("xa.set") + F.size("xb.set") - both)).select("a", "b"))


def _first() -> Column:
    """The smallest of rows (doc_id, x); those without an id come last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x")).alias("first")


def joined(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    order = docs.sparkSession.sparkContext.broadcast(levels(docs, words))
    rows = staged(prefixes(docs, words, percent, order))
    classes = rows.where("cls is not null").groupBy("cls").agg(_first(), F.first("n").alias("n"), F.first("p").alias("p"), F.first("prefix").alias("prefix"),
                                                             F.first("last").alias("last"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("id"), "cls", "n", "first.doc_id", "first.x",
                                    "p", "prefix", "last"))
    slim = staged(rows.select("doc_id", "n", "cls"))
    removed(rows)
    lists = staged(inverted(classes, percent))
    light = boundary(lists, percent)
    heavy = lists.where((F.col("n") * 100 >= light * percent) | _tiny(F.col("n"), percent)).withColumn("subset", F.lit(False))
    small = lists.select("id", "n", "last").where(F.col("n") <= light).distinct()
    lists = heavy.unionByName(_shared(subsets(lists, light)).join(small, "id").withColumn("subset", F.lit(True)))
    fat, classes = classes, staged(classes.drop("prefix", "last"))
    removed(fat)

    lists = staged(lists.withColumn("root", F.col("id")))
    drawn = Window.partitionBy("key").orderBy((F.col("n") > light).desc(), F.xxhash64("id"), "id")
    stars = lists.withColumn("k", F.row_number().over(drawn)).where(F.col("k") <= STARS)
    found = linked(_pairs(lists, stars, light, percent), docs, classes, words, percent)
    lists = _open(lists, staged(components(found)))
    rest = linked(_pairs(lists, None, light, percent), docs, classes, words, percent)
    roots = components(found.unionByName(rest))
    named = classes.select("cls", "id", "doc_id", "x").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = named.join(named.groupBy("root").agg(_first()), "root").select("cls", F.col("first.doc_id").alias("least"))
    return slim.join(named, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: the component of every document, over 5-word shingles, from a similarity of 0.8."""
    return joined(table(spark, sf_dir, "documents"))
