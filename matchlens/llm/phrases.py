"""Phrase collocations of each language, mined with stripes.

A stripe is a phrase (the prefix) with a counter of the words that follow it: (lang, prefix, {next: times}).
Level k makes the stripes of prefixes of k - 1 words, and merging them elementwise gives everything at
once: the phrases of k words and their frequency (entries), the frequency of the prefix (total of
the stripe, with what ends a piece or is followed by a rare word), and the longer phrases that subsume
others (the highest entry of a stripe, and of the entries that end alike).

* Only phrases whose first and last k - 1 words are both frequent can be frequent. The frequent ones
  of a level reach the tasks of the next as a bitmap of their hashes, BITS bits whatever the
  corpus is: a chance hit costs an entry that turns out to be rare, and nothing is ever missed.
  A pass over the texts may make the stripes of several levels from the bitmap of the level before them.
* Tasks merge stripes in memory, ENTRIES at most, before they are shuffled by prefix, many in a row.
  Prefixes that hold more than 1 / HOT of all words, of which there are HOT at most, have their stripes
  split by the next word into cells of about 1 / HOT of all words, so that no task holds the stripe of a
  frequent word.
* Phrases are compared as words, hashes only decide what is looked at.
* Scores are exact: products as 38-digit decimals, for corpora up to 10^17 words.

Defined results: null text is empty, null lang is `und`; ties go by frequency, then by the phrase's UTF-8
bytes; repeated rows, and rows without an id, each count; texts of any length count whole; an empty
table gives no rows; columns other than text and lang are not read.
"""
from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near import _mix
from .packing import chunks
from .store import staged, table

BITS = 1 << 26
PAGE = 1 << 15                  # bits in a row of a bitmap
HOT = 4096
WORD_CELLS = 1024               # of the stripe of the empty prefix
PASSES = ((1,), (2,), (3,), (4, 5))     # the levels that a pass over the texts makes; longer phrases take one pass each
ENTRIES = 1_500_000
KNOWN_WORDS = 400_000
CHUNK_BYTES = 4 << 20
BORDERS = bytes.maketrans(b".,;:!?\n\v\f\r", b"\n" * 10)
SHARD_BITS = 12                 # stripes go in rows of 2 ** SHARD_BITS shards, by a hash of the prefix
ROWS = "k int, shard int, stripes array<struct<lang:string,prefix:string,cell:int,next:array<string>,n:array<bigint>>>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, with b"." between its pieces."""
    return (text or "").encode().lower().translate(BORDERS).replace(b"\n", b" . ").split()


class Words(dict):
    """word -> number; 0 stands between pieces."""

    def __init__(self):
        self[b"."] = 0
        self.names = [b"."]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.names.append(word)
        return n


def _fold(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _mix(h * np.uint64(0x9E3779B97F4A7C15) + word)


def _word_hash(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """What `Stripes` gives for the same words."""
    out = np.empty(len(phrases), np.uint64)
    split = [p.encode().split(b" ") for p in phrases]
    sizes = np.array(list(map(len, split)))
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        h = _word_hash([langs[i].encode() for i in at])
        words = _word_hash(list(chain.from_iterable(split[i] for i in at))).reshape(-1, n)
        for j in range(n):
            h = _fold(h, words[:, j])
        out[at] = h
    return out


def _groups(keys: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows in an order that brings equal columns together, and where these begin.

    Sorted by a hash of the columns; where two differ under one hash, sorted by the columns."""
    order = np.argsort(keys, kind="stable")
    if not len(order):
        return order, order
    k, c = keys[order], columns[:, order]
    new = np.r_[True, (c[:, 1:] != c[:, :-1]).any(axis=0)]
    if (new[1:] & (k[1:] == k[:-1])).any():
        order = np.lexsort(columns)
        c = columns[:, order]
        new = np.r_[True, (c[:, 1:] != c[:, :-1]).any(axis=0)]
    return order, np.flatnonzero(new)


class Stripes:
    """The stripes of one task: for each level, entries (language, words of the prefix, next) with their times.

    base: the level of the bitmap; hot, cells: hashes of the hot prefixes of that level and their cells."""

    def __init__(self, ks: tuple[int, ...], base: int, bitmap: np.ndarray | None, hot: np.ndarray, cells: np.ndarray, entries: int, known: int):
        self.ks, self.base, self.bitmap, self.hot, self.cells = ks, base, bitmap, hot, cells
        self.entries, self.known = entries, known
        self.langs: dict[str, int] = {}
        self.forget()
        self.clear()

    def forget(self) -> None:
        self.words, self.hashes = Words(), np.zeros(1, np.uint64)

    def clear(self) -> None:
        self.held = {k: ([], [], []) for k in self.ks}      # hashes, columns, times
        self.size = 0

    def _frequent(self, h: np.ndarray) -> np.ndarray:
        slot = h & np.uint64(8 * len(self.bitmap) - 1)
        return (self.bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def add(self, langs: list[str], texts: list[str | None]) -> None:
        split = [words_of(t) for t in texts]
        for s in split:
            s.append(b".")
        sizes = np.array(list(map(len, split)), np.int64)
        w = np.fromiter(map(self.words.__getitem__, chain.from_iterable(split)), np.int32, int(sizes.sum()))
        del split
        names = self.words.names
        if len(names) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, _word_hash(names[len(self.hashes):])])
        lang = np.repeat(np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int32), sizes)
        seeds = _word_hash([x.encode() for x in self.langs])
        hashed, inside = self.hashes[w], w != 0
        at = np.flatnonzero(inside)
        h = _fold(seeds[lang[at]], hashed[at])
        if self.base == 0:
            self._take(1, h, np.stack([lang[at], w[at]]))
            return
        # where phrases of `base` words begin that may be frequent
        for j in range(1, self.base):
            stay = inside[at + j]               # a text ends with a border, so at + j is a word or that border
            at, h = at[stay], h[stay]
            h = _fold(h, hashed[at + j])
        stay = self._frequent(h)
        at, h = at[stay], h[stay]
        begins = np.zeros(len(w), np.bool_)
        begins[at] = True
        for k in range(self.base + 1, self.ks[-1] + 1):     # at, h: prefixes of k - 1 words
            goes_on = begins[at + k - self.base]            # no border comes before the end of a phrase that begins there
            after = np.where(goes_on, w[at + k - 1], 0)     # 0: nothing, or nothing frequent
            if k in self.ks:
                columns = np.stack([lang[at], *(w[at + j] for j in range(k - 1)), after])
                self._take(k, _fold(h, np.where(goes_on, hashed[at + k - 1], np.uint64(0))), columns)
            at, h = at[goes_on], h[goes_on]
            h = _fold(h, hashed[at + k - 1])

    def _take(self, k, keys, columns, times=None) -> None:
        order, starts = _groups(keys, columns)
        if times is None:
            times = np.diff(np.r_[starts, len(order)])
        else:
            times = np.add.reduceat(times[order], starts) if len(starts) else times
        first = order[starts]
        for held, x in zip(self.held[k], (keys[first], columns[:, first], times)):
            held.append(x)
        self.size += len(first)

    def full(self) -> bool:
        """Have the merged stripes outgrown the task's memory?"""
        if self.size < self.entries and len(self.words) < self.known:
            return False
        before = self.held
        self.clear()
        for k, (keys, columns, times) in before.items():
            if keys:
                self._take(k, np.concatenate(keys), np.concatenate(columns, axis=1), np.concatenate(times))
        return self.size > self.entries // 2 or len(self.words) >= self.known

    def rows(self):
        """The stripes, those of a shard in one row, in batches."""
        before = self.held
        self.clear()
        names = pa.array([None, *(x.decode() for x in self.words.names[1:])], pa.string())
        for k, (_, columns, times) in before.items():
            if columns:
                yield from self._rows(k, np.concatenate(columns, axis=1), np.concatenate(times), names)

    def _rows(self, k, columns, times, names):
        langs, seeds = list(self.langs), _word_hash([x.encode() for x in self.langs])
        h = of_base = seeds[columns[0]]
        for j, c in enumerate(columns[1:-1], 1):
            h = _fold(h, self.hashes[c])
            of_base = h if j == self.base else of_base
        after = self.hashes[columns[-1]]
        if k == 1:
            cell = (after % np.uint64(WORD_CELLS)).astype(np.int32)
        else:       # a hot prefix begins with a hot phrase
            place = np.minimum(np.searchsorted(self.hot, of_base), max(len(self.hot) - 1, 0))
            is_hot = self.hot[place] == of_base if len(self.hot) else np.zeros(len(of_base), np.bool_)
            cell = np.full(len(is_hot), -1, np.int32)
            cell[is_hot] = (after[is_hot] % self.cells[place[is_hot]]).astype(np.int32)
        head = np.concatenate([columns[:-1], cell[None, :]])
        keys = _fold(h, (cell.astype(np.int64) + 1).astype(np.uint64))
        order, starts = _groups(keys, head)         # the first bits of a key are the shard
        ends = np.r_[starts, len(order)]
        shards = (keys[order[starts]] >> np.uint64(64 - SHARD_BITS)).astype(np.int32)
        step = 1 << 15
        for s in range(0, len(starts), step):
            some, shard = starts[s:s + step], shards[s:s + step]
            lo, hi = ends[s], ends[min(s + step, len(starts))]
            own, first = order[lo:hi], order[some]
            offsets = pa.array((np.r_[some, hi] - lo).astype(np.int32))
            parts = [names.take(pa.array(c[first])).to_pylist() for c in columns[1:-1]]
            prefix = [" ".join(x) for x in zip(*parts)] if parts else [""] * len(first)
            made = pa.StructArray.from_arrays([
                pa.array([langs[i] for i in columns[0][first].tolist()], pa.string()),
                pa.array(prefix, pa.string()), pa.array(cell[first], pa.int32()), pa.ListArray.from_arrays(offsets, names.take(pa.array(columns[-1][own]))),
                pa.ListArray.from_arrays(offsets, pa.array(times[own], pa.int64()))], names=["lang", "prefix", "cell", "next", "n"])
            at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(at), k, np.int32)), pa.array(shard[at]),
                pa.ListArray.from_arrays(pa.array(np.r_[at, len(shard)].astype(np.int32)), made)], names=["k", "shard", "stripes"])


def stripes(docs: DataFrame, ks: tuple[int, ...], base: int, bitmap, hot: np.ndarray, cells: np.ndarray) -> DataFrame:
    """The stripes of some levels, merged within tasks; bitmap: a broadcast one of level `base`."""
    limits = ENTRIES, KNOWN_WORDS

    def make(batches):
        own = Stripes(ks, base, None if bitmap is None else np.frombuffer(bitmap.value, np.uint8), hot, cells, *limits)
        with np.errstate(over="ignore"):
            for batch in batches:
                langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for part in chunks([len(t or "") for t in texts], CHUNK_BYTES):
                    own.add(langs[part], texts[part])
                    if own.full():
                        yield from own.rows()
                        own.forget()
            yield from own.rows()
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(make, ROWS)


def merged(made: DataFrame, least: int) -> DataFrame:
    """(k, shard, lang, prefix, cell, total, ext): stripes added up elementwise, with the entries of `least` at least."""
    stripe = ["k", "shard", "lang", "prefix", "cell"]
    entries = F.flatten(F.transform("stripes", lambda s: F.transform(s["next"], lambda w, i: F.struct(
        s["lang"].alias("lang"), s["prefix"].alias("prefix"), s["cell"].alias("cell"), w.alias("next"), F.get(s["n"], i).alias("n")))))
    dealt = made.repartition("k", "shard").select("k", "shard", F.explode(entries).alias("x")).select("k", "shard", "x.*")
    dealt = dealt.groupBy(*stripe, "next").agg(F.sum("n").alias("n"))      # the shuffle by shard serves both
    kept = F.when(F.col("next").isNotNull() & (F.col("n") >= least), F.struct("next", "n"))
    return dealt.groupBy(*stripe).agg(F.sum("n").alias("total"), F.collect_list(kept).alias("ext"))


def bitmap_of(phrases: DataFrame) -> bytes:
    """The hashes of (lang, phrase) in BITS bits: BITS / PAGE rows come to the driver, however many phrases there are."""
    def slots(batches):
        with np.errstate(over="ignore"):
            for b in batches:
                h = phrase_hashes(b.column(0).to_pylist(), b.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array((h & np.uint64(BITS - 1)).astype(np.int64))], names=["slot"])
    s = phrases.select("lang", "phrase").mapInArrow(slots, "slot long")
    pages = s.groupBy(F.floor(F.col("slot") / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("slot") % PAGE).alias("bits"))
    out = np.zeros(BITS // 8, np.uint8)
    for r in pages.collect():
        bits = np.frombuffer(r["bits"], np.uint8)
        out[r["page"] * (PAGE // 8):][:len(bits)] = bits
    return out.tobytes()


def hot_hashes(phrases: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the phrases that hold 1 / HOT of all words at least, HOT of them at most, and how many
    times that share they hold."""
    rows = phrases.where(F.col("a") * HOT >= total).select("lang", "phrase", "a").collect()
    with np.errstate(over="ignore"):
        hashes = phrase_hashes([r["lang"] for r in rows], [r["phrase"] for r in rows])
    order = np.argsort(hashes)
    return hashes[order], np.array([1 + r["a"] * HOT // max(total, 1) for r in rows], np.uint64)[order]


def _passes(longest: int) -> list[tuple[int, ...]]:
    some = [tuple(k for k in ks if k <= longest) for ks in PASSES]
    return [ks for ks in some if ks] + [(k,) for k in range(PASSES[-1][-1] + 1, longest + 1)]


def levels(docs: DataFrame, least: int, longest: int) -> list[DataFrame]:
    """For 1 to `longest` words, (lang, phrase, prefix, suffix, a, n, lefts, rights): the phrases of a frequency a of
    `least` at least, those of their first 1, 2, .. words, and those of what is left after these."""
    spark = docs.sparkSession
    out: list[DataFrame] = []
    bitmap, hot, cells, total = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
    for ks in _passes(longest):
        rows = staged(merged(stripes(docs, ks, len(out), bitmap, hot, cells), least))
        if ks[0] == 1:
            total = rows.agg(F.sum("total")).first()[0] or 0
        for k in ks:
            out.append(staged(_level(rows.where(F.col("k") == k), k, out[-1] if out else None)))
        if k < longest:
            bitmap = spark.sparkContext.broadcast(bitmap_of(out[-1]))
            hot, cells = hot_hashes(out[-1], total)
    return out


def _level(rows: DataFrame, k: int, last: DataFrame | None) -> DataFrame:
    """The frequent phrases of k words from merged stripes; last: those of k - 1 words."""
    # a stripe in one cell has its total, those of hot prefixes (and of the empty one) add it up
    split = rows.where("cell >= 0")
    split = split.join(split.groupBy("lang", "prefix").agg(F.sum("total").alias("l")), ["lang", "prefix"])
    found = split.unionByName(rows.where("cell < 0").withColumn("l", F.col("total"))).select(
        "lang", "prefix", "l", F.explode("ext").alias("x")).select("lang", "prefix", "l", F.col("x.next").alias("next"), F.col("x.n").alias("a"))
    if k == 1:
        none = F.array().cast("array<bigint>")
        return found.select("lang", F.col("next").alias("phrase"), "prefix", F.lit("").alias("suffix"), "a", F.col("l").alias("n"),
                            none.alias("lefts"), none.alias("rights"))
    phrase = F.concat_ws(" ", "prefix", "next")
    found = found.select("lang", phrase.alias("phrase"), "prefix", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("suffix"), "a", "l")
    before = last.select("lang", F.col("phrase").alias("prefix"), "n", F.col("lefts").alias("ls"))
    behind = last.select("lang", F.col("phrase").alias("suffix"), F.array_prepend("rights", F.col("a")).alias("rights"))
    return found.join(before, ["lang", "prefix"]).join(behind, ["lang", "suffix"]).select(
        "lang", "phrase", "prefix", "suffix", "a", "n", F.array_append("ls", F.col("l")).alias("lefts"), "rights")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, first: int = 2000) -> DataFrame:
    """The `first` best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found = levels(docs, least, longest)
    out = None
    for k in range(2, longest + 1):
        some = found[k - 1]
        if k < longest:
            longer = found[k]
            for side in ("prefix", "suffix"):
                most = longer.groupBy("lang", F.col(side).alias("phrase")).agg(F.max("a").alias("most"))
                some = some.join(most, ["lang", "phrase"], "left").where("most is null or most < a").drop("most")
        out = some if out is None else out.unionByName(some)
    big = "cast({} as decimal(38,0))".format
    cuts = F.expr(f"transform(sequence(1, size(lefts)), i -> struct(({big(1000)} * a * n) div ({big('lefts[i - 1]')} * rights[i - 1]) as score, "
                  "i as cut, lefts[i - 1] as l, rights[i - 1] as r))")
    scored = out.withColumn("best", F.array_min(cuts)).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the best phrases of every language."""
    return collocations(table(spark, sf_dir, "documents"))
