"""Alignment of two tokenizers: what their tokens share, counted over a corpus.

Every document is encoded by A and by B. Byte offsets where tokens of both end cut it into groups, and
an A and a B token are linked where their bytes overlap. An id pair counts in each document that
links it at least once.

1. The identity map, A id -> B id of the same bytes, is made from the two vocabularies. Pairs of this
   map, which exact one-to-one groups consist of, are counted in one vector of vocabulary length per
   task. Only the other pairs, of irregular groups, are counted by a shuffle, once per document.
2. The counts come back to the documents: the identity counts and each A id's highest count are two
   vectors of vocabulary length. Of the irregular pairs, the most frequent, HOT_PAIRS at most, are a
   table that every task holds, so that no frequent pair is a hot key; all others are joined.

Both tokenizers are run once per distinct stretch of text from one blank to the next that both are known to
cut at (after a letter, digit or ASCII sign, not at the end); no token of either crosses such a place.

Defined results: a text that is null or empty, or whose A or B tokens do not spell a blank and the text
byte for byte (as where it holds U+2581), has no tokens: zeros and an empty digest; special tokens'
strings are plain text; texts of any length are encoded whole; repeated rows, and rows without an
id, count and return one by one; an empty table gives no rows; columns other than doc_id and text are
not read.
"""
from __future__ import annotations

import hashlib
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import chunks
from .store import kept, staged, table

KNOWN = 300_000                 # stretches whose tokens a worker remembers
TOGETHER = 64                   # new stretches given to a tokenizer as one text
CHUNK_BYTES = 2 << 20
ROWS_TOGETHER = 512
HOT_PAIRS = 1 << 18             # irregular pairs that every task holds
BINS = 8                        # per doubling of a count, to find the most frequent pairs
CUT = re.compile(r"(?<=[\w!-~])(?= (?!\Z))")      # B gives nothing for a blank alone
CLOSED = re.compile(r"[\w!-~]\Z")
ROWS = ("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
        "same array<int>, same_n array<int>, odd array<long>, odd_n array<int>")


def _unbyte() -> dict[str, int]:
    """The signs that stand for bytes in a byte-level vocabulary: printable bytes as themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """The two tokenizers, the bytes of their tokens and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        unbyte = _unbyte()
        special = set(self.a.get_added_tokens_decoder())
        self.bytes_a = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = b"" if i in special else bytes(unbyte[c] for c in token)
        size = self.b.get_piece_size()
        self.bytes_b = [b""] * size
        for i in range(size):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b[i] = bytes([int(piece[1:-1], 16)])
            elif not (self.b.is_control(i) or self.b.is_unknown(i)):
                self.bytes_b[i] = piece.replace("▁", " ").encode()
        # a piece comes before a single byte of the same value
        by_bytes = {self.bytes_b[i]: i for i in sorted(range(size), key=lambda i: not self.b.is_byte(i)) if self.bytes_b[i]}
        self.identity = np.array([by_bytes.get(x, -1) if x else -1 for x in self.bytes_a], np.int64)
        self.length_a, self.length_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids by A and B; the texts start with a blank, which B adds."""
        return ([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)],
                self.b.encode([x[1:] for x in texts], num_threads=1))

    def sound(self, text: bytes, a: list[int], b: list[int]) -> bool:
        return text == b"".join(map(self.bytes_a.__getitem__, a)) == b"".join(map(self.bytes_b.__getitem__, b))


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the A and B tokens that overlap, from the byte offsets where tokens end."""
    starts_a, starts_b = (np.r_[0, x[:-1]] if len(x) else x for x in (ends_a, ends_b))
    first = np.searchsorted(ends_b, starts_a, "right")
    n = np.searchsorted(starts_b, ends_a, "left") - first
    at_a = np.repeat(np.arange(len(ends_a)), n)
    return at_a, np.arange(len(at_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Places(dict):
    """stretch -> place; a new one waits to be learned."""

    def __init__(self):
        self.new = []

    def __missing__(self, key: str) -> int:
        self[key] = place = len(self)
        self.new.append(key)
        return place


class Stretches:
    """What is known of each stretch: its token, group and link counts, its groups as text, its links."""

    def __init__(self, path_a: str, path_b: str):
        self.pair = Pair(path_a, path_b)
        self.forget()

    def forget(self) -> None:
        self.at, self.groups = Places(), []
        self.numbers = np.zeros((0, 6), np.int64)       # a, b, groups, links, is sound, may be cut after
        self.first, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        new, self.at.new = self.at.new, []
        got = {}
        for k in range(0, len(new), 64 * TOGETHER):
            self._together(new[k:k + 64 * TOGETHER], got)
        numbers, links = np.array([got[x][0] for x in new], np.int64).reshape(-1, 6), [got[x][2] for x in new]
        self.first = np.concatenate([self.first, len(self.links) + np.cumsum(numbers[:, 3]) - numbers[:, 3]])
        self.numbers = np.concatenate([self.numbers, numbers])
        self.links = np.concatenate([self.links, *links])
        self.groups += [got[x][1] for x in new]

    def _together(self, new: list[str], got: dict) -> None:
        closed = [x for x in new if CLOSED.search(x)]
        blocks = [closed[k:k + TOGETHER] for k in range(0, len(closed), TOGETHER)] + [[x] for x in new if not CLOSED.search(x)]
        while blocks:
            texts = ["".join(" " + x for x in block) for block in blocks]
            apart = []
            for block, text, a, b in zip(blocks, texts, *self.pair.encode(texts)):
                raw = text.encode()
                if self.pair.sound(raw, a, b):
                    self._read(block, a, b, got)
                elif len(block) > 1:
                    apart += [[x] for x in block]
                else:
                    got[block[0]] = (0, 0, 0, 0, 0, 0), "", np.zeros(0, np.int64)
            blocks = apart

    def _read(self, block: list[str], a: list[int], b: list[int], got: dict) -> None:
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = np.cumsum(self.pair.length_a[ids_a]), np.cumsum(self.pair.length_b[ids_b])
        at_a, at_b = overlaps(ends_a, ends_b)
        codes = ids_a[at_a] * len(self.pair.bytes_b) + ids_b[at_b]
        borders = np.intersect1d(ends_a, ends_b, assume_unique=True)
        ends = np.cumsum([len(x.encode()) + 1 for x in block])
        to_a, to_b = (np.searchsorted(x, borders, "right").tolist() for x in (ends_a, ends_b))
        text_a, text_b = list(map(str, a)), list(map(str, b))
        groups, i, j = [], 0, 0
        for p, q in zip(to_a, to_b):
            groups.append(f"{text_a[i]}|{text_b[j]}" if p == i + 1 and q == j + 1 else f"{','.join(text_a[i:p])}|{','.join(text_b[j:q])}")
            i, j = p, q
        n_a, n_b, n_groups = (np.searchsorted(x, ends, "right") for x in (ends_a, ends_b, borders))
        n_links = np.searchsorted(at_a, n_a, "left")
        rows = np.stack([n_a, n_b, n_groups, n_links])
        counts = np.diff(rows, axis=1, prepend=0).T.tolist()
        g = l = 0
        for key, count, to_g, to_l in zip(block, counts, n_groups.tolist(), n_links.tolist()):
            got[key] = (*count, 1, int(bool(CLOSED.search(key)))), ";".join(groups[g:to_g]), codes[l:to_l]
            g, l = to_g, to_l

    def places(self, texts: list[str]) -> list[np.ndarray]:
        """The places of each text's stretches, in order."""
        if len(self.at) > KNOWN:
            self.forget()
        split = [x.split(" ") if x else [] for x in texts]
        sizes = np.array(list(map(len, split)), np.int64)
        flat = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if self.at.new:
            self.learn()
        out = np.split(flat, np.cumsum(sizes)[:-1]) if len(texts) else []
        # a blank that no letter, digit or sign comes before is no place to cut at
        for i, p in enumerate(out):
            if len(p) > 1 and (texts[i][-1] == " " or not self.numbers[p[:-1], 5].all()):
                own = [x[1:] for x in CUT.split(" " + texts[i])]
                out[i] = np.fromiter(map(self.at.__getitem__, own), np.int64, len(own))
        if self.at.new:
            self.learn()
        return out


def tallied(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, in order, with the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(weights, starts) if len(keys) else weights


def linked_ids(known: Stretches, texts: list[str], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, times): the distinct id pairs of each text, in order."""
    owner = np.repeat(np.arange(len(texts)), list(map(len, places)))
    flat = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
    stretch, times = tallied(owner << 32 | flat, np.ones(len(flat), np.int64))
    owner, flat = stretch >> 32, stretch & 0xFFFFFFFF
    n = known.numbers[flat, 3]
    ends = np.cumsum(n)
    links = known.links[np.repeat(known.first[flat] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
    keys, times = tallied(np.repeat(owner, n) << 32 | links, np.repeat(times, n))
    return keys >> 32, keys & 0xFFFFFFFF, times


def encoded(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False) -> DataFrame:
    """One row per document, with its id pairs of the identity map (same) and the others (odd) and their times;
    and one row per task, without a number, with the documents that hold each pair of the identity map."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(pa.int32())] * 2 + [pa.list_(pa.int64()), pa.list_(pa.int32())]

    def lists(owner, values, n, kind):
        offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

    def encode(batches):
        from pyspark import TaskContext
        known = kept((path_a, path_b), lambda: Stretches(path_a, path_b))
        identity, width = known.pair.identity, len(known.pair.bytes_b)
        vector, row = np.zeros(len(identity), np.int64), TaskContext.get().partitionId() << 33
        for batch in batches:
            ids, all_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in chunks([len(t or "") for t in all_texts], CHUNK_BYTES):
                texts = [t or "" for t in all_texts[part]]
                n = len(texts)
                places = known.places(texts)
                places = [p if known.numbers[p, 4].all() else p[:0] for p in places]
                groups = [";".join(map(known.groups.__getitem__, p.tolist())) for p in places]
                sums = np.array([known.numbers[p, :4].sum(axis=0) for p in places]).reshape(-1, 4)
                owner, code, times = linked_ids(known, texts, places)
                a, b = code // width, code % width
                same = identity[a] == b
                vector += np.bincount(a[same], minlength=len(vector))
                columns = [np.arange(row, row + n), ids[part], *sums.T,
                           [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups],
                           groups if keep_groups else [None] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)] + [
                    lists(owner[same], a[same], n, pa.int32()), lists(owner[same], times[same], n, pa.int32()),
                    lists(owner[~same], code[~same], n, pa.int64()), lists(owner[~same], times[~same], n, pa.int32())], names=names)
                row += n
        held = np.flatnonzero(vector)
        yield pa.RecordBatch.from_arrays([pa.array([{"same": held, "same_n": vector[held]}.get(c)], k) for c, k in zip(names, kinds)], names=names)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, ROWS)


def identity_counts(rows: DataFrame) -> DataFrame:
    """(a, n): documents that hold an A id linked with the B id of its bytes."""
    held = rows.where("row is null").select(F.explode(F.arrays_zip("same", "same_n")).alias("x"))
    return held.groupBy(F.col("x.same").cast("long").alias("a")).agg(F.sum(F.col("x.same_n")).alias("n"))


def odd_counts(rows: DataFrame) -> DataFrame:
    """(code, n, bin): documents that hold each other pair, and the bin of that number."""
    pairs = rows.select(F.explode("odd").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return pairs.withColumn("bin", F.floor(F.log2("n") * BINS))


def hottest(pairs: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """A bin, and the codes and counts of the pairs from it on: `most` of them at most."""
    sizes = pairs.groupBy("bin").count().orderBy(F.desc("bin")).collect()      # BINS rows per doubling
    least, total = 64 * BINS, 0
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        least = r["bin"]
    hot = pairs.where(F.col("bin") >= least).select("code", "n").toArrow()
    code, n = (hot.column(i).to_numpy() for i in range(2))
    order = np.argsort(code)
    return least, code[order], n[order]


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column."""
    n = column.value_lengths().to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(n)), n), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def aligned(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS, keep_groups: bool = False) -> DataFrame:
    """Every row of docs with its numbers of tokens, groups and links, how many of its links count as
    often as any of their A id (n_best), the sum of their counts, and its groups."""
    rows = staged(encoded(docs, path_a, path_b, keep_groups))
    pair = Pair(path_a, path_b)
    width = len(pair.bytes_b)
    same = np.zeros(len(pair.bytes_a), np.int64)
    counted = identity_counts(rows).toArrow()                                   # a row per A id at most
    same[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    pairs = staged(odd_counts(rows))
    best = same.copy()
    top = pairs.groupBy(F.floor(F.col("code") / width).alias("a")).agg(F.max("n").alias("n")).toArrow()    # likewise
    at = top.column(0).to_numpy()
    best[at] = np.maximum(best[at], top.column(1).to_numpy())
    least, hot, hot_n = hottest(pairs, hot_pairs)

    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "n_best", "count_sum", "rare", "rare_n"]

    def count(batches):
        for batch in (b.slice(k, ROWS_TOGETHER) for b in batches for k in range(0, b.num_rows, ROWS_TOGETHER)):
            n = batch.num_rows
            n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)

            def add(owner, a, counts, times):
                np.add.at(n_best, owner, times * (counts == best[a]))
                np.add.at(count_sum, owner, times * counts)
            (owner, a), (_, times) = (_flat(batch.column(i)) for i in (8, 9))
            add(owner, a, same[a], times)
            (owner, code), (_, times) = (_flat(batch.column(i)) for i in (10, 11))
            at = np.searchsorted(hot, code)
            known = hot[np.minimum(at, len(hot) - 1)] == code if len(hot) else np.zeros(len(code), np.bool_)
            add(owner[known], code[known] // width, hot_n[at[known]], times[known])
            owner, code, times = owner[~known], code[~known], times[~known]
            offsets = pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:8], pa.array(n_best), pa.array(count_sum), pa.ListArray.from_arrays(
                offsets, pa.array(code)), pa.ListArray.from_arrays(offsets, pa.array(times))], names=names)
    columns = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]
    sums = staged(rows.where("row is not null").mapInArrow(count, ", ".join(
        ROWS.split(", ")[:8] + ["n_best long", "count_sum long", "rare array<long>", "rare_n array<long>"])))
    highest = docs.sparkSession.createDataFrame(pa.table({"a": np.flatnonzero(best), "best": best[best > 0]}), "a long, best long")
    rest = pairs.where(F.col("bin") < least).withColumn("a", F.floor(F.col("code") / width)).join(F.broadcast(highest), "a").select(
        "code", "n", (F.col("n") == F.col("best")).cast("long").alias("is_best"))
    rare = sums.select("row", F.explode(F.arrays_zip("rare", "rare_n")).alias("x")).select("row", F.col("x.rare").alias("code"), F.col("x.rare_n").alias("times"))
    rare = rare.join(rest, "code").groupBy("row").agg(
        F.sum(F.col("times") * F.col("is_best")).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
    zero = F.lit(0).cast("long")
    return sums.join(rare, "row", "left").select(*columns[1:], (F.col("n_best") + F.coalesce("b", zero)).alias("n_best"),
                                                 (F.col("count_sum") + F.coalesce("c", zero)).alias("count_sum"))


def id_map(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n): every id pair that the corpus links, and in how many documents."""
    rows = staged(encoded(docs, path_a, path_b))
    pair = Pair(path_a, path_b)
    width = len(pair.bytes_b)
    identity = docs.sparkSession.createDataFrame(pa.table({"a": np.arange(len(pair.identity)), "b": pair.identity}), "a long, b long")
    same = identity_counts(rows).join(F.broadcast(identity), "a").select("a", "b", "n")
    odd = odd_counts(rows).select(F.floor(F.col("code") / width).alias("a"), (F.col("code") % width).alias("b"), "n")
    return same.unionByName(odd)


def vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    """op13: tokens, groups and links of every document."""
    return aligned(table(spark, sf_dir, "documents"), *vocabularies()).drop("groups")
