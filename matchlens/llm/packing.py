"""Packing documents into fixed-length token sequences: shortest-pack-first over the length histogram.

Documents are tokenized, ended with END, and cut into pieces of at most `size` tokens. The histogram
of piece lengths, `size` numbers at most, is all the planner sees: lengths go longest first, each
into the packs with the fewest tokens so far that still have room, many packs at a time. The result
is a list of patterns with counts. Pieces are numbered within their length, and a pattern's slots
own ranges of these numbers, so that a join with the patterns gives every piece its sequence and
its offset there.

Defined results: null and empty text is END alone; text of any length is cut, never shortened;
strings of special tokens are these tokens;
repeated rows are packed one by one; an empty table gives no rows; columns other than doc_id and
text are not read. Which of equally long pieces goes where follows doc_id and start.
"""
from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import kept, numbered, staged, table

SIZE = 2048
END = 1
KNOWN_WORDS = 600_000            # words whose ids a worker remembers
TOGETHER = 2000                 # new words given to the tokenizer at a time
CHUNK_BYTES = 4 << 20           # text that a worker holds as words at a time
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Places(dict):
    """word -> place; a word asked for the first time gets the next place and waits to be learned."""

    def __init__(self):
        self.new = []

    def __missing__(self, word: bytes) -> int:
        self[word] = place = len(self) + 1      # place 0 is the end of a document
        self.new.append(word)
        return place


def ends_in_letter(stem: str) -> bool:
    """Is a full stop after this word a token of its own? Only said of letters that every Unicode version has; a letter
    whose lower case ends in a mark (as U+0130) joins its mark with the stop."""
    last = unicodedata.normalize("NFC", stem).lower()[-1:]
    return stem.isalpha() and last.isalpha() and last < "\u0250"


class WordIds:
    """Token ids by white-space-separated word.

    The tokenizer never joins what ASCII white space separates, nor letters with a comma or full stop,
    and it drops case. So a text's ids are those of its lower-cased words in order, and each
    distinct word without its stop is tokenized once, together with other new words. The strings of special tokens, which
    the tokenizer finds first and with case, part a text; a blank before them keeps them apart from words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {b" " + t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.parts = re.compile("(" + "|".join(re.escape(x[1:].decode()) for x in self.special) + ")") if self.special else None
        self.tokenizer.encode_special_tokens = True     # what words lower-case to is no special token
        self.forget()

    def split(self, text: str) -> list[bytes]:
        parts = self.parts.split(text) if self.parts else [text]
        if len(parts) == 1:
            return text.encode().lower().split()
        return [w for i, x in enumerate(parts) for w in ([b" " + x.encode()] if i % 2 else x.encode().lower().split())]

    def forget(self) -> None:
        self.at = Places()
        self.first, self.count = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.ids = np.full(1, END, np.uint32)

    def learn(self) -> None:
        """Finds the ids of the new words, by place."""
        known, at = len(self.count), self.at
        stems = {}      # place of a word with a stop -> places of the word and of the stop
        for word in at.new[:]:
            if word[-1:] in (b".", b",") and ends_in_letter(word[:-1].decode()):
                stems[at[word]] = at[word[:-1]], at[word[-1:]]
        words = at.new
        at.new = []
        whole = [w for i, w in enumerate(words, known) if i not in stems and w not in self.special]
        counts, ids = [np.zeros(0, np.int64)], []
        for k in range(0, len(whole), TOGETHER):
            texts = [w.decode() for w in whole[k:k + TOGETHER]]
            got = self.tokenizer.encode("\n".join(texts), add_special_tokens=False)
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            owner = np.searchsorted(starts, np.fromiter((o[0] for o in got.offsets), np.int64, len(got)), "right") - 1
            counts.append(np.bincount(owner, minlength=len(texts)).astype(np.int64))
            ids.append(np.array(got.ids, np.uint32))
        count, first = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        apart = np.ones(len(words), np.bool_)
        special = {i: self.special[w] for i, w in enumerate(words) if w in self.special}
        apart[np.array([*stems], np.int64) - known] = False
        apart[np.array([*special], np.int64)] = False
        count[apart] = np.concatenate(counts)
        first[apart] = len(self.ids) + np.cumsum(count[apart]) - count[apart]
        for i, token in special.items():
            count[i], first[i] = 1, len(self.ids) + sum(map(len, ids))
            ids.append(np.array([token], np.uint32))
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])
        self.ids = np.concatenate([self.ids, *ids])
        if stems:
            own = np.array([*stems], np.int64)
            parts = np.array([*stems.values()], np.int64)
            n = self.count[parts]
            self.count[own] = n.sum(axis=1)
            self.first[own] = len(self.ids) + np.cumsum(n.sum(axis=1)) - n.sum(axis=1)
            self.ids = np.concatenate([self.ids, self.joined(parts.ravel())])

    def joined(self, places: np.ndarray) -> np.ndarray:
        count = self.count[places]
        ends = np.cumsum(count)
        return self.ids[np.repeat(self.first[places] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, with END."""
        if len(self.at) > KNOWN_WORDS:
            self.forget()
        split = [self.split(t) for t in texts]
        sizes = np.array([len(w) + 1 for w in split], np.int64)
        places = np.zeros(sizes.sum(), np.int64)
        of_word = np.ones(len(places), np.bool_)
        of_word[np.cumsum(sizes) - 1] = False
        places[of_word] = np.fromiter(map(self.at.__getitem__, chain.from_iterable(split)), np.int64, len(places) - len(texts))
        if self.at.new:
            self.learn()
        flat = self.joined(places)
        return np.split(flat, np.cumsum(self.count[places])[np.cumsum(sizes) - 1][:-1])


def word_ids(path: str) -> WordIds:
    return kept(path, lambda: WordIds(path))


def chunks(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive runs of rows of about `most` bytes; a larger row is a run of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """One row per piece; the ids themselves stay in the task."""
    def cut(batches):
        ids_of = word_ids(path)
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in chunks([len(t) for t in texts], CHUNK_BYTES):
                rows = [[], [], [], [], []]
                for doc_id, ids in zip(doc_ids[part], ids_of(texts[part])):
                    for start in range(0, len(ids), size):
                        piece = ids[start:start + size]
                        for column, value in zip(rows, (doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids))):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=[
                    "doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).mapInArrow(cut, PIECE)


def patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Packs as (((length, times), ...), number of such packs), from length -> number of pieces."""
    open_: dict[int, list] = {}         # room -> [(slots, number of packs)]
    done = []

    def put(slots, packs, room):
        if packs:
            (open_.setdefault(room, []) if room else done).append((slots, packs))
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(open_, default=0)
            if room < length:           # no open pack has room: new ones, as full of this length as they get
                times = size // length
                packs, rest = divmod(left, times)
                put(((length, times),), packs, size - times * length)
                if rest:
                    put(((length, rest),), 1, size - rest * length)
                break
            slots, packs = open_[room].pop()
            if not open_[room]:
                del open_[room]
            # the shortest packs take turns until they are no longer the shortest
            level = max([r for r in open_ if r >= length], default=0)
            times = max(1, min(room // length, -(-(room - level) // length)))
            full, rest = divmod(left, times)
            if full >= packs:
                put((*slots, (length, times)), packs, room - times * length)
                left -= packs * times
            else:
                put((*slots, (length, times)), full, room - times * length)
                if rest:
                    put((*slots, (length, rest)), 1, room - rest * length)
                put(slots, packs - full - (rest > 0), room)
                left = 0
    return done + [x for room in open_ for x in open_[room]]


def slots(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, end, times, sequence, offset): numbers from first to end of a length go `times`
    to a sequence, from that sequence and that offset on. Numbers run over all lengths, shortest first."""
    next_, n = {}, 0
    for length in sorted(histogram):
        next_[length] = n
        n += histogram[length]
    out, sequence = [], 0
    for filled, packs in patterns(histogram, size):
        offset = 0
        for length, times in filled:
            out.append((length, next_[length], next_[length] + packs * times, times, sequence, offset))
            next_[length] += packs * times
            offset += length * times
        sequence += packs
    return out


def pack(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    cut = numbered(staged(pieces(docs, path, size)), [F.col(c) for c in ("length", "doc_id", "start", "ids_crc32")], "n")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # `size` rows at most
    plan = docs.sparkSession.createDataFrame(
        slots(histogram, size), "slot_length long, first long, end long, times long, sequence long, at long")
    met = (F.col("length") == F.col("slot_length")) & (F.col("n") >= F.col("first")) & (F.col("n") < F.col("end"))
    k = F.col("n") - F.col("first")
    return cut.join(F.broadcast(plan), met).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("sequence") + F.floor(k / F.col("times"))).cast("long").alias("sequence_id"),
        (F.col("at") + k % F.col("times") * F.col("length")).cast("long").alias("offset"))


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: the pieces of all documents."""
    return pack(table(spark, sf_dir, "documents"), vocabulary())
