"""Exact top-k inner products by norm-bucketed retrieval.

Vectors, as integers, are dealt by length into buckets of at most BUCKET rows, longest first; equal
lengths are split by id. Queries come in blocks. Each query first meets the bucket of the longest
vectors, which gives a score that its k-th result reaches at least. That score, over the lengths of
the query and of a bucket's longest vector, is the bucket's cosine threshold for the query: above 1
the bucket is skipped; a high one prunes by the query's largest coordinate, as a vector at that
angle can't differ much there; a low one prunes by length. What is left is verified by full products.

Queries are met in rounds of at most ROUND, the only thing broadcast; buckets are not shuffled
again. A task keeps k results per query of the round.

Defined results: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; a vector meets those of its own number of components; rows with the query's id
are no candidates; repeated rows are candidates one by one, a repeated query is asked once (with its
smallest vector); ties go to the smaller id; fewer candidates than k are all returned; scores beyond
64 bits become the nearest 64-bit number; an empty table gives no rows; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import small_batches, staged, table

BUCKET = 2048
BLOCK = 1024
ROUND = 8 * BLOCK
STEEP = 0.75                    # cosine threshold from which coordinates prune better than lengths
EXACT = 2.0 ** 53
PACKED = "dim int, part int, seq int, longest double, ids binary, vectors binary, floors binary"
RESULT = "query_id long, vec_id long, score long"


def integers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v, dim, norm) of the rows that take part; v as doubles without fraction."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: (x.cast("double") * scale))
    whole = F.transform("v", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))    # beyond, all are whole
    t = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    t = t.withColumn("v", whole)
    return t.select("vec_id", "v", F.size("v").alias("dim"), F.sqrt(F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


def packed(vectors: DataFrame, rows: int, floors: bool = False) -> DataFrame:
    """Blocks of at most `rows` vectors of near lengths, longest first."""
    parts = max(1, -(-vectors.count() // rows))

    def pack(batches):
        from pyspark import TaskContext
        part, seq, held = TaskContext.get().partitionId(), 0, {}

        def block(dim, full):
            ids, vs, norms, low = (np.array(x) for x in zip(*full))
            order = np.lexsort((ids, -norms))
            return (dim, part, seq, float(norms.max()), ids[order].astype(np.int64).tobytes(),
                    vs[order].astype(np.float64).tobytes(), low[order].astype(np.float64).tobytes())
        for batch in batches:
            out = []
            for vec_id, v, dim, norm, low in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own = held.setdefault(dim, [])
                own.append((vec_id, v, norm, low))
                if len(own) == rows:
                    out.append(block(dim, held.pop(dim)))
                    seq += 1
            if out:
                yield as_batch(out)
        for dim, own in held.items():
            yield as_batch([block(dim, own)])
            seq += 1
    low = F.col("floor") if floors else F.lit(float("-inf"))
    dealt = vectors.select("vec_id", "v", "dim", "norm", low.alias("floor")).repartitionByRange(
        parts, F.col("dim"), F.col("norm").desc(), F.col("vec_id"))
    return dealt.mapInArrow(pack, PACKED)


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in PACKED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


class Best:
    """The k best results of each query of a block, so far."""

    def __init__(self, ids, vectors, floors, k: int):
        self.ids, self.vectors, self.floors, self.k = ids, vectors, floors.copy(), k
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.found = [np.empty(0, np.int64)] * 2 + [np.empty(0)]   # query's place, id, score

    def meet(self, ids, vectors, norms) -> None:
        """vectors: a bucket, longest first."""
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = self.floors / (self.norms * norms[0])
        slack = 1e-9 * (1 + np.abs(self.floors))
        alive = ~(self.floors - slack > self.norms * norms[0])
        steep = alive & (cosine >= STEEP) & (cosine <= 1) & (len(ids) > self.k)
        for i in np.flatnonzero(steep):
            q = self.vectors[i] / self.norms[i]
            f = int(np.abs(q).argmax())
            c = cosine[i] - 1e-9
            off = np.sqrt(max(0.0, 1 - q[f] ** 2) * max(0.0, 1 - c * c))
            x = vectors[:, f]
            near = np.flatnonzero((x >= (q[f] * c - off) * norms - 1e-6) & (norms * self.norms[i] >= self.floors[i] - slack[i])
                                  if q[f] > 0 else (x <= (q[f] * c + off) * norms + 1e-6) & (norms * self.norms[i] >= self.floors[i] - slack[i]))
            if len(near):
                self.verify(np.array([i]), ids[near], vectors[near])
        flat = np.flatnonzero(alive & ~steep)
        if len(flat):
            need = np.min(np.where(self.norms[flat] > 0, (self.floors[flat] - slack[flat]) / np.maximum(self.norms[flat], 1e-300), -np.inf))
            n = int(np.count_nonzero(norms >= need))
            if n:
                self.verify(flat, ids[:n], vectors[:n])

    def verify(self, queries, ids, vectors) -> None:
        q = self.vectors[queries]
        if self.norms[queries].max(initial=0) * np.sqrt((vectors * vectors).sum(axis=1).max()) < EXACT:
            scores = q @ vectors.T
        else:
            exact = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in vectors], object).T
            scores = np.clip(exact, -(1 << 63), (1 << 63) - 1)
        own = self.ids[queries][:, None] == ids[None, :]
        if scores.dtype != object:
            scores[own] = -np.inf
            if scores.shape[1] > self.k:    # the k-th best of this bucket is one more floor
                kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
                self.floors[queries] = np.maximum(self.floors[queries], kth)
            near = (scores >= self.floors[queries][:, None]) & ~own
        else:
            near = ~own
        at, of = np.nonzero(near)
        place, vec, score = (np.concatenate([a, b]) for a, b in zip(
            self.found, (queries[at], ids[of], scores[at, of])))
        order = sorted(range(len(place)), key=lambda i: (place[i], -score[i], vec[i])) if score.dtype == object else np.lexsort((vec, -score, place))
        place, vec, score = place[order], vec[order], score[order]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else np.empty(0, np.int64)
        rank = np.arange(len(place)) - np.repeat(starts, np.diff(np.r_[starts, len(place)]))
        kept = rank < self.k
        self.found = [place[kept], vec[kept], score[kept]]
        last = rank == self.k - 1
        self.floors[place[last]] = np.maximum(self.floors[place[last]], score[last].astype(float)) if scores.dtype != object else self.floors[place[last]]

    def rows(self) -> pa.RecordBatch:
        place, vec, score = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[place], pa.int64()), pa.array(vec, pa.int64()),
                                           pa.array([int(s) for s in score], pa.int64())], names=["query_id", "vec_id", "score"])


def _met(queries: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """The k best of each query in each task; queries: at most ROUND, packed."""
    asked = queries.select("dim", F.col("part").alias("q_part"), F.col("seq").alias("q_seq"), F.col("ids").alias("q_ids"),
                           F.col("vectors").alias("q_vectors"), F.col("floors").alias("q_floors"))
    pairs = buckets.select("dim", "ids", "vectors").join(F.broadcast(asked), "dim")

    def search(batches):
        best = {}
        for batch in batches:
            for r in batch.to_pylist():
                key = r["q_part"], r["q_seq"], r["dim"]
                if key not in best:
                    best[key] = Best(np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vectors"]).reshape(-1, r["dim"]),
                                     np.frombuffer(r["q_floors"]), k)
                vectors = np.frombuffer(r["vectors"]).reshape(-1, r["dim"])
                best[key].meet(np.frombuffer(r["ids"], np.int64), vectors, np.sqrt((vectors * vectors).sum(axis=1)))
        for b in best.values():
            yield b.rows()
    return pairs.mapInArrow(search, RESULT)


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): k best for every query; both as `integers` gives them."""
    spark = vectors.sparkSession
    with small_batches(spark, 16):
        buckets = staged(packed(vectors.where("dim > 0"), BUCKET))
    longest = buckets.groupBy("dim").agg(F.min(F.struct(-F.col("longest"), "part", "seq")).alias("first")).select(
        "dim", "first.part", "first.seq")
    first = buckets.join(F.broadcast(longest), ["dim", "part", "seq"])     # one bucket per number of components
    asked = queries.where("dim > 0").groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm")).alias("q")).select("vec_id", "q.*")

    def rounds(queries: DataFrame, floors: bool, buckets: DataFrame) -> DataFrame:
        with small_batches(spark, 16):
            blocks = staged(packed(queries, BLOCK, floors))
            parts = blocks.select("part", "seq").distinct().orderBy("part", "seq").collect()   # one row per BLOCK queries
            out, some = None, []
            for i, p in enumerate(parts):
                some.append((F.col("part") == p["part"]) & (F.col("seq") == p["seq"]))
                if len(some) == ROUND // BLOCK or i == len(parts) - 1:
                    chosen = some[0]
                    for x in some[1:]:
                        chosen = chosen | x
                    met = staged(_met(blocks.where(chosen), buckets, k))
                    out, some = met if out is None else out.unionByName(met), []
        return out if out is not None else spark.createDataFrame([], RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    seeds = rounds(asked, False, first).withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(
        F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    asked = asked.join(seeds, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    return rounds(asked, True, buckets).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the 10 best vectors for every row whose id is divisible by 100."""
    vectors = staged(integers(table(spark, sf_dir, "embeddings")))
    return search(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT * FROM r WHERE rank <= 10
"""
