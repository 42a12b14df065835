"""Time chunks: how one arbitrarily long match is split over many tasks.

A match may hold a third of all frames, so no operator partitions a window by ``match_id``
alone. Frames are grouped in chunks of ``matchlens.chunk.frames`` consecutive frames.

* Operators that look a bounded number of frames around (steps, gaps, sliding windows) work
  on ``reach``: a row is also copied into a neighbouring chunk when a core frame of that
  chunk can see it. The copied share is (before + after) / chunk length.
* Operators with unbounded memory (last owner, running totals, run starts) reduce every
  chunk to one row, scan those few rows, and hand the result back to each chunk.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from matchlens import session

CHUNK = "__chunk"
DEFAULT_FRAMES = 8192


def chunk_frames() -> int:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return DEFAULT_FRAMES
    return int(spark.conf.get("matchlens.chunk.frames", str(DEFAULT_FRAMES)))


def _index(frame: Column, size: int) -> Column:
    return F.floor(frame / F.lit(size)).cast("bigint")


def reach(df: DataFrame, before: int = 0, after: int = 0, frame: str = "frame",
          size: int | None = None) -> DataFrame:
    """Copy each row into every chunk that has a core frame within reach of it."""
    size = size or chunk_frames()
    f = F.col(frame)
    if not before and not after:
        return df.withColumn(CHUNK, _index(f, size))
    first = F.greatest(F.lit(0).cast("bigint"), _index(f - after, size))
    return df.withColumn(CHUNK, F.explode(F.sequence(first, _index(f + before, size))))


def is_core(frame: str = "frame", size: int | None = None) -> Column:
    return F.col(CHUNK) == _index(F.col(frame), size or chunk_frames())


def core(df: DataFrame, frame: str = "frame") -> DataFrame:
    return df.where(is_core(frame)).drop(CHUNK)


def along(key: str | list[str] = "match_id", order: str = "frame"):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys, CHUNK).orderBy(order)


def carry_last(df: DataFrame, values: dict[str, Column], key: str | list[str] = "match_id",
               frame: str = "frame") -> DataFrame:
    """Add, per output name, the last non-null value at or before each frame.

    ``df`` must already hold its chunk column with core rows only (``reach`` without context).
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = list(values)
    staged = df.select("*", *[v.alias(f"__v_{n}") for n, v in values.items()])
    per_chunk = staged.groupBy(*keys, CHUNK).agg(*[
        F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(frame)))
        .alias(f"__c_{n}") for n in names])
    earlier = (Window.partitionBy(*keys).orderBy(CHUNK)
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = per_chunk.select(*keys, CHUNK, *[
        F.last(f"__c_{n}", ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in names])
    upto = along(keys, frame).rowsBetween(Window.unboundedPreceding, 0)
    joined = staged.join(carried, [*keys, CHUNK])
    out = joined.select(*[c for c in df.columns if c not in names], *[
        F.coalesce(F.last(f"__v_{n}", ignorenulls=True).over(upto), F.col(f"__c_{n}")).alias(n)
        for n in names])
    return out.hint("merge")    # a row for each frame, whatever Spark takes its size to be


def running(df: DataFrame, values: dict[str, tuple[str, Column]],
            key: str | list[str] = "match_id", frame: str = "frame") -> DataFrame:
    """Add, per output name, the running "sum" or "max" up to and including each row.

    ``df`` must hold its chunk column with core rows only. Empty history counts as zero.
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = list(values)
    agg = {"sum": F.sum, "max": F.max}
    join = {"sum": lambda a, b: a + b, "max": F.greatest}
    staged = df.select("*", *[v.alias(f"__v_{n}") for n, (_, v) in values.items()])
    per_chunk = staged.groupBy(*keys, CHUNK).agg(*[
        agg[how](f"__v_{n}").alias(f"__c_{n}") for n, (how, _) in values.items()])
    earlier = (Window.partitionBy(*keys).orderBy(CHUNK)
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = per_chunk.select(*keys, CHUNK, *[
        F.coalesce(agg[how](f"__c_{n}").over(earlier), F.lit(0)).alias(f"__c_{n}")
        for n, (how, _) in values.items()])
    upto = along(keys, frame).rowsBetween(Window.unboundedPreceding, 0)
    joined = staged.join(carried, [*keys, CHUNK])
    return joined.select(*[c for c in df.columns if c not in names], *[
        join[how](F.coalesce(agg[how](f"__v_{n}").over(upto), F.lit(0)),
                  F.col(f"__c_{n}")).alias(n) for n, (how, _) in values.items()]).hint("merge")    # as above


def range_sums(rows: DataFrame, ranges: DataFrame, values: dict[str, Column], pane: int = 1) -> DataFrame:
    """ranges (match_id, start, end, ...) with the sum of each value over the frames of [start, end).

    Frames are added up to panes of ``pane`` frames and panes to running totals, which are kept where a
    range begins or ends; a range is the difference of two totals, however long it is and however many
    ranges a frame lies in. Starts and ends must be multiples of ``pane``.
    """
    names = list(values)
    whole = F.when((F.col("start") % pane != 0) | (F.col("end") % pane != 0), F.raise_error(F.lit(f"a range that does not fit panes of {pane} frames")))
    ranges = ranges.withColumn("start", F.coalesce(whole.cast("bigint"), F.col("start")))
    panes = rows.select("match_id", (F.expr(f"(frame div {pane} + 1) * {pane}")).alias("at"), F.lit(False).alias("asked"),
                        *[v.cast("bigint").alias(n) for n, v in values.items()])
    asked = ranges.select("match_id", F.explode(F.array("start", "end")).alias("at")).distinct().select(
        "match_id", "at", F.lit(True).alias("asked"), *[F.lit(0).cast("bigint").alias(n) for n in names])
    marks = panes.unionByName(asked).groupBy("match_id", "at").agg(
        F.max("asked").alias("asked"), *[F.sum(n).alias(n) for n in names])
    totals = running(reach(marks, frame="at"), {f"__t_{n}": ("sum", F.col(n)) for n in names}, frame="at").where("asked")
    totals = totals.select("match_id", "at", F.array(*[f"__t_{n}" for n in names]).alias("t"))
    first = totals.select("match_id", F.col("at").alias("start"), F.col("t").alias("__a"))
    last = totals.select("match_id", F.col("at").alias("end"), F.col("t").alias("__b"))
    out = ranges.join(first, ["match_id", "start"]).join(last, ["match_id", "end"])
    return out.select(*ranges.columns, *[(F.col("__b")[i] - F.col("__a")[i]).alias(n) for i, n in enumerate(names)])


def covering(trace: DataFrame, ranges: DataFrame, lo: Column, hi: Column, bucket: int = 128
             ) -> DataFrame:
    """Join each range row (match_id, ...) to the trace frames lo..hi, both included.

    Ranges are cut at time buckets and meet the trace on (match, bucket), so a range of any
    length is a few rows for each bucket it touches. Whether few ranges are broadcast, so that
    the trace stays where it lies, is left to Spark.
    """
    cut = ranges.select("*", lo.alias("__lo"), hi.alias("__hi")).withColumn("__b", F.explode(
        F.sequence(_index(F.col("__lo"), bucket), _index(F.col("__hi"), bucket))))
    hit = trace.withColumn("__b", _index(F.col("frame"), bucket)).join(cut, ["match_id", "__b"])
    return hit.where(F.col("frame").between(F.col("__lo"), F.col("__hi"))).drop(
        "__lo", "__hi", "__b")


def number_rows(df: DataFrame, order: list[str], bucket: Column | None, name: str = "k",
                key: list[str] | None = None) -> DataFrame:
    """Zero-based position in the order of ``order`` (within ``key``), without one big sort.

    With a key, ``bucket`` must be non-decreasing along ``order``; rows are counted per bucket, the bucket
    offsets are summed per key, and only the rows of a bucket are sorted together. Without a key, rows are dealt
    by ranges of ``order``; the counts of the ranges, one number for each partition, are summed on the driver.
    """
    if not key:
        spark = df.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = session.cut_lineage(df.repartitionByRange(parts, *order).withColumn("__b", F.spark_partition_id()))
        counts = {r["__b"]: r["count"] for r in dealt.groupBy("__b").count().collect()}
        offsets, total = [], 0
        for b in sorted(counts):
            offsets += [F.lit(b), F.lit(total).cast("bigint")]
            total += counts[b]
        first = F.create_map(*offsets)[F.col("__b")] if offsets else F.lit(0).cast("bigint")
        within = Window.partitionBy("__b").orderBy(*order)
        return dealt.withColumn(name, first + F.row_number().over(within) - 1).drop("__b")
    staged = df.withColumn("__b", bucket)
    sizes = staged.groupBy(*key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(*key, "__b", F.coalesce(
        F.sum("__n").over(Window.partitionBy(*key).orderBy("__b")
                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    within = Window.partitionBy(*key, "__b").orderBy(*order)
    return (staged.join(offsets, [*key, "__b"])
            .withColumn(name, F.col("__o") + F.row_number().over(within) - 1)
            .drop("__b", "__o"))
