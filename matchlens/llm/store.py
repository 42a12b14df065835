"""Intermediate tables in the shared folder, and ranks over whole tables."""
from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens import session


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STAGED: list[str] = []


def clear(spark) -> None:
    """Removes the tables that this driver staged, once no DataFrame needs them any more."""
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet to the folder all executors share and read again.

    Cuts the lineage: a lost executor costs the tasks it ran, not the stages before."""
    path = f"{session.shared_folder(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes a staged table that no DataFrame needs any more."""
    files = df.inputFiles()
    folder = files[0].rsplit("/", 1)[0] if files else ""
    spark = df.sparkSession
    for path in [p for p in _STAGED if folder and folder.endswith(p.rsplit("/", 1)[1])]:
        _STAGED.remove(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def numbered(df: DataFrame, order: list[Column], name: str, first: int = 0) -> DataFrame:
    """df with consecutive numbers in the given order, without one task seeing all rows.

    Finding the ranges reads df once more, so stage what is costly to make. Rows are dealt by ranges of the order; the counts of the ranges, one number for each
    partition, are summed on the driver. Rows that tie in the whole order get any of their numbers."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}
    before, offsets = first - 1, []
    for p in sorted(counts):
        offsets.append((p, before))
        before += counts[p]
    if not offsets:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("__part")
    base = F.element_at(F.map_from_entries(F.array(*[F.struct(F.lit(p), F.lit(b).cast("long")) for p, b in offsets])), F.col("__part"))
    n = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn(name, n + base).drop("__part")


_KEPT: dict = {}


def kept(key, make):
    """What make() made in this Python worker, kept between tasks; one thing at a time, as workers live
    on through the stages and their memory with them."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


@contextmanager
def small_batches(spark, rows: int):
    """Tables with large rows go to Python a few rows at a time while this holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
