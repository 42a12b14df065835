"""Session settings the operators rely on, and the checkpoint folder."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

SETTINGS = {
    # no stack capture per Column call: it makes building a plan several times slower
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

# Settings that may change in a running session.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # The number of shuffle partitions does not follow the input, and adaptive execution only ever merges
    # partitions: it starts from many, so that what a task sorts stays at its advisory size. Up to 200
    # are written without being sorted, and so without memory, on the map side.
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.session.timeZone": "UTC",
    # The JVM never compiles methods above 8000 bytes of bytecode. Expressions over 22 players
    # reach that when fused in one method; split operators are then several times faster.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def tune(spark: SparkSession) -> SparkSession:
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    return spark


def build(master: str | None = None, shuffle_partitions: int | None = None,
          **extra: str) -> SparkSession:
    b = SparkSession.builder.appName("matchlens")
    if master:
        b = b.master(master)
    for k, v in {**SETTINGS, **RUNTIME}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in extra.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a local one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = spark.conf.get("matchlens.local.checkpoint", None)
    if not made:
        made = tempfile.mkdtemp(prefix="matchlens-")
        spark.conf.set("matchlens.local.checkpoint", made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder: cuts the lineage as `cut_lineage` does, and tells
    Spark how large they are, so that it can choose how to join them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


FEW = 200_000


def few(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few rows (of a handful of numbers each); counted, not guessed."""
    return F.broadcast(df) if df.count() <= FEW else df
