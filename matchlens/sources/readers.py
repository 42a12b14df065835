"""Readers: match files, step logs, keys, answers and JSON maps to flat tables."""
from __future__ import annotations

import io

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from matchlens import schemas


def match_arrays(spark: SparkSession, path: str) -> DataFrame:
    """One array archive per match (or per stretch of one) to trace rows.

    A one-off ingest job: each file is decoded in its own task, frames leave in batches, and
    the result is meant to be written as Parquet. ``first_frame`` in an archive shifts its
    frames; the file name ``shape_sSEED`` (up to a dot) gives shape and seed, unless the archive holds the ``seed``.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path)

    def decode(batches):
        import numpy as np
        import pandas as pd
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                match = name.rsplit("/", 1)[-1].split(".")[0]
                shape, seed = match.rsplit("_s", 1)
                z = np.load(io.BytesIO(content), allow_pickle=False)
                first = int(z["first_frame"]) if "first_frame" in z.files else 0
                seed = int(z["seed"]) if "seed" in z.files else int(seed)
                n = len(z["ball"])
                for lo in range(0, n, 4096):
                    part = slice(lo, min(lo + 4096, n))
                    ball, score = z["ball"][part], z["score"][part]

                    def points(key):
                        return [[{"x": float(x), "y": float(y)} for x, y in frame]
                                for frame in z[key][part]]
                    yield pd.DataFrame({
                        "match": match, "shape": shape, "seed": seed,
                        "frame": np.arange(part.start, part.stop) + first,
                        "ball_x": ball[:, 0].astype(float), "ball_y": ball[:, 1].astype(float),
                        "ball_z": ball[:, 2].astype(float),
                        "owned_team": z["owned_team"][part].astype(int),
                        "owned_player": z["owned_player"][part].astype(int),
                        "game_mode": z["game_mode"][part].astype(int),
                        "score_l": score[:, 0].astype(int), "score_r": score[:, 1].astype(int),
                        "left": points("left"), "right": points("right")})
    return files.select("path", "content").mapInPandas(decode, schemas.TRACE)


def step_logs(spark: SparkSession, path: str) -> DataFrame:
    """Logs of step records to trace rows; the position in the list is the frame."""
    logs = spark.read.schema(schemas.STEP_LOG).json(path)
    s = logs.select("match_id", "first_frame", F.posexplode("steps").alias("pos", "s"))

    def points(side):
        return F.transform(F.col(f"s.{side}_team"), lambda p: F.struct(
            p[0].alias("x"), p[1].alias("y"))).alias(side)
    return s.select(
        "match_id", (F.coalesce("first_frame", F.lit(0)) + F.col("pos")).alias("frame"),
        *[F.col("s.ball")[i].alias(f"ball_{a}") for i, a in enumerate("xyz")],
        F.col("s.ball_owned_team").alias("owned_team"),
        F.col("s.ball_owned_player").alias("owned_player"),
        F.col("s.game_mode").alias("game_mode"), F.col("s.score")[0].alias("score_l"),
        F.col("s.score")[1].alias("score_r"), points("left"), points("right"))


def cell_key(spark: SparkSession, path: str) -> DataFrame:
    """Typed final-cell key; cells and rows in upper case without blanks."""
    key = spark.read.schema(schemas.CELL_KEY).option("header", True).csv(path)
    return key.withColumn("ball_cell", F.upper(F.trim("ball_cell"))).withColumn(
        "grid_row", F.upper(F.trim("grid_row")))


def detail(column: Column, schema: str) -> Column:
    """JSON stored in a CSV cell with ; in place of the commas."""
    return F.from_json(F.replace(column, F.lit(";"), F.lit(",")), schema)


def ball_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Documents {frame: [px, py]} per match to rows."""
    docs = spark.read.schema(schemas.PIXEL_MAP).json(path)
    return docs.select("match_id", F.explode("pixels").alias("frame", "p")).select(
        "match_id", F.col("frame").cast("bigint").alias("frame"), F.col("p")[0].alias("px"),
        F.col("p")[1].alias("py"))


def absent_spans(spark: SparkSession, path: str) -> DataFrame:
    """Documents {match: [[lo, hi], ...]} to rows."""
    docs = spark.read.schema(schemas.SPAN_MAP).json(path)
    return docs.select(F.explode("spans").alias("match_id", "s")).select(
        F.col("match_id").cast("bigint").alias("match_id"), F.explode("s").alias("s")).select(
        "match_id", F.col("s")[0].alias("lo"), F.col("s")[1].alias("hi"))


# --- the published layouts: one document per file, named after its match ---
def _documents(spark: SparkSession, path: str, schema: str, layout: str) -> DataFrame:
    """(match, doc) of whole JSON files; a file of another layout is an error, not no rows.

    The match is the file's name, or that of a folder ``match=NAME``."""
    files = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_path").alias("path"))
    doc = F.from_json("value", schema, {"mode": "FAILFAST"})
    opening = "[" if schema.startswith("array") else "{"
    other = doc.isNull() | ~F.ltrim("value").startswith(opening)
    return files.select(_match_of("path").alias("match"), F.when(other, F.raise_error(F.concat(
        F.lit(f"not {layout}: "), "path"))).otherwise(doc).alias("doc"))


def _match_of(path: str) -> Column:
    """The match a file belongs to: its name, or that of a folder ``match=NAME``."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "/match=([^/]+)/", 1), F.lit("")),
                      F.regexp_extract(path, r"([^/]+?)(?:\.[^/.]*)?$", 1))


def match_step_lists(spark: SparkSession, path: str) -> DataFrame:
    """Files with a list of steps each; the position in the list is the frame.

    A list of any length is read by as many tasks as its file has splits: steps hold no braces of their
    own, so every "}" ends one. The steps of a split are numbered where they are read; the counts of the
    splits, one row each, give every split its first frame. A file of another layout is an error."""
    at = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    parts = spark.read.text(path, lineSep="}").select("value", at.alias("at")).select(
        "at.*", F.monotonically_increasing_id().alias("i"), F.ltrim(F.regexp_replace("value", "[\\s]+", " ")).alias("part"))
    splits = parts.groupBy("path", "block").agg(F.min("i").alias("i0"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("path", "block", "i0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"),
                           F.sum("n").over(Window.partitionBy("path")).alias("all"))
    rows = parts.join(splits, ["path", "block"]).withColumn("frame", F.col("first") + F.col("i") - F.col("i0"))
    # "[ step", ", step" and so on, and "]" at the end; "[]" is an empty list
    opening = F.when(F.col("frame") == 0, "[").otherwise(",")
    last = F.col("frame") == F.col("all") - 1
    ends = F.when(F.col("frame") == 0, F.col("part").rlike(r"\A\[ *\] *\z")).otherwise(F.col("part").rlike(r"\A\] *\z"))
    sound = F.when(last, ends).otherwise(F.col("part").startswith(opening))
    body = F.concat(F.ltrim(F.substring("part", 2, 1 << 30)), F.lit("}"))
    step = F.when(sound, F.from_json(body, schemas.STEP, {"mode": "FAILFAST"})).otherwise(
        F.raise_error(F.concat(F.lit("not a list of steps: "), "path")).cast(schemas.STEP))
    s = rows.where(~(last & sound)).select(_match_of("path").alias("match"), F.col("frame").cast("bigint").alias("frame"), step.alias("s"))

    def points(side):
        return F.transform(F.col(f"s.{side}_team"), lambda p: F.struct(
            p[0].alias("x"), p[1].alias("y"))).alias(side)
    return s.select(
        "match", "frame", *[F.col("s.ball")[i].alias(f"ball_{a}") for i, a in enumerate("xyz")],
        F.col("s.ball_owned_team").alias("owned_team"), F.col("s.ball_owned_player").alias("owned_player"),
        F.col("s.game_mode").alias("game_mode"), F.col("s.score")[0].alias("score_l"),
        F.col("s.score")[1].alias("score_r"), points("left"), points("right"))


def match_pixels(spark: SparkSession, path: str) -> DataFrame:
    """Files {frame: [px, py]} per match to (match, frame, px, py)."""
    docs = _documents(spark, path, "map<string,array<double>>", "a map of frames to pixels")
    return docs.select("match", F.explode("doc").alias("f", "p")).select(
        "match", F.col("f").cast("bigint").alias("frame"), F.col("p")[0].alias("px"), F.col("p")[1].alias("py"))


def match_spans(spark: SparkSession, path: str) -> DataFrame:
    """A file {match: [[lo, hi], ...]} to (match, lo, hi)."""
    docs = _documents(spark, path, "map<string,array<array<bigint>>>", "a map of matches to spans")
    return docs.select(F.explode("doc").alias("match", "s")).select("match", F.explode("s").alias("s")).select(
        "match", F.col("s")[0].alias("lo"), F.col("s")[1].alias("hi"))


def _listed(spark: SparkSession, path: str, schema, layout: str) -> DataFrame:
    return _documents(spark, path, f"array<{schema.simpleString()}>", layout).select(F.explode("doc").alias("x")).select("x.*")


def plan(spark: SparkSession, path: str) -> DataFrame:
    """The probe plan: one row per match, its windows nested."""
    return _listed(spark, path, schemas.PLAN, "a plan")


def picks(spark: SparkSession, path: str) -> DataFrame:
    """The picked clips."""
    return _listed(spark, path, schemas.PICKS, "a list of picks")


def clip_key(spark: SparkSession, path: str) -> DataFrame:
    """The key of finished clips, 27 columns; another header is an error. ``number`` is that of the clip."""
    key = spark.read.schema(schemas.CLIP_KEY).option("header", True).option("enforceSchema", False).csv(path)
    return key.withColumn("number", F.regexp_extract("clip", "([0-9]+)$", 1).try_cast("bigint"))


def category_answers(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers of all categories, one JSON object per line; blank lines are no rows."""
    return spark.read.schema(schemas.CATEGORY_ANSWERS).json(path).where("category is not null")


def answers(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers, one JSON object per line; blank lines are no rows."""
    return spark.read.schema(schemas.ANSWERS).json(path).where(
        "clip is not null or raw is not null")
