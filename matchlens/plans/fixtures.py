"""Trace-shaped tables derived from the benchmark tables, by integer arithmetic.

Coordinates are milli-units, so ``unit=1000`` everywhere these views are used.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

UNIT = 1000.0
BLOCK = 8192


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A benchmark table. Its footer is read for the schema once per process, not per query."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def lengths(spark, sf) -> DataFrame:
    """match_id, n: one match per supplier, as long as the supplier has line items."""
    return (table(spark, sf, "lineitem")
            .groupBy(F.col("l_suppkey").cast("bigint").alias("match_id"))
            .agg(F.count(F.lit(1)).alias("n")))


def frames(spark, sf) -> DataFrame:
    """match_id, frame, n. Long matches are cut in blocks before their frames are written
    out, so that no single row or task unfolds a whole match.

    Spark takes unfolded rows to be as large as the rows they come from, a few bytes for each match, and would
    broadcast all frames to join them. The hint, which reaches the next join above, has them sorted and merged."""
    blocks = lengths(spark, sf).select(
        "match_id", "n", F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK})")).alias("block"))
    # The number is given because a few bytes of blocks unfold to many frames: left to itself,
    # adaptive execution would merge the small input into one task.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (blocks.repartition(tasks, "match_id", "block")
            .select("match_id", "n", F.explode(F.sequence(
                F.col("block") * BLOCK,
                F.least(F.col("n"), (F.col("block") + 1) * BLOCK) - 1)).alias("frame"))
            .hint("merge"))


def _side(team: int) -> Column:
    """The eleven points of one side; the owner (slot __o0 or __o1) stands at the ball."""
    s, owner = (-1 if team == 0 else 1), f"__o{team}"
    spots = []
    for i in range(11):
        x = f"{s * 950}L" if i == 0 else f"{s}L * ({50 + 70 * i} - 3 * __ph)"
        y = "0L" if i == 0 else f"({97 * i} + 13 * __m) % 801 - 400"
        spots.append(f"named_struct('x', if({owner} = {i}, ball_x + 5, {x}),"
                     f" 'y', if({owner} = {i}, ball_y + 5, {y}))")
    return F.expr(f"array({', '.join(spots)})")


def track(df: DataFrame, play: str = "match_id") -> DataFrame:
    """Add the trace columns to (match_id, frame, ...); ``play`` names the track followed."""
    keep = df.columns
    df = df.select(*keep, F.expr(play).alias("__m"), F.expr(f"frame + 37 * {play}").alias("__t"))
    df = df.select(
        "*", F.expr("__t % 173").alias("__ph"), F.expr("(__t div 173) % 3").alias("__k"),
        F.expr("case when (__t div 519) % 2 = 0 then 1L else -1L end").alias("__sg"),
        F.expr("(frame + 11 * __m) % 97 between 40 and 55").alias("__held"),
        F.expr("(frame + 11 * __m) div 97").alias("__gi"),
        F.expr("greatest(0L, __t % 173 - 12)").alias("__q"))
    df = df.select(
        "*", F.expr("case when __q <= 78 then __q else 156 - __q end").alias("__r"),
        F.expr("case when __held then __gi % 2 when ((frame + 3 * __m) div 9) % (2 + __m % 4)"
               " = 1 then -1L else ((frame + 3 * __m) div 18) % 2 end").alias("owned_team"))
    df = df.select(
        "*",
        F.expr("case __k when 0 then __sg * (990 - 3 * __r) when 1 then __sg * (3 * __r - 300)"
               " else __sg * 3 * __r end").alias("ball_x"),
        F.expr("case __k when 0 then 410 - 2 * __q when 1 then 2 * __q - 150 else 2 * __q end")
        .alias("ball_y"),
        F.expr("case when __held then 1300L else abs((37 * frame + 53 * __m) % (3000 + 600 *"
               " (__m % 6)) - (1500 + 300 * (__m % 6))) end").alias("ball_z"),
        F.expr("case when __held then 0L when owned_team = -1 then -1L else"
               " 1 + ((frame + __m) div 7) % 10 end").alias("owned_player"))
    df = df.select("*", *[F.expr(f"if(owned_team = {t}, owned_player, -1L)").alias(f"__o{t}")
                          for t in (0, 1)])
    # A goal opens every third leg at alternating ends, so the score counts the multiples of
    # the double leg cycle passed since the first frame.
    return df.select(
        *keep, "ball_x", "ball_y", "ball_z", "owned_team", "owned_player",
        F.expr("case when __ph < 14 and __k = 0 then 4L when __ph < 14 and __k = 1 then 3L"
               " else 0L end").alias("game_mode"),
        F.expr("(__t + 692) div 1038 - (37 * __m + 692) div 1038").alias("score_l"),
        F.expr("(__t + 173) div 1038 - (37 * __m + 173) div 1038").alias("score_r"),
        _side(0).alias("left"), _side(1).alias("right"))


def trace(spark, sf) -> DataFrame:
    return track(frames(spark, sf))


def players(tr: DataFrame) -> DataFrame:
    """Long form: match_id, frame, team, slot, x, y."""
    def tagged(side, team):
        return F.transform(F.col(side), lambda p, i: F.struct(
            F.lit(team).cast("bigint").alias("team"), i.cast("bigint").alias("slot"),
            p["x"].alias("x"), p["y"].alias("y")))
    return (tr.select("match_id", "frame",
                      F.explode(F.concat(tagged("left", 0), tagged("right", 1))).alias("p"))
            .select("match_id", "frame", "p.*"))


def named(df: DataFrame) -> DataFrame:
    """Add shape and seed, and the readable match name, to a table keyed by match_id."""
    from matchlens.config import SHAPES
    shape = F.element_at(F.array(*[F.lit(s) for s in SHAPES]),
                         (F.col("match_id") % len(SHAPES) + 1).cast("int"))
    return (df.withColumn("shape", shape)
            .withColumn("seed", F.expr(f"300 + match_id div {len(SHAPES)}"))
            .withColumn("match", F.concat("shape", F.lit("_s"),
                                          F.lpad(F.col("seed").cast("string"), 3, "0"))))


def inshot(spark, sf) -> DataFrame:
    """match_id, frame, body array<bigint>(22), shadow array<bigint>(22): pixels per slot."""
    return frames(spark, sf).select("match_id", "frame", *inshot_columns())


def inshot_columns() -> list[Column]:
    return [
        F.expr("transform(sequence(0L, 21L), i -> greatest(0L, abs((3 * frame + 29 * match_id"
               " + 71 * i) % 300 - 150) - 15 * (match_id % 6)))").alias("body"),
        F.expr("transform(sequence(0L, 21L), i -> (match_id + i) % 7)").alias("shadow")]


def ballpix(spark, sf) -> DataFrame:
    """match_id, frame, px, py over all matches; one frame in eleven has no measurement, which is
    what the unmatched-window reports look for."""
    return (frames(spark, sf).where("(frame + match_id) % 11 <> 0").select(
        "match_id", "frame", F.expr("(389 * match_id + 17 * frame + 211) % 1280").alias("px"),
        F.expr("(157 * match_id + 7 * frame + 97) % 480").alias("py")))


def absent(spark, sf) -> DataFrame:
    """match_id, lo, hi: the stretch of every match where the ball was not measured."""
    return lengths(spark, sf).select("match_id", F.expr("(41 * match_id) % 500").alias("lo"),
                                     F.expr("(41 * match_id) % 500 + 30").alias("hi"))


def truth(spark, sf) -> DataFrame:
    return lengths(spark, sf).select(
        F.col("match_id").alias("clip"), F.expr("(389 * match_id + 211) % 1280").alias("px"),
        F.expr("(157 * match_id + 97) % 480").alias("py"))


def answers(spark, sf) -> DataFrame:
    """event_id, model, clip, raw: one stored free-text answer per event."""
    ev = table(spark, sf, "events").select(
        F.col("event_id").cast("bigint").alias("event_id"), F.col("event_type").alias("model"))
    total = lengths(spark, sf).agg(F.count(F.lit(1))).scalar()
    letter = F.expr("char(65 + (7 * event_id) % 8)")
    col = F.expr("cast((11 * event_id) % 18 + 1 as string)")
    kind = F.col("event_id") % 6
    raw = (F.when(kind == 0, F.concat(F.lit("Reasoning: run forward.\nBall position: "), letter,
                                      col))
           .when(kind == 1, F.concat(F.lit("Ball position: "), letter, F.lit(", "), col))
           .when(kind == 2, F.concat(F.lit("Ball position: row "), letter, F.lit(" column "),
                                     col))
           .when(kind == 3, F.concat(F.lit("ball position: "),
                                     (F.col("event_id") % 9).cast("string"), F.lit(", "), col))
           .when(kind == 4, F.concat(F.lit("I think it is near "), letter, col,
                                     F.lit(" or B2")))
           .otherwise(F.lit("ERROR: timeout")))
    return ev.select("event_id", "model", (F.col("event_id") % total).alias("clip"),
                     raw.alias("raw"))


def rollouts(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("level"), F.col("o_orderkey").cast("bigint").alias("seed"),
        F.expr("case when o_custkey % 5 = 0 then 1L else 0L end").alias("left"),
        F.expr("case when o_custkey % 7 = 0 then 1L else 0L end").alias("right"),
        (F.col("o_orderstatus") != "P").alias("natural_end"))


PIXEL_W, PIXEL_H = 64, 24


def pixels(spark, sf) -> DataFrame:
    """clip, y, x and the colour of both passes: one small frame pair per match.

    Stored wide (both passes of a pixel in one row), which is how a frame pair is written.
    """
    base = lengths(spark, sf).select(
        F.col("match_id").alias("clip"), F.expr("(389 * match_id + 211) % 1280 div 20").alias("bx"),
        F.expr("(157 * match_id + 97) % 480 div 20").alias("by"))
    # a task for few pairs each: a few bytes unfold to 1536 pixels, as in frames
    base = base.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "clip")
    grid = base.select("*", F.explode(F.expr(f"sequence(0L, {PIXEL_H - 1}L)")).alias("y")).select(
        "*", F.explode(F.expr(f"sequence(0L, {PIXEL_W - 1}L)")).alias("x")).hint("merge")    # as frames
    grid = grid.select("clip", "y", "x", F.expr("20 + (7 * x + 13 * y + 3 * clip) % 30")
                       .alias("gr"), F.expr("abs(x - bx) <= 1 and abs(y - by) <= 1").alias("on"))
    return grid.select(
        "clip", "y", "x",
        F.expr("case when on then 230L else gr end").alias("vis_r"),
        F.expr("case when on then 228L else gr + 40 end").alias("vis_g"),
        F.expr("case when on then 226L else gr - 5 end").alias("vis_b"),
        F.col("gr").alias("inv_r"), F.expr("gr + 40").alias("inv_g"),
        F.expr("gr - 5").alias("inv_b"))
