"""Step-wise episode quantities: rewards, counters, end of episode, stacked frames."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from matchlens import config as C
from matchlens.functions import grid
from matchlens.operators import chunks, events


def rewards(trace: DataFrame) -> DataFrame:
    """Change of the score difference per step; its running total is the difference itself."""
    w = chunks.along()
    diff = F.col("score_l") - F.col("score_r")
    body = chunks.reach(trace.select("match_id", "frame", "score_l", "score_r"), 1, 0)
    return chunks.core(body.select(
        "match_id", "frame", chunks.CHUNK,
        (diff - F.coalesce(F.lag(diff).over(w), F.lit(0))).alias("reward"),
        diff.alias("cumulative")))


def waiting(trace: DataFrame) -> DataFrame:
    """match_id, frame, waiting: how long the game has not been in normal play."""
    body = trace.select("match_id", "frame", "game_mode")
    stopped = events.runs(body, F.col("game_mode") != C.NORMAL, [])
    return (body.join(stopped.select("match_id", "frame", "run_start"), ["match_id", "frame"],
                      "left")
            .select("match_id", "frame", F.coalesce(F.col("frame") - F.col("run_start") + 1,
                                                    F.lit(0)).alias("waiting")))


def waiting_spans(trace: DataFrame) -> DataFrame:
    """match_id, since, until, frames of every unbroken stoppage."""
    body = trace.select("match_id", "frame", "game_mode")
    return events.runs(body, F.col("game_mode") != C.NORMAL, []).groupBy(
        "match_id", F.col("run_start").alias("since")).agg(
        F.max("frame").alias("until"), F.count(F.lit(1)).alias("frames"))


def previous_owner(trace: DataFrame) -> DataFrame:
    """Adds ``owner_before``: the last owning team strictly before each frame, -1 if none."""
    w = chunks.along()
    body = chunks.reach(trace, 1, 0).withColumn("__prev", F.lag("owned_team").over(w))
    body = body.where(chunks.is_core())
    out = chunks.carry_last(body, {"owner_before": F.when(F.col("__prev") >= 0,
                                                          F.col("__prev"))})
    return out.withColumn("owner_before", F.coalesce("owner_before", F.lit(-1))).drop(
        "__prev", chunks.CHUNK)


def episode_end(trace: DataFrame, duration: int) -> DataFrame:
    """First frame per match at which each rule would end the episode, and the earliest."""
    w = chunks.along()
    body = trace.select("match_id", "frame", "owned_team", "game_mode", "score_l", "score_r")
    staged = chunks.core(chunks.reach(body, 1, 0).select(
        "*", F.lag("game_mode").over(w).alias("mode_before")))
    rows = previous_owner(staged)
    own, was = F.col("owned_team"), F.col("owner_before")

    def first(test):
        return F.min(F.when(test, F.col("frame")))
    agg = rows.groupBy("match_id").agg(
        first((F.col("score_l") > 0) | (F.col("score_r") > 0)).alias("on_score"),
        first((F.col("game_mode") != C.NORMAL) & (F.col("mode_before") == C.NORMAL))
        .alias("on_out_of_play"),
        first((own != -1) & (was != -1) & (own != was)).alias("on_possession_change"),
        first(F.col("frame") + 1 >= duration).alias("on_duration"))
    return agg.withColumn("ends", F.least("on_score", "on_out_of_play", "on_possession_change",
                                          "on_duration"))


def checkpoint_rewards(trace: DataFrame, *, count: int = 10, each: float = 0.1,
                       unit: float = 1.0) -> DataFrame:
    """Reward plus checkpoints: while the active left player has the ball, every distance
    threshold to the far goal is paid once; a goal pays all that are left.

    Thresholds shrink, so the number collected is the running maximum of how many the current
    distance clears.
    """
    u = F.lit(float(unit))
    dx = F.col("ball_x") / u - 1.0
    dy = F.col("ball_y") / u
    d = F.sqrt(dx * dx + dy * dy)
    cleared = F.lit(0).cast("bigint")
    for i in range(count):
        limit = 0.99 - 0.8 if count == 1 else 0.99 - 0.8 / (count - 1) * i
        cleared = cleared + F.when(d <= limit, 1).otherwise(0)
    w = chunks.along()
    body = chunks.core(chunks.reach(trace.select(
        "match_id", "frame", "ball_x", "ball_y", "owned_team", "owned_player", "active",
        "score_l", "score_r"), 1, 0).select(
        "*", (F.col("score_l") - F.col("score_r") - F.coalesce(
            F.lag(F.col("score_l") - F.col("score_r")).over(w), F.lit(0))).alias("reward")))
    now = F.when(F.col("reward") == 1, F.lit(count).cast("bigint")).when(
        (F.col("owned_team") == 0) & (F.col("owned_player") == F.col("active")), cleared
    ).otherwise(F.lit(0).cast("bigint"))
    run = chunks.running(chunks.reach(body.select("match_id", "frame", "reward",
                                                  now.alias("now"))),
                         {"collected": ("max", F.col("now"))}).drop(chunks.CHUNK)
    again = chunks.reach(run, 1, 0)
    out = again.select("match_id", "frame", "reward", "collected", chunks.CHUNK,
                       (F.col("collected") - F.coalesce(F.lag("collected").over(w), F.lit(0)))
                       .alias("new"))
    return chunks.core(out).select("match_id", "frame", "collected", F.round(
        F.col("reward") + F.col("new") * each, 6).alias("reward"))


def stacked(trace: DataFrame, columns: list[str], k: int = 4) -> DataFrame:
    """The last k values of each column per frame, oldest first; the first value fills up."""
    w = chunks.along()
    body = chunks.reach(trace.select("match_id", "frame", *columns), k - 1, 0)
    out = []
    for c in columns:
        seen = F.collect_list(c).over(w.rowsBetween(-(k - 1), 0))
        out.append(F.concat(F.array_repeat(F.get(seen, F.lit(0)), F.lit(k) - F.size(seen)), seen)
                   .alias(c))
    return chunks.core(body.select("match_id", "frame", chunks.CHUNK, *out))


def prediction_truth(trace: DataFrame, cutoff: int, final: int, unit: float = 1.0) -> DataFrame:
    """Ball at the cutoff and at the end, its end bin, who scored, whether it ended early."""
    u = F.lit(float(unit))
    spot = F.struct((F.col("ball_x") / u).alias("x"), (F.col("ball_y") / u).alias("y"))
    agg = trace.groupBy("match_id").agg(
        F.max_by(spot, F.when(F.col("frame") <= cutoff, F.col("frame"))).alias("c"),
        F.max_by(spot, "frame").alias("e"), F.max_by("score_l", "frame").alias("sl"),
        F.max_by("score_r", "frame").alias("sr"), F.max("frame").alias("end_frame"))
    col, row = grid.pitch_bin(F.col("e.x"), F.col("e.y"))
    return agg.select(
        "match_id", F.col("c.x").alias("cutoff_x"), F.col("c.y").alias("cutoff_y"),
        F.col("e.x").alias("end_x"), F.col("e.y").alias("end_y"), col.alias("end_col"),
        row.alias("end_row"), (F.col("sl") > 0).alias("left_scored"),
        (F.col("sr") > 0).alias("right_scored"), "end_frame",
        (F.col("end_frame") < final).alias("ended_early"))


def decimate(trace: DataFrame, step: int) -> DataFrame:
    return trace.where(F.col("frame") % step == 0)


def upsample(steps: DataFrame, factor: int, tail: int = 10, idle: str = "idle") -> DataFrame:
    """Repeat each step ``factor`` times; repeats and ``tail`` extra last steps idle.

    ``steps`` has match_id, frame, action and n (frames of the match); the new position follows
    from frame and repeat alone.
    """
    last = F.col("frame") == F.col("n") - 1
    copies = F.when(last, F.lit(factor + tail)).otherwise(F.lit(factor))
    out = steps.withColumn("__k", F.explode(F.sequence(F.lit(0), copies - 1)))
    return out.select(
        *[c for c in steps.columns if c not in ("frame", "action")],
        F.col("frame").alias("source_frame"),
        (F.col("frame") * factor + F.col("__k")).cast("bigint").alias("frame"),
        F.when(F.col("__k") == 0, F.col("action")).otherwise(F.lit(idle)).alias("action"))

