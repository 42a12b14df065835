"""Window gates beyond the basic ones: movement bands, watchability, exact-count scoring, slides."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchlens import config as C
from matchlens.functions import geometry as G
from matchlens.operators import chunks, report as R

KEY = ["match_id", "start", "end"]


def tumbling(trace: DataFrame, size: int, *, unit: float = 1.0) -> DataFrame:
    """Non-overlapping complete windows: path, largest step, largest |x|, goals inside."""
    w = chunks.along()
    u = F.lit(float(unit))
    body = chunks.core(chunks.reach(trace.select(
        "match_id", "frame", "ball_x", "ball_y", "score_l", "score_r"), 1, 0).select(
        "*", G.step_from(w).alias("step"),
        ((F.col("score_l") != F.lag("score_l").over(w))
         | (F.col("score_r") != F.lag("score_r").over(w))).alias("goal")))
    inner = F.col("frame") % size != 0
    agg = body.groupBy("match_id", F.expr(f"frame div {size}").alias("k")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.when(inner, F.col("step"))) / u, 6).alias("path"),
        (F.max(F.when(inner, F.col("step"))) / u).alias("max_step"),
        (F.max(F.abs("ball_x")) / u).alias("max_x"),
        F.count(F.when(F.col("goal"), 1)).alias("goals"))
    return agg.where(F.col("n") == size).select(
        "match_id", (F.col("k") * size).alias("start"), ((F.col("k") + 1) * size).alias("end"),
        "path", "max_step", "max_x", "goals")


def movement_band(windows: DataFrame, lo: float = 0.33, hi: float = 0.95, cap: int = 3
                  ) -> DataFrame:
    """Goal-free windows with a moderate path; the first ``cap`` of each match."""
    ok = windows.where((F.col("goals") == 0) & F.col("path").between(lo, hi))
    w = Window.partitionBy("match_id").orderBy("start")
    return ok.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap).drop("k")


def clean_drill(windows: DataFrame, lo: float = 0.12, hi: float = 4.0) -> DataFrame:
    return windows.where((F.col("max_step") < C.TELEPORT) & (F.col("max_x") <= 1.0)
                         & (F.col("path") > lo) & (F.col("path") < hi))


def watchable(windows: DataFrame, changes: int = 3, travel: float = 0.50, ymax: float = 0.38
              ) -> DataFrame:
    return windows.where((F.col("changes") >= changes) & (F.col("travel") >= travel)
                         & (F.col("ymax") <= ymax))


def in_own_third(windows: DataFrame, trace: DataFrame, *, unit: float = 1.0,
                 min_x: float = 0.50) -> DataFrame:
    """Windows whose ball never leaves one end of the pitch."""
    rows = R.clip_frames(windows, trace.select("match_id", "frame", "ball_x"))
    agg = rows.groupBy(*KEY).agg((F.min(F.abs("ball_x")) / F.lit(float(unit))).alias("min_x"),
                                 F.min(F.signum("ball_x")).alias("s0"),
                                 F.max(F.signum("ball_x")).alias("s1"))
    ok = agg.where((F.col("min_x") >= min_x) & (F.col("s0") == F.col("s1"))).select(*KEY, "min_x")
    return windows.join(ok, KEY)


def funnel(tested: DataFrame, gates: list[tuple[str, str]]) -> DataFrame:
    """Survivors after each gate in order: one row per gate, one pass over the windows."""
    still = F.lit(True)
    sums = [F.count(F.lit(1)).alias("g0")]
    for i, (_, column) in enumerate(gates, 1):
        still = still & F.col(column)
        sums.append(F.count(F.when(still, 1)).alias(f"g{i}"))
    names = ["windows", *[n for n, _ in gates]]
    return tested.agg(*sums).select(F.explode(F.array(*[F.struct(
        F.lit(i).cast("bigint").alias("step"), F.lit(n).alias("gate"),
        F.col(f"g{i}").alias("left")) for i, n in enumerate(names)])).alias("r")).select("r.*")


def min_near_for(want: Column) -> Column:
    """How many players must surround the ball, given how many are shown."""
    return F.when(want <= 6, 2).otherwise(3)


def exact_count(windows: DataFrame, trace: DataFrame, inshot: DataFrame, wants: list[int], *,
                unit: float = 1.0, radius: float = 0.13, min_travel: float = 0.10,
                threshold: int = 25) -> DataFrame:
    """Score continuous windows that end with exactly a wanted number of people in shot.

    The ball must be among people at both ends and must get somewhere; close players and a
    long path raise the score, a scattered picture lowers it.
    """
    u = float(unit)
    ends = windows.select("match_id", F.explode(F.array("start", F.col("end") - 1))
                          .alias("frame")).distinct()
    players = G.everyone()
    dist = [f"sqrt(cast(get(d2, {i}) as double))" for i in range(len(players))]
    seen = [f"(mask & {1 << i}L) <> 0" for i in range(len(players))]
    total = " + ".join(["0.0D", *(f"if({s}, {d}, 0.0D)" for s, d in zip(seen, dist))])
    # the joins move a distance for each player and one bit for each slot, no positions
    apart = F.expr(f"array({', '.join(G.squared_sql(p) for p in players)})")
    mask = F.expr(" + ".join(f"if(get(body, {i}) >= {threshold}, {1 << i}L, 0L)" for i in range(len(players))))
    at = (trace.select("match_id", "frame", "ball_x", "ball_y", apart.alias("d2"), G.near_count(radius, unit).alias("near"))
          .join(ends, ["match_id", "frame"])
          .join(inshot.select("match_id", "frame", mask.alias("mask")), ["match_id", "frame"])
          .select("match_id", "frame", "ball_x", "ball_y", "near", G.count_of(seen).alias("people"),
                  F.expr(total).alias("dist_sum")).hint("merge"))
    first = at.select("match_id", F.col("frame").alias("start"), F.col("near").alias("near_first"),
                      F.col("ball_x").alias("x0"), F.col("ball_y").alias("y0"))
    last = at.where(F.col("people").isin(*wants)).select(
        "match_id", (F.col("frame") + 1).alias("end"), F.col("near").alias("near_last"),
        F.col("ball_x").alias("x1"), F.col("ball_y").alias("y1"), F.col("people").alias("want"),
        F.round(F.when(F.col("people") > 0, F.col("dist_sum") / F.col("people") / u)
                .otherwise(9.9), 6).alias("spread"))
    j = windows.join(last, ["match_id", "end"]).join(first, ["match_id", "start"])
    need = min_near_for(F.col("want"))
    travel = G.planar(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / u
    j = j.withColumn("travel", travel).where(
        (F.col("near_first") >= need) & (F.col("near_last") >= need)
        & (F.col("travel") >= min_travel))
    return j.select(*KEY, "want", "near_first", "near_last", "travel", "path", "spread", F.round(
        F.col("near_last") * 3 + F.col("near_first") * 2 + F.col("path") * 6
        - F.col("spread") * 8, 6).alias("score"))


def longest_slide(windows: DataFrame, trace: DataFrame, *, unit: float = 1.0, limit: int = 50,
                  min_x: float = 0.50) -> DataFrame:
    """How far each legal window may slide later before a gate breaks.

    Sliding only ever adds frames at the end, so the answer is the distance to the first frame
    after the window that breaks a gate, or to the end of the trace.
    """
    w = chunks.along()
    cols = trace.select("match_id", "frame", "ball_x", "ball_y", "game_mode")
    body = chunks.reach(cols, 1, limit)
    mode = F.col("game_mode")
    bad = ((G.step_from(w) >= C.TELEPORT * unit) | G.in_goal(unit)
           | (F.abs("ball_x") < min_x * unit)
           | (F.signum("ball_x") != F.signum(F.lag("ball_x").over(w)))
           | (mode.between(1, 6) & (mode != F.lag("game_mode").over(w))))
    body = body.withColumn("bad", F.coalesce(bad, F.lit(False)))
    ahead = w.rowsBetween(0, limit - 1)
    body = chunks.core(body.select(
        "match_id", "frame", chunks.CHUNK,
        F.min(F.when(F.col("bad"), F.col("frame"))).over(ahead).alias("stop"),
        F.max("frame").over(ahead).alias("last")))
    nxt = body.select("match_id", F.col("frame").alias("end"), F.least(
        F.lit(limit), F.coalesce("stop", F.col("last") + 1) - F.col("frame")).alias("room"))
    return windows.join(nxt, ["match_id", "end"], "left").withColumn(
        "max_slide", F.coalesce("room", F.lit(0)).cast("bigint")).drop("room")


def best_slide(windows: DataFrame, counts: DataFrame, ball: DataFrame, *, extra: int = 50,
               clip: int = C.CLIP_FRAMES) -> DataFrame:
    """Offset whose emptiest frame is fullest, earliest first; ball needed at both ends.

    ``counts`` has people per frame, ``ball`` a has_ball flag per frame.
    """
    w = chunks.along()
    both = counts.select("match_id", "frame", "people").join(ball, ["match_id", "frame"]).hint("merge")
    body = chunks.reach(both, 0, clip - 1)
    span = w.rowsBetween(0, clip - 1)
    body = chunks.core(body.select(
        "match_id", "frame", chunks.CHUNK, F.min("people").over(span).alias("worst"),
        F.count("frame").over(span).alias("n"),
        (F.col("has_ball") & F.last("has_ball").over(span)).alias("ends_ok")))
    legal = body.where((F.col("n") == clip) & F.col("ends_ok")).select("match_id", "frame",
                                                                      "worst")
    tries = windows.select(*KEY, F.explode(F.expr(f"sequence(0L, {extra}L)")).alias("offset"))
    hit = tries.withColumn("frame", F.col("start") + F.col("offset")).join(
        legal, ["match_id", "frame"])
    best = hit.groupBy(*KEY).agg(F.max(F.struct("worst", (-F.col("offset")).alias("o")))
                                 .alias("b"))
    return windows.select(*KEY).join(best, KEY, "left").select(
        *KEY, (-F.col("b.o")).alias("offset"), F.col("b.worst").alias("worst"))


def ballless_ends(clips: DataFrame, ball: DataFrame, *, mark: int = C.MARK_FRAMES,
                  min_px: int = 3) -> DataFrame:
    """Absent stretches at the two ends of each clip, as absolute frames.

    The opening counts when the ball shows up only after the marked frames (or never); the
    ending when the last frame has no ball. ``ball`` has ball_px per frame.
    """
    rows = clips.select(*KEY, F.explode(F.sequence("start", F.col("end") - 1)).alias("frame"))
    j = rows.join(ball.select("match_id", "frame", "ball_px"), ["match_id", "frame"])
    agg = j.groupBy(*KEY).agg(
        F.min(F.when(F.col("ball_px") >= min_px, F.col("frame"))).alias("first"),
        F.max_by("ball_px", "frame").alias("end_px"))
    late = F.col("first").isNull() | (F.col("first") - F.col("start") >= mark)
    opening = F.when(late, F.struct(F.lit("opening").alias("why"), F.col("start").alias("lo"), (
        F.coalesce("first", "end") - 1).alias("hi")))
    ending = F.when(F.col("end_px") < min_px, F.struct(
        F.lit("ending").alias("why"), (F.col("end") - 1).alias("lo"),
        (F.col("end") - 1).alias("hi")))
    return agg.select(*KEY, F.explode(F.array_compact(F.array(opening, ending))).alias("s")
                      ).select(*KEY, "s.*")


def ballless_status(clips: DataFrame, ball: DataFrame, plate: DataFrame, *, min_px: int = 3
                    ) -> DataFrame:
    """Per clip: clean, occluded (the plate shows the ball throughout), rejected (with the
    absent stretch) or in need of plate evidence."""
    rows = clips.select(*KEY, F.explode(F.sequence("start", F.col("end") - 1)).alias("frame"))
    j = rows.join(ball.select("match_id", "frame", "ball_px"), ["match_id", "frame"]).join(
        plate.select("match_id", "frame", "plate_px"), ["match_id", "frame"], "left")
    gone = F.col("plate_px") < min_px
    agg = j.groupBy(*KEY).agg(
        F.count(F.when(F.col("ball_px") < min_px, 1)).alias("gaps"),
        F.count("plate_px").alias("evidence"), F.min(F.when(gone, F.col("frame"))).alias("lo"),
        F.max(F.when(gone, F.col("frame"))).alias("hi"))
    status = (F.when(F.col("gaps") == 0, "clean").when(F.col("evidence") == 0, "needs evidence")
              .when(F.col("lo").isNull(), "occluded").otherwise("rejected"))
    out = agg.withColumn("status", status)
    only = F.col("status") == "rejected"
    return out.select(*KEY, "gaps", "status", F.when(only, F.col("lo")).alias("lo"),
                      F.when(only, F.col("hi")).alias("hi"))

