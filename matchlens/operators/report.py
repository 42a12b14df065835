"""Tables about finished clips: classification, passes, scene graphs, batch statistics."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchlens import config as C, session
from matchlens.functions import geometry as G, grid
from matchlens.operators import chunks, measure as M

CLIP = ["match_id", "start", "end"]


def clip_frames(clips: DataFrame, trace: DataFrame, before: int = 0,
                derived: list[Column] | None = None) -> DataFrame:
    """Clip rows joined to their trace frames.

    ``derived`` columns may use windows over ``along()``, which also sees the ``before`` frames
    ahead of the clip. A window group is one clip, so only frames of clips are ever sorted.
    """
    rows = chunks.covering(trace, clips.select(*CLIP),
                           F.greatest(F.lit(0), F.col("start") - before), F.col("end") - 1)
    if derived:
        rows = rows.select("*", *derived)
    return rows.where(F.col("frame") >= F.col("start")) if before else rows


def along():
    return Window.partitionBy(*CLIP).orderBy("frame")


def metre_step() -> Column:
    w = along()
    dx = (F.col("ball_x") - F.lag("ball_x").over(w)) * F.lit(C.METRES_X)
    dy = (F.col("ball_y") - F.lag("ball_y").over(w)) * F.lit(C.METRES_Y)
    return F.sqrt(dx * dx + dy * dy)


def previous_holder() -> Column:
    """The team of the last held frame before this one inside the clip."""
    held = F.when(F.col("owned_team") >= 0, F.col("owned_team"))
    return F.last(held, ignorenulls=True).over(
        along().rowsBetween(Window.unboundedPreceding, -1))


def possession_changes() -> Column:
    """Changes between consecutive held frames (needs ``prev_held``)."""
    change = (F.col("owned_team") >= 0) & (F.col("prev_held") != F.col("owned_team"))
    return F.count(F.when(change, 1))


def at_first(c) -> Column:
    return F.min_by(c, "frame")


def at_last(c) -> Column:
    return F.max_by(c, "frame")


def classify(clips: DataFrame, trace: DataFrame, inshot: DataFrame, *, unit: float = 1.0,
             body_px: int = 20) -> DataFrame:
    """One row of measured facts per clip. ``clips`` needs kind and anchor."""
    u = F.lit(float(unit))
    clips = session.written(clips)
    # counted before the join, which then moves no players
    near = trace.select("match_id", "frame", "ball_x", "ball_y", "ball_z", "owned_team",
                        G.near_count(C.NEAR_RADIUS, unit).alias("near_n"))
    rows = clip_frames(session.few(clips.select(*CLIP)), near, 0, [
        metre_step().alias("step_m"), previous_holder().alias("prev_held")])
    shown = inshot.select("match_id", "frame", M.count_over("body", body_px).alias("people"))
    rows = rows.join(shown, ["match_id", "frame"], "left")
    point = F.struct("ball_x", "ball_y")
    agg = rows.groupBy(*CLIP).agg(
        F.round(F.sum(F.when(F.col("frame") > F.col("start"), F.col("step_m"))) / u, 6)
        .alias("travel_m"),
        at_first(point).alias("p0"), at_last(point).alias("p1"),
        (F.max("ball_z") / u).alias("apex_m"),
        F.avg((F.col("ball_z") > 0.5 * unit).cast("double")).alias("airborne_frac"),
        at_first("owned_team").alias("poss_start"), at_last("owned_team").alias("poss_end"),
        possession_changes().alias("turnovers"),
        at_first("near_n").alias("near_start"), at_last("near_n").alias("near_end"),
        at_first("people").alias("count_start"), F.min("people").alias("count_min"),
        F.max("people").alias("count_max"), at_last("people").alias("count_end"))
    dx = (F.col("p1.ball_x") - F.col("p0.ball_x")) * F.lit(C.METRES_X) / u
    dy = (F.col("p1.ball_y") - F.col("p0.ball_y")) * F.lit(C.METRES_Y) / u
    out = clips.join(agg, CLIP)
    open_play = F.col("kind") == "open"
    return out.select(
        *clips.columns, "travel_m", F.round(F.sqrt(dx * dx + dy * dy), 6).alias("net_m"),
        grid.direction(dx).alias("direction"), "apex_m", "airborne_frac",
        grid.third(F.col("p0.ball_x") / u).alias("zone_start"),
        grid.third(F.col("p1.ball_x") / u).alias("zone_end"),
        grid.names(F.col("poss_start"), C.TEAM_COLOURS).alias("possession_start"),
        grid.names(F.col("poss_end"), C.TEAM_COLOURS).alias("possession_end"),
        F.col("turnovers").alias("possession_changes"), "near_start", "near_end",
        grid.crowding(F.col("near_end")).alias("crowding_end"),
        "count_start", "count_min", "count_max", "count_end",
        (F.col("count_end") - F.col("count_start")).alias("count_delta"),
        grid.names(F.col("kind"), C.KIND_NAMES).alias("situation"),
        F.when(~open_play, (F.col("anchor") - F.col("start")) / float(C.FPS))
        .alias("restart_s"),
        F.when(~open_play, (F.col("start") <= F.col("anchor"))
               & (F.col("anchor") < F.col("end"))).alias("restart_visible"))


# --- fixed values: the wording of the sentence, here and in `sentence` ---
RESTART_PHRASES = {"corner": "Corner kick taken", "gk_throw": "Keeper releases the ball",
                   "kickoff": "Kick-off restart"}


def parts_of(c: Column, parts: int) -> Column:
    """A value from 0 to 2047 in whole tenths, hundredths, .., rounded as it is stored: a double is a
    binary fraction, so that only true halves are ties, which go to the even digit (2.25 is 22
    tenths, 2.45 is 25)."""
    one = F.lit(1 << 52).cast("decimal(20,0)")
    some = (c * F.lit(float(1 << 52))).cast("bigint").cast("decimal(20,0)") * parts
    rest = some % one
    k = ((some - rest) / one).cast("bigint")
    return k + F.when((rest * 2 > one) | ((rest * 2 == one) & (k % 2 == 1)), 1).otherwise(0)


def in_tenths(c: Column) -> Column:
    k = parts_of(c, 10)
    return F.concat(F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"))


def sentence() -> Column:
    """One sentence per classified clip, from its measured fields."""
    def whole(c):
        return F.format_string("%.0f", F.bround(c, 0))

    def tenth(c):
        return in_tenths(c)
    t = F.col("restart_s")
    what = grid.names(F.col("kind"), RESTART_PHRASES)
    opening = (F.when(F.col("kind") == "open", F.concat(F.lit("Open play in the "), "zone_start"))
               .when(F.col("restart_visible"),
                     F.concat(what, F.lit(" "), tenth(t), F.lit(" s into the clip")))
               .otherwise(F.concat(what, F.lit(" "), tenth(F.abs(t)), F.lit(
                   " s before the clip opens, so the clip shows what followed"))))
    n, k = F.col("near_end"), F.col("possession_changes")
    d = F.col("count_delta")
    signed = F.when(d == 0, "unchanged").when(d > 0, F.concat(F.lit("+"), d.cast("string"))
                                              ).otherwise(d.cast("string"))
    parts = [
        opening,
        F.concat(F.lit("net movement "), whole(F.col("net_m")), F.lit(" m "), "direction",
                 F.lit(" over "), whole(F.col("travel_m")),
                 F.lit(" m of travel, finishing in the "), "zone_end"),
        F.when(F.col("apex_m") >= 2.0, F.concat(F.lit("lofted to "), tenth(F.col("apex_m")),
                                                F.lit(" m"))),
        F.concat(n.cast("string"), F.when(n == 1, " player").otherwise(" players"),
                 F.lit(" around it at the end ("), "crowding_end", F.lit(")")),
        F.when(F.col("possession_end") == "loose", "nobody in possession at the end").otherwise(
            F.concat("possession_end", F.lit(" in possession at the end"))),
        F.when(k > 0, F.concat(k.cast("string"), F.when(k > 1, " changes").otherwise(" change"),
                               F.lit(" of possession"))),
        F.when(F.col("count_start").isNotNull(), F.concat(
            F.col("count_start").cast("string"), F.lit(" people in shot at the start and "),
            F.col("count_end").cast("string"), F.lit(" at the end ("), signed, F.lit(")")))]
    return F.concat(F.concat_ws("; ", *parts), F.lit("."))


def passes(clips: DataFrame, trace: DataFrame, *, visible: int = C.VISIBLE_FRAMES,
           min_hold: int = 2) -> DataFrame:
    """Passes and turnovers after the visible part: consecutive different holders, each holding
    for at least ``min_hold`` frames; loose frames break a run. Groups are single clips."""
    clips = session.written(clips)
    rows = clip_frames(session.few(clips.select(*CLIP)), trace.select("match_id", "frame", "owned_team", "owned_player"))
    rows = rows.where(F.col("frame") >= F.col("start") + visible - 1)
    w = Window.partitionBy(*CLIP).orderBy("frame")
    fresh = ((F.col("owned_team") != F.lag("owned_team", 1, -2).over(w))
             | (F.col("owned_player") != F.lag("owned_player", 1, -2).over(w)))
    rows = rows.withColumn("run", F.sum(fresh.cast("int")).over(w)).where("owned_team >= 0")
    runs = rows.groupBy(*CLIP, "run", "owned_team", "owned_player").agg(
        F.count(F.lit(1)).alias("len")).where(F.col("len") >= min_hold)
    by_run = Window.partitionBy(*CLIP).orderBy("run")
    last = F.lag(F.struct("owned_team", "owned_player")).over(by_run)
    pairs = runs.withColumn("before", last).where(
        (F.col("before.owned_team") != F.col("owned_team"))
        | (F.col("before.owned_player") != F.col("owned_player")))
    same = F.col("before.owned_team") == F.col("owned_team")
    counts = pairs.groupBy(*CLIP).agg(F.count(F.when(same, 1)).alias("passes"),
                                      F.count(F.when(~same, 1)).alias("turnovers"),
                                      F.count(F.lit(1)).alias("changes"))
    return clips.select(*CLIP).join(counts, CLIP, "left").fillna(
        0, ["passes", "turnovers", "changes"])


def velocities(trace: DataFrame, fps: int = C.FPS, unit: float = 1.0) -> DataFrame:
    """Ball velocity per second by backward difference; zero on the first frame."""
    w = chunks.along()
    body = chunks.reach(trace.select("match_id", "frame", "ball_x", "ball_y", "ball_z"), 1, 0)
    return chunks.core(body.select("match_id", "frame", chunks.CHUNK, *[
        (F.coalesce(F.col(f"ball_{a}") - F.lag(f"ball_{a}").over(w), F.lit(0)) * fps
         / F.lit(float(unit))).alias(f"v{a}") for a in "xyz"]))


def scene_frames(clips: DataFrame, trace: DataFrame, *, unit: float = 1.0, fps: int = C.FPS,
                 hide_after: int | None = None, digits: int = 4) -> DataFrame:
    """clip key, frame in clip, and a struct with everything known about that frame."""
    w = along()
    u = F.lit(float(unit))
    rows = clip_frames(clips, trace, 1, [
        F.coalesce(F.lag(c).over(w), F.col(c)).alias(f"was_{c}")
        for c in ("ball_x", "ball_y", "ball_z", "left", "right")])

    def r(c):
        return F.round(c, digits)
    roles = F.array(*[F.lit(x) for x in C.SLOT_ROLES])

    def side(name, team):
        return F.transform(F.arrays_zip(F.col(name).alias("now"), F.col(f"was_{name}")
                                        .alias("was")), lambda p, i: F.struct(
            F.concat(F.lit(team), i.cast("string")).alias("id"), F.lit(team).alias("team"),
            i.alias("slot"), F.get(roles, i).alias("role"), (i == 0).alias("is_goalkeeper"),
            r(p["now"]["x"] / u).alias("x"), r(p["now"]["y"] / u).alias("y"),
            r((p["now"]["x"] - p["was"]["x"]) * fps / u).alias("vx"),
            r((p["now"]["y"] - p["was"]["y"]) * fps / u).alias("vy")))
    j = F.col("frame") - F.col("start")
    ball = F.struct(*[r(F.col(f"ball_{a}") / u).alias(a) for a in "xyz"], *[
        r((F.col(f"ball_{a}") - F.col(f"was_ball_{a}")) * fps / u).alias(f"v{a}") for a in "xyz"])
    if hide_after is not None:
        ball = F.when(j < hide_after, ball)
    near = G.nearest_player()
    owner = F.when(F.col("owned_team") == 0, "A").when(F.col("owned_team") == 1, "B")
    frame = F.struct(
        j.alias("frame"), F.col("frame").alias("engine_frame"),
        F.round(j / float(fps), 3).alias("t"),
        grid.names(F.col("game_mode"), C.MODE_NAMES).alias("game_mode"),
        F.array("score_l", "score_r").alias("score"),
        F.struct(owner.alias("team"), F.when(F.col("owned_player") >= 0, F.concat(
            owner, F.col("owned_player").cast("string"))).alias("player"),
            (F.col("owned_team") < 0).alias("loose")).alias("possession"),
        F.concat(side("left", "A"), side("right", "B")).alias("players"),
        F.struct(F.concat(F.when(near["team"] == 0, "A").otherwise("B"),
                          near["slot"].cast("string")).alias("id"),
                 r(F.sqrt(near["d2"].cast("double")) / u).alias("distance"))
        .alias("nearest_player_to_ball"),
        F.struct(*[F.array(r(M.team_mean(t, "x", unit)), r(M.team_mean(t, "y", unit))).alias(n)
                   for t, n in ((0, "A"), (1, "B"))])
        .alias("team_centroid"),
        ball.alias("ball"))
    return rows.select(*CLIP, frame.alias("f"))


def scene_documents(clips: DataFrame, trace: DataFrame, **how) -> DataFrame:
    """One nested document per clip: header columns of ``clips`` and its ordered frames.

    A document holds one clip, so the collected list has a fixed length.
    """
    clips = session.written(clips)
    frames = scene_frames(session.few(clips.select(*CLIP)), trace, **how).groupBy(*CLIP).agg(
        F.array_sort(F.collect_list("f")).alias("frames"))
    head = [c for c in clips.columns if c not in CLIP]
    return clips.join(frames, CLIP).select(
        *CLIP, F.struct(*head).alias("ground_truth") if head else F.lit(None).alias("ground_truth"),
        F.size("frames").alias("n_frames"), "frames")


# --- batch statistics ---
def grid_heatmap(cells: DataFrame, cols: int = C.GRID_COLS, rows: int = C.GRID_ROWS) -> DataFrame:
    """Dense cell counts plus row and column totals against a uniform share.

    ``cells`` has zero-based row and col. The dense grid has cols x rows + cols + rows entries.
    """
    sets = cells.groupingSets([[F.col("row"), F.col("col")], [F.col("row")], [F.col("col")]],
                              "row", "col").agg(F.count(F.lit(1)).alias("n"),
                                                F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 0, "cell").when(F.col("g") == 1, "row").otherwise("col")
    sets = sets.select(level.alias("level"), "row", "col", "n")
    spark = cells.sparkSession
    dense = (spark.range(rows).select(F.col("id").alias("row"), F.explode(
        F.expr(f"sequence(0L, {cols - 1}L)")).alias("col"))
        .select(F.lit("cell").alias("level"), "row", "col")
        .unionByName(spark.range(rows).select(F.lit("row").alias("level"),
                                              F.col("id").alias("row"),
                                              F.lit(None).cast("bigint").alias("col")))
        .unionByName(spark.range(cols).select(F.lit("col").alias("level"),
                                              F.lit(None).cast("bigint").alias("row"),
                                              F.col("id").alias("col"))))
    a, b = dense.alias("a"), sets.alias("b")
    on = (F.col("a.level") == F.col("b.level")) & F.col("a.row").eqNullSafe(F.col("b.row")) \
        & F.col("a.col").eqNullSafe(F.col("b.col"))
    j = a.join(b, on, "left").select("a.level", "a.row", "a.col",
                                     F.coalesce("b.n", F.lit(0)).alias("n"))
    whole = F.sum(F.when(F.col("level") == "row", F.col("n"))).over(
        Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding,
                                                 Window.unboundedFollowing))
    share = F.when(F.col("level") == "cell", cols * rows).when(F.col("level") == "row", rows
                                                               ).otherwise(cols)
    return j.select("level", "row", "col", "n", (whole / share).alias("expected"))


def spread_stats(cells: DataFrame, by: list[str]) -> DataFrame:
    """n, occupied cells, busiest cell and its share, rows and columns used, pixel spread.

    Reduced per cell first, so the second grouping sees at most one row per grid cell; the
    population deviations come from sums of exact integers.
    """
    per_cell = cells.groupBy(*by, "row", "col").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(k) for k, e in (
            ("sx", F.col("px")), ("sy", F.col("py")), ("sxx", F.col("px") * F.col("px")),
            ("syy", F.col("py") * F.col("py")))])

    def sd(s, ss):
        n = F.sum("n")
        mean = F.sum(s) / n
        return F.round(F.sqrt(F.sum(ss) / n - mean * mean), 6)
    return per_cell.groupBy(*by).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("occupied"), F.max("n").alias("top"),
        (F.max("n") * 100.0 / F.sum("n")).alias("top_pct"),
        F.countDistinct("row").alias("rows_used"), F.countDistinct("col").alias("cols_used"),
        sd("sx", "sxx").alias("px_sd"), sd("sy", "syy").alias("py_sd"))


def level_distribution(clips: DataFrame, levels=tuple(C.LEVELS), per_level: int = C.PER_LEVEL
                       ) -> DataFrame:
    """Measured against designed clips per level, with missing / over / out of range."""
    got = clips.groupBy(F.col("level")).agg(F.count(F.lit(1)).alias("measured"))
    want = clips.sparkSession.range(min(levels), max(levels) + 1).select(
        F.col("id").alias("level"), F.lit(per_level).cast("bigint").alias("designed"))
    j = want.join(got, "level", "full_outer").fillna(0, ["measured", "designed"])
    return j.withColumn("note", F.when((F.col("designed") == 0), "out of range").when(
        F.col("measured") == 0, "missing").when(F.col("measured") > F.col("designed"), "over")
        .otherwise(""))


def final_frame_verdict(slots: DataFrame, published: DataFrame, *, min_px: int = 20,
                        sliver: int = 120) -> DataFrame:
    """Per clip: bodies measured on the last frame against the published number.

    ``slots`` has clip, pix and body_pix per player; ``published`` clip and players.
    """
    seen = F.col("pix") >= min_px
    body = seen & (F.col("body_pix") >= min_px)
    agg = slots.groupBy("clip").agg(
        F.count(F.when(body, 1)).alias("measured"),
        F.count(F.when(body & (F.col("body_pix") < sliver), 1)).alias("slivers"),
        F.count(F.when(seen & ~(F.col("body_pix") >= min_px), 1)).alias("shadow_only"),
        F.coalesce(F.min(F.when(body, F.col("body_pix"))), F.lit(0)).alias("smallest"))
    j = published.join(agg, "clip")
    clear = F.col("measured") - F.col("slivers")
    return j.select("clip", "players", "measured", clear.alias("clear"), "slivers",
                    "shadow_only", "smallest",
                    F.when(F.col("players") == F.col("measured"), "matches")
                    .when(F.col("players") == clear, "borderline").otherwise("wrong")
                    .alias("verdict"))


def reproducibility(runs: DataFrame) -> DataFrame:
    """Totals over per-clip replay records, with the number of failures."""
    bad = ~(F.col("determinism_ok") & F.col("render_invariant_ok"))
    return runs.agg(
        F.count(F.lit(1)).alias("clips"),
        F.sum(F.col("determinism_ok").cast("bigint")).alias("deterministic"),
        F.sum(F.col("render_invariant_ok").cast("bigint")).alias("render_invariant"),
        F.countDistinct("play_sha").alias("distinct_plays"),
        (F.sum("steps") * 3).alias("steps_replayed"),
        F.count(F.when(bad, 1)).alias("failures"))


# --- rollouts ---
def rollout_rates(rollouts: DataFrame, by: str = "level") -> DataFrame:
    return rollouts.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("left") > 0).cast("double")).alias("left_rate"),
        F.avg((F.col("right") > 0).cast("double")).alias("right_rate"),
        F.avg(F.col("natural_end").cast("double")).alias("natural_end_rate"))


def best_intervention(rates: DataFrame, item: str, tag: str, rate: str) -> DataFrame:
    """Highest rate per item; equal rates go to the tag that sorts last."""
    return rates.groupBy(item).agg(F.max(F.struct(F.col(rate), F.col(tag))).alias("b")).select(
        item, F.col(f"b.{tag}").alias("best"), F.col(f"b.{rate}").alias("rate"))


def responsibility(rates: DataFrame, base: DataFrame, item: str, tag: str, rate: str
                   ) -> DataFrame:
    """Base rate less the ablated rate, ranked; defenders with the opposite sign."""
    j = rates.join(base.select(item, F.col(rate).alias("base_rate")), item)
    d = F.col("base_rate") - F.col(rate)
    delta = F.when(F.col(tag).startswith("right"), -d).otherwise(d)
    j = j.select(item, tag, delta.alias("delta"))
    w = Window.partitionBy(item).orderBy(F.col("delta").desc(), tag)
    return j.withColumn("rank", F.row_number().over(w).cast("bigint"))
