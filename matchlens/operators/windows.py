"""Fixed-length windows over a trace: features, gates, placement, thinning."""
from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchlens import config as C
from matchlens.functions import geometry as G
from matchlens.operators import chunks

def flags(unit: float, keys: list[str] | None = None) -> list[Column]:
    """Per-frame ingredients of every window test, along the time chunk or along ``keys``."""
    w = Window.partitionBy(*keys).orderBy("frame") if keys else chunks.along()
    mode, before = F.col("game_mode"), F.lag("game_mode").over(w)
    return [G.step_from(w).alias("step"),
            G.in_goal(unit).alias("goal_touch"),
            (mode.between(1, 6) & (mode != F.coalesce(before, mode))).alias("award")]


WATCH = ["score_l", "score_r"]


def _watch_flags(keys: list[str]) -> list[Column]:
    """Does the holder change on this (held) frame? Null on loose frames."""
    w = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    held = F.when(F.col("owned_team") >= 0, F.col("owned_team"))
    before = F.last(held, ignorenulls=True).over(w)
    return [F.when(held.isNotNull(), F.coalesce(before != held, F.lit(False)).cast("int"))
            .alias("switch")]


def _watch_panes() -> list[Column]:
    score = F.struct(*WATCH)
    return [F.min("ball_x").alias("x_lo"), F.max("ball_x").alias("x_hi"),
            F.max(F.abs("ball_y")).alias("y_hi"), F.sum("switch").alias("switches"),
            F.min_by("switch", F.when(F.col("switch").isNotNull(), F.col("frame")))
            .alias("first_switch"),
            F.min_by(score, "frame").alias("score0"), F.max_by(score, "frame").alias("score1")]


def _watch_over(whole) -> list[Column]:
    # the first held frame of a window has no holder before it inside the window
    return [(F.max("x_hi").over(whole) - F.min("x_lo").over(whole)).alias("x_range"),
            F.max("y_hi").over(whole).alias("y_hi"),
            (F.coalesce(F.sum("switches").over(whole), F.lit(0)) - F.coalesce(
                F.first("first_switch", ignorenulls=True).over(whole), F.lit(0)))
            .alias("changes"),
            (F.col("score0") == F.last("score1").over(whole)).alias("same_score")]


def _to_panes(rows: DataFrame, keys: list[str], offset: Column, pane: int, near: bool,
              watch: bool = False) -> DataFrame:
    """Reduce frames to blocks of ``pane`` frames, counted from ``offset`` zero.

    Steps and awards belong to the later of two frames, so a block keeps them twice: with and
    without its opening frame, for blocks inside a window and blocks that open one.
    """
    rows = rows.withColumn("pane", F.floor(offset / pane).cast("bigint")).withColumn(
        "opens", offset % pane == 0)
    return rows.groupBy(*keys, "pane").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.col("owned_team") == -1).cast("bigint")).alias("loose"),
        F.max("ball_z").alias("apex"),
        F.sum("step").alias("steps"), F.max("step").alias("top"),
        F.sum(F.when(~F.col("opens"), F.col("step"))).alias("steps_in"),
        F.max(F.when(~F.col("opens"), F.col("step"))).alias("top_in"),
        F.max("goal_touch").alias("goal_touch"),
        F.max("award").alias("award"),
        F.max(F.when(~F.col("opens"), F.col("award"))).alias("award_in"),
        *([F.collect_list("near_m").alias("near")] if near else []),
        *(_watch_panes() if watch else []))


def _over_panes(panes: DataFrame, keys: list[str], per: int, near: bool,
                watch: bool = False) -> DataFrame:
    """Features of the window that opens with each pane and spans ``per`` of them."""
    w = Window.partitionBy(*keys).orderBy("pane")
    whole, tail = w.rowsBetween(0, per - 1), w.rowsBetween(1, per - 1)

    def over_tail(agg: Column, default) -> Column:
        return F.coalesce(agg.over(tail), F.lit(default)) if per > 1 else F.lit(default)
    return panes.select(
        *keys, "pane", F.sum("n").over(whole).alias("frames"),
        F.sum("n").over(w.rowsBetween(0, per)).alias("frames_next"),
        F.sum("loose").over(whole).alias("loose_n"),
        F.max("apex").over(whole).alias("apex"),
        (F.coalesce("steps_in", F.lit(0.0)) + over_tail(F.sum("steps"), 0.0)).alias("path"),
        F.greatest(F.coalesce("top_in", F.lit(0.0)), over_tail(F.max("top"), 0.0))
        .alias("max_step"),
        F.max("goal_touch").over(whole).alias("goal_touch"),
        (F.coalesce("award_in", F.lit(False)) | over_tail(F.max("award"), False))
        .alias("award_inside"),
        *([F.collect_list("near").over(whole).alias("near")] if near else []),
        *(_watch_over(whole) if watch else []))


def _features(clip: int, unit: float, near: bool) -> list[Column]:
    u = F.lit(float(unit))
    return [(F.col("loose_n").cast("double") / F.col("frames").cast("double")).alias("loose"),
            (F.col("apex") / u).alias("apex"), F.round(F.col("path") / u, 6).alias("path"),
            (F.col("max_step") / u).alias("max_step"), F.col("goal_touch"),
            F.col("award_inside"),
            *([F.round(middle(F.flatten("near"), clip), 6).alias("dnear")] if near else [])]


NEEDED = ["match_id", "frame", "ball_x", "ball_y", "ball_z", "owned_team", "game_mode"]


def _measured(trace: DataFrame, after: int, unit: float, near: bool, watch: bool = False
              ) -> DataFrame:
    cols = [*NEEDED, *(WATCH if watch else [])]
    body = trace.select(*cols, *([G.nearest_metres(unit).alias("near_m")] if near else []))
    return chunks.reach(body, 1, after).select(
        *cols, chunks.CHUNK, *(["near_m"] if near else []), *flags(unit),
        *(_watch_flags(["match_id", chunks.CHUNK]) if watch else []))


def sliding(trace: DataFrame, *, clip: int = C.CLIP_FRAMES, stride: int = C.STRIDE,
            first: int = C.SKIP_START, last_start: bool = False, unit: float = 1.0,
            near: bool = True, watch: bool = False, missing: int = 0) -> DataFrame:
    """Every window of ``clip`` frames starting at first, first + stride, ...

    ``missing`` also keeps the windows that the end of the trace cuts short by up to so many frames; they
    have no nearest distance (``near`` must be off), and ``frames`` tells how many they have.

    Frames are first reduced to panes (the largest block all windows are made of), then
    clip / pane panes are combined per window: one shuffle, and no frame is touched once per
    window it belongs to. ``last_start`` keeps the window that ends with the match.
    Coherence inputs: loose share, apex, median nearest distance in metres, path. ``watch`` adds
    changes of possession, x range (travel), largest |y| (ymax) and whether the score stayed.
    """
    if missing and near:
        raise ValueError("windows cut short have no median distance")
    pane = gcd(gcd(stride, clip), first)
    keys = ["match_id", chunks.CHUNK]
    panes = _to_panes(_measured(trace, clip, unit, near, watch), keys, F.col("frame"), pane,
                      near, watch)
    out = _over_panes(panes, keys, clip // pane, near, watch).withColumn(
        "start", F.col("pane") * pane)
    whole = F.col("frames") >= clip - missing
    if not last_start and not missing:
        whole = whole & (F.col("frames_next") > clip)
    out = chunks.core(out.where(whole & (F.col("start") >= first) &
                                ((F.col("start") - first) % stride == 0)), "start")
    u = F.lit(float(unit))
    seen = [F.col("changes").cast("bigint").alias("changes"),
            (F.col("x_range") / u).alias("travel"), (F.col("y_hi") / u).alias("ymax"),
            F.col("same_score")] if watch else []
    return out.select("match_id", "start", (F.col("start") + clip).alias("end"),
                      *_features(clip, unit, near), *(["frames"] if missing else []), *seen)


def slides(trace: DataFrame, events: DataFrame, lengths: DataFrame, *,
           clip: int = C.CLIP_FRAMES, stride: int = C.STRIDE, unit: float = 1.0) -> DataFrame:
    """Windows around anchors, every legal slide of each, with their features.

    ``events`` holds kind, match_id, anchor, min_start. A window opens at the anchor less the
    lead of its kind (never before min_start) and slides later up to the anchor, within the
    trace. The frames of all slides of an anchor are read once, reduced to panes, and the
    slides are combined from those; a group is one anchor, so its size is fixed.
    """
    lead, slide = F.lit(0), F.lit(0)
    for k in C.SLIDE:
        lead = F.when(F.col("kind") == k, C.LEAD[k]).otherwise(lead)
        slide = F.when(F.col("kind") == k, C.SLIDE[k]).otherwise(slide)
    spots = events.select("kind", "match_id", "anchor", F.greatest(
        F.col("anchor") - lead, F.col("min_start")).alias("base"), slide.alias("slide"))
    spots = spots.join(lengths, "match_id").withColumn("room", F.least(
        F.col("slide"), F.col("anchor") - F.col("base"), F.col("n") - clip - F.col("base")))
    spots = spots.where((F.col("base") >= 0) & (F.col("room") >= 0)).select(
        "kind", "match_id", "anchor", "base", "room")
    keys = ["kind", "match_id", "anchor", "base", "room"]
    # slides overlap, so a distance is worth measuring once per frame; the join then moves no players
    rows = chunks.covering(trace.select(*NEEDED, G.nearest_metres(unit).alias("near_m")), spots, F.col("base"),
                           F.col("base") + F.col("room") + clip - 1)
    # no context before the first frame: a window never counts the step into its opening frame
    rows = rows.select(*keys, *[c for c in NEEDED if c != "match_id"], "near_m")
    rows = rows.select("*", *flags(unit, keys))
    pane = gcd(stride, clip)
    panes = _to_panes(rows, keys, F.col("frame") - F.col("base"), pane, True)
    out = _over_panes(panes, keys, clip // pane, True).withColumn("slid", F.col("pane") * pane)
    out = out.where((F.col("frames") == clip) & (F.col("slid") % stride == 0)
                    & (F.col("slid") <= F.col("room")))
    start = F.col("base") + F.col("slid")
    return out.select("kind", "match_id", "anchor", start.alias("start"),
                      (start + clip).alias("end"), *_features(clip, unit, True))


def middle(values: Column, n: int) -> Column:
    """Median of an array of n numbers."""
    s = F.sort_array(values)
    if n % 2:
        return F.element_at(s, n // 2 + 1)
    return (F.element_at(s, n // 2) + F.element_at(s, n // 2 + 1)) / 2


def continuous(goal_test: bool = True, frames: str | None = None, clip: int = C.CLIP_FRAMES, missing: int = 0) -> Column:
    """No jump of the ball and, with ``goal_test``, no frame between the posts behind the line.

    ``frames`` names a column with the frames a window has, where a trace may end inside it: up
    to ``missing`` of its last frames may be gone."""
    ok = F.col("max_step") < C.TELEPORT
    if goal_test:
        ok = ok & ~F.col("goal_touch")
    return ok & (F.col(frames) >= clip - missing) if frames else ok


def no_restart() -> Column:
    return ~F.col("award_inside")


def engaged(kind: str | Column) -> Column:
    """The per-class movement and possession bands, as one predicate."""
    def band(k):
        loose, apex, dnear, lo, hi = C.ENGAGEMENT[k]
        return ((F.col("loose") <= loose) & (F.col("apex") <= apex) & (F.col("dnear") <= dnear)
                & F.col("path").between(lo, hi))
    if isinstance(kind, str):
        return band(kind)
    test = F.lit(False)
    for k in C.ENGAGEMENT:
        test = F.when(kind == k, band(k)).otherwise(test)
    return test


def coherence() -> Column:
    """Lower is calmer. Rounded once so that every ranking sees the same ties."""
    return F.round(F.col("loose") * 2.0 + F.col("apex") / 3.2 + F.col("dnear") / 4.0, 4)


def spread(candidates: DataFrame, *, keep: int = C.MAX_WINDOWS, apart: int = C.MIN_SEPARATION
           ) -> DataFrame:
    """Greedy thinning per match: best first, at least ``apart`` frames between kept starts.

    Of windows with the same start only the best can be kept. A kept window rules out the
    2 * apart - 2 starts around its own, so the first ``keep`` survivors are always among the
    best keep * (2 * apart - 1) starts: the fold sees a bounded list however long the match is
    and wherever its windows start.
    """
    fields = [c for c in candidates.columns if c != "match_id"]
    ties = [f for f in fields if f not in ("coh", "start")]
    one = candidates.withColumn("__r", F.row_number().over(
        Window.partitionBy("match_id", "start").orderBy("coh", *ties))).where("__r = 1")
    best = Window.partitionBy("match_id").orderBy("coh", "start")
    short = one.withColumn("__r", F.row_number().over(best)).where(
        F.col("__r") <= keep * (2 * apart - 1)).drop("__r")
    lists = short.groupBy("match_id").agg(F.array_sort(F.collect_list(
        F.struct("coh", "start", *[f for f in fields if f not in ("coh", "start")])))
        .alias("w"))
    kept = F.aggregate(
        "w", F.filter("w", lambda x: F.lit(False)),
        lambda acc, x: F.when(
            (F.size(acc) < keep) & ~F.exists(acc, lambda k: F.abs(k["start"] - x["start"]) < apart),
            F.concat(acc, F.array(x))).otherwise(acc))
    return (lists.select("match_id", F.posexplode(kept).alias("rank", "x"))
            .select("match_id", (F.col("rank") + 1).cast("bigint").alias("rank"), "x.*"))
