"""Situation detectors: trace -> one row per detected moment.

Every detector returns match_id, anchor, award, min_start plus its own columns. All of them
look a bounded number of frames around, except keeper holds, whose runs have no length limit.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchlens import config as C
from matchlens.functions import geometry as G
from matchlens.operators import chunks


def awards(trace: DataFrame, modes=C.SET_PIECES) -> DataFrame:
    """match_id, frame, mode, opens: every switch into one of ``modes``.

    A match that opens in a mode counts as an award on frame 0 (``opens``); drop those rows
    for the stricter rule that needs a real transition.
    """
    w = chunks.along()
    body = chunks.reach(trace.select("match_id", "frame", "game_mode"), 1, 0)
    body = body.withColumn("before", F.lag("game_mode").over(w))
    hit = F.col("game_mode").isin(*modes) & (
        (F.col("frame") == 0) | (F.col("before") != F.col("game_mode")))
    return chunks.core(body.where(hit)).select(
        "match_id", "frame", F.col("game_mode").alias("mode"),
        (F.col("frame") == 0).alias("opens"))


def next_frame_where(test: Column) -> Column:
    """First frame at or after each row where ``test`` holds, within the chunk.

    Read backwards as a running value: a forward frame of fixed length would be scanned again
    for every row.
    """
    back = (Window.partitionBy("match_id", chunks.CHUNK).orderBy(F.col("frame").desc())
            .rowsBetween(Window.unboundedPreceding, 0))
    return F.last(F.when(test, F.col("frame")), ignorenulls=True).over(back)


def deliveries(trace: DataFrame, mode: int = C.CORNER, *, quiet: float = 0.0048,
               search: int = 225, unit: float = 1.0) -> DataFrame:
    """First frame after an award whose following ball step exceeds ``quiet``."""
    w = chunks.along()
    body = chunks.reach(trace.select("match_id", "frame", "game_mode", "ball_x", "ball_y"),
                        1, search)
    body = body.select("match_id", "frame", "game_mode", chunks.CHUNK,
                       F.lag("game_mode").over(w).alias("before"),
                       G.step_to_next(w).alias("next_step"),
                       F.lead("frame", 2).over(w).isNotNull().alias("long_enough"))
    body = body.withColumn("anchor", next_frame_where(F.col("next_step") > quiet * unit))
    hit = (F.col("game_mode") == mode) & (
        (F.col("frame") == 0) | (F.col("before") != F.col("game_mode")))
    return chunks.core(body.where(
        hit & F.col("long_enough") & (F.col("anchor") <= F.col("frame") + search - 2))).select(
        "match_id", "anchor", F.col("frame").alias("award"),
        (F.col("frame") + 1).alias("min_start"))


def kickoffs(trace: DataFrame, *, spot: float = 0.03, own_half: int = 10,
             quiet: float = 0.0015, search: int = 225, unit: float = 1.0) -> DataFrame:
    """Restarts from the centre mark, recognised by behaviour: opening or changed score, ball on
    the mark, both sides at home, then the first movement."""
    w = chunks.along()
    # counting 22 players is only worth it on the few frames with the ball on the mark
    on_mark = G.planar(F.col("ball_x"), F.col("ball_y")) <= spot * unit
    left, right = G.home_counts()
    home = F.when(on_mark, (left >= own_half) & (right >= own_half)).otherwise(False)
    body = chunks.reach(trace.select("match_id", "frame", "ball_x", "ball_y", "score_l",
                                     "score_r", home.alias("home")), 1, search)
    body = body.select(
        "match_id", "frame", chunks.CHUNK, "home",
        ((F.col("frame") == 0) | (F.lag("score_l").over(w) != F.col("score_l"))
         | (F.lag("score_r").over(w) != F.col("score_r"))).alias("restart"),
        G.step_to_next(w).alias("next_step"),
        F.lead("frame", 2).over(w).isNotNull().alias("long_enough"))
    body = body.withColumn("anchor", next_frame_where(F.col("next_step") > quiet * unit))
    hit = (F.col("restart") & F.col("long_enough")
           & (F.col("anchor") <= F.col("frame") + search - 2)
           & F.col("home"))
    return chunks.core(body.where(hit)).select(
        "match_id", "anchor", F.col("frame").alias("award"),
        F.col("frame").alias("min_start"), (F.col("frame") == 0).alias("opening"))


def runs(framed: DataFrame, held: Column, same: list[str]) -> DataFrame:
    """Add ``run_start`` to the rows where ``held``: the first frame of the unbroken run with
    equal ``same`` columns. Runs may be arbitrarily long; their start is carried over chunks."""
    w = chunks.along()
    body = chunks.reach(framed.withColumn("__held", F.coalesce(held, F.lit(False))), 1, 0)
    fresh = F.lag("__held").over(w).isNull() | ~F.lag("__held").over(w)
    for c in same:
        fresh = fresh | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    body = body.withColumn("__fresh", fresh)
    body = body.where(chunks.is_core() & F.col("__held"))
    return chunks.carry_last(body, {"run_start": F.when(F.col("__fresh"), F.col("frame"))}
                             ).drop("__fresh", "__held", chunks.CHUNK)


def keeper_holds(trace: DataFrame, *, hold_min: int = 10, z_lo: float = 1.15,
                 z_hi: float = 1.75, travel_min: float = 0.20, ahead: int = 75,
                 from_release: int = 0, in_hand: bool = True, unit: float = 1.0) -> DataFrame:
    """Keeper holds that end in a long release.

    A hold counts when at least ``hold_min`` of its frames have the ball at hand height (any
    height if not ``in_hand``) and the trace goes on after it. Travel is measured from the
    release to ``ahead`` frames after it (plus ``from_release``), clamped to the trace end.
    """
    w = chunks.along()
    far = ahead + from_release
    body = chunks.reach(trace.select("match_id", "frame", "ball_x", "ball_y", "ball_z",
                                     "owned_team", "owned_player"), 0, far)
    end = Window.partitionBy("match_id", chunks.CHUNK).orderBy("frame").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)

    def later(c):
        # no frame that far ahead means the trace ends inside this chunk's reach
        return F.coalesce(F.lead(c, far).over(w), F.last(c).over(end))
    body = chunks.core(body.select(
        "match_id", "frame", chunks.CHUNK, "ball_z", "owned_team", "owned_player",
        F.lead("frame").over(w).isNotNull().alias("goes_on"),
        F.round(G.planar(later("ball_x") - F.col("ball_x"), later("ball_y") - F.col("ball_y"))
                / F.lit(float(unit)), 6).alias("travel"),
        F.max("ball_z").over(w.rowsBetween(0, max(far - 1, 0))).alias("apex")))
    held = (F.col("owned_player") == 0) & F.col("owned_team").isin(0, 1)
    tagged = runs(body, held, ["owned_team"])
    hand = F.col("ball_z").between(z_lo * unit, z_hi * unit)
    per_run = tagged.groupBy("match_id", "run_start").agg(
        F.max("frame").alias("release"), F.max("owned_team").alias("team"),
        F.count(F.lit(1)).alias("hold_frames"),
        F.sum(F.when(hand, 1).otherwise(0)).alias("hand_frames"),
        *[F.max_by(c, "frame").alias(c) for c in ("goes_on", "travel", "apex")])
    enough = F.col("hand_frames") if in_hand else F.col("hold_frames")
    return per_run.where((enough >= hold_min) & F.col("goes_on")
                         & (F.col("travel") >= travel_min)).select(
        "match_id", F.col("release").alias("anchor"), F.col("release").alias("award"),
        F.lit(0).cast("bigint").alias("min_start"), F.col("run_start").alias("caught"),
        "team", "hold_frames", "hand_frames", "travel",
        (F.col("apex") / F.lit(float(unit))).alias("apex"))


def headers(trace: DataFrame, *, z_min: float = 1.35, z_max: float | None = 2.9,
            turn_max: float = 0.35, near: float = 0.035, gap: int = 5, look_back: int = 45,
            min_step: float = 0.02, contested_min: int = 1, unit: float = 1.0) -> DataFrame:
    """A high ball that turns sharply with a player under it."""
    w = chunks.along()
    tall = F.col("ball_z") >= z_min * unit
    if z_max is not None:
        tall = tall & (F.col("ball_z") <= z_max * unit)
    # 22 players are looked at on frames with a high ball only
    body = trace.select(
        "match_id", "frame", "ball_x", "ball_y", "ball_z",
        F.when(tall, G.nearest_squared()).alias("near2"),
        F.when(tall, G.near_count(C.NEAR_RADIUS, unit)).alias("contested"))
    body = chunks.reach(body, max(gap, look_back), gap)
    x, y = F.col("ball_x"), F.col("ball_y")
    body = body.select(
        "match_id", "frame", chunks.CHUNK, "ball_z", "near2", "contested",
        (x - F.lag(x, gap).over(w)).alias("ix"), (y - F.lag(y, gap).over(w)).alias("iy"),
        (F.lead(x, gap).over(w) - x).alias("ox"), (F.lead(y, gap).over(w) - y).alias("oy"),
        F.max("ball_z").over(w.rowsBetween(-look_back, 0)).alias("apex_in"))
    n_in, n_out = G.planar(F.col("ix"), F.col("iy")), G.planar(F.col("ox"), F.col("oy"))
    cos = (F.col("ix") * F.col("ox") + F.col("iy") * F.col("oy")) / (n_in * n_out)
    out = body.where(tall & (n_in >= min_step * unit) & (n_out >= min_step * unit)
                     & (F.sqrt(F.col("near2").cast("double")) <= near * unit)
                     & (F.col("contested") >= contested_min)).withColumn("turn_cos", cos)
    u = F.lit(float(unit))
    return chunks.core(out.where(F.col("turn_cos") <= turn_max)).select(
        "match_id", F.col("frame").alias("anchor"), F.col("frame").alias("award"),
        F.lit(0).cast("bigint").alias("min_start"), (F.col("ball_z") / u).alias("z"),
        "contested", (F.col("apex_in") / u).alias("apex_in"),
        F.round("turn_cos", 6).alias("turn_cos"),
        (F.col("contested") * 10 + F.col("apex_in") / u).alias("score"))


def _around_hits(body: DataFrame, hit: Column, span: int) -> DataFrame:
    """Keep only frames up to ``span`` after a hit. Events are rare: the costly frames below are
    then only evaluated around them. What follows must count frames by value, not by row."""
    upto = chunks.along().rowsBetween(Window.unboundedPreceding, 0)
    body = body.withColumn("hit", hit)
    since = F.last(F.when(F.col("hit"), F.col("frame")), ignorenulls=True).over(upto)
    return body.withColumn("since", since).where(F.col("frame") - F.col("since") <= span)


def aftermath(trace: DataFrame, mode: int, *, window: int, unit: float,
              drop_from: int, anchor: str = "award", quiet: float = 0.012,
              search: int = 90) -> DataFrame:
    """Per award (or its delivery): what the next ``window`` frames look like.

    Adds apex, the largest |x| and x range, and ``contest``: the most players around the ball on
    the first six frames, from ``drop_from`` on, where it is low and deep in the box.
    """
    w = chunks.along()
    low = (F.col("ball_z") < 1.5 * unit) & (F.abs("ball_x") > 0.82 * unit)
    body = trace.select("match_id", "frame", "game_mode", "ball_x", "ball_y", "ball_z",
                        F.when(low, G.near_count(C.NEAR_RADIUS, unit)).alias("near_n"))
    body = chunks.reach(body, 1, search + window + 1)
    body = body.select("*", G.step_from(w).alias("step"), G.step_to_next(w).alias("next_step"),
                       F.lag("game_mode").over(w).alias("before"))
    hit = (F.col("game_mode") == mode) & (
        (F.col("frame") == 0) | (F.col("before") != F.col("game_mode")))
    body = _around_hits(body, hit, search + window)
    ahead = w.rangeBetween(0, window - 1)
    # the last frame of the trace never counts: segments are cut one frame before it
    inner = F.col("next_step").isNotNull()
    body = body.select(
        "*", F.max(F.when(inner, F.col("ball_z"))).over(ahead).alias("apex"),
        F.max(F.when(inner, F.abs("ball_x"))).over(ahead).alias("deepest"),
        F.max(F.when(inner, F.col("ball_x"))).over(ahead).alias("x_hi"),
        F.min(F.when(inner, F.col("ball_x"))).over(ahead).alias("x_lo"),
        F.max("step").over(w.rangeBetween(2, window - 1)).alias("jump"),
        F.count("frame").over(w.rangeBetween(1, window - 1)).alias("ahead_n"),
        F.collect_list(F.when(low & inner, F.col("near_n"))).over(
            w.rangeBetween(drop_from, window - 1)).alias("drops"))
    body = body.withColumn("contest", F.coalesce(
        F.array_max(F.slice("drops", 1, 6)), F.lit(0)).cast("bigint"))
    hit = F.col("hit")
    fields = ["apex", "deepest", "x_hi", "x_lo", "jump", "ahead_n", "contest", "ball_x",
              "ball_y"]
    if anchor == "delivery":
        here = F.when(F.col("next_step") > quiet * unit,
                      F.struct("frame", *fields))
        body = body.withColumn("at", F.min(here).over(w.rangeBetween(0, search - 2)))
        hit = hit & (F.col("frame") > 0) & F.col("at").isNotNull()
    else:
        body = body.withColumn("at", F.struct("frame", *fields))
    return chunks.core(body.where(hit)).select(
        "match_id", F.col("frame").alias("award"), F.col("at.frame").alias("anchor"),
        *[F.col(f"at.{f}").alias(f) for f in fields])


def corner_quality(trace: DataFrame, *, quiet: float = 0.012, unit: float = 1.0) -> DataFrame:
    """Corners scored by how contested and how high the delivery was."""
    out = aftermath(trace, C.CORNER, window=45, unit=unit, drop_from=5, anchor="delivery",
                    quiet=quiet)
    u = F.lit(float(unit))
    return out.select("match_id", "award", "anchor", (F.col("award") + 1).alias("min_start"),
                      (F.col("apex") / u).alias("apex"), F.col("contest").alias("contested"),
                      (F.col("contest") * 10 + F.col("apex") / u).alias("score"))


def freekick_quality(trace: DataFrame, *, unit: float = 1.0, window: int = 60,
                     scoring: str = "basic") -> DataFrame:
    """Free kicks scored by direction, reach, range (and centrality and contest if "full").

    Kicks followed by a ball jump within ``window`` frames are dropped. ``window`` is also the
    shortest stretch that can be judged, so kicks with fewer than three frames left go too.
    """
    w = chunks.along()
    reachf = max(window, 35) + 1
    body = trace.select("match_id", "frame", "game_mode", "ball_x", "ball_y", "ball_z",
                        G.near_count(C.NEAR_RADIUS, unit).alias("near_n"))
    body = chunks.reach(body, 1, reachf)
    inner = F.lead("frame").over(w).isNotNull()
    body = body.select("*", G.step_from(w).alias("step"), inner.alias("inner"),
                       F.lag("game_mode").over(w).alias("before"))
    hit = (F.col("game_mode") == C.FREEKICK) & (
        (F.col("frame") == 0) | (F.col("before") != F.col("game_mode")))
    body = _around_hits(body, hit, reachf)
    seg = w.rangeBetween(0, 34)

    def within(agg, c):
        return agg(F.when(F.col("inner"), c)).over(seg)
    body = body.select(
        "*", within(F.max, F.col("ball_z")).alias("apex"),
        within(F.max, F.abs("ball_x")).alias("deepest"),
        within(F.max, F.col("ball_x")).alias("x_hi"), within(F.min, F.col("ball_x")).alias("x_lo"),
        F.max("step").over(w.rangeBetween(2, window - 1)).alias("jump"),
        F.count("frame").over(w.rangeBetween(1, window - 1)).alias("ahead_n"),
        F.coalesce(F.max(F.when(F.col("inner"), F.col("near_n"))).over(w.rangeBetween(8, 29)),
                   F.lit(0)).cast("bigint").alias("contest"))
    ok = (F.col("ahead_n") >= 3) & (F.col("jump") < C.TELEPORT * unit) & F.col("inner")
    u = F.lit(float(unit))
    out = chunks.core(body.where(F.col("hit") & ok))
    towards = F.when(F.col("ball_x") >= 0, F.col("x_hi") - F.col("ball_x")).otherwise(
        F.col("ball_x") - F.col("x_lo")) / u
    dist = F.lit(1.0) - F.abs("ball_x") / u
    reach_x = F.col("deepest") / u
    basic = scoring == "basic"
    out = out.select(
        "match_id", F.col("frame").alias("award"), towards.alias("towards"),
        dist.alias("dist_to_goal"), reach_x.alias("reach"), (F.col("apex") / u).alias("apex"),
        ((towards > (0.05 if basic else 0.04)) & (reach_x > (0.85 if basic else 0.88)))
        .alias("attacking"),
        dist.between(*((0.08, 0.32) if basic else (0.06, 0.34))).alias("in_range"),
        (F.abs(F.col("ball_y")) < 0.22 * unit).alias("central"), F.col("contest"))
    pts = F.when(F.col("attacking"), 60 if basic else 80).otherwise(0) + F.when(
        F.col("in_range"), 25 if basic else 30).otherwise(0) + F.col("apex")
    if not basic:
        pts = pts + F.when(F.col("central"), 15).otherwise(0) + F.col("contest") * 5
    return out.withColumn("score", F.round(pts, 6))


def goals(trace: DataFrame, *, lead_in: int = 100, lead_out: int = 25,
          unit: float = 1.0) -> DataFrame:
    """Score changes: the ball one frame earlier, the score before and after, the clip."""
    w = chunks.along()
    body = chunks.reach(trace.select("match_id", "frame", "ball_x", "ball_y", "ball_z",
                                     "score_l", "score_r"), 1, 0)
    cols = ["score_l", "score_r", "ball_x", "ball_y", "ball_z"]
    body = body.select("*", *[F.lag(c).over(w).alias(f"was_{c}") for c in cols])
    hit = (F.col("was_score_l") != F.col("score_l")) | (F.col("was_score_r") != F.col("score_r"))
    u = F.lit(float(unit))
    return chunks.core(body.where(hit)).select(
        "match_id", "frame", F.col("was_score_l").alias("before_l"),
        F.col("was_score_r").alias("before_r"), F.col("score_l").alias("after_l"),
        F.col("score_r").alias("after_r"), *[(F.col(f"was_{c}") / u).alias(c)
                                             for c in ("ball_x", "ball_y", "ball_z")],
        F.greatest(F.lit(0), F.col("frame") - lead_in).alias("clip_start"),
        (F.col("frame") + lead_out).alias("clip_end"))


def after_awards(trace: DataFrame, within: int, *, unit: float = 1.0) -> DataFrame:
    """match_id, frame, mode of each award, with the ball's apex over the next ``within`` frames
    (the last frame of the trace left out) and its travel to the clamped end of them."""
    w = chunks.along()
    body = chunks.reach(trace.select("match_id", "frame", "game_mode", "ball_x", "ball_y",
                                     "ball_z"), 1, within + 1)
    body = body.select("*", F.lag("game_mode").over(w).alias("before"),
                       F.lead("frame").over(w).isNotNull().alias("inner"))
    span = w.rowsBetween(0, within)
    u = F.lit(float(unit))
    body = body.select(
        "*", (F.coalesce(F.max(F.when(F.col("inner"), F.col("ball_z"))).over(
            w.rowsBetween(0, within - 1)), F.lit(0)) / u).alias("apex"),
        (G.planar(F.last("ball_x").over(span) - F.col("ball_x"),
                  F.last("ball_y").over(span) - F.col("ball_y")) / u).alias("travel"))
    hit = F.col("game_mode").isin(*C.SET_PIECES) & (
        (F.col("frame") == 0) | (F.col("before") != F.col("game_mode")))
    return chunks.core(body.where(hit)).select(
        "match_id", "frame", F.col("game_mode").alias("mode"), "apex", "travel")


def followed_by(events: DataFrame, others: DataFrame, within: int,
                bucket: int = 64) -> DataFrame:
    """Per event: how many ``others`` (match_id, frame) fall in (frame, frame + within].

    Events meet the others through time buckets of both, so a match with a huge number of
    events is spread over its buckets.
    """
    probes = events.select("match_id", "frame", F.explode(F.sequence(
        F.expr(f"(frame + 1) div {bucket}"), F.expr(f"(frame + {within}) div {bucket}")))
        .alias("__b"))
    marks = others.select("match_id", F.col("frame").alias("other"),
                          F.expr(f"frame div {bucket}").alias("__b"))
    hits = probes.join(marks, ["match_id", "__b"]).where(
        (F.col("other") > F.col("frame")) & (F.col("other") <= F.col("frame") + within))
    counts = hits.groupBy("match_id", "frame").agg(
        F.count(F.lit(1)).alias("followers"), F.min("other").alias("first_follower"))
    return events.join(counts, ["match_id", "frame"], "left").withColumn(
        "followers", F.coalesce("followers", F.lit(0)))


def sweep_summary(trace: DataFrame) -> DataFrame:
    """Per match: corner and free-kick awards, frames held by a keeper, goals."""
    w = chunks.along()
    body = chunks.core(chunks.reach(trace.select(
        "match_id", "frame", "game_mode", "owned_team", "owned_player", "score_l", "score_r"),
        1, 0).select(
        "*", F.lag("game_mode").over(w).alias("before"),
        (F.col("score_l") + F.col("score_r")
         - F.lag("score_l").over(w) - F.lag("score_r").over(w)).alias("scored")))

    def awarded(mode):
        return F.sum(((F.col("game_mode") == mode) & (F.col("before") != mode)).cast("bigint"))
    return body.groupBy("match_id").agg(
        F.coalesce(awarded(C.CORNER), F.lit(0)).alias("corners"),
        F.coalesce(awarded(C.FREEKICK), F.lit(0)).alias("free_kicks"),
        F.sum(((F.col("owned_player") == 0) & (F.col("owned_team") >= 0)).cast("bigint"))
        .alias("keeper_frames"),
        F.coalesce(F.sum((F.col("scored") > 0).cast("bigint")), F.lit(0)).alias("goals"))


def place(events: DataFrame, lengths: DataFrame, kind: str, *, clip: int = C.CLIP_FRAMES,
          stride: int = C.STRIDE, snap: int = 1) -> DataFrame:
    """Windows around anchors: lead, floor at min_start, slides up to the anchor, bounds.

    ``snap`` moves the first start up to a multiple of it.
    """
    base = F.greatest(F.col("anchor") - C.LEAD[kind], F.col("min_start"))
    if snap > 1:
        base = F.ceil(base / snap) * snap
    staged = events.withColumn("base", base.cast("bigint"))
    room = F.least(F.lit(C.SLIDE[kind]), F.col("anchor") - F.col("base"))
    out = staged.withColumn("start", F.explode(F.sequence(
        F.col("base"), F.col("base") + F.greatest(room, F.lit(0)), F.lit(stride).cast("bigint"))))
    out = out.withColumn("end", F.col("start") + clip)
    return (out.join(lengths, "match_id")
            .where((F.col("start") >= 0) & (F.col("end") <= F.col("n"))
                   & (F.col("start") <= F.col("anchor")))
            .drop("n", "base"))


# kind -> detector; add an entry to detect another situation
DETECTORS = {"corner": deliveries, "kickoff": kickoffs, "gk_throw": keeper_holds,
             "header": headers}

# What the two detectors that wait for a first movement look for, with their defaults.
WAITING = {"corner": dict(mode=C.CORNER, quiet=0.0048, search=225),
           "kickoff": dict(spot=0.03, own_half=10, quiet=0.0015, search=225)}


def _waiting(trace: DataFrame, kinds: list[str], unit: float, options: dict[str, dict]) -> DataFrame:
    """Corners and kick-offs in one pass: one copy of the trace in chunks, read backwards once.

    Both are moments after which the ball's first movement is searched, so they share the chunks
    with the widest look-around, the steps, and the running searches; a frame gives one row for
    each kind that it is a moment of."""
    how = {k: {**WAITING[k], **options.get(k, {})} for k in kinds}
    w = chunks.along()
    cols = ["match_id", "frame", "ball_x", "ball_y"]
    body = trace.select(*cols, *(["game_mode"] if "corner" in how else []), *(
        ["score_l", "score_r", _at_home(how["kickoff"], unit).alias("home")] if "kickoff" in how else []))
    body = chunks.reach(body, 1, max(h["search"] for h in how.values()))
    moment, first = {}, {}
    step = G.step_to_next(w)
    body = body.select("*", step.alias("next_step"), F.lead("frame", 2).over(w).isNotNull().alias("long_enough"), *(
        [F.lag("game_mode").over(w).alias("before")] if "corner" in how else []), *(
        [((F.col("frame") == 0) | (F.lag("score_l").over(w) != F.col("score_l"))
          | (F.lag("score_r").over(w) != F.col("score_r"))).alias("restart")] if "kickoff" in how else []))
    for k, h in how.items():
        body = body.withColumn(f"anchor_{k}", next_frame_where(F.col("next_step") > h["quiet"] * unit))
        moment[k] = ((F.col("game_mode") == h["mode"]) & ((F.col("frame") == 0) | (F.col("before") != F.col("game_mode")))
                     if k == "corner" else F.col("restart") & F.col("home"))
        moment[k] = moment[k] & F.col("long_enough") & (F.col(f"anchor_{k}") <= F.col("frame") + h["search"] - 2)
        first[k] = F.col("frame") + (1 if k == "corner" else 0)
    found = F.filter(F.array(*[F.when(F.coalesce(moment[k], F.lit(False)), F.struct(
        F.lit(k).alias("kind"), F.col(f"anchor_{k}").alias("anchor"), first[k].alias("min_start"))) for k in how]),
        lambda x: x.isNotNull())
    return chunks.core(body.select("match_id", "frame", chunks.CHUNK, F.explode(found).alias("x"))).select(
        "match_id", "x.kind", "x.anchor", F.col("frame").alias("award"), "x.min_start")


def _at_home(how: dict, unit: float) -> Column:
    on_mark = G.planar(F.col("ball_x"), F.col("ball_y")) <= how["spot"] * unit
    left, right = G.home_counts()
    return F.when(on_mark, (left >= how["own_half"]) & (right >= how["own_half"])).otherwise(False)


def detect(trace: DataFrame, kinds: list[str], unit: float = 1.0,
           options: dict[str, dict] | None = None) -> DataFrame:
    """Run registered detectors; one row per anchor with its kind. Those of one form share a pass."""
    options = options or {}
    together = [k for k in kinds if DETECTORS[k] in (deliveries, kickoffs)]
    out = _waiting(trace, together, unit, options) if together else None
    for k in kinds:
        if k not in together:
            found = DETECTORS[k](trace, unit=unit, **options.get(k, {})).select(
                "match_id", F.lit(k).alias("kind"), "anchor", "award", "min_start")
            out = found if out is None else out.unionByName(found)
    return out
