"""Choosing a batch from a pool: thinning, budgets, quotas, joint selection, alternates.

Quotas are small numbers, so every choice needs only a short list of best rows per slot. Each
operator first cuts the pool to such a list with grouped or ranked reductions (which Spark
applies before shuffling), with a stated bound on its length; only that list is folded.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchlens import config as C
from matchlens import session
from matchlens.operators import chunks, matching


def top(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def thin_evenly(df: DataFrame, limit: int, key: str = "match_id", order: str = "frame"
                ) -> DataFrame:
    """At most ``limit`` rows per key, evenly spread: positions floor(i * n / limit)."""
    df = session.cut_lineage(df)
    numbered = chunks.number_rows(df, [order], F.expr(f"{order} div 4096"), "__k", [key])
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    j = numbered.join(sizes, key)
    return j.where(F.expr(
        f"__n <= {limit} or ((((__k * {limit} + __n - 1) div __n) * __n) div {limit} = __k and "
        f"((__k * {limit} + __n - 1) div __n) < {limit})")).drop("__k", "__n")


def scarcest_class(candidates: DataFrame, order: list[str] = C.CLASS_ORDER) -> DataFrame:
    """Spend every match on the scarcest class it can supply."""
    candidates = session.cut_lineage(candidates)  # read twice below
    rank = F.array_position(F.array(*[F.lit(k) for k in order]), F.col("kind"))
    best = candidates.groupBy("match_id").agg(F.min(rank).alias("__r"))
    return candidates.withColumn("__r", rank).join(best, ["match_id", "__r"]).drop("__r")


def scheduled(df: DataFrame, position: str) -> DataFrame:
    """Camera offsets in turn from the two schedules."""
    def turn(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]),
                            (F.col(position) % len(values) + 1).cast("int"))
    return df.withColumn("offset_x", turn(C.OFFSET_X_SCHEDULE)).withColumn(
        "offset_y", turn(C.OFFSET_Y_SCHEDULE))


def probe_plan(candidates: DataFrame, budget: dict[str, int] | None = None,
               max_end: int = C.MAX_END) -> DataFrame:
    """Per class the matches with the calmest window, up to the class budget, in class order.

    Plentiful classes only use windows that end by ``max_end``. The plan has at most the sum of
    the budgets rows, so numbering it is cheap.
    """
    budget = budget or C.PROBE_BUDGET
    ok = candidates.where(F.col("kind").isin(*C.SCARCE) | (F.col("end") <= max_end))
    per_match = ok.groupBy("kind", "match_id").agg(F.min("coh").alias("coh"),
                                                   F.count(F.lit(1)).alias("windows"))
    w = Window.partitionBy("kind").orderBy("coh", "match_id")
    limit = F.lit(0)
    for k, n in budget.items():
        limit = F.when(F.col("kind") == k, n).otherwise(limit)
    ranked = per_match.withColumn("r", F.row_number().over(w)).where(
        F.col("r") <= max(budget.values())).where(F.col("r") <= limit)
    rank = F.array_position(F.array(*[F.lit(k) for k in C.CLASS_ORDER]), F.col("kind"))
    pos = F.row_number().over(Window.orderBy(rank, "r")) - 1
    return scheduled(ranked.withColumn("position", pos.cast("bigint")), "position").select(
        "position", "kind", "match_id", "coh", "windows", "offset_x", "offset_y")


def incremental_plan(matches: DataFrame, old: DataFrame, budget: dict[str, int]) -> DataFrame:
    """Scarcest class first in (shape, seed) order, every match once, old entries kept.

    ``matches``: match_id, shape, seed and one boolean can_<kind> per class.
    """
    plan = None
    for kind in C.CLASS_ORDER:
        free = matches.where(F.col(f"can_{kind}"))
        if plan is not None:
            free = free.join(plan.select("match_id"), "match_id", "left_anti")
        w = Window.orderBy("shape", "seed", "match_id")
        # a plain limit keeps only the budget per task before the rows are numbered
        chosen = free.orderBy("shape", "seed", "match_id").limit(budget.get(kind, 0)).select(
            "match_id", F.lit(kind).alias("kind"),
            F.row_number().over(w).cast("bigint").alias("rank"))
        plan = chosen if plan is None else plan.unionByName(chosen)
        plan = session.cut_lineage(plan)
    kept = old.select("match_id", F.lit(True).alias("was"))
    return plan.join(kept, "match_id", "full_outer").select(
        "match_id", F.coalesce("kind", F.lit("open")).alias("kind"), "rank",
        F.coalesce("was", F.lit(False)).alias("kept"))


def quota_pick(candidates: DataFrame, want: int, per_shape: int = 8) -> DataFrame:
    """Score order, one per match, ``per_shape`` per shape, ``want`` per kind.

    A match has one shape, so taking the best per match, then the best per shape, then the best
    per kind gives what a sequential pass gives.
    """
    order = [F.col("score").desc(), "match_id", "start"]
    one = top(candidates, ["kind", "match_id"], order, 1)
    few = top(one, ["kind", "shape"], order, per_shape)
    return top(few, ["kind"], order, want)


def by_scarce_level(candidates: DataFrame, levels: list[int], per_level: int) -> DataFrame:
    """Levels in turn (highest first), best score first, every match used once over all levels.

    Earlier levels use at most per_level * (levels - 1) matches, so per level the best
    per_level * levels matches are enough: the folded list holds at most per_level * levels^2.
    """
    order = [F.col("score").desc(), "match_id", "start"]
    pool = candidates.where(F.col("level").isin(*levels))
    short = top(top(pool, ["level", "match_id"], order, 1), ["level"], order,
                per_level * len(levels))
    row = F.struct((-F.col("level")).alias("a"), (-F.col("score")).alias("b"), "match_id",
                   "start", "end", "level", "score")
    lists = short.groupBy().agg(F.array_sort(F.collect_list(row)).alias("w"))
    picked = F.aggregate(
        "w", F.filter("w", lambda x: F.lit(False)),
        lambda acc, x: F.when(
            (F.size(F.filter(acc, lambda p: p["level"] == x["level"])) < per_level)
            & ~F.exists(acc, lambda p: p["match_id"] == x["match_id"]),
            F.concat(acc, F.array(x))).otherwise(acc))
    return lists.select(F.explode(picked).alias("p")).select(
        "p.level", "p.match_id", "p.start", "p.end", "p.score")


def contrasting_pair(candidates: DataFrame) -> DataFrame:
    """The calmest window, and the calmest with another shape, match and starting team.

    Only the best window per (shape, team) can be either of them: two rows per shape.
    """
    best = top(candidates, ["shape", "startown"], ["coh", "match_id", "start"], 1)
    every = Window.orderBy("coh", "match_id", "start")
    first = F.first(F.struct("shape", "startown")).over(
        every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    k = F.row_number().over(every)
    marked = best.select("*", k.alias("k"), first.alias("f"))
    second = (F.col("shape") != F.col("f.shape")) & (F.col("startown") != F.col("f.startown"))
    return marked.where((F.col("k") == 1) | second).withColumn(
        "pick", F.row_number().over(Window.orderBy("k")).cast("bigint")).where(
        "pick <= 2").drop("k", "f")


def drop_close(events: DataFrame, apart: int = 40, key: str = "match_id") -> DataFrame:
    """Best score first, drop events of the same trace closer than ``apart`` frames to a kept one.

    Of events on one frame only the best can be kept (then by the other columns, in order). The
    rest is decided in time chunks: inside a chunk the sequential pass is done as far as nothing
    outside can change it; an event is left open if a better one within reach is open, or lies in
    a neighbouring chunk. Open events meet again in chunks twice as long, so that a chain of any
    length takes as many rounds as its logarithm in chunks, and each round only holds the events
    that the last one left open.
    """
    ties = [F.col(c) for c in events.columns if c not in (key, "frame", "score")]
    on_frame = Window.partitionBy(key, "frame").orderBy(F.col("score").desc(), *ties)
    all_ = session.cut_lineage(events.withColumn("__k", F.row_number().over(on_frame)).where("__k = 1").drop("__k"))
    open_, kept = all_.select(key, "frame", "score"), None
    size = max(chunks.chunk_frames(), 4 * apart)
    none = F.filter(F.array(F.lit(0).cast("bigint")), lambda x: F.lit(False))
    while True:
        item = F.struct((-F.col("score")).alias("s"), F.col("frame").cast("bigint").alias("frame"),
                        chunks.is_core(size=size).alias("core"))
        lists = chunks.reach(open_, apart, apart, size=size).groupBy(key, chunks.CHUNK).agg(
            F.array_sort(F.collect_list(item)).alias("w"))

        def near(frames, x):
            return F.exists(frames, lambda f: F.abs(f - x["frame"]) < apart)

        def step(acc, x):
            sure = x["core"] & ~near(acc["open"], x)
            return F.when(near(acc["kept"], x), acc).otherwise(F.struct(
                F.when(sure, F.concat(acc["kept"], F.array(x["frame"]))).otherwise(acc["kept"]).alias("kept"),
                F.when(sure, acc["open"]).otherwise(F.concat(acc["open"], F.array(x["frame"]))).alias("open")))
        decided = lists.select(key, F.aggregate("w", F.struct(none.alias("kept"), none.alias("open")), step).alias("d"), "w")
        inside = F.transform(F.filter("w", lambda x: x["core"]), lambda x: x["frame"])
        marked = decided.select(key, F.explode(F.concat(
            F.transform("d.kept", lambda f: F.struct(f.alias("frame"), F.lit(True).alias("kept"))),
            F.transform(F.array_intersect("d.open", inside), lambda f: F.struct(f.alias("frame"), F.lit(False).alias("kept"))))).alias("x"))
        state = session.cut_lineage(marked.select(key, "x.frame", "x.kept"))
        won = state.where("kept").select(key, "frame")
        kept = won if kept is None else kept.unionByName(won)
        left = state.where("not kept").select(key, "frame")
        if left.isEmpty():
            return all_.join(kept, [key, "frame"], "left_semi")
        # what a kept event of a neighbouring chunk rules out
        around = chunks.along(key).rangeBetween(-(apart - 1), apart - 1)
        both = won.withColumn("won", F.lit(1)).unionByName(left.withColumn("won", F.lit(0)))
        free = chunks.reach(both, apart, apart).withColumn("hit", F.max("won").over(around)).where(
            chunks.is_core() & (F.col("won") == 0) & (F.col("hit") == 0))
        open_ = session.cut_lineage(open_.join(free.select(key, "frame"), [key, "frame"], "left_semi"))
        size *= 2


def score_changes(trace: DataFrame) -> DataFrame:
    """match_id, frame, event: steps that score or concede exactly one goal."""
    w = chunks.along()
    diff = F.col("score_l") - F.col("score_r")
    body = chunks.reach(trace.select("match_id", "frame", "score_l", "score_r"), 1, 0)
    body = body.select("match_id", "frame", chunks.CHUNK, (
        diff - F.coalesce(F.lag(diff).over(w), F.lit(0))).alias("reward"))
    return chunks.core(body.where(F.abs("reward") == 1)).select(
        "match_id", "frame", F.when(F.col("reward") == 1, "score").otherwise("lost_score")
        .alias("event"))


def spaced_triggers(events: DataFrame, every: int, after: int = 1, max_count: int | None = None) -> DataFrame:
    """Take an event unless one of its kind was taken less than ``every`` frames before, or is still
    pending (``after`` frames); at most ``max_count`` of a kind, if given. As ``online.captures``.

    An event with no predecessor that close is always taken, so each stretch that starts with
    one is decided on its own: the folded list is one such stretch, not a whole match.
    """
    key, every = ["match_id", "event"], max(every, after)
    body = chunks.reach(events, every, 0)
    close = chunks.along(key).rangeBetween(-(every - 1), -1)
    body = body.withColumn("__near", F.count("frame").over(close))
    starts = chunks.carry_last(body.where(chunks.is_core()), {"stretch": F.when(
        F.col("__near") == 0, F.col("frame"))}, key=key)
    lists = starts.groupBy(*key, "stretch").agg(F.array_sort(F.collect_list("frame")).alias("f"))
    taken = F.aggregate("f", F.filter("f", lambda x: F.lit(False)), lambda acc, x: F.when(
        (F.size(acc) == 0) | (x - F.try_element_at(acc, F.lit(-1)) >= every),
        F.concat(acc, F.array(x))).otherwise(acc))
    out = lists.select(*key, F.explode(taken).alias("frame"))
    return out if max_count is None else top(out, key, ["frame"], max_count)


# --- joint selection ---
def _row_col(cell: Column) -> tuple[Column, Column]:
    return F.substring(cell, 1, 1), F.substring(cell, 2, 2).cast("bigint")


def spread_cost(picks: DataFrame, weight: float = C.SPREAD_WEIGHT) -> DataFrame:
    """Mean coherence plus weighted unevenness over the occupied cells, rows and columns."""
    r, c = _row_col(F.col("cell"))
    picks = session.cut_lineage(picks.select("cell", "coh"))
    rows = picks.select("cell", "coh", r.alias("row"), c.alias("col"))
    base = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("coh").alias("s"),
                    F.countDistinct("cell").alias("cells"))

    def squares(col, k):
        # sum over used values of (v - n/k)^2 = sum v^2 - 2 n/k sum v + used (n/k)^2
        g = rows.groupBy(col).agg(F.count(F.lit(1)).alias("v"))
        return g.agg(F.sum(F.col("v") * F.col("v")).alias(f"{col}_sq"),
                     F.count(F.lit(1)).alias(f"{col}_used"))
    j = (base.withColumn("one", F.lit(1))
         .join(squares("row", 6).withColumn("one", F.lit(1)), "one")
         .join(squares("col", 16).withColumn("one", F.lit(1)), "one"))

    def var(col, k):
        share = F.col("n") / k
        return F.col(f"{col}_sq") - 2 * share * F.col("n") + F.col(f"{col}_used") * share * share
    cost = ((F.col("n") - F.col("cells")) * C.SPREAD_CELL + var("row", float(C.GRID_ROWS)) * C.SPREAD_ROW
            + var("col", float(C.GRID_COLS)) * C.SPREAD_COLUMN)
    return j.select("n", F.round(F.col("s") / F.col("n"), 6).alias("mean_coh"),
                    F.round(cost, 6).alias("spread_cost"),
                    F.round(F.col("s") / F.col("n") + F.lit(weight) * cost, 6)
                    .alias("objective"))


PICK = ["match_id", "kind", "start", "end", "level", "startown", "cell", "coh"]


def joint_selection(pool: DataFrame, *, levels=tuple(C.LEVELS), per_level: int = C.PER_LEVEL,
                    quota: dict[str, int] | None = None, weight: float = C.SPREAD_WEIGHT) -> DataFrame:
    """A batch with both teams at every level, class quotas, one clip per match, spread cells.

    Of all windows of a (slot, class, cell) only the calmest of ``target`` matches can matter:
    whatever the other picks are, one of them is free. Two ranked reductions over the pool
    leave that short list, of slots x classes x cells x target rows at most, from which ``matching``
    fills and improves the batch in rounds of joins.
    """
    quota = quota or C.CLASS_QUOTA
    target = per_level * len(levels)
    usable = pool.where(F.col("level").isin(*levels) & F.col("startown").isin(0, 1)
                        & F.col("kind").isin(*quota))
    kept = F.col("kept") if "kept" in pool.columns else F.lit(False)
    order = [F.col("kept").desc(), "coh", "match_id", "start", "end"]
    cell = ["level", "startown", "kind", "cell"]
    rows = usable.select(*PICK, kept.alias("kept"))
    one = top(rows, ["match_id", *cell], order, 1)
    short = top(one, cell, order, target)
    each = F.explode(F.sequence(F.lit(1), F.lit(per_level // 2)))
    options = short.withColumn("__n", each).withColumn(
        "slot", F.format_string("%05d/%d/%05d", "level", "startown", "__n")).drop("__n")
    return matching.batch(options, quota, weight).select(
        *PICK, *(["kept"] if "kept" in pool.columns else []))


def reselect(existing: DataFrame, candidates: DataFrame, *, bonus: float = C.KEPT_BONUS, **how
             ) -> DataFrame:
    """Joint selection that starts from the clips already there; their coherence gets a bonus."""
    keep = existing.select(*PICK).withColumn("coh", F.col("coh") - bonus)
    fresh = candidates.select(*PICK).join(existing.select("match_id", "start", "kind"),
                                          ["match_id", "start", "kind"], "left_anti")
    out = joint_selection(keep.withColumn("kept", F.lit(True)).unionByName(
        fresh.withColumn("kept", F.lit(False))), **how)
    return out.withColumn("coh", F.when(F.col("kept"), F.round(F.col("coh") + bonus, 4)).otherwise(F.col("coh")))


def selection_counts(picks: DataFrame) -> DataFrame:
    """(what, name, n): size, distinct matches, and picks per class, level, team and slot."""
    n = F.count(F.lit(1))
    out = picks.agg(n.alias("n")).select(F.lit("size").alias("what"), F.lit("").alias("name"), "n").unionByName(
        picks.agg(F.countDistinct("match_id").alias("n")).select(F.lit("matches").alias("what"), F.lit("").alias("name"), "n"))
    text = {"class": F.col("kind"), "level": F.col("level").cast("string"), "team": F.col("startown").cast("string"),
            "slot": F.concat_ws("/", "level", "startown")}
    for what, name in text.items():
        out = out.unionByName(picks.groupBy(name.alias("name")).agg(n.alias("n")).select(F.lit(what).alias("what"), "name", "n"))
    return out


def shortages(pool: DataFrame, *, levels=tuple(C.LEVELS), per_level: int = C.PER_LEVEL,
              quota: dict[str, int] | None = None) -> DataFrame:
    """Which classes, levels and (level, team) slots the pool cannot fill."""
    quota = quota or C.CLASS_QUOTA
    spark = pool.sparkSession
    matches = F.countDistinct("match_id")
    kinds = spark.createDataFrame(list(quota.items()), "name string, need bigint").join(
        pool.groupBy(F.col("kind").alias("name")).agg(matches.alias("have")), "name", "left")
    per = pool.groupBy(F.col("level").cast("string").alias("name")).agg(matches.alias("have"))
    lv = spark.createDataFrame([(str(v), per_level) for v in levels],
                               "name string, need bigint").join(per, "name", "left")
    team = F.when(F.col("startown") == 0, "blue").otherwise("red")
    slot = pool.groupBy(F.concat(F.col("level").cast("string"), F.lit("/"), team).alias("name")
                        ).agg(matches.alias("have"))
    sl = spark.createDataFrame([(f"{v}/{t}", per_level // 2) for v in levels
                                for t in ("blue", "red")], "name string, need bigint").join(
        slot, "name", "left")
    out = None
    for what, df in (("class", kinds), ("level", lv), ("slot", sl)):
        part = df.select(F.lit(what).alias("what"), "name", "need",
                         F.coalesce("have", F.lit(0)).alias("have"))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("short", F.col("have") < F.col("need"))


def supply(pool: DataFrame, by: list[str], dense: DataFrame | None = None, need: int = 2
           ) -> DataFrame:
    """Distinct matches per group, zero-filled over ``dense``, with a SHORT flag."""
    got = pool.groupBy(*by).agg(F.countDistinct("match_id").alias("matches"))
    if dense is not None:
        got = dense.join(got, by, "left").withColumn("matches",
                                                     F.coalesce("matches", F.lit(0)))
    return got.withColumn("short", F.col("matches") < need)


def alternates(candidates: DataFrame, done: DataFrame, slots: DataFrame, n: int = 3
               ) -> DataFrame:
    """The ``n`` calmest windows per wanted (level, team, kind) slot, then not yet measured."""
    slot = ["level", "startown", "kind"]
    wanted = candidates.join(slots.select(*slot).distinct(), slot, "left_semi")
    best = top(wanted, slot, ["coh", "match_id", "start"], n)
    return best.join(done.select("match_id", "start").distinct(), ["match_id", "start"],
                     "left_anti")


def slot_table(picks: DataFrame, levels=tuple(C.LEVELS), per_level: int = C.PER_LEVEL
               ) -> DataFrame:
    """``per_level`` rows for each level; empty ones say "unfilled"."""
    w = Window.partitionBy("level").orderBy("clip")
    got = picks.withColumn("slot", F.row_number().over(w).cast("bigint")).where(
        F.col("slot") <= per_level).select("level", "slot", "clip")
    dense = picks.sparkSession.range(min(levels), max(levels) + 1).select(
        F.col("id").alias("level"), F.explode(F.expr(f"sequence(1L, {per_level}L)"))
        .alias("slot"))
    return dense.join(got, ["level", "slot"], "left").withColumn(
        "status", F.when(F.col("clip").isNull(), "unfilled").otherwise("filled"))


def hide_sets(windows: DataFrame, inshot: DataFrame, *, first: int = 8, last: int = 6,
              threshold: int = 25, pane: int = 1) -> DataFrame:
    """Which slots to show so that a clip opens with ``first`` and ends with ``last`` people.

    Keep a players seen at both ends, first - a seen only at the start and last - a only at the
    end, longest on camera first; the largest feasible a wins. Never-seen players need no
    hiding. Null where no split works.
    """
    key = ["match_id", "start", "end"]
    ranges = session.cut_lineage(windows.select(*key).distinct())
    on = {f"s{i}": F.expr(f"if(get(body, {i}) >= {threshold}, 1, 0)") for i in range(22)}
    agg = chunks.range_sums(inshot.select("match_id", "frame", "body"), ranges, {**on, "n": F.lit(1)}, pane).where("n > 0").select(
        *key, F.array(*on).alias("dwell"))
    # who is seen on the first and on the last frame: read at these frames only
    ends = ranges.select("match_id", F.explode(F.array("start", F.col("end") - 1)).alias("frame")).distinct()
    seen_at = inshot.join(ends, ["match_id", "frame"], "left_semi").select("match_id", "frame", "body")
    agg = agg.join(seen_at.select("match_id", F.col("frame").alias("start"), F.col("body").alias("b0")), ["match_id", "start"], "left").join(
        seen_at.select("match_id", (F.col("frame") + 1).alias("end"), F.col("body").alias("b1")), ["match_id", "end"], "left")
    seq = F.sequence(F.lit(0), F.lit(21))

    def seen(side, i):
        return F.coalesce(F.get(F.col(side), i) >= threshold, F.lit(False))

    def ranked(test):
        return F.transform(F.array_sort(F.transform(F.filter(seq, test), lambda i: F.struct(
            (-F.get(F.col("dwell"), i)).alias("d"), i.alias("i")))), lambda s: s["i"])
    agg = agg.select(
        *key, ranked(lambda i: seen("b0", i) & seen("b1", i)).alias("both"),
        ranked(lambda i: seen("b0", i) & ~seen("b1", i)).alias("only_a"),
        ranked(lambda i: ~seen("b0", i) & seen("b1", i)).alias("only_b"),
        F.filter(seq, lambda i: F.get(F.col("dwell"), i) == 0).alias("never"))
    choices = F.filter(
        F.sequence(F.lit(min(first, last)), F.lit(0), F.lit(-1)),
        lambda a: (a <= F.size("both")) & (F.lit(first) - a <= F.size("only_a"))
        & (F.lit(last) - a <= F.size("only_b")))
    agg = agg.withColumn("a", F.get(choices, F.lit(0)))
    b, c = F.lit(first) - F.col("a"), F.lit(last) - F.col("a")
    shown = F.array_sort(F.concat(
        F.slice("both", F.lit(1), F.col("a")), F.slice("only_a", F.lit(1), b),
        F.slice("only_b", F.lit(1), c), F.col("never")))
    return agg.select(*key, F.col("a").cast("bigint").alias("a"), b.cast("bigint").alias("b"),
                      c.cast("bigint").alias("c"),
                      F.when(F.col("a").isNotNull(), shown).alias("shown"))


def target_cells(draws: DataFrame, *, cols: int = C.GRID_COLS, rows: int = C.GRID_ROWS,
                 cap: int = 2, first_row: int = 1, seed: int = 20260807) -> DataFrame:
    """Centre-weighted target cells, at most ``cap`` per cell.

    One candidate draw per input row: the sum of twelve uniform numbers, taken from hashes of the
    seed and ``draw``, so that any engine and any partitioning draws the same. Draws outside the
    grid or in the excluded top rows are dropped, and each cell keeps its first ``cap`` draws.
    """
    def normal(axis):
        parts = []
        for k in range(3):
            digest = F.md5(F.concat_ws("-", F.lit(f"{seed}{axis}{k}"), F.col("draw").cast("string")))
            parts += [F.conv(F.substring(digest, 8 * j + 1, 8), 16, 10).cast("bigint") for j in range(4)]
        return sum(parts[1:], parts[0]) / float(1 << 32) - 6.0
    c = F.floor(normal("x") * 3.7 + 8.0).cast("bigint")
    r = F.floor(normal("y") * 1.30 + 3.2).cast("bigint")
    inside = draws.select("draw", r.alias("row"), c.alias("col")).where(
        F.col("col").between(0, cols - 1) & F.col("row").between(first_row, rows - 1))
    return top(inside, ["row", "col"], ["draw"], cap)


# --- job lists ---
def job_matrix(seeds: DataFrame, shapes: list[str] = C.SHAPES) -> DataFrame:
    """Every seed with every shape, numbered seed by seed. The shapes are a fixed list that is
    unfolded per seed row, so there is no cross join."""
    names = F.array(*[F.lit(s) for s in shapes])
    numbered = chunks.number_rows(seeds.select("seed").distinct(), ["seed"], None, "__i")
    return numbered.select("seed", "__i", F.posexplode(names).alias("p", "shape")).select(
        (F.col("__i") * len(shapes) + F.col("p")).alias("job"), "seed", "shape")


def todo(jobs: DataFrame, done: DataFrame, shard: int, of: int) -> DataFrame:
    """Jobs of one shard (job modulo ``of``) that are not done yet."""
    return jobs.where(F.col("job") % of == shard).join(
        done.select("shape", "seed").distinct(), ["shape", "seed"], "left_anti")
