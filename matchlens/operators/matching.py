"""Filling the slots of a batch as DataFrame rounds: joins on slot, match and class, no row seen twice by the driver.

An option is a row (slot, match_id, kind, cell, coh, and any further columns). A pick takes its slot, its
match and one place of its class. Three kinds of rounds follow each other; each is a few joins,
ends in a checkpoint, and the driver sees only how many picks there are or whether any is left to change:

* `accepted`: every open slot asks for its calmest option, every match takes its calmest asker, and every class
  takes the calmest of these as long as it has places. Until no open slot has an option.
* `augmented`: alternating paths, all open slots at once and layer by layer. A slot moves on to the
  holder of a match it could take, or, for a free match of a full class, to the holders of that class; a
  path ends at a free match of a class with a place. Until no open slot has a path, however long. With
  one class to a match (as `select.scarcest_class` gives) this is the residual search of a maximum
  flow, so that no selection fills more slots. Options of a match that is held for another class
  are steps only where that leaves every class within its quota.
* `exchanged`: each slot proposes the exchange of its pick that makes the batch calmer or more even by most; those
  that are best at their match, rows and columns of the grid take place at once, as their gains add up.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from matchlens import config as C
from matchlens import session

GAIN = 1e-9


def _best(df: DataFrame, by: list[str], order: list) -> DataFrame:
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")


def _calm() -> list:
    return ["coh", "match_id", "kind", "cell", "slot"]


def _rooms(picks: DataFrame, quota: DataFrame) -> DataFrame:
    """(kind, room): places that each class has left."""
    used = picks.groupBy("kind").agg(F.count(F.lit(1)).alias("used"))
    return quota.join(used, "kind", "left").select("kind", (F.col("places") - F.coalesce("used", F.lit(0))).alias("room"))


def _within(df: DataFrame, rooms: DataFrame) -> DataFrame:
    """The calmest rows of each class, as many as it has places."""
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy("kind").orderBy(*_calm())))
    return ranked.join(rooms, "kind").where("__k <= room").drop("__k", "room")


def quotas(spark, quota: dict[str, int]) -> DataFrame:
    return spark.createDataFrame([(k, n) for k, n in quota.items()], "kind string, places int")


def accepted(options: DataFrame, picks: DataFrame, quota: DataFrame) -> DataFrame:
    """picks and what open slots are given without moving any."""
    before = -1
    while (now := picks.count()) != before:
        before = now
        left = options.join(picks.select("slot"), "slot", "left_anti").join(picks.select("match_id"), "match_id", "left_anti")
        rooms = _rooms(picks, quota).where("room > 0")
        asked = _best(left.join(rooms.select("kind"), "kind", "left_semi"), ["slot"], _calm())
        given = _within(_best(asked, ["match_id"], _calm()), rooms)
        picks = session.cut_lineage(picks.unionByName(given.select(*picks.columns)))
    return picks


def _searched(options: DataFrame, picks: DataFrame, quota: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(steps, ends): alternating trees from the open slots, and the options that end a path, if there are any.

    A step (slot, root, parent, match_id, kind, free): `parent` takes that option and displaces `slot`."""
    held = picks.select(F.col("slot").alias("holder"), "match_id", F.col("kind").alias("held_kind"))
    rooms = _rooms(picks, quota)
    # the calmest window of each (slot, match, class) is all that paths need
    first = session.cut_lineage(_best(options, ["slot", "match_id", "kind"], _calm()).select("slot", "match_id", "kind", "coh", "cell").join(
        held, "match_id", "left").join(rooms, "kind"))
    open_ = options.select("slot").distinct().join(picks.select("slot"), "slot", "left_anti")
    steps = session.cut_lineage(open_.select(
        "slot", F.col("slot").alias("root"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("bigint").alias("match_id"),
        F.lit(None).cast("string").alias("kind"), F.lit(False).alias("free")))
    frontier = steps
    while not frontier.isEmpty():
        mine = frontier.select("slot", "root").join(first, "slot")
        ends = session.cut_lineage(mine.where("holder is null and room > 0"))
        if not ends.isEmpty():
            return steps, ends
        taken = mine.where((F.col("holder").isNotNull()) & ((F.col("held_kind") == F.col("kind")) | (F.col("room") > 0)))
        moved = taken.select("root", F.col("slot").alias("parent"), F.col("holder").alias("slot"), "match_id", "kind", F.lit(False).alias("free"), "coh", "cell")
        full = _best(mine.where("holder is null"), ["kind"], _calm()).select("root", F.col("slot").alias("parent"), "kind", "match_id", "coh", "cell")
        out = full.join(picks.select("slot", "kind"), "kind").withColumn("free", F.lit(True))
        reached = moved.unionByName(out.select(*moved.columns)).join(steps.select("slot"), "slot", "left_anti")
        frontier = session.cut_lineage(_best(reached, ["slot"], ["coh", "parent", "match_id", "kind"]).select(*steps.columns))
        steps = session.cut_lineage(steps.unionByName(frontier))
    return None


def augmented(options: DataFrame, picks: DataFrame, quota: DataFrame) -> DataFrame:
    """picks with as many slots filled as paths of moves can fill; no filled slot is emptied."""
    while (found := _searched(options, picks, quota)) is not None:
        steps, ends = found
        rooms = _rooms(picks, quota)
        last = _within(_best(_best(ends.drop("room"), ["root"], _calm()), ["match_id"], _calm()), rooms)
        walk = last.select("root", "slot", "match_id", "kind", F.lit(True).alias("free"))
        path = walk = session.cut_lineage(walk)
        while True:     # from the end of a path back to its open slot
            up = walk.select("root", "slot").join(steps.where("parent is not null").drop("root"), "slot").select(
                "root", F.col("parent").alias("slot"), "match_id", "kind", "free")
            walk = session.cut_lineage(up)
            if walk.isEmpty():
                break
            path = path.unionByName(walk)
        path = session.cut_lineage(path)
        kept = _apart(path, picks, rooms)
        chosen = path.join(kept, "root", "left_semi").select("slot", "match_id", "kind")
        given = _best(options.join(chosen, ["slot", "match_id", "kind"], "left_semi"), ["slot"], _calm()).select(*picks.columns)
        before = picks.count()
        picks = session.cut_lineage(picks.join(given.select("slot"), "slot", "left_anti").unionByName(given))
        if picks.count() == before:
            break
    return picks


def _apart(path: DataFrame, picks: DataFrame, rooms: DataFrame) -> DataFrame:
    """(root): paths that no smaller root shares a free match with, and that together leave every class within its quota."""
    shared = path.where("free").groupBy("match_id").agg(F.min("root").alias("m"))
    lost = path.where("free").join(shared, "match_id").where("root != m").select("root").distinct()
    left = path.join(lost, "root", "left_anti")
    old = picks.select("slot", F.col("kind").alias("old"))
    moves = left.join(old, "slot", "left")
    use = moves.select("root", "kind", F.lit(1).alias("n")).unionByName(moves.where("old is not null").select("root", F.col("old").alias("kind"), F.lit(-1).alias("n")))
    use = use.groupBy("root", "kind").agg(F.sum("n").alias("n"))
    total = F.sum(F.greatest("n", F.lit(0))).over(Window.partitionBy("kind").orderBy("root"))
    over = use.withColumn("t", total).join(rooms, "kind").where("n > 0 and t > room").select("root").distinct()
    return left.select("root").distinct().join(over, "root", "left_anti")


def _f(v: Column, n: Column, places: int) -> Column:
    """What a row or column of the grid with v picks adds to the unevenness; empty ones add nothing."""
    share = n / F.lit(float(places))
    return F.when(v > 0, (v - share) * (v - share)).otherwise(0.0)


def _counted(picks: DataFrame) -> DataFrame:
    """One row: n picks, and of the grid's cells (k + name), rows (r) and columns (c) that hold some, how many."""
    at = F.explode(F.array(*[F.concat(F.lit(t), of(F.col("cell"))) for t, of in _PLACES.items()]))
    counts = picks.select(at.alias("at")).where("at is not null").groupBy("at").agg(F.count(F.lit(1)).alias("v"))
    held = counts.agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("held"))
    return picks.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(held))     # one row each


_PLACES = {"k": lambda c: c, "r": lambda c: F.substring(c, 1, 1), "c": lambda c: F.substring(c, 2, 2)}


def _exchanges(options: DataFrame, picks: DataFrame, weight: float) -> DataFrame:
    """The picks of a round that take the places of others; each slot, match, row and column changes once at most."""
    here = picks.select("slot", F.col("kind").alias("old_kind"), F.col("match_id").alias("old_match"), F.col("cell").alias("old_cell"), F.col("coh").alias("old_coh"))
    can = options.join(here, "slot").where("kind = old_kind")
    can = can.join(picks.select("match_id", F.col("slot").alias("user")), "match_id", "left").where("user is null or user = slot").drop("user")
    # the counts of the whole grid fit in a row: a join for each of them would make the plan of a round several times larger
    can = _best(can, ["slot", "cell"], _calm()).join(F.broadcast(_counted(picks)))

    def held(t, cell):
        return F.coalesce(F.element_at("held", F.concat(F.lit(t), _PLACES[t](F.col(cell)))), F.lit(0))

    def moved(t, places):
        old, new, n, of = held(t, "old_cell"), held(t, "cell"), F.col("n"), _PLACES[t]
        change = _f(old - 1, n, places) - _f(old, n, places) + _f(new + 1, n, places) - _f(new, n, places)
        return F.when(of(F.col("old_cell")) == of(F.col("cell")), 0.0).otherwise(change)
    used = F.when(F.col("cell") == F.col("old_cell"), 0).otherwise(
        (held("k", "cell") == 0).cast("int") - (held("k", "old_cell") == 1).cast("int"))
    uneven = -used * C.SPREAD_CELL + moved("r", C.GRID_ROWS) * C.SPREAD_ROW + moved("c", C.GRID_COLS) * C.SPREAD_COLUMN
    gain = (F.col("old_coh") - F.col("coh")) / F.col("n") - F.lit(weight) * uneven
    can = _best(can.withColumn("gain", gain).where(F.col("gain") > GAIN), ["slot"], [F.desc("gain"), *_calm()])
    touches = F.array_distinct(F.array(F.concat(F.lit("m"), "match_id"), *[
        F.concat(F.lit(t), _PLACES[t](F.col(c))) for t in "rc" for c in ("old_cell", "cell")]))
    at = can.select("*", F.posexplode(touches).alias("nth", "at"))
    first = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("gain"), *_calm()))
    last = F.max("first").over(Window.partitionBy("slot"))
    return at.withColumn("first", first).withColumn("last", last).where("last = 1 and nth = 0").select(*picks.columns)


def exchanged(options: DataFrame, picks: DataFrame, weight: float) -> DataFrame:
    """picks after all exchanges, within slot and class, that make the batch calmer or more even."""
    while True:
        new = session.cut_lineage(_exchanges(options, picks, weight))
        if new.isEmpty():
            return picks
        picks = session.cut_lineage(picks.join(new.select("slot"), "slot", "left_anti").unionByName(new))


def batch(options: DataFrame, quota: dict[str, int], weight: float) -> DataFrame:
    """The picks of a batch; options with a low coh (as kept ones have) come first."""
    # written: a checkpoint keeps the constraints of the plan it came from, which unions can't map
    options = session.written(options)
    places = quotas(options.sparkSession, quota)
    picks = accepted(options, options.limit(0), places)
    return exchanged(options, augmented(options, picks, places), weight)
