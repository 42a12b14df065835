"""Batch expectations: one row per check with its name, result and detail."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchlens import config as C
from matchlens.operators import measure as M


def _rows(df: DataFrame, checks: list[tuple[str, Column, Column]]) -> DataFrame:
    """Turn a one-row table of facts into check rows."""
    return df.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("check"), F.coalesce(ok, F.lit(False)).alias("pass"),
        detail.cast("string").alias("detail")) for n, ok, detail in checks])).alias("r")
    ).select("r.*")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def batch_spec(key: DataFrame, *, size: int = 24, levels=tuple(C.LEVELS),
               per_level: int = C.PER_LEVEL, quota: dict[str, int] | None = None) -> DataFrame:
    """Size, levels, class quota, team balance, nobody hidden, restarts shown.

    ``key``: clip, level, kind, startown, hidden, start, anchor.
    """
    quota = quota or C.CLASS_QUOTA
    by_level = key.groupBy("level").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("startown") == 0, 1)).alias("blue"))
    lv = by_level.agg(
        F.count(F.when(F.col("level").isin(*levels) & (F.col("n") == per_level), 1)).alias("full"),
        F.count(F.when(~F.col("level").isin(*levels), 1)).alias("outside"),
        F.count(F.when((F.col("n") == 2) & (F.col("blue") != 1), 1)).alias("uneven"))
    late = (F.col("kind") != "open") & (F.col("start") > F.col("anchor"))
    whole = key.agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("startown") == 0, 1)).alias("blue"),
        F.count(F.when(F.col("startown") == 1, 1)).alias("red"),
        F.count(F.when(F.col("hidden") != 0, 1)).alias("hidden"),
        F.count(F.when(late, 1)).alias("late"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"k_{k}") for k in quota],
        F.count(F.when(~F.col("kind").isin(*quota), 1)).alias("k_other"))
    exact = (F.col("full") == len(levels)) & (F.col("outside") == 0)
    mix = F.col("k_other") == 0
    for k, v in quota.items():
        mix = mix & (F.col(f"k_{k}") == v)
    got = F.concat_ws(" ", *[F.concat(F.lit(k + "="), F.col(f"k_{k}").cast("string"))
                             for k in quota])
    return union([
        _rows(whole, [
            ("batch size", F.col("n") == size, F.col("n")),
            ("situation quota", mix, got),
            ("team totals", (F.col("blue") == size // 2) & (F.col("red") == size // 2),
             F.concat("blue", F.lit("/"), "red")),
            ("nobody hidden", F.col("hidden") == 0, F.col("hidden")),
            ("restart shown", F.col("late") == 0, F.col("late"))]),
        _rows(lv, [
            ("levels filled exactly", exact, F.concat("full", F.lit("/"), "outside")),
            ("two-clip levels split by team", F.col("uneven") == 0, F.col("uneven"))])])


def distinct_passages(clips: DataFrame) -> DataFrame:
    """``clips`` carries same_play: other clips on an overlapping stretch of the same play."""
    agg = clips.agg(F.count(F.when(F.col("same_play") > 0, 1)).alias("shared"))
    return _rows(agg, [("one clip per passage of play", F.col("shared") == 0, F.col("shared"))])


def frame_checks(pixels: DataFrame, *, pitch_floor: float = 0.80, max_diff: int = 400,
                 min_ball: int = 3) -> DataFrame:
    """Framing and ball checks over clip frames; the worst clip is named."""
    per = M.pitch_fraction(pixels, ["clip"]).join(M.ball_visible(pixels, ["clip"]), "clip")
    agg = per.agg(
        F.min("pitch").alias("pitch"),
        F.min(F.struct("pitch", "clip"))["clip"].alias("pitch_clip"),
        F.max(F.struct("ball_px", "clip")).alias("most"),
        F.min(F.struct("ball_px", "clip")).alias("least"))

    def named(s):
        return F.concat(F.lit("clip "), F.col(f"{s}.clip").cast("string"), F.lit(" at "),
                        F.col(f"{s}.ball_px").cast("string"), F.lit(" px"))
    return _rows(agg, [
        ("framing shows pitch", F.col("pitch") >= pitch_floor,
         F.concat(F.lit("clip "), F.col("pitch_clip").cast("string"))),
        ("passes differ only in the ball", F.col("most.ball_px") <= max_diff, named("most")),
        ("ball on every final frame", F.col("least.ball_px") >= min_ball, named("least"))])


def spread_checks(cells: DataFrame, *, max_row: int = 12, min_cells: int = 12, min_rows: int = 4,
                  min_cols: int = 8) -> DataFrame:
    row, col = F.substring("cell", 1, 1), F.substring("cell", 2, 2)
    per = cells.groupBy(row.alias("row"), col.alias("col")).agg(F.count(F.lit(1)).alias("n"))
    rows = per.groupBy("row").agg(F.sum("n").alias("n"))
    a = rows.agg(F.max("n").alias("busiest"), F.count(F.lit(1)).alias("rows"))
    b = per.agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("col").alias("cols"))
    return union([
        _rows(a, [("no row holds too many", F.col("busiest") <= max_row, F.col("busiest")),
                  ("enough rows", F.col("rows") >= min_rows, F.col("rows"))]),
        _rows(b, [("enough distinct cells", F.col("cells") >= min_cells, F.col("cells")),
                  ("enough columns", F.col("cols") >= min_cols, F.col("cols"))])])


def key_completeness(key: DataFrame, files: DataFrame) -> DataFrame:
    """Rows against files, blank cells, count against target, players in play."""
    both = key.select("clip", F.lit(1).alias("k")).join(
        files.select("clip", F.lit(1).alias("f")), "clip", "full_outer").agg(
        F.count(F.when(F.col("f").isNull(), 1)).alias("only_key"),
        F.count(F.when(F.col("k").isNull(), 1)).alias("only_files"))
    blank = F.coalesce("start_cell", F.lit("")) == ""
    facts = key.agg(
        F.count(F.when(blank | (F.coalesce("final_cell", F.lit("")) == ""), 1)).alias("blank"),
        F.count(F.when(F.col("measured") != F.col("target"), 1)).alias("off"),
        F.count(F.when(F.col("in_play") != 22, 1)).alias("missing"))
    return union([
        _rows(both, [("key rows have files", F.col("only_key") == 0, F.col("only_key")),
                     ("files have key rows", F.col("only_files") == 0, F.col("only_files"))]),
        _rows(facts, [("no blank cells", F.col("blank") == 0, F.col("blank")),
                      ("counts equal targets", F.col("off") == 0, F.col("off")),
                      ("all players in play", F.col("missing") == 0, F.col("missing"))])])


def published_counts(published: DataFrame, measured: DataFrame) -> DataFrame:
    """Published against re-measured head counts, as one check."""
    j = published.join(measured, "clip", "left")
    same = F.col("players").eqNullSafe(F.col("measured"))
    agg = j.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(~same, 1)).alias("bad"))
    return _rows(agg, [("published counts hold", F.col("bad") == 0,
                        F.concat("bad", F.lit("/"), "n"))])
