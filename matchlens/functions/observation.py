"""Observation transforms: 180 degree flip, flat feature vector, minimap points."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from matchlens.functions.geometry import SQUAD

# --- fixed values: direction k of the eight sticky directions is opposite to k + 4 ---
DIRECTIONS = ["left", "top_left", "top", "top_right", "right", "bottom_right", "bottom",
              "bottom_left"]


def flip_sticky(sticky: Column) -> Column:
    """Swap opposite direction bits; the remaining bits stay."""
    half = len(DIRECTIONS) // 2
    return F.concat(F.slice(sticky, half + 1, half), F.slice(sticky, 1, half),
                    F.slice(sticky, len(DIRECTIONS) + 1, 100))


def _each(points: Column, entries, width: int, whole) -> Column:
    """``entries(p)``, ``width`` values a point, of all points in order. Up to a squad they are written out, so that
    they stay in generated code (see `geometry.everyone`); ``whole(points)`` serves longer lists."""
    values = [v for i in range(SQUAD) for v in entries(F.get(points, F.lit(i)))]
    n = F.size(points)
    return F.when(n <= SQUAD, F.slice(F.array(*values), F.lit(1), n * width)).otherwise(whole(points))


def _turned(points: Column) -> Column:
    def turn(p):
        return F.struct((-p["x"]).alias("x"), (-p["y"]).alias("y"))
    return _each(points, lambda p: [turn(p)], 1, lambda ps: F.transform(ps, turn))


def flip(df: DataFrame) -> DataFrame:
    """The same observation seen from the other end. Applying it twice changes nothing."""
    swap = {"left": _turned(F.col("right")), "right": _turned(F.col("left")),
            "left_dir": lambda: _turned(F.col("right_dir")),
            "right_dir": lambda: _turned(F.col("left_dir")),
            "ball_x": -F.col("ball_x"), "ball_y": -F.col("ball_y"),
            "owned_team": F.when(F.col("owned_team") > -1, 1 - F.col("owned_team")).otherwise(-1),
            "score_l": F.col("score_r"), "score_r": F.col("score_l")}
    out = []
    for c in df.columns:
        if c == "sticky":
            out.append(flip_sticky(F.col(c)).alias(c))
        elif c in ("ball_dx", "ball_dy"):
            out.append((-F.col(c)).alias(c))
        elif c in swap:
            e = swap[c]
            out.append((e() if callable(e) else e).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def _flat(points: Column) -> Column:
    def pair(p):
        return [p["x"].cast("double"), p["y"].cast("double")]
    return _each(points, pair, 2, lambda ps: F.flatten(F.transform(ps, lambda p: F.array(*pair(p)))))


def _pad(values: Column, n: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(-1.0), F.greatest(F.lit(0), n - F.size(values))))


def _one_hot(index: Column, n: int) -> Column:
    return F.array(*[F.when(index == i, 1.0).otherwise(0.0) for i in range(n)])


LENGTH = 115


def features(fixed: bool = True) -> Column:
    """115 numbers: players and directions (88, -1 where missing), ball and its direction (6),
    owner (3), active player (11), game mode (7).

    ``fixed``: each of the four player blocks keeps its place when a side is short; otherwise
    the blocks are packed and padded at the end.
    """
    blocks = [_flat(F.col(c)) for c in ("left", "left_dir", "right", "right_dir")]
    people = F.concat(*[_pad(b, 22) for b in blocks]) if fixed else _pad(F.concat(*blocks), 88)
    ball = F.array(*[F.col(c).cast("double") for c in
                     ("ball_x", "ball_y", "ball_z", "ball_dx", "ball_dy", "ball_dz")])
    return F.concat(people, ball, _one_hot(F.col("owned_team") + 1, 3),
                    _one_hot(F.col("active"), 11), _one_hot(F.col("game_mode"), 7))


# --- fixed values: minimap size and extent ---
MAP_W, MAP_H = 96, 72
MAP_X, MAP_Y = 1.0, 1.0 / 2.25


def minimap(df: DataFrame, key: list[str], unit: float = 1.0) -> DataFrame:
    """Lit minimap cells per layer (left, right, ball, active) as a sparse raster."""
    def dot(x, y):
        mx = ((x / float(unit) + MAP_X) / (2 * MAP_X) * MAP_W).cast("bigint")
        my = ((y / float(unit) + MAP_Y) / (2 * MAP_Y) * MAP_H).cast("bigint")
        return F.struct(F.least(F.greatest(my, F.lit(0)), F.lit(MAP_H - 1)).cast("bigint")
                        .alias("y"), F.least(F.greatest(mx, F.lit(0)), F.lit(MAP_W - 1))
                        .cast("bigint").alias("x"))

    def layer(name, dots):
        return F.struct(F.lit(name).alias("layer"), F.array_distinct(dots).alias("dots"))
    active = F.get("left", F.col("active").cast("int"))
    layers = F.array(
        layer("left_team", F.transform("left", lambda p: dot(p["x"], p["y"]))),
        layer("right_team", F.transform("right", lambda p: dot(p["x"], p["y"]))),
        layer("ball", F.array(dot(F.col("ball_x"), F.col("ball_y")))),
        layer("active", F.when(F.col("active") >= 0, F.array(dot(active["x"], active["y"])))))
    return (df.select(*key, F.explode(layers).alias("l"))
            .select(*key, F.col("l.layer").alias("layer"), F.explode("l.dots").alias("d"))
            .select(*key, "layer", "d.y", "d.x"))
