"""Column builders for points, steps and players. Nothing here shuffles."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from matchlens.config import METRES_X, METRES_Y


def planar(dx: Column, dy: Column) -> Column:
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def step_from(w) -> Column:
    """Ball step from the previous frame in the window ordering; null on the first frame."""
    return planar(F.col("ball_x") - F.lag("ball_x").over(w),
                  F.col("ball_y") - F.lag("ball_y").over(w))


def step_to_next(w) -> Column:
    return planar(F.lead("ball_x").over(w) - F.col("ball_x"),
                  F.lead("ball_y").over(w) - F.col("ball_y"))


SQUAD = 11


def everyone() -> list[str]:
    """The 22 players as separate SQL terms.

    Written out one by one so that distances stay in generated code: a lambda over the array
    is interpreted per element and costs several times more. They are text because one parsed
    expression is much cheaper to set up than hundreds of Column calls. A missing player is
    null, and least and the counts skip it.
    """
    return [f"get(`{side}`, {i})" for side in ("left", "right") for i in range(SQUAD)]


def squared_sql(p: str) -> str:
    return f"(({p}.x - ball_x) * ({p}.x - ball_x) + ({p}.y - ball_y) * ({p}.y - ball_y))"


def _metres(p: str, unit: float) -> str:
    dx, dy = f"(({p}.x - ball_x) * {METRES_X!r}D)", f"(({p}.y - ball_y) * {METRES_Y!r}D)"
    return f"sqrt({dx} * {dx} + {dy} * {dy}) / {float(unit)!r}D"


def nearest_metres(unit: float) -> Column:
    return F.expr(f"least({', '.join(_metres(p, unit) for p in everyone())})")


def nearest_squared() -> Column:
    return F.expr(f"least({', '.join(squared_sql(p) for p in everyone())})")


def count_of(tests: list[str]) -> Column:
    """How many of the SQL predicates hold, as a bigint."""
    return F.expr(" + ".join(["0L", *(f"if({t}, 1L, 0L)" for t in tests)]))


def near_count(radius: float, unit: float) -> Column:
    r2 = round((radius * unit) ** 2, 9)
    return count_of([f"{squared_sql(p)} < {r2!r}D" for p in everyone()])


def home_counts() -> tuple[Column, Column]:
    """Players of each side in their own half."""
    squad = everyone()
    return (count_of([f"{p}.x < 0" for p in squad[:SQUAD]]),
            count_of([f"{p}.x > 0" for p in squad[SQUAD:]]))


def nearest_player() -> Column:
    """struct(d2, team, slot) of the closest player; ties go to the lowest team, slot."""
    entries = [f"if({p} is null, null, named_struct('d2', {squared_sql(p)}, 'team', {k // SQUAD}L,"
               f" 'slot', {k % SQUAD}L))" for k, p in enumerate(everyone())]
    return F.expr(f"array_min(array({', '.join(entries)}))")


def in_goal(unit: float) -> Column:
    return (F.abs(F.col("ball_x")) > F.lit(1.0 * unit)) & (
        F.abs(F.col("ball_y")) < F.lit(0.05 * unit))
