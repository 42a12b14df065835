"""Grid cells, pitch bins, pixel projection and the camera offset, as Columns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from matchlens import config as C


def _whole(c: Column) -> Column:
    return c.cast("bigint")


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def cell_index(px: Column, py: Column, cols: int = C.GRID_COLS,
               rows: int = C.GRID_ROWS) -> tuple[Column, Column]:
    """Zero-based (row, col) of a pixel; outside pixels fall in the border cells."""
    col = clamp(_whole(F.floor(px / F.lit(C.FRAME_W / cols))), 0, cols - 1)
    row = clamp(_whole(F.floor(py / F.lit(C.FRAME_H / rows))), 0, rows - 1)
    return _whole(row), _whole(col)


def letter(row: Column) -> Column:
    return F.char(F.lit(65) + row)


def label(row: Column, col: Column) -> Column:
    return F.concat(letter(row), (col + 1).cast("string"))


def cell_of(px: Column, py: Column, cols: int = C.GRID_COLS, rows: int = C.GRID_ROWS) -> Column:
    row, col = cell_index(px, py, cols, rows)
    return label(row, col)


def cell_centre(row: Column, col: Column, cols: int = C.GRID_COLS,
                rows: int = C.GRID_ROWS) -> tuple[Column, Column]:
    return ((col + 0.5) * F.lit(C.FRAME_W / cols), (row + 0.5) * F.lit(C.FRAME_H / rows))


def parse_label(cell: Column) -> tuple[Column, Column]:
    """Row letter and one-based column of a cell label."""
    return F.substring(cell, 1, 1), F.substring(cell, 2, 2).cast("bigint")


def pitch_bin(x: Column, y: Column, nx: int = 6, ny: int = 4) -> tuple[Column, Column]:
    """(col, row) of a pitch point; truncates towards zero before clamping."""
    col = clamp(_whole((x + 1.0) / F.lit(2.0 / nx)), 0, nx - 1)
    row = clamp(_whole((y + 0.42) / F.lit(0.84 / ny)), 0, ny - 1)
    return _whole(col), _whole(row)


# --- fixed values: rendered frame of the pitch projection ---
RENDER_W, RENDER_H, PAD_X, PAD_Y, HUD, BIN, BIN_COLS, BIN_ROWS = 1280, 720, 60, 80, 60, 40, 32, 12


def pitch_to_pixel(x: Column, y: Column) -> tuple[Column, Column]:
    px = F.lit(float(PAD_X)) + (x + 1.0) / 2.0 * (RENDER_W - 2 * PAD_X)
    py = F.lit(float(PAD_Y)) + (y + 0.42) / 0.84 * (RENDER_H - 2 * PAD_Y)
    return _whole(px), _whole(py)


def pixel_row_sql(y: str) -> str:
    """The pixel row of pitch_to_pixel as SQL text, for expressions over many players."""
    return f"cast({float(PAD_Y)}D + ({y} + 0.42D) / 0.84D * {RENDER_H - 2 * PAD_Y} as bigint)"


def pixel_bin(x: Column, y: Column) -> tuple[Column, Column]:
    px, py = pitch_to_pixel(x, y)
    col = clamp(_whole(F.floor(px / BIN)), 0, BIN_COLS - 1)
    row = clamp(_whole(F.floor((py - HUD) / BIN)), 0, BIN_ROWS - 1)
    return _whole(col), _whole(row)


def interpolate(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Piecewise-linear table lookup, flat outside the table."""
    out = F.when(x <= xs[0], F.lit(ys[0]))
    for (x0, y0), (x1, y1) in zip(zip(xs, ys), zip(xs[1:], ys[1:])):
        out = out.when(x <= x1, F.lit((y1 - y0) / (x1 - x0)) * (x - x0) + y0)
    return out.otherwise(F.lit(ys[-1]))


def camera_offset(px: Column, py: Column, target_px: Column, target_py: Column,
                  world_x: Column | None = None, world_y: Column | None = None
                  ) -> tuple[Column, Column]:
    """Offset that moves the ball from its natural pixel to a target, within the envelope."""
    tx, ty = clamp(target_px, *C.SAFE_PX), clamp(target_py, *C.SAFE_PY)
    off_y = clamp(interpolate(ty - py, C.CAL_DPY, C.CAL_OFFY), *C.OFFSET_Y_RANGE)
    off_x = clamp((tx - px - F.lit(C.CROSS_TERM) * off_y) / F.lit(C.PX_PER_OFFSET_X),
                  *C.OFFSET_X_RANGE)
    if world_x is not None:
        off_x = F.least(F.greatest(off_x, F.lit(-C.ENVELOPE_X) - world_x),
                        F.lit(C.ENVELOPE_X) - world_x)
        off_y = F.least(F.greatest(off_y, F.lit(-C.ENVELOPE_Y) - world_y),
                        F.lit(C.ENVELOPE_Y) - world_y)
    return F.round(off_x, 3), F.round(off_y, 3)


def third(x: Column) -> Column:
    return (F.when(x < -1 / 3, "blue defensive third").when(x > 1 / 3, "red defensive third")
            .otherwise("middle third"))


def crowding(n: Column) -> Column:
    return F.when(n < 2, "isolated").when(n < 5, "contested").otherwise("crowded")


def direction(net_x_m: Column) -> Column:
    return (F.when(F.abs(net_x_m) < 5, "across the pitch")
            .when(net_x_m > 0, "towards the red goal").otherwise("towards the blue goal"))


def names(code: Column, table: dict) -> Column:
    """Code to name by a small fixed table; unknown codes give null."""
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


# --- fixed values: the legend sentence ---
def legend(cols: Column, rows: Column) -> Column:
    last = letter(rows - 1)
    c, r = cols.cast("string"), rows.cast("string")
    return F.concat(
        F.lit("A yellow coordinate grid is overlaid on the video. Its ROWS are labelled A-"),
        last, F.lit(" from top to bottom ("), r,
        F.lit(" rows) and its COLUMNS are labelled 1-"), c, F.lit(" from left to right ("), c,
        F.lit(" columns). A cell is named <row-letter><column-number>, e.g. B2 is row B, "
              "column 2.\n\n"))


def match_key(shape: Column, seed: Column) -> Column:
    return F.concat(shape, F.lit("_s"), F.lpad(seed.cast("string"), 3, "0"))


def canonical_match(match: Column) -> Column:
    """One name per actual match: shape aliases collapse to the first name."""
    shape = F.regexp_extract(match, r"^(.*)_s([^_]*)$", 1)
    seed = F.regexp_extract(match, r"^(.*)_s([^_]*)$", 2)
    known = shape
    for alias, first in C.SHAPE_ALIASES.items():
        known = F.when(shape == alias, F.lit(first)).otherwise(known)
    return F.concat(known, F.lit("_s"), seed)


def item_id(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 10)
