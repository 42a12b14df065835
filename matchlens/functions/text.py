"""Answer parsers, as Columns over whole texts.

Patterns use ASCII digits and no look-around, and [^\\n] instead of a dot, so that they mean
the same in every engine.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: patterns ---
LABELLED = r"(?i)Ball position:\s*([^\n]+)"
CELL = r"([A-Za-z])\s*[-, ]?\s*([0-9]{1,2})"
LOOSE_CELL = r"([A-Fa-f])[^0-9]{0,12}?([0-9]{1,2})"
BIN = r"(?i)col[^0-9]{0,5}([0-9])[^0-9]{0,10}row[^0-9]{0,5}([0-9])"
WHOLE_NUMBER = r"(?:^|[^\p{L}\p{N}_])([0-9]+)(?:[^\p{L}\p{N}_]|$)"
CHOICE = r"(?:^|[^\p{L}\p{N}_])([ABCD])(?:[^\p{L}\p{N}_]|$)"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _answer_part(text: Column) -> Column:
    # a plain search is much cheaper than the pattern on the long texts that have no label
    part = F.regexp_extract(text, LABELLED, 1)
    return F.when(F.lower(text).contains("ball position:") & (part != ""), part).otherwise(text)


def _cell(row: Column, col: Column, ok: Column) -> Column:
    return F.when(ok, F.struct(F.concat(row, col.cast("string")).alias("cell"),
                               row.alias("row"), col.alias("col")))


def parse_cell(text: Column, cols: int, rows: int) -> Column:
    """struct(cell, row, col) of the first in-range cell in the answer, else null."""
    last = chr(ord("A") + rows - 1)
    found = F.regexp_extract_all(_answer_part(text), F.lit(CELL), F.lit(0))

    def row(m):
        return F.upper(F.substring(m, 1, 1))

    def col(m):
        return F.regexp_extract(m, "([0-9]{1,2})$", 1).try_cast("bigint")
    fit = F.filter(found, lambda m: row(m).between("A", last) & col(m).between(1, cols))
    first = F.get(fit, F.lit(0))
    return _cell(row(first), col(first), first.isNotNull())


def parse_cell_tolerant(text: Column, cols: int, rows: int) -> Column:
    """As parse_cell, but also "row D column 5" and numeric rows ("4, 5")."""
    part = _answer_part(text)
    row = F.upper(F.regexp_extract(part, LOOSE_CELL, 1))
    col = F.regexp_extract(part, LOOSE_CELL, 2).try_cast("bigint")
    by_letter = (row != "") & col.between(1, cols)
    nums = F.regexp_extract_all(part, F.lit("([0-9]{1,2})"), F.lit(1))
    a = F.get(nums, F.lit(0)).try_cast("bigint")
    b = F.get(nums, F.lit(1)).try_cast("bigint")
    by_number = a.between(1, rows) & b.between(1, cols)
    number_row = F.char(F.lit(64) + a)
    # without a digit there is no cell, and the patterns need not walk the text
    return F.when(part.rlike("[0-9]"), F.when(by_letter, _cell(row, col, F.lit(True))).otherwise(
        _cell(number_row, b, F.coalesce(by_number, F.lit(False)))))


def parse_bin(text: Column) -> tuple[Column, Column]:
    """(col, row) of a "col.. row.." answer."""
    def part(i):
        s = F.regexp_extract(text, BIN, i)
        return F.when(s != "", s.try_cast("bigint"))
    return part(1), part(2)


def first_number(text: Column) -> Column:
    """First standalone whole number, as its digits without leading zeros; null without one.

    Digits keep numbers of any length; compare them with other numbers as text."""
    s = F.regexp_extract(text, WHOLE_NUMBER, 1)
    return F.when(s != "", F.regexp_replace(s, "^0+([0-9])", "$1"))


def first_choice(text: Column) -> Column:
    s = F.regexp_extract(F.upper(text), CHOICE, 1)
    return F.when(s != "", s)


def reasoning(text: Column) -> Column:
    """The reasoning line; without one, the whole answer on one line."""
    s = F.regexp_extract(text, r"(?i)Reasoning:\s*([^\n]+)", 1)
    return F.when(s != "", strip(s)).otherwise(F.regexp_replace(text, "\n", " "))


def shortened(text: Column, keep: int) -> Column:
    """For display beside the whole text."""
    return F.substring(text, 1, keep)


def position(text: Column) -> Column:
    s = F.regexp_extract(text, LABELLED, 1)
    return F.when(s != "", strip(s)).otherwise(F.lit("(not in expected format)"))


def between_marks(text: Column) -> Column:
    """What stands after the first "Reasoning:" and before the next "Ball position:"."""
    at = F.locate("Reasoning:", text)
    tail = F.when(at > 0, F.substring(text, at + F.lit(10), F.length(text))).otherwise(text)
    return F.regexp_replace(strip(F.substring_index(tail, "Ball position:", 1)), "\n", " ")


def is_error(text: Column) -> Column:
    return text.startswith("ERROR:")
