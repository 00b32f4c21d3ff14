"""A1 notation <-> numeric bounds, as Column expressions and as driver-side helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The size of a spreadsheet grid.

_RANGE_TEXT = re.compile(r"^\$?([A-Za-z]{1,3})\$?(\d+)(?::\$?([A-Za-z]{1,3})\$?(\d+))?$")

_CELL_PATTERN = r"^\$?([A-Z]{1,3})\$?([0-9]+)$"
_DIGITS, _LETTERS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RANGE_PATTERN = r"^\$?([A-Z]{1,3})\$?([0-9]+)(?::\$?([A-Z]{1,3})\$?([0-9]+))?$"


def letters_to_number(letters: str) -> int:
    total = 0
    for ch in letters.upper():
        total = total * 26 + ord(ch) - 64
    return total


def number_to_letters(number: int) -> str:
    out = ""
    while number > 0:
        number, rest = divmod(number - 1, 26)
        out = chr(65 + rest) + out
    return out


def parse_range(text: str) -> tuple[int, int, int, int]:
    """``B2:D50`` -> (min_row, min_col, max_row, max_col); a single cell is a 1x1 range."""
    found = _RANGE_TEXT.match(text.strip())
    if not found:
        raise ValueError(f"invalid_range: {text!r}")
    c1, r1, c2, r2 = found.groups()
    c2, r2 = c2 or c1, r2 or r1
    cols = sorted((letters_to_number(c1), letters_to_number(c2)))
    rows = sorted((int(r1), int(r2)))
    return rows[0], cols[0], rows[1], cols[1]


def col_number(letters: Column) -> Column:
    """Column letters (up to three) to a 1-based number."""
    up = F.upper(letters)
    padded = F.lpad(up, 3, "@")  # the character before A
    digit = lambda pos: F.ascii(F.substr(padded, F.lit(pos), F.lit(1))) - 64
    return F.when(F.length(up).between(1, 3), digit(1) * 676 + digit(2) * 26 + digit(3)).cast("int")


def col_letters(number: Column) -> Column:
    """1-based column number (at most 18278 = ZZZ) to letters."""
    n = number.cast("int")
    letter = lambda v: F.char(v + F.lit(65))
    one = n - 1
    two = n - 27
    three = n - 703
    return (
        F.when(n <= 26, letter(one))
        .when(n <= 702, F.concat(letter(_div(two, 26)), letter(two % 26)))
        .otherwise(
            F.concat(letter(_div(three, 676)), letter(_div(three, 26) % 26), letter(three % 26))
        )
    )


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by)).cast("int")


def cell_a1(r: Column, c: Column) -> Column:
    return F.concat(col_letters(c), r.cast("string"))


def bounds_a1(min_r: Column, min_c: Column, max_r: Column, max_c: Column) -> Column:
    return F.concat(cell_a1(min_r, min_c), F.lit(":"), cell_a1(max_r, max_c))


def cell_ref(text: Column) -> tuple[Column, Column]:
    """(row, column) of a single-cell reference; nulls when the text is not one."""
    up = F.upper(text)
    ok = up.rlike(_CELL_PATTERN)
    row = F.when(ok, F.regexp_extract(up, _CELL_PATTERN, 2).cast("long"))
    col = F.when(ok, col_number(F.regexp_extract(up, _CELL_PATTERN, 1)))
    return row, col


def range_hit(text: Column) -> Column:
    """A cell or range reference in capitals, without $; empty when malformed."""
    return F.replace(F.regexp_extract(F.upper(text), _RANGE_PATTERN, 0), F.lit("$"), F.lit(""))


def hit_bounds(hit: Column) -> Column:
    """Struct(min_r, min_c, max_r, max_c) of what ``range_hit`` gives; null when that is empty. Needs no pattern."""
    ends = [F.substring_index(hit, ":", 1), F.substring_index(hit, ":", -1)]  # the same for a single cell
    (c1, r1), (c2, r2) = [
        (col_number(F.rtrim(end, F.lit(_DIGITS))), F.ltrim(end, F.lit(_LETTERS)).cast("long")) for end in ends]
    return F.when(
        hit != "",
        F.struct(
            F.least(r1, r2).alias("min_r"),
            F.least(c1, c2).alias("min_c"),
            F.greatest(r1, r2).alias("max_r"),
            F.greatest(c1, c2).alias("max_c"),
        ),
    )


def range_bounds(text: Column) -> Column:
    """Struct(min_r, min_c, max_r, max_c) of a cell or range reference; null when malformed."""
    return hit_bounds(range_hit(text))


def source_ref(file_name: Column, sheet: Column, bounds: Column) -> Column:
    """``file#'sheet'!A1:B2`` with single quotes in the sheet name doubled."""
    quoted = F.replace(sheet, F.lit("'"), F.lit("''"))
    return F.concat(file_name, F.lit("#'"), quoted, F.lit("'!"), bounds)
