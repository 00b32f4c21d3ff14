"""Text rules: blank test, identifiers, number and date spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space around a value (Unicode-aware).
_EDGE_SPACE = r"(?U)^\s+|\s+$"


#: The same white space as a SQL literal, for expressions that are built as SQL text.
SPACES = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip_sql(text: str, sides: str = "both") -> str:
    return f"trim({sides} '{SPACES}' from {text})"


def strip(text: Column) -> Column:
    """Trim every kind of white space. The regex runs only when trim() leaves a candidate edge."""
    trimmed = F.trim(text)
    # First and last characters that print settle it.
    plain = F.ascii(trimmed).between(33, 126) & F.ascii(F.substring(trimmed, -1, 1)).between(33, 126)
    return F.when(plain | ~trimmed.rlike(_EDGE_SPACE), trimmed).otherwise(F.regexp_replace(trimmed, _EDGE_SPACE, ""))


def non_empty(text: Column) -> Column:
    """Not null and not white space only."""
    # A first character that prints, blanks aside, settles it; the regex is for the rest.
    plain = F.ascii(F.trim(text)).between(33, 126)
    return F.coalesce(F.when(plain, F.lit(True)).otherwise(text.rlike(r"(?U)\S")), F.lit(False))


def safe_identifier(text: Column, fallback: str | Column) -> Column:
    """Runs of non-word characters to ``_``, edges stripped, lower case, ``c_`` before a digit."""
    default = F.lit(fallback) if isinstance(fallback, str) else fallback
    # The text is named twice and every step once, so that none is worked out again for each branch. White space at the edges
    # needs no step: it ends as an underscore there.
    snake = F.lower(F.btrim(F.regexp_replace(text, r"(?U)\W+", "_"), F.lit("_")))
    word = F.when(~text.rlike(r"(?U)[\w&&[^_]]"), default).otherwise(snake)
    return F.regexp_replace(word, r"^(?U)(?=\d)", "c_")


def float_text(value: Column) -> Column:
    """Shortest decimal spelling of a double: ``1458480.0``, ``3127444.992``, ``1e-05``, ``1e+16``.

    The digits are the JVM's; only the smallest denormals differ from other printers (4.9e-324).
    """
    raw = value.cast("string")
    mag = F.abs(value)
    plain = F.regexp_replace(raw.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1)
    sign = F.when(power.startswith("-"), F.lit("-")).otherwise(F.lit("+"))
    digits = F.replace(power, F.lit("-"), F.lit(""))
    digits = F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits)
    scientific = F.concat(mantissa, F.lit("e"), sign, digits)
    return (
        # The JVM spells these without an exponent.
        F.when(((mag >= 1e-3) & (mag < 1e7)) | (mag == 0), raw)
        .when(F.isnan(value), F.lit("nan"))
        .when(mag == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((mag >= 1e-4) & (mag < 1e16), plain)
        .otherwise(scientific)
    )


def iso_timestamp(ts: Column) -> Column:
    """ISO text of a timestamp, with microseconds only when there are any."""
    return _timestamp_text(ts, "T")


def spaced_timestamp(ts: Column) -> Column:
    """The same moment as printed text: a blank instead of the ``T``."""
    return _timestamp_text(ts, " ")


def _timestamp_text(ts: Column, gap: str) -> Column:
    sep = "'T'" if gap == "T" else gap
    # The plain spelling has the same first 19 characters in years of four digits.
    whole = F.when(F.year(ts).between(1, 9999), F.translate(F.substring(ts.cast("string"), 1, 19), " ", gap)).otherwise(
        F.date_format(ts, f"yyyy-MM-dd{sep}HH:mm:ss"))
    # Tables hold moments with or without a time zone; the micros are those of either.
    return F.when(F.unix_micros(ts.cast("timestamp")) % 1_000_000 == 0, whole).otherwise(F.concat(whole, F.lit("."), F.date_format(ts, "SSSSSS")))


def normalize_text(text: Column) -> Column:
    """P10: white-space runs to one blank, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))
