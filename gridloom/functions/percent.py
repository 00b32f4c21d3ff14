"""Percent-like texts as numbers and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.text import SPACES, strip_sql

# Words in a column name that mark it as percent-like.
PERCENT_HINTS = (
    "apy", "apr", "yield", "rate", "pct", "percent", "доход", "доходность", "ставк", "процент",
)
# Fixed value: the word that means "percent" inside a text.
PERCENT_WORD = "процент"

NUMBER_PATTERN = r"\d+(?:\.\d+)?"

PERCENT_SUFFIXES = ("kind", "num", "min", "max")


def parse_percent(kind: str, text: str, num: str) -> Column:
    """Struct(kind, num, min, max) of one value.

    The arguments are SQL snippets: ``kind`` is the value kind (text/int/float/bool/date/null),
    ``text`` its spelling and ``num`` its number. Minus signs in texts are ignored: only digits are
    read.
    """
    # Each step of a text is worked out once and handed on; white space around it changes no number in it.
    marked = f"contains(s, '%') or contains(lower(s), '{PERCENT_WORD}')"
    found = (f"transform(transform(array(replace({text}, ',', '.')), s -> named_struct('m', {marked}, 'n', regexp_extract_all(s, r'{NUMBER_PATTERN}', 0))), "
             "x -> named_struct('m', x.m, 'a', cast(get(x.n, 0) as double), 'b', cast(get(x.n, 1) as double)))")
    low, high = "least(y.a, y.b)", "greatest(y.a, y.b)"
    range_scale = f"if(y.m or {high} > 1, 100.0D, 1.0D)"

    def shape(label: str, n: str, lo: str, hi: str) -> str:
        return (f"named_struct('kind', '{label}', 'num', cast({n} as double), "
                f"'min', cast({lo} as double), 'max', cast({hi} as double))")

    none = ("null", "null", "null")
    return F.expr(f"""case
        when {kind} is null or {text} = '' then {shape("empty", *none)}
        when {kind} = 'text' and contains({text}, '=') and startswith({strip_sql(text, 'leading')}, '=') then {shape("formula", *none)}
        when {kind} = 'bool' then {shape("other", *none)}
        when {kind} in ('int', 'float') then {shape("number", num, num, num)}
        else get(transform({found}, y -> case
            when y.a is null then {shape("other", *none)}
            when y.b is not null then {shape("range", "null", f"{low} / {range_scale}", f"{high} / {range_scale}")}
            when y.m or y.a > 1 then {shape("percent", *["y.a / 100.0D"] * 3)}
            else {shape("number", "y.a", "y.a", "y.a")} end), 0) end""")


def percent_usable(kind: Column, text: Column) -> Column:
    """True when parse_percent would give number, percent or range (cheap form for counting)."""
    textual = kind.isin("text", "date") & text.rlike(r"\d") & ~(text.contains("=") & F.ltrim(text, F.lit(SPACES)).startswith("="))
    return F.coalesce(kind.isin("int", "float") | textual, F.lit(False))


def percent_counted(kind: Column, text: Column) -> Column:
    """True for the values that take part in the usable share: neither null nor the empty text."""
    return F.coalesce(kind.isNotNull() & ((kind != "text") | (text != "")), F.lit(False))


def has_percent_hint(name: Column) -> Column:
    lowered = F.lower(name)
    hit = F.lit(False)
    for hint in PERCENT_HINTS:
        hit = hit | lowered.contains(hint)
    return hit


def percent_like(name: Column, usable: Column, counted: Column) -> Column:
    """Hinted name, or at least max(2, half of the counted values) usable."""
    enough = usable >= F.greatest(F.lit(2), F.floor(counted / 2))
    return has_percent_hint(name) | ((counted > 0) & enough)
