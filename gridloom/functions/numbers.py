"""Lenient numeric parsing used by checks and gold scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.text import strip

# Suffix letters and their factors.
SUFFIX_FACTORS = {"k": 1e3, "m": 1e6, "b": 1e9}

_GOLD_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)\s*([kmb])?"


def check_number(text: Column) -> Column:
    """Commas dropped, white space stripped, then a plain double; null when it is not one."""
    bare = strip(F.replace(text, F.lit(","), F.lit("")))
    return F.when(bare.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), bare.try_cast("double"))


def gold_number(text: Column) -> Column:
    """First number in the text, with ``$``, ``usd``, commas and a final ``%`` removed and k/m/b applied."""
    bare = F.lower(strip(text))
    for noise in (",", "$", "usd"):
        bare = F.replace(bare, F.lit(noise), F.lit(""))
    bare = F.when(bare.endswith("%"), strip(F.regexp_replace(bare, "%$", ""))).otherwise(bare)
    digits = F.regexp_extract(bare, _GOLD_NUMBER, 1)
    suffix = F.regexp_extract(bare, _GOLD_NUMBER, 2)
    factor = F.lit(1.0)
    for letter, value in SUFFIX_FACTORS.items():
        factor = F.when(suffix == letter, F.lit(value)).otherwise(factor)
    return F.when(digits != "", digits.try_cast("double") * factor)
