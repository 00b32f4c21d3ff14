"""L1: cell and range references inside formula texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an optional 'sheet'! or sheet! prefix, then A1 or A1:B2 with optional $ signs. A name gives no character back: no
# shorter one ends before a ! or a quote.
REF_PATTERN = (
    r"(?:(?:'[^']++'|[A-Za-z_][A-Za-z0-9_.]*+)!)?"
    r"\$?[A-Z]{1,3}\$?[0-9]+(?::\$?[A-Z]{1,3}\$?[0-9]+)?"
)


def extract_refs(formula: Column, own_sheet: Column) -> Column:
    """Ordered, distinct array<struct<sheet, ref>> of the references in a formula text.

    Text literals are not stripped and whole-column references do not match.
    """
    # No reference contains the leading =, so it stays.
    hits = F.regexp_extract_all(formula, F.lit(REF_PATTERN), F.lit(0))

    def one(hit: Column) -> Column:
        last = F.substring_index(hit, "!", -1)
        # Only a quoted name may contain a ! itself.
        quoted = F.regexp_replace(F.substr(hit, F.lit(1), F.length(hit) - F.length(last) - 1), r"^'|'$", "")
        sheet = F.when(hit.startswith("'"), quoted).when(hit.contains("!"), F.substring_index(hit, "!", 1)).otherwise(own_sheet)
        return F.struct(sheet.alias("sheet"), F.replace(last, F.lit("$"), F.lit("")).alias("ref"))

    return F.array_distinct(F.transform(hits, one))
