"""Runs the extraction of many checks over one workbook of a lake, for scoring.

Cell, formula and trace checks are answered together by joins; SQL checks are one query each, as each is a text of its own.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import a1
from gridloom.functions.references import extract_refs
from gridloom.functions.sql_guard import GuardError
from gridloom.operators.scoring import score_checks, truth

#: Rows that the map of one SQL check may have.
MAP_ROWS = 1_000
ANSWERS = ("id string, value string, flag boolean, values map<string,string>, formula string, precedents array<string>, "
           "precedent_sheets array<string>, error string")


def _printed(value) -> str | None:
    return None if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def cell_answers(cells: DataFrame, sheets: DataFrame, checks: DataFrame, workbook: str) -> DataFrame:
    """Answers of cell, formula and trace checks. ``sheets``: the known (workbook, sheet) pairs."""
    at = F.upper(F.replace(F.col("extract.cell"), F.lit("$"), F.lit("")))
    row, col = a1.cell_ref(at)
    asked = checks.select("id", F.col("extract.type").alias("type"), F.col("extract.sheet").alias("sheet"), row.alias("r"), col.alias("c"),
                          F.coalesce("extract.depth", F.lit(1)).alias("depth"))
    own = cells.where(F.col("workbook") == workbook).select("sheet", "r", "c", "val_text", "val_kind", "formula")
    known = sheets.where(F.col("workbook") == workbook).select("sheet").distinct().withColumn("known", F.lit(True))
    found = asked.join(own, ["sheet", "r", "c"], "left").join(known, "sheet", "left")
    refs = F.when((F.col("type") == "trace") & (F.col("depth") > 0), F.coalesce(
        extract_refs(F.col("formula"), F.col("sheet")), F.array().cast("array<struct<sheet:string,ref:string>>")))
    error = F.when(F.col("known").isNull(), F.concat(F.lit("sheet_not_found: "), F.coalesce("sheet", F.lit("")))).when(
        F.col("r").isNull(), F.lit("invalid_cell"))
    value = F.when(F.col("type") == "cell", F.col("val_text"))
    return found.select(
        "id", value.alias("value"), F.when(F.col("type") == "cell", truth(F.col("val_text"))).alias("flag"),
        F.lit(None).cast("map<string,string>").alias("values"), F.when(F.col("type") != "cell", F.col("formula")).alias("formula"),
        F.transform(refs, lambda x: x["ref"]).alias("precedents"), F.array_sort(F.array_distinct(F.transform(refs, lambda x: x["sheet"]))).alias("precedent_sheets"),
        error.alias("error"))


def sql_answers(lake, checks: list, workbook: str | None) -> list[tuple]:
    """Answers of SQL checks, in order; a query that is refused or fails is an error of its check only."""
    out = []
    for check in checks:
        spec, value, values, error = check["extract"], None, None, None
        try:
            if spec["type"] == "sql":
                rows = lake.query(spec["sql"], workbook, limit=1).rows
                value = rows[0]["v"] if rows else None
            else:
                rows = lake.query(spec["sql"], workbook, limit=MAP_ROWS).rows
                values = {str(r[spec["key"]]): _printed(r[spec["val"]]) for r in rows}
        except (GuardError, PySparkException, KeyError) as exc:
            error = f"{type(exc).__name__}: {exc}"[:500]
        out.append((check["id"], _printed(value), bool(value), values, None, None, None, error))
    return out


def run_checks(lake, checks: DataFrame, workbook: str) -> DataFrame:
    """Answers to all checks, one row per check. Unknown kinds of checks are errors."""
    kind = F.col("extract.type")
    sheets = lake.bounds.select("workbook", "sheet")
    answers = cell_answers(lake.cells, sheets, checks.where(kind.isin("cell", "formula", "trace")), workbook)
    # The texts of the suite's SQL checks.
    asked = checks.where(kind.isin("sql", "sql_map")).select("id", "extract").collect()
    if asked:
        answers = answers.unionByName(lake.spark.createDataFrame(sql_answers(lake, asked, workbook), ANSWERS))
    other = checks.where(~F.coalesce(kind.isin("cell", "formula", "trace", "sql", "sql_map"), F.lit(False)))
    return answers.unionByName(other.select("id", F.lit("unknown extract type").alias("error")), allowMissingColumns=True)


def check_suite(lake, checks: DataFrame, workbook: str) -> DataFrame:
    """Verdict per check: extraction, then scoring."""
    return score_checks(checks, run_checks(lake, checks, workbook))
