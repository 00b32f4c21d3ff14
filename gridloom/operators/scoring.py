"""V1-V7, L4: scoring answers against gold rows and structured answers against checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import matching as m
from gridloom.functions.numbers import check_number, gold_number


def last_of(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One row per id: the last by ``order``, or the last as stored (rows of a file keep their order)."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    kept = rows.select("id", F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row"), at.alias("_at"))
    return kept.groupBy("id").agg(F.max_by("_row", "_at").alias("_row")).select("_row.*")


def score_answers(gold: DataFrame, answers: DataFrame, order: str | None = None) -> DataFrame:
    """V7 on gold rows: pass, fail or missing per id. Of repeated ids the last one counts, in gold and answers."""
    gold = last_of(gold, order if order in gold.columns else None)
    got = last_of(answers, order if order in answers.columns else None).select("id", F.col("answer"), F.lit(True).alias("_answered"))
    joined = gold.join(got, "id", "left")
    number = gold_number(F.col("answer"))
    expected = F.col("expected").try_cast("double")
    tol = F.coalesce("tolerance", F.lit(0.0))
    accept = F.coalesce("accept", F.array("expected"))
    ok = (
        F.when(F.col("match") == "relative", m.relative_match(number, expected, tol))
        .when(F.col("match") == "absolute", m.absolute_match(number, expected, tol))
        .when(F.col("match") == "percent_or_fraction", m.percent_or_fraction_match(number, expected, tol))
        .when(F.col("match") == "enum", m.enum_match(F.col("answer"), accept))
        .when(F.col("match") == "contains_all_groups", m.all_groups_match(F.col("answer"), F.col("groups")))
        .otherwise(F.lit(False))
    )
    verdict = F.when(F.col("_answered").isNull(), "missing").when(ok, "pass").otherwise("fail")
    return joined.select("id", verdict.alias("verdict"), "expected", F.col("answer").alias("got"),
                         *[F.col(c) for c in ("source_ref",) if c in joined.columns])


def truth(text: Column) -> Column:
    """Truth of a JSON scalar read as text: true, or a number other than zero."""
    return (F.lower(text) == "true") | F.coalesce(text.try_cast("double") != 0, F.lit(False))


def score_checks(checks: DataFrame, answers: DataFrame) -> DataFrame:
    """V7 on checks. ``answers``: id, value (text), flag (boolean), values (map<string,string>),
    formula, precedents, precedent_sheets, error."""
    joined = checks.join(answers, "id", "left")
    match, tol = F.col("expect.match"), F.coalesce("expect.tol", F.lit(0.0))
    number = check_number(F.col("value"))
    expected = F.col("expect.value").try_cast("double")
    got_map = F.transform_values("values", lambda k, v: check_number(v))
    ok = (
        F.when(F.col("error").isNotNull(), F.lit(False))
        .when(match == "relative", m.relative_match(number, expected, tol))
        .when(match == "absolute", m.absolute_match(number, expected, tol))
        .when(match == "bool", m.bool_match(F.col("flag"), truth(F.col("expect.value"))))
        .when(match.isin("values", "relative_map"), m.map_match(got_map, F.col("expect.values"), tol))
        .when(match == "trace_precedent_sheet", F.array_contains("precedent_sheets", F.col("expect.precedent_sheet")))
        .when(match == "trace_formula", (F.col("formula") == F.col("expect.formula"))
              & (F.size(F.array_except("expect.precedents", "precedents")) == 0))
        .when(match == "formula_contains", m.formula_contains(F.col("formula"), F.col("expect.contains")))
        .otherwise(F.lit(False))
    )
    return joined.select("id", F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("verdict"))


def score_total(results: DataFrame) -> DataFrame:
    """passed, total and ``passed/total``."""
    totals = results.agg(F.count_if(F.col("verdict") == "pass").alias("passed"), F.count(F.lit(1)).alias("total"))
    return totals.select("passed", "total", F.concat_ws("/", F.col("passed"), F.col("total")).alias("score"))
