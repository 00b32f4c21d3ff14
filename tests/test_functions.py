import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import a1, matching
from gridloom.functions import text as tx
from gridloom.functions.numbers import check_number, gold_number
from gridloom.functions.percent import parse_percent
from gridloom.functions.references import extract_refs
from gridloom.functions.sql_guard import GuardError, require_read_only, sql_verdict


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_safe_identifier(spark):
    texts = ["Выручка, %", " Total  Revenue ", "2024", "***", "a__b!", "P&L Projection"]
    assert column(spark, texts, lambda c: tx.safe_identifier(c, "column")) == [
        "выручка", "total_revenue", "c_2024", "column", "a__b", "p_l_projection"]


def test_float_text_matches_python(spark):
    values = [0.0, 1458480.0, 3127444.992, 12345678.25, 1e-4, 1.5e-5, 123456789012345.0, 1e16, -0.5, 1e22, 1e-300]
    assert column(spark, values, tx.float_text, "double") == [str(v) for v in values]


def test_non_empty(spark):
    assert column(spark, ["", "  ", " \t", "x", None], tx.non_empty) == [False, False, False, True, False]


def test_a1_round_trip(spark):
    numbers = [1, 26, 27, 52, 702, 703, 16384]
    letters = column(spark, numbers, a1.col_letters, "int")
    assert letters == [a1.number_to_letters(n) for n in numbers] == ["A", "Z", "AA", "AZ", "ZZ", "AAA", "XFD"]
    assert column(spark, letters, a1.col_number) == numbers
    assert column(spark, ["B2:D50", "$C$3", "bad", None], a1.range_bounds) == [(2, 2, 50, 4), (3, 3, 3, 3), None, None]


@pytest.mark.parametrize("text, want", [
    ("0.34", ("number", 0.34, 0.34, 0.34)), ("10-30%", ("range", None, 0.1, 0.3)), ("от 11% до 80%+", ("range", None, 0.11, 0.8)),
    ("=AVERAGE(D3:D10)", ("formula", None, None, None)), ("n/a", ("other", None, None, None)), ("", ("empty", None, None, None)),
    ("2,5 процента", ("percent", 0.025, 0.025, 0.025)), ("-7", ("percent", 0.07, 0.07, 0.07)),
])
def test_percent(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(parse_percent("'text'", "t", "null")).first()[0]
    assert got["kind"] == want[0]
    for g, w in zip(got[1:], want[1:]):
        assert g == w or math.isclose(g, w)


def test_numbers(spark):
    texts = ["$144.4k", "5 months", "12%", "USD 1,200.50", "none", "-3b"]
    assert column(spark, texts, gold_number) == [144400.0, 5e6, 12.0, 1200.5, None, -3e9]
    assert column(spark, ["1,458,480", " 2.5 ", "$3", ""], check_number) == [1458480.0, 2.5, None, None]


def test_guard(spark):
    texts = ["select 1", " WITH x as (select 1) select * from x;", "", ";", "delete from t", "select 'drop' as x", "explain select 1", "selected"]
    want = ["ok", "ok", "empty_sql", "empty_sql", "mutating_sql_rejected", "mutating_sql_rejected", "unsupported_sql", "unsupported_sql"]
    assert column(spark, texts, sql_verdict) == want
    for text, code in zip(texts, want):
        if code == "ok":
            require_read_only(text)
        else:
            with pytest.raises(GuardError) as err:
                require_read_only(text)
            assert err.value.code == code


def test_references(spark):
    formula = "=SUM('P&L Projection'!$B$7:M7)+Assumptions!B7*B11+B11-\"C3\""
    got = column(spark, [formula], lambda c: extract_refs(c, F.lit("Own")))[0]
    assert [(x["sheet"], x["ref"]) for x in got] == [("P&L Projection", "B7:M7"), ("Assumptions", "B7"), ("Own", "B11"), ("Own", "C3")]


def test_matching(spark):
    one = spark.range(1)
    pick = lambda c: one.select(c).first()[0]
    assert pick(matching.relative_match(F.lit(100.4), F.lit(100.0), F.lit(0.005)))
    assert not pick(matching.relative_match(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.5)))
    assert pick(matching.percent_or_fraction_match(F.lit(0.025), F.lit(2.5), F.lit(0.001)))
    assert pick(matching.enum_match(F.lit(" It goes UP "), F.array(F.lit("up"))))
    assert pick(matching.all_groups_match(F.lit("P&L total revenue"), F.array(F.array(F.lit("p&l")), F.array(F.lit("row 7"), F.lit("revenue")))))
    assert not pick(matching.map_match(F.create_map(F.lit("a"), F.lit(1.0)), F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0)), F.lit(0.1)))


def test_identifiers_of_odd_texts_step_by_step_and_each_step_once(spark):
    """the cleaned word stood in every branch of its rule, and its patterns ran again in each."""
    texts = [None, "", " ", "_", "\u3000a\u00a0", "__a__", "1x", "_1", "\u0663x", " 9 lives ", "\u00c9 \u00e9", "a\u200db", "$x", "Mid\u0301 x", "\\1", "\u01c59", "-1-", "x__y", "\u2028"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    strip = tx.strip(F.col("t"))
    word = F.lower(F.regexp_replace(F.regexp_replace(strip, r"(?U)\W+", "_"), r"^_+|_+$", ""))
    for default in (F.lit("column"), F.concat(F.lit("1_$"), F.col("i"))):
        filled = F.when(word == "", default).otherwise(word)
        plain = F.when(filled.rlike(r"^(?U)\d"), F.concat(F.lit("c_"), filled)).otherwise(filled)
        rows = df.select("t", tx.safe_identifier(F.col("t"), default).alias("got"), plain.alias("want")).collect()
        assert [r["got"] for r in rows] == [r["want"] for r in rows]
    plan = df.select(tx.safe_identifier(F.col("t"), "column"))._jdf.queryExecution().optimizedPlan().toString()
    plan = plan.split(" AS regexp_replace")[0]
    assert plan.count("regexp_replace(") == 2 and plan.count("RLIKE") == 1
