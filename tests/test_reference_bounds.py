"""Bounds of references: odd texts, and how often a text meets the pattern."""

import random
import re

from pyspark.sql import functions as F

from gridloom.functions import a1
from gridloom.functions.references import extract_refs
from gridloom.operators import lineage


def test_bounds_of_odd_texts(spark):
    texts = ["a1", "$c$3:b2", "A1B2", "A1\n", "", None, "ABCD1", "A1:", "ZZZ99:$A$007", "A$$1", " A1", "AA10:AA10"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] and tuple(r[0]) for r in df.select(a1.range_bounds(df["t"])).collect()]
    assert got == [(1, 1, 1, 1), (2, 2, 3, 3), None, (1, 1, 1, 1), None, None, None, None, (7, 1, 99, 18278), None, None, (10, 27, 10, 27)]


def test_a_trace_meets_the_pattern_once_a_node(spark):
    nodes = spark.createDataFrame([("b", "S", "A1"), ("b", "S", "B2:C3")], "workbook string, sheet string, ref string")
    bounded = lineage.with_area(nodes)
    assert sorted((r["min_r"], r["max_c"], r["area"]) for r in bounded.collect()) == [(1, 1, 1), (2, 3, 4)]
    plan = bounded._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") + plan.count("RLIKE") == 1
    # Filters on the bounds find them stored.
    edges = lineage.LineageGraph(nodes.selectExpr("workbook", "sheet", "1L as r", "1 as c", "'=B2' as formula"), nodes)._children(nodes)
    assert "regexp_extract(upper" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_references_of_odd_formulas(spark):
    pattern = re.compile(r"(?:(?:'([^']+)'|([A-Za-z_][A-Za-z0-9_.]*))!)?(\$?[A-Z]{1,3}\$?[0-9]+(?::\$?[A-Z]{1,3}\$?[0-9]+)?)")
    rng = random.Random(7)
    parts = ["'", "!", "$", "A", "B1", "AB", "ZZZZ9", "a1", "_x.", ".", "1", ":", "+", "=", "(", " ", "é", "S", "'a b'!", "'x!y'!", "S!", "$C$3", "''", "A1!", "foo"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(9))) for _ in range(2000)]
    texts = ["='it!s'!$B$2+'nation list'!A1:B2", "=A1!foo", "=orders!B2*part!$C$3+SUM(orders!B2:C2)+B2+$B$2", "=''!A1", *["=" + t for t in texts], *texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.orderBy("i").select(extract_refs(df["t"], F.lit("own"))).collect()
    for text, (refs,) in zip(texts, got):
        want = [((m[1] or m[2] or "own"), m[3].replace("$", "")) for m in pattern.finditer(text.removeprefix("="))]
        assert [tuple(r) for r in refs] == list(dict.fromkeys(want)), text


def test_a_name_is_read_once(spark):
    # A name without a sheet mark gives no character back, which the pattern says itself.
    plan = spark.range(1).select(extract_refs(F.lit("x").cast("string"), F.lit("own")))._jdf.queryExecution().analyzed().toString()
    assert "[A-Za-z0-9_.]*+" in plan
