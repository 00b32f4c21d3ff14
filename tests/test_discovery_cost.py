"""Discovery reads each thing once: plans without sorted aggregates, texts spelled once, runs cut at index entries."""

import random

from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.operators import bands
from gridloom.operators.structure import Structure, header_scores
from gridloom.sources.grid import to_grid


def _cells(spark, spots):
    return spark.createDataFrame([("b", "s", r, c, "int") for r, c in spots], "workbook string, sheet string, r long, c int, raw_kind string").withColumn(
        "raw_text", F.lit("1"))


def test_runs_and_layout_match_plain_bands(spark):
    rng = random.Random(11)
    dense = {(r, 2) for r in range(60, 700)} - {(300, 2), (447, 2), (448, 2)}
    spots = dense | {(rng.randint(1, 900), rng.choice([1, 3, 5, 64, 65, 66, 128, 129, 400])) for _ in range(150)}
    rows = sorted({r for r, _ in spots})
    want, first = {}, rows[0]
    for row, after in zip(rows, rows[1:] + [10**9]):
        if after != row + 1:
            cols = sorted({c for r, c in spots if first <= r <= row})
            starts = [c for c in cols if c - 1 not in cols]
            want[first] = (row, list(zip(starts, [c for c in cols if c + 1 not in cols])))
            first = after
    for block_rows in (8, 100, 128, 65_536):
        runs = bands.row_runs(_cells(spark, spots), block_rows)
        pieces = runs.collect()
        assert {r for x in pieces for r in range(x["start"], x["end"] + 1)} == set(rows)
        # No run goes on beyond its index entry, so the index takes each as it is.
        assert all(x["start"] // 64 == x["end"] // 64 for x in pieces)
        assert {x["band_start"]: x["band_end"] for x in bands.row_bands(runs).collect()} == {k: v[0] for k, v in want.items()}
        layout = {x["band_start"]: (x["band_end"], [tuple(b) for b in x["col_bands"]]) for x in bands.band_layout(runs).collect()}
        assert layout == want


def test_runs_keep_cells_without_row_or_column(spark):
    runs = bands.row_runs(_cells(spark, [(None, 1), (None, 2), (3, None), (4, 1), (5, None), (9, None)]))
    assert sorted(map(str, ((x["band_start"], x["band_end"]) for x in bands.row_bands(runs).collect()))) == ["(3, 5)", "(9, 9)", "(None, None)"]
    layout = {x["band_start"]: (x["band_end"], [tuple(b) for b in x["col_bands"]]) for x in bands.band_layout(runs).collect()}
    assert layout == {None: (None, [(1, 2)]), 3: (5, [(1, 1)])}


def test_scores_and_head_hold_no_more_than_they_need(grid):
    structure = Structure(grid({"S": {"A1": "Name", "B1": "name ", "C1": "x" * 70, "A2": 1, "B2": "=A1", "C2": 2.5}}))
    assert not {"pct_usable", "pct_counted", "val_filled"} & set(structure.head.columns)
    scores = header_scores(structure.head)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    got = {r["r"]: round(r["score"], 6) for r in scores.collect()}
    assert got == {1: round(0.3 + 0.3 + 0.25 * 2 / 3 + 0.15 * 2 / 3, 6), 2: round(0.3 + 0.3 / 3 + 0.25 + 0.15, 6)}


def test_texts_keep_their_spelling(spark):
    values = [0.0, -0.0, 0.001, 9.999e-4, 9999999.5, 1e7, -1e7, 1e16, 1e-5, float("nan"), float("inf"), None, 123.25]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(tx.float_text(F.col("v"))).collect()] == [None if v is None else str(v) for v in values]
    texts = ["  a b ", " a\t", "é", "a ", "", "   ", "\x1fa", None]
    df = spark.createDataFrame([(v,) for v in texts], "v string")
    assert [r[0] for r in df.select(tx.strip(F.col("v"))).collect()] == ["a b", "a", "é", "a", "", "", "\x1fa", None]


def test_grid_works_texts_out_once(spark):
    df = spark.createDataFrame([(1, 2.5)], "k long, v double")
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    once = plan(df.select(tx.float_text(F.col("v")))).count("decimal(38,20)")
    assert once and plan(to_grid(df, "S", ["k"])).count("decimal(38,20)") == once
