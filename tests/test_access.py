import difflib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.operators import audit, fuzzy, joins
from gridloom.operators.fuzzy import did_you_mean
from gridloom.operators.scoring import score_answers, score_checks, score_total
from gridloom.session import cut_lineage
from gridloom.sources import jsonlines as jl
from gridloom.sources.catalog import changed_files, list_workbooks
from gridloom.sources.grid import to_grid, with_row_index
from gridloom.streaming.repeat_reads import stream_repeat_reads


def _reads():
    rng = random.Random(3)
    # One session holds most of the reads.
    return [(rng.choice(["hot", "hot", "hot", "a", "b"]), i, float(i), f"S!A{rng.randint(1, 9)}") for i in range(900)]


def _expected(memory=200):
    seen, out = defaultdict(list), {}
    for session, event, _, key in _reads():
        prior = seen[session][-memory:].count(key)
        seen[session].append(key)
        out[event] = (prior + 1, prior + 1 >= 3)
    return out


def test_repeat_reads_in_small_blocks(spark):
    df = spark.createDataFrame(_reads(), "session_id string, event_id long, created_at double, key string")
    for block in (64, 8192):
        rows = audit.repeat_reads(df, ["created_at"], F.floor(F.col("created_at") / 50), read_block=max(block, 200)).collect()
        assert {r["event_id"]: (r["times_read"], r["warn"]) for r in rows} == _expected()


def test_repeat_reads_stream(spark, tmp_path):
    df = spark.createDataFrame(_reads(), "session_id string, event_id long, created_at double, key string")
    for i in range(3):
        df.where(F.floor(F.col("event_id") / 300) == i).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
    # One folder per micro-batch, in order.
    files = sorted((tmp_path / "in").glob("b*/*.parquet"))
    (tmp_path / "feed").mkdir()
    out = {}
    for f in files:
        (tmp_path / "feed" / f"{f.parent.name}.parquet").write_bytes(f.read_bytes())
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "feed"))
        query = stream_repeat_reads(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    out = {r["event_id"]: (r["times_read"], r["warn"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert out == _expected()


def test_asof_lookup(spark):
    rng = random.Random(4)
    left = [(rng.choice("kkq"), rng.randint(0, 300), i) for i in range(120)]
    right = [(rng.choice("kkq"), rng.randint(0, 300), i, float(i)) for i in range(80)]
    l = spark.createDataFrame(left, "k string, t long, id long")
    r = spark.createDataFrame(right, "k string, t long, id long, v double")
    got = {x["id"]: x["asof_value"] for x in joins.asof_lookup(l, r, "k", "t", "v", "id").collect()}
    for k, t, i in left:
        best = [(rt, ri, v) for rk, rt, ri, v in right if rk == k and rt <= t]
        assert got[i] == (max(best)[2] if best else None)


def test_asof_ranges_carry_over(spark):
    """One key over every range, keys that end and begin at the edges, nulls, large integers, no right rows at all."""
    rng = random.Random(8)
    for keys in ("a", "ab", "abcdefgh"):
        left = [(rng.choice(keys), rng.randint(0, 400), i) for i in range(150)] + [(None, 5, 900), ("zz", 5, 901)]
        right = [(rng.choice(keys), rng.randint(0, 40), i, 2**60 + i if i % 5 else None) for i in range(30)] + [(None, 1, 99, 7)]
        l, r = spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, t long, id long, v long")
        got = {x["id"]: x["asof_value"] for x in joins.asof_lookup(l, r, "k", "t", "v", "id").collect()}
        for k, t, i in left:
            best = [(rt, ri, v) for rk, rt, ri, v in right if rk == k and rt <= t and k is not None]
            assert got[i] == (max(best, key=lambda x: x[:2])[2] if best else None)
        assert all(x["asof_value"] is None for x in joins.asof_lookup(l, r.where("false"), "k", "t", "v", "id").collect())
        assert joins.asof_lookup(l.where("false"), r, "k", "t", "v", "id").count() == 0


def test_range_lookup_of_any_width(spark):
    rng = random.Random(6)
    points = [(i, rng.choice([50.0, rng.uniform(-300, 300)])) for i in range(120)] + [(500, None), (501, float("nan"))]
    spans = [(i, a, a + rng.choice([0.0, 0.5, 3.0, 70.0, 1000.0])) for i, a in enumerate(rng.uniform(-300, 300) for _ in range(60))]
    spans += [(100, -1e300, 1e300), (101, 50.0, 50.0), (102, 5.0, 4.0), (103, None, 9.0), (104, float("-inf"), float("inf"))]
    p, s = spark.createDataFrame(points, "p long, x double"), spark.createDataFrame(spans, "s long, lo double, hi double")
    want = sorted((i, j) for i, x in points for j, a, b in spans if x is not None and a is not None and a <= x <= b)
    for hot in (100_000, 5):
        assert sorted((r.p, r.s) for r in joins.range_lookup(p, s, "x", "lo", "hi", 1.0, hot).collect()) == want
    assert joins.range_lookup(p, s.where("false"), "x", "lo", "hi", 1.0).count() == 0


def test_range_lookup_merges_points_inside_spans(spark):
    """Totals over pairs, from far fewer rows than there are pairs; crowded points, equal points, open and empty spans."""
    rng = random.Random(16)
    points = [(rng.choice([50.0, -7.25, rng.uniform(-300, 300), rng.uniform(10, 10.5)]), rng.randint(1, 9)) for _ in range(900)] + [(None, 1), (float("nan"), 1)]
    spans = [(i, a, a + rng.choice([0.0, 0.1, 3.0, 70.0, 1000.0])) for i, a in enumerate(rng.uniform(-300, 300) for _ in range(60))]
    spans += [(100, -1e300, 1e300), (101, 50.0, 50.0), (102, 5.0, 4.0), (103, None, 9.0), (104, float("-inf"), float("inf")), (105, 10.1, 10.4)]
    p, s = spark.createDataFrame(points, "x double, n long"), spark.createDataFrame(spans, "s long, lo double, hi double")
    pairs = [(j, n, x) for x, n in points for j, a, b in spans if x is not None and a is not None and a <= x <= b]
    want = {j: (sum(n for i, n, _ in pairs if i == j), max(x for i, _, x in pairs if i == j)) for j, _, _ in pairs}
    for width, hot in ((1.0, 100_000), (1.0, 3), (50.0, 100_000)):
        met = joins.range_lookup(p, s, "x", "lo", "hi", width, hot, combine={"n": "sum", "x": "max"})
        assert sorted(met.columns) == ["hi", "lo", "n", "s", "x"]
        rows = met.collect()
        assert {j: (sum(r.n for r in rows if r.s == j), max(r.x for r in rows if r.s == j)) for j in {r.s for r in rows}} == want
        assert len(rows) < len(pairs) / 5
    assert joins.range_lookup(p.where("false"), s, "x", "lo", "hi", 1.0, combine={"n": "sum"}).count() == 0
    assert joins.range_lookup(p, s.where("false"), "x", "lo", "hi", 1.0, combine={"n": "sum"}).count() == 0


def test_row_index(spark):
    keys = random.Random(5).sample(range(10**6), 700)
    df = spark.createDataFrame([(k, f"t{k:07d}") for k in keys], "k long, t string")
    for order in (["k"], ["t"], ["t", "k"]):
        rows = with_row_index(df, order, "n", buckets=7).collect()
        assert {r["k"]: r["n"] for r in rows} == {k: i for i, k in enumerate(sorted(keys), start=1)}


def test_grid_kinds(spark):
    df = spark.sql("select 1 as id, true as flag, 2.5D as x, timestamp'2024-01-02 03:04:05' as ts, date'2024-01-02' as d, cast(null as string) as gone")
    rows = {r["c"]: r for r in to_grid(df, "S", ["id"]).where("r = 2").collect()}
    assert [rows[c]["raw_kind"] for c in (1, 2, 3, 4, 5)] == ["int", "bool", "float", "date", "date"] and 6 not in rows
    assert (rows[4]["raw_text"], rows[4]["val_text"], rows[5]["val_text"]) == ("2024-01-02 03:04:05", "2024-01-02T03:04:05", "2024-01-02")


def test_did_you_mean(spark):
    names = [f"/x/Financial_Report{i}.xlsx" for i in range(30)] + ["/y/budget.xlsx", "/z/finances.xlsx", "/x/sub/Financial_Report.xlsx"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    for target in ("Financial_Reporx.xlsx", "report", "budget"):
        t = target.lower()
        scored = []
        for n in names:
            base = n.rsplit("/", 1)[1].lower()
            ratio = difflib.SequenceMatcher(None, t, base).ratio()
            if t in base or ratio >= 0.6:
                scored.append((-ratio, n))
        got = [(r["path"], r["ratio"]) for r in did_you_mean(df, [target]).orderBy("rank").collect()]
        assert got == [(n, -s) for s, n in sorted(scored)[:5]]


def test_catalogue(spark, tmp_path):
    for name in ("a.xlsx", "sub/b.XLSX", "sub/~$b.xlsx", ".git/c.xlsx", "venv/d.xlsx", "e.csv"):
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * len(name))
    root = str(tmp_path / "root")
    names = lambda df: {r["path"].split("/root/")[-1] for r in df.collect()}
    everything = list_workbooks(spark, root)
    assert names(everything) == {"a.xlsx", "sub/b.XLSX"}
    assert names(list_workbooks(spark, root, "*.csv")) == set()
    assert names(list_workbooks(spark, root, "sub/*")) == {"sub/b.XLSX"}
    assert list_workbooks(spark, root, limit=1).count() == 1
    seen = cut_lineage(everything.where("path like '%a.xlsx'"), "seen")
    assert names(changed_files(everything, seen)) == {"sub/b.XLSX"}


def test_scores(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text(
        '{"id": "a", "expected": 100, "match": "relative", "tolerance": 0.005}\n\n'
        '{"id": "b", "expected": "Sep", "match": "enum", "accept": ["sep", "month 9"]}\n'
        '{"id": "c", "expected": 2.5, "match": "percent_or_fraction", "tolerance": 0.001}\n{"id": "d", "expected": 1, "match": "absolute"}\n')
    (tmp_path / "answers.jsonl").write_text(
        '{"id": "a", "answer": "$100.4"}\n{"id": "b", "answer": "September"}\n{"id": "c", "answer": 0.3}\n')
    gold = jl.read_json_lines(spark, str(tmp_path / "gold.jsonl"), jl.GOLD_SCHEMA)
    answers = jl.read_json_lines(spark, str(tmp_path / "answers.jsonl"), jl.ANSWER_SCHEMA)
    results = score_answers(gold.where("id is not null"), answers)
    assert {r["id"]: r["verdict"] for r in results.collect()} == {"a": "pass", "b": "pass", "c": "fail", "d": "missing"}
    assert score_total(results).first()["score"] == "2/4"


def test_checks(spark, tmp_path):
    (tmp_path / "checks.jsonl").write_text(
        '{"id": "n", "expect": {"value": 1458480, "match": "relative", "tol": 0.005}}\n{"id": "t", "expect": {"value": true, "match": "bool"}}\n'
        '{"id": "m", "expect": {"values": {"a": 10, "b": 20}, "match": "values", "tol": 0.01}}\n'
        '{"id": "p", "expect": {"precedent_sheet": "P&L", "match": "trace_precedent_sheet"}}\n'
        '{"id": "f", "expect": {"formula": "=B47-B49", "precedents": ["B47", "B49"], "match": "trace_formula"}}\n'
        '{"id": "c", "expect": {"contains": ["Assumptions!B7", "*"], "match": "formula_contains"}}\n')
    checks = jl.read_json_lines(spark, str(tmp_path / "checks.jsonl"), jl.CHECK_SCHEMA)
    answers = spark.createDataFrame([
        ("n", "1,458,480", None, None, None, None, None, None), ("t", None, True, None, None, None, None, None),
        ("m", None, None, {"a": "10", "b": "30"}, None, None, None, None), ("p", None, None, None, None, None, ["P&L"], None),
        ("f", None, None, None, "=B47-B49", ["B47", "B49"], None, None), ("c", None, None, None, "=Assumptions!B7*2", None, None, None),
    ], "id string, value string, flag boolean, values map<string,string>, formula string, precedents array<string>, precedent_sheets array<string>, error string")
    assert {r["id"]: r["verdict"] for r in score_checks(checks, answers).collect()} == {
        "n": "pass", "t": "pass", "m": "fail", "p": "pass", "f": "pass", "c": "pass"}


def test_names_of_one_split_are_scored_by_many_tasks_and_few_in_full(spark, monkeypatch):
    """a catalogue of one small file gave one task, and every name was compared in full with every target."""
    names = spark.range(3000).coalesce(1).select(F.format_string("/x/customer#%09d.xlsx", F.col("id")).alias("path"))
    found = did_you_mean(names, ["Custmer#000000042.xlsx"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and plan.count("ArrowEvalPython") == 1
    target, calls = "custmer#000000042.xlsx", []
    base = [f"customer#{i:09d}.xlsx" for i in range(3000)]
    wanted = sorted((-difflib.SequenceMatcher(None, target, n).ratio(), n) for n in base)[:5]
    assert [(-r["ratio"], r["path"][3:]) for r in found.orderBy("rank").collect()] == wanted
    full = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: calls.append(1) or full(self))
    scorer = fuzzy._Scorer([target], 5)
    kept = sorted((-hit["ratio"], n) for n in base for hit in scorer.scores(n))
    assert kept[:5] == wanted and len(calls) < len(base) / 2
