"""Circular references and traces that read what they reach."""

import random

import pytest

from gridloom import Lake
from gridloom.operators import lineage
from gridloom.operators.lineage import LineageGraph, strong_components
from gridloom.plans import lineage as plans


def plain_components(edges):
    reach = {}
    nodes = {x for e in edges for x in e}
    for n in nodes:
        seen, todo = set(), [n]
        while todo:
            for a, b in edges:
                if a == (x := todo[-1]) and b not in seen:
                    seen.add(b)
                    todo.append(b)
                    break
            else:
                todo.pop()
        reach[n] = seen
    return {(n, min(m for m in nodes if m in reach[n] and n in reach[m])) for n in nodes if n in reach[n]}


GRAPHS = {
    "ring and self": [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "d"), ("e", "a")],
    "chains between": [("a", "b"), ("a", "x1"), ("x1", "x2"), ("x2", "b"), ("b", "y1"), ("y1", "y2"), ("y2", "y3"), ("y3", "a"), ("b", "z1"), ("z1", "z2"), ("z2", "q"), ("q", "r"), ("r", "q"), ("q", "q")],
    "no cycle": [("a", "b"), ("b", "c"), ("a", "c")],
    "long ring": [(f"n{i:03}", f"n{(i + 1) % 150:03}") for i in range(150)],
    "two on a chain": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e")],
}


@pytest.mark.parametrize("name, core", [*[(n, 1_000) for n in GRAPHS], ("chains between", 0)])
def test_components(spark, name, core):
    edges = GRAPHS[name]
    df = spark.createDataFrame([("w", *e) for e in edges] + [("v", "a", "b")], "k string, a string, b string")
    got = strong_components(df, ["k"], core).collect()
    assert {(r.node, r.root) for r in got} == plain_components(edges) and all(r.k == "w" for r in got)


def test_random_components(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for key in range(12):
        edges = list({(f"{rng.randrange(14):02}", f"{rng.randrange(14):02}") for _ in range(rng.randrange(5, 26))})
        rows += [(key, *e) for e in edges]
        want |= {(key, *x) for x in plain_components(edges)}
    df = spark.createDataFrame(rows, "k int, a string, b string")
    for core in (10_000, 12):  # 12: some graphs are too large for one task
        assert {(r.k, r.node, r.root) for r in strong_components(df, ["k"], core).collect()} == want


def test_cycles_of_formulas(spark, grid):
    lake = Lake(grid({"S": {"A1": "=SUM(B1:B2)", "B1": "=C1", "B2": 5, "C1": "=A1+T!A1", "E1": "=E1", "F1": "=A1"}, "T": {"A1": 5}}))
    roots = spark.createDataFrame([("book.xlsx", "S", "F1"), ("book.xlsx", "S", "E1")], "workbook string, sheet string, ref string")
    graph = LineageGraph(lake.cells, roots)
    assert sorted((r.ref, r.cycle_ref) for r in graph.cycles().collect()) == [("A1", "A1"), ("B1:B2", "A1"), ("C1", "A1"), ("E1", "E1")]
    assert {(r.root_ref, r.ref) for r in graph.reachable(None).collect()} == {("E1", "E1"), *[("F1", x) for x in ("F1", "A1", "B1:B2", "C1")], ("F1", "A1")} | {
        (r.root_ref, r.ref) for r in graph.reachable(None).where("sheet = 'T'").collect()}


def test_a_trace_reads_what_it_reaches(spark, grid, tmp_path):
    lake = Lake(grid({"S": {"A1": "=B2", "B2": "=C3", "C3": 7, **{f"Z{i}": f"=Y{i}" for i in range(1, 40)}}, "T": {"A1": "=A2"}})).save(str(tmp_path / "lake"))
    roots = spark.createDataFrame([("book.xlsx", "S", "A1")], "workbook string, sheet string, ref string")
    graph = LineageGraph(lake.cells, roots)
    assert sorted(r.ref for r in graph.trace(9).collect()) == ["A1", "B2", "C3"]
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = graph._cells_at(lineage.with_area(graph.roots))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [" in plan and "EqualTo(sheet,S)" in plan and "GreaterThanOrEqual(r,1)" in plan
    assert graph.expanded.count() == 3


def test_checks_tell_lost_precedents(spark, tmp_path, monkeypatch):
    tables = {
        "lineitem": ([(1, 1, 5), (1, 1, 4), (1, 2, 5), (2, 1, None), (3, None, 4)], "l_orderkey long, l_linenumber int, l_partkey long"),
        "orders": ([(1, 7, "x"), (2, 8, "y"), (2, 7, "z"), (3, None, "x")], "o_orderkey long, o_custkey long, o_orderpriority string"),
        "customer": ([(7, 0), (8, 0)], "c_custkey long, c_nationkey int"), "nation": ([(0, 1)], "n_nationkey int, n_regionkey int"),
        "region": ([(1, "r")], "r_regionkey int, r_name string"), "part": ([(4, "p"), (5, "q")], "p_partkey long, p_name string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    verdicts = lambda: {(r["sheet"], r["r"]): (r["n"], r["covered"]) for r in plans.lineage_checks(spark, str(tmp_path)).collect()}
    whole = {("lineitem", 9): (3, True), ("lineitem", 10): (3, True), ("lineitem", None): (3, True), ("orders", 2): (1, True), ("orders", 3): (2, True),
             ("customer", 8): (1, True), ("customer", 9): (1, True), ("nation list", 1): (1, True)}
    assert verdicts() == whole
    # All but the first reference of a formula are lost: those cells are not covered, though their first one is.
    every = lineage.formula_refs
    monkeypatch.setattr(lineage, "formula_refs", lambda cells: every(cells).where("pos = 0"))
    assert verdicts() == whole | {("lineitem", r): (1, False) for r in (9, 10, None)}
