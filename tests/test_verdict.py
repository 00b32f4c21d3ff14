"""Rules that hold outside the registered queries: odd files, empty sheets, guard, single cells, repeated ids, white space."""

import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom import Lake
from gridloom.functions.numbers import check_number, gold_number
from gridloom.functions.percent import parse_percent
from gridloom.functions.sql_guard import GuardError, require_read_only
from gridloom.operators import audit, edits, scoring
from gridloom.operators.checks import check_suite
from gridloom.sources.catalog import list_workbooks
from gridloom.sources.workbooks import WorkbookScan

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def write_book(path, sheets, extra=""):
    """sheets: {name: sheetData and what follows it}."""
    with zipfile.ZipFile(path, "w") as z:
        listed = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{REL}"><sheets>{listed}</sheets>{extra}</workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{REL}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, body in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {NS}>{body}</worksheet>")


def cell(at, text):
    return f'<c r="{at}" t="inlineStr"><is><t>{text}</t></is></c>'


DATA = ("<sheetData><row r=\"1\">" + cell("A1", "Vendor") + cell("B1", "Amount") + "</row><row r=\"2\">" + cell("A2", "Acme") + '<c r="B2"><v>5</v></c></row>'
        "<row r=\"3\">" + cell("A3", "Beta") + '<c r="B3"><f>B2*2</f></c></row></sheetData>')


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    (root / "sub").mkdir()
    (root / ".hidden").mkdir()
    write_book(root / "a.xlsx", {"Data": DATA + '<sheetProtection sheet="1"/><mergeCells><mergeCell ref="A2:A3"/></mergeCells>', "Empty": "<sheetData/>"})
    for other in ("sub/B.XLSX", "~$a.xlsx", ".hidden/c.xlsx"):
        write_book(root / other, {"Data": DATA})
    return f"file://{root}"


@pytest.fixture(scope="module")
def lake(spark, folder):
    return Lake.from_workbooks(spark, folder)


def names(df, column):
    return sorted(r[0].rsplit("/", 1)[-1] for r in df.select(column).distinct().collect())


def test_scan_and_catalogue_take_the_same_files(spark, folder, lake):
    assert names(list_workbooks(spark, folder), "path") == names(lake.cells, "workbook") == ["B.XLSX", "a.xlsx"]


def test_known_versions_are_not_scanned_again(spark, folder):
    seen = list_workbooks(spark, folder, glob="a.xlsx")
    assert names(WorkbookScan.of_folder(spark, folder, seen).cells, "workbook") == ["B.XLSX"]


def test_empty_sheets_stay(lake, folder):
    book = f"{folder}/a.xlsx".replace("file://", "file:")
    listed = {r.sheet: r for r in lake.sheets().where(F.col("workbook").endswith("/a.xlsx")).collect()}
    assert listed["Empty"].bounds == "A1:A1" and listed["Empty"].region_count == 0 and listed["Empty"].formula_count == 0
    ranked = {r.sheet: r for r in lake.best_source().where(F.col("workbook").endswith("/a.xlsx")).collect()}
    assert ranked["Empty"].reason == "no detected regions" and ranked["Empty"].score == 0 and ranked["Data"].rank == 1
    assert lake.read(book, "Empty", "A1:B2").count() == 2
    assert lake.trace(book, "Empty", "A1").count() == 1
    with pytest.raises(GuardError, match="sheet_not_found"):
        lake.read(book, "None", "A1")


def test_uncached_formulas_are_flagged(lake, folder):
    book = f"{folder}/a.xlsx".replace("file://", "file:")
    rows = {r.r: r.cells[0] for r in lake.read(book, "Data", "B2:B3").collect()}
    assert not rows[2].unavailable and rows[3].unavailable and rows[3].value is None


def test_edit_warns_and_writes_only_its_workbook(lake, spark, folder, tmp_path):
    book = f"{folder}/a.xlsx".replace("file://", "file:")
    done = lake.edit([{"type": "clear_range", "sheet": "Data", "range": "A3:B3"}, {"type": "set_values", "sheet": "Empty", "start": "A1", "values": [["x"]]}],
                     str(tmp_path / "out"), book)
    said = sorted(r.warning for r in done["warnings"].collect())
    assert said == ["Data is protected.", "Data!A3:B3 intersects merged cells.", "Data!A3:B3 touches 1 formula cell(s)."]
    assert sorted(r.touched_range for r in done["touched"].collect()) == ["Data!A3:B3", "Empty!A1:A1"]
    out = spark.read.parquet(done["committed"])
    assert names(out, "workbook") == ["a.xlsx"] and {(r.sheet, r.r, r.c) for r in out.collect()} == {
        ("Data", 1, 1), ("Data", 1, 2), ("Data", 2, 1), ("Data", 2, 2), ("Empty", 1, 1)}


def test_default_output_is_next_to_the_workbook(lake, spark, folder):
    book = f"{folder}/sub/B.XLSX".replace("file://", "file:")
    done = lake.edit([{"type": "set_values", "sheet": "Data", "start": "A9", "values": [[1]]}], workbook=book)
    assert done["committed"] == book + ".updated" and spark.read.parquet(done["committed"]).count() == 7


@pytest.mark.parametrize("op", [
    {"type": "set_values", "start": "A1:B2", "values": [["x"]]}, {"type": "set_formula", "cell": "A1:B2", "formula": "=A1"},
    {"type": "copy_range", "source": "A1:A2", "target": "C1:D2"}])
def test_one_cell_where_one_is_asked_for(spark, grid, op):
    cells = grid({"S": {"A1": "a", "A2": "b"}})
    staged = edits.stage(edits.edits_frame(spark, "book.xlsx", [{**op, "sheet": "S"}]), cells)
    assert [r.code for r in edits.rejected(staged).collect()] == ["invalid_operation"]


def test_formula_labels_make_a_summary(grid):
    lake = Lake(grid({"S": {"A1": "Item", "B1": "Jan cost", "C1": "Feb cost", "D1": "Mar cost", "E1": "Q cost",
                            **{f"A{i}": f"=Total!A{i}" for i in range(2, 12)}, **{f"{c}{i}": i for i in range(2, 12) for c in "BCDE"}}}))
    assert lake.best_source().first().reason.startswith("summary")


SIDE_DOORS = [
    "select transform(1) using 'echo hi' as (x string)", "select transform(1) using /* x */ 'echo'", "select reflect('java.lang.System', 'getenv')",
    "select `reflect` ('a', 'b')", "select java_method('a', 'b') from t", "select try_reflect--x\n('a')", "select * from parquet.`/etc/x`",
    "select * from \"csv\" . \"/etc/x\"", "select * from t, json.`/x`", "select * from other.t", "select 1 from t join other.t2 on true",
    "select * from identifier('parquet.`/x`')",
    "select 1 /* /* */ ' */ , reflect('java.lang.System', 'getenv') -- '", "select r'\\' as x, reflect('java.lang.System', 'getenv') as y, '' as z",
    "select sum(a) over w from t window w as (order by reflect('a', 'b'))", "select a from t where exists (select reflect('a', 'b'))",
    "select system.builtin.reflect('a', 'b')", "select 1 from t lateral view reflect('a', 'b') x", "select * from t version as of 1",
    "select input_file_name() from t", "select :x", "select * from read_files('/etc')", "select a from t order by java_method('a', 'b') limit 1",
    "with c as (select reflect('a', 'b') as x) select 1", "select transform(array(1), x -> reflect('a', 'b'))", "select aes_decrypt(a, b) from t"]


@pytest.mark.parametrize("sql", SIDE_DOORS)
def test_side_doors_are_closed(spark, sql):
    with pytest.raises(GuardError, match="mutating_sql_rejected"):
        require_read_only(sql)


@pytest.mark.parametrize("sql", [
    "select a.x, b.y from a join b using (k) where a.t = 'using ''x'' reflect('", "with c as (select 1 as text) select c.text from c -- from x.y",
    "select transform(array(1), x -> x + 1) from t", "select \"from\" from t where s = 'from a.b'", "select extract(year from d.x) from d",
    "with recursive r(n) as (select 1 union all select n + 1 from r where n < 5) select * from r", "select * from t pivot (sum(x) for m in ('a', 'b'))",
    "select a, sum(b) filter (where c), row_number() over w from t group by rollup(a) having count(*) > 1 window w as (order by a)",
    "select * from t, lateral (select t.a + 1), lateral (select 2)", "select * from values (1, 2) as v(a, b) where a in (select x from t limit 5 offset 1)"])
def test_plain_queries_pass(spark, sql):
    assert require_read_only(sql) == sql


def test_free_tables(spark):
    from gridloom.functions.sql_guard import parsed_read_only
    free = lambda sql: parsed_read_only(sql)[1].relations
    assert free("with c as (select * from t), d as (select * from c) select * from d join E on true") == {"t", "e"}
    assert free("with t as (select * from t) select * from t") == {"t"}
    assert free("select * from (with x as (select 1) select * from x) a, x") == {"x"}
    assert free("with recursive r(n) as (select 1 union all select n + 1 from r) select n from r") == set()


def test_only_region_tables_are_answered(spark, grid):
    spark.range(3).createOrReplaceTempView("secrets")
    lake = Lake(grid({"S": {"A1": "Vendor", "B1": "Amount", "A2": "x", "B2": 1}}))
    with pytest.raises(GuardError, match="table_not_found"):
        lake.sql("select * from secrets")
    with pytest.raises(GuardError, match="table_not_found"):
        lake.sql("select * from (with secrets as (select 1) select * from secrets) a, secrets")
    assert lake.query("with secrets as (select vendor from S_LEDGER_1) select * from secrets").rows == [{"vendor": "x"}]


def test_query_limits_follow_the_caller(grid):
    lake = Lake(grid({"S": {"A1": "Vendor", "B1": "Amount", **{f"A{i}": f"v{i}" for i in range(2, 1300)}, **{f"B{i}": i for i in range(2, 1300)}}}))
    sql = "select * from s_ledger_1"
    assert lake.query(sql).truncated and lake.query(sql, limit=1200).row_count == 1200
    assert lake.query(sql, limit=None).row_count == 1298 and not lake.query(sql, limit=None).truncated
    assert "Aggregate" not in lake.sql(sql)._jdf.queryExecution().executedPlan().toString()  # stored: no pivot again
    assert lake.summary("book.xlsx", "S", "A1:CZ1300").first()["count"] == 1298
    assert lake.read("book.xlsx", "S", "A1:B1299", row_limit=None).count() == 1299


def test_one_workbook_is_discovered_alone(grid):
    both = grid({"S": {"A1": "Vendor", "B1": "Amount", "A2": "x", "B2": 1}}, "one").unionByName(
        grid({"S": {"A1": "Vendor", "B1": "Amount", "A2": "y", "B2": 2}}, "two"))
    lake = Lake(both)
    assert [r.vendor for r in lake.sql("select vendor from s_ledger_1", workbook="two").collect()] == ["y"]
    assert "regions" not in lake.structure.__dict__
    assert sorted(r.vendor for r in lake.sql("select vendor from s_ledger_1").collect()) == ["x", "y"]


def test_wide_ranges_and_deep_chains(grid):
    cells = grid({"S": {"A1": "=SUM(B1:C5000)", "B3000": "=D1", "C4999": "=D2", **{f"D{i}": f"=D{i + 1}" for i in range(1, 12)}}})
    lake = Lake(cells)
    traced = lake.trace("book.xlsx", "S", "A1", depth=2)
    assert sorted(r.ref for r in traced.collect()) == ["A1", "B1:C5000", "D1", "D2"]
    assert {r.ref: r["values"] for r in traced.collect()}["B1:C5000"] is None
    assert lake.trace("book.xlsx", "S", "A1", depth=2, range_cap=32).count() == 2
    assert lake.trace("book.xlsx", "S", "D1", depth=9).agg(F.max("depth")).first()[0] == 9


def test_the_last_answer_counts(spark):
    gold = spark.createDataFrame([("a", "5", "absolute", 0.0, None, None), ("a", "6", "absolute", 0.0, None, None), ("b", "1", "absolute", 0.0, None, None)],
                                 "id string, expected string, match string, tolerance double, accept array<string>, groups array<array<string>>").coalesce(1)
    answers = spark.createDataFrame([("a", "6", 2), ("a", "5", 1), ("b", "1", 1), ("b", "2", 5)], "id string, answer string, n int").coalesce(1)
    got = {r.id: r.verdict for r in scoring.score_answers(gold, answers, order="n").collect()}
    assert got == {"a": "pass", "b": "fail"}
    assert scoring.score_answers(gold, answers).count() == 2


def test_white_space_of_any_kind(spark):
    rows = spark.createDataFrame([("\n=A1*5",), ("\t12",), (" 7\r\n",), (" 3 %\n",)], "t string")
    got = rows.select(parse_percent("'text'", "t", "cast(null as double)")["kind"].alias("k"), check_number(F.col("t")).alias("n"), gold_number(F.col("t")).alias("g")).collect()
    assert got[0].k == "formula" and got[3].k == "percent"
    assert [r.n for r in got][1:3] == [12.0, 7.0] and got[3].g == 3.0


def test_truth_of_json_scalars(spark):
    rows = spark.createDataFrame([("true",), ("1",), ("0",), ("false",), ("2.5",), (None,)], "v string")
    assert [r[0] for r in rows.select(F.coalesce(scoring.truth(F.col("v")), F.lit(False))).collect()] == [True, True, False, False, True, False]


def test_small_reads_and_open_audit_limit(spark):
    reads = spark.createDataFrame([(i, float(i), i % 3, "s") for i in range(200)], "event_id long, created_at double, n_cells long, session_id string")
    assert audit.small_reads(reads, F.col("n_cells") * 40).count() == sum(1 for i in range(200) if i % 3 * 40 <= 64)
    assert audit.latest_audit(reads).count() == 100 and audit.latest_audit(reads, limit=None).count() == 200


def test_checks_of_every_kind(grid, spark):
    lake = Lake(grid({"S": {"A1": "Vendor", "B1": "Amount", "A2": "Acme", "B2": 5, "A3": "Beta", "B3": 7}, "F": {"A1": "=SUM(S!B2:B3)+'S'!B2", "A2": 0}}))
    sql = lambda i, text, **expect: (i, dict(type="sql", sql=text), expect)
    rows = [
        sql("sql", "select sum(amount) as v from s_ledger_1", value="12", match="absolute", tol=0.0),
        sql("bad sql", "select nothing as v from s_ledger_1", value="12", match="absolute", tol=0.0),
        sql("refused", "drop table x", value="12", match="absolute", tol=0.0),
        sql("bool", "select sum(amount) > 3 as v from s_ledger_1", value="true", match="bool"),
        sql("no bool", "select sum(amount) > 30 as v from s_ledger_1", value="1", match="bool"),
        ("map", dict(type="sql_map", sql="select vendor as k, amount as v from s_ledger_1", key="k", val="v"), dict(values={"Acme": 5.0, "Beta": 7.0}, match="values", tol=0.0)),
        ("cell", dict(type="cell", sheet="S", cell="b3"), dict(value="7", match="relative", tol=0.0)),
        ("zero", dict(type="cell", sheet="F", cell="A2"), dict(value="false", match="bool")),
        ("no sheet", dict(type="cell", sheet="X", cell="B3"), dict(value="7", match="relative", tol=0.0)),
        ("formula", dict(type="formula", sheet="F", cell="$A$1"), dict(contains=["SUM", "B3"], match="formula_contains")),
        ("trace", dict(type="trace", sheet="F", cell="A1", depth=1), dict(formula="=SUM(S!B2:B3)+'S'!B2", precedents=["B2"], match="trace_formula")),
        ("sheet", dict(type="trace", sheet="F", cell="A1", depth=1), dict(precedent_sheet="S", match="trace_precedent_sheet")),
        ("shallow", dict(type="trace", sheet="F", cell="A1", depth=0), dict(precedent_sheet="S", match="trace_precedent_sheet")),
        ("odd", dict(type="magic"), dict(value="1", match="absolute"))]
    from gridloom.sources.jsonlines import CHECK_SCHEMA
    checks = spark.createDataFrame([(i, None, e, x) for i, e, x in rows], CHECK_SCHEMA)
    got = {r.id: r.verdict for r in check_suite(lake, checks, "book.xlsx").collect()}
    assert {i for i, v in got.items() if v == "fail"} == {"bad sql", "refused", "no bool", "no sheet", "shallow", "odd"} and len(got) == len(rows)


def test_diamonds_are_reached_once(grid, spark):
    from gridloom.operators.lineage import LineageGraph
    wide = {f"{c}{i}": f"=A{i + 1}+B{i + 1}" for i in range(1, 9) for c in "AB"}  # 2^8 paths, 18 nodes
    cells = Lake(grid({"S": wide})).cells
    roots = spark.createDataFrame([("book.xlsx", "S", "A1")], "workbook string, sheet string, ref string")
    graph = LineageGraph(cells, roots)
    got = {r.ref: r.depth for r in graph.reachable(12).collect()}
    assert got == {"A1": 0, **{f"{c}{i}": i - 1 for i in range(2, 10) for c in "AB"}}
    assert graph.trace(4, with_values=False).count() == 1 + 2 + 4 + 8 + 16
