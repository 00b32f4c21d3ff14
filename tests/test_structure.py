import random

from pyspark.sql import functions as F

from gridloom.lake import Lake
from gridloom.operators.structure import Structure
from gridloom.operators import ranges

LEDGER = {
    "Transactions": {
        "A1": "Date", "B1": "Vendor", "C1": "Category", "D1": "Amount", "A2": "2026-01-01", "B2": "Acme", "C2": "Software", "D2": 100,
        "A3": "2026-01-03", "B3": "Beta", "C3": "Marketing", "D3": 250, "A4": "2026-01-10", "B4": "Acme", "C4": "Software", "D4": 150,
        "F1": "Metric", "G1": "Value", "F2": "Total", "G2": "=SUM(D2:D4)"},
    "Summary": {"A1": "Category", "B1": "Budget", "A2": "Software", "B2": 500, "A3": "Marketing", "B3": 400},
}


def test_ledger_book(grid):
    lake = Lake(grid(LEDGER))
    regions = {(r["sheet"], r["bounds"]): r for r in lake.regions.collect()}
    # A side block keeps the full height of its row band.
    assert set(regions) == {("Transactions", "A1:D4"), ("Transactions", "F1:G4"), ("Summary", "A1:B3")}
    ledger = regions["Transactions", "A1:D4"]
    assert (ledger["table_name"], ledger["region_kind"], ledger["header_row"], ledger["row_count"]) == ("transactions_ledger_1", "ledger", 1, 3)
    assert [c["type"] for c in ledger["columns"]] == ["text", "text", "text", "integer"]
    assert ledger["source_ref"] == "book.xlsx#'Transactions'!A1:D4"
    got = lake.query('select sum(amount) as total from "transactions_ledger_1" where vendor = \'Acme\'')
    assert got.rows == [{"total": 250.0}] and not got.truncated
    capped = lake.query("select vendor from transactions_ledger_1", limit=1)
    assert capped.truncated and capped.row_count == 1
    profile = {r["sheet"]: r for r in lake.profile.collect()}
    assert profile["Transactions"]["formula_count"] == 1 and profile["Transactions"]["region_count"] == 2
    assert lake.query("select 1 as one").rows == [{"one": 1}]
    assert [r["sheet"] for r in lake.best_source().orderBy("rank").collect()] == ["Transactions", "Summary"]


def test_duplicate_and_missing_headers(grid):
    cells = {"A1": "x", "B1": "x", "C1": "x_2", "D1": 0, "A2": 1, "B2": 2, "C2": 3, "D2": 4, "A3": 1.5, "B3": True, "C3": "t", "D3": 5}
    st = Structure(grid({"S": cells}))
    cols = st.columns.orderBy("idx").collect()
    # A header that reads x_2 keeps its name; the generated one gives way.
    assert [c["name"] for c in cols] == ["x", "x_2_c2", "x_2", "column_4"]
    assert [c["type"] for c in cols] == ["decimal", "text", "text", "integer"]
    assert [c["sql_type"] for c in cols] == ["double", "varchar", "varchar", "double"]


def test_matrix_and_year_total(grid):
    cells = {"A1": "Model", "B1": "Jan", "C1": "Feb", "D1": "Mar", "E1": "Year 2", "A3": "Revenue", "B3": 10, "C3": 20, "D3": 30, "E3": 500,
             "A4": "Costs", "B4": "n/a", "C4": 5, "E4": 1}
    lake = Lake(grid({"Rev": cells}))
    names = [r["table_name"] for r in lake.regions.orderBy("region_no").collect()]
    got = {r["line_item"]: r for r in lake.table(names[1]).collect()}
    assert got["Revenue"]["year_1_total"] == 60.0 and got["Costs"]["year_1_total"] == 5.0
    assert got["Costs"]["jan"] == "n/a" and got["Revenue"]["jan"] == "10"
    assert lake.regions.where("region_no = 2").first()["orientation"] == "matrix"


def test_regions_cover_and_do_not_depend_on_blocks(grid, spark):
    rng = random.Random(5)
    spots = {(rng.randint(1, 60), rng.randint(1, 90)) for _ in range(700)} | {(r, 3) for r in range(20, 45)}
    from gridloom.functions.a1 import number_to_letters
    cells = grid({"S": {f"{number_to_letters(c)}{r}": 1 for r, c in spots}})
    rects = [tuple(r) for r in Structure(cells, 8).rectangles.orderBy("region_no").select("min_r", "min_c", "max_r", "max_c").collect()]
    whole = [tuple(r) for r in Structure(cells).rectangles.orderBy("region_no").select("min_r", "min_c", "max_r", "max_c").collect()]
    assert rects == whole == sorted(rects)
    for r, c in spots:
        assert sum(a <= r <= b2 and b <= c <= d for a, b, b2, d in rects) == 1
    filled_rows = sorted({r for r, _ in spots})
    bands, start = [], filled_rows[0]
    for prev, cur in zip(filled_rows, filled_rows[1:] + [10**9]):
        if cur != prev + 1:
            cols = sorted({c for r, c in spots if start <= r <= prev})
            lo = cols[0]
            for p, q in zip(cols, cols[1:] + [10**9]):
                if q != p + 1:
                    bands.append((start, lo, prev, p))
                    lo = q
            start = cur
    assert rects == bands


def test_read_and_summary(grid):
    cells = grid({"D": {"B5": 100, "C5": 168.8, "D5": "x", "E5": True, "F5": 0.0, "B6": 7}})
    rows = ranges.read_range(cells, "book.xlsx", "D", "A5:B6", ("values", "formulas")).orderBy("r").collect()
    assert [[x["value"] for x in r["cells"]] for r in rows] == [[None, "100"], [None, "7"]]
    one = ranges.summarize_range(cells, "book.xlsx", "D", "B5:F6", growth=True).first()
    assert (one["count"], one["skipped"], one["min"], one["max"]) == (4, 2, 0.0, 168.8)
    assert list(one["growth_pct"]) == [68.8, -100.0, 0.0]


def test_growth_across_blocks(grid, spark):
    cells = grid({"D": {f"A{i}": i * i for i in range(1, 40)}})
    span = spark.createDataFrame([("g", "book.xlsx", "D", 1, 1, 39, 1)], "range_id string, workbook string, sheet string, min_r long, min_c int, max_r long, max_c int")
    small = ranges.RANGE_BLOCK
    try:
        ranges.range_cells.__defaults__ = (4,)
        got = [r["growth_pct"] for r in ranges.range_growth(cells, span).orderBy("r").collect()]
    finally:
        ranges.range_cells.__defaults__ = (small,)
    assert got == [round((b * b - a * a) / (a * a) * 100, 1) for a, b in zip(range(1, 39), range(2, 40))]
