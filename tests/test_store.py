"""Saved lakes: versions, what survives an edit, reuse by later sessions, refusals."""

import os

import pytest
from pyspark.sql import functions as F

from gridloom import Lake
from gridloom.functions.sql_guard import GuardError
from gridloom.operators import structure
from gridloom.sources.store import LakeStore
from tests.test_verdict import DATA, cell, write_book

LOCKED = DATA + '<sheetProtection sheet="1"/><mergeCells><mergeCell ref="A2:A3"/></mergeCells>'


@pytest.fixture
def books(tmp_path):
    write_book(tmp_path / "a.xlsx", {"Data": LOCKED, "Empty": "<sheetData/>"}, extra="<definedNames><definedName name=\"Top\">Data!A1</definedName></definedNames>")
    write_book(tmp_path / "b.xlsx", {"Data": DATA})
    return tmp_path


def url(path):
    return f"file://{path}"


def stamp(path, seconds):
    os.utime(path, (seconds, seconds))


def no_discovery(monkeypatch):
    def refuse(self):
        raise AssertionError("discovered again")
    monkeypatch.setattr(structure.Structure, "runs", property(refuse))


def test_an_emptied_sheet_keeps_its_protection(spark, books, tmp_path):
    lake = Lake.from_workbooks(spark, url(books / "a.xlsx"))
    book = lake.cells.first()["workbook"]
    done = lake.edit([{"type": "clear_range", "sheet": "Data", "range": "A1:B9"}], str(tmp_path / "out"), book)
    again = Lake.open(spark, done["committed"])
    assert again.cells.isEmpty()
    assert sorted((r.sheet, r.bounds) for r in again.sheets().collect()) == [("Data", "A1:A1"), ("Empty", "A1:A1")]
    assert again.profile.where("sheet = 'Data'").first()["merged_ranges_count"] == 1 and again.scan.names.first()["name"] == "Top"
    told = again.edit([{"type": "set_values", "sheet": "Data", "start": "A2", "values": [["x"]]}], workbook=book)
    assert sorted(r.warning for r in told["warnings"].collect()) == ["Data is protected.", "Data!A2:A2 intersects merged cells."]
    assert told["committed"] == again.store.root
    last = Lake.open(spark, again.store.root)
    assert [r.raw_text for r in last.cells.collect()] == ["x"] and last.store.version == 2
    # Versions that were replaced are still on disk, and not read.
    assert last.store.history.count() == 2


def test_staged_batches_wait_for_their_commit(spark, grid, tmp_path):
    root = str(tmp_path / "lake")
    Lake(grid({"S": {"A1": "Vendor", "B1": "Amount", "A2": "x", "B2": 1}})).save(root)
    found = Lake.open(spark, root).stage([{"type": "set_values", "sheet": "S", "start": "B2", "values": [[2]]}], "book.xlsx")
    later = Lake.open(spark, root)  # any later session
    assert [tuple(r) for r in later.staged(found)["changes"].select("cell", "before", "after").collect()] == [("B2", "1", "2")]
    assert later.commit(found) == root
    # What was shown is kept as it was shown, and the old snapshot cannot overwrite the new version.
    assert [tuple(r) for r in later.staged(found)["changes"].select("before", "after").collect()] == [("1", "2")]
    with pytest.raises(GuardError, match="version_conflict"):
        later.commit(found)
    with pytest.raises(GuardError, match="staged_not_found"):
        later.staged("s123")
    bad = later.stage([{"type": "set_values", "sheet": "None", "start": "B2", "values": [[2]]}], "book.xlsx")
    assert not later.staged(bad)["ok"]
    with pytest.raises(GuardError, match="rejected_operations"):
        later.commit(bad)


def test_a_later_session_discovers_nothing(spark, grid, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    both = grid({"S": {"A1": "Vendor", "B1": "Amount", "A2": "x", "B2": 1}}, "one").unionByName(
        grid({"S": {"A1": "Vendor", "B1": "Amount", "A2": "y", "B2": 2}}, "two"))
    sql = "select * from s_ledger_1 order by vendor"
    want = Lake(both).save(root).query(sql).rows
    assert [(r["vendor"], r["amount"], r["workbook"]) for r in want] == [("x", 1, "one"), ("y", 2, "two")]
    assert Lake(both).query(sql).rows == want  # the same without a store
    with monkeypatch.context() as patch:
        no_discovery(patch)
        assert Lake.open(spark, root).query(sql).rows == want
    # A new version of one workbook: only that one is discovered, and its column turns into text for all.
    Lake.open(spark, root).edit([{"type": "set_values", "sheet": "S", "start": "B2", "values": [["many"]]}], workbook="two")
    assert [(r["vendor"], r["amount"]) for r in Lake.open(spark, root).query(sql).rows] == [("x", "1"), ("y", "many")]
    with monkeypatch.context() as patch:
        no_discovery(patch)
        assert [(r["vendor"], r["amount"]) for r in Lake.open(spark, root).query(sql).rows] == [("x", "1"), ("y", "many")]
    assert "workbook" not in Lake.open(spark, root).query(sql, workbook="one").columns


def test_sync_scans_what_changed(spark, books, tmp_path, monkeypatch):
    root = str(tmp_path / "lake")
    sql = "select vendor, count(*) as n from data_ledger_1 group by vendor order by vendor"
    counts = lambda: [(r["vendor"], r["n"]) for r in Lake.sync(spark, url(books), root).query(sql).rows]
    assert counts() == [("Acme", 2), ("Beta", 2)]
    first = LakeStore.at(spark, root).version
    assert counts() == [("Acme", 2), ("Beta", 2)] and LakeStore.at(spark, root).version == first
    write_book(books / "b.xlsx", {"Data": DATA.replace("Acme", "Gamma")})
    stamp(books / "b.xlsx", 2_000_000_000)
    assert counts() == [("Acme", 1), ("Beta", 2), ("Gamma", 1)] and LakeStore.at(spark, root).version == first + 1
    os.replace(books / "a.xlsx", tmp_path / "a.old")
    assert counts() == [("Beta", 1), ("Gamma", 1)]
    assert Lake.open(spark, root).sheets().count() == 1


def test_outputs_are_not_written_over(spark, grid, tmp_path):
    lake = Lake(grid({"S": {"A1": "a"}}, "one").unionByName(grid({"S": {"A1": "b"}}, "two")))
    write = lambda book, text: [{"type": "set_values", "sheet": "S", "start": "A1", "values": [[text]]}]
    out = str(tmp_path / "out")
    lake.edit(write("one", "x"), out, "one")
    with pytest.raises(GuardError, match="output_exists"):
        lake.edit(write("two", "y"), out, "two")
    lake.edit(write("two", "y"), out, "two", overwrite=True)
    assert [(r.workbook, r.raw_text) for r in Lake.open(spark, out).cells.collect()] == [("two", "y")]
    (tmp_path / "other").mkdir()
    with pytest.raises(GuardError, match="output_exists"):
        lake.edit(write("two", "y"), str(tmp_path / "other"), "two", overwrite=True)
    with pytest.raises(GuardError, match="output_exists"):
        lake.save(out)
    with pytest.raises(GuardError, match="lake_not_found"):
        Lake.open(spark, str(tmp_path / "nothing"))


def test_edits_read_their_workbooks_only(spark, grid, tmp_path):
    from gridloom.sources.store import of_books
    lake = Lake(grid({"S": {"A1": "a"}}, "one").unionByName(grid({"S": {"A1": "b"}}, "two"))).save(str(tmp_path / "lake"))
    asked = spark.createDataFrame([("one",)], "workbook string")
    plan = of_books(lake.cells, asked)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(workbook,one)" in plan or "In(workbook, [one])" in plan
    assert of_books(lake.cells, asked).count() == 1


def test_a_torn_commit_is_not_seen(spark, grid, tmp_path):
    root = str(tmp_path / "lake")
    lake = Lake(grid({"S": {"A1": "a"}})).save(root)
    lake.cells.withColumn("raw_text", F.lit("torn")).write.parquet(f"{root}/commit=ctorn")
    assert [r.raw_text for r in Lake.open(spark, root).cells.collect()] == ["a"]


def test_cells_read_as_parquet(spark, grid, tmp_path):
    out = str(tmp_path / "out")
    Lake(grid({"S": {"A1": "a", "B2": 5}})).save(out)
    assert spark.read.parquet(out).count() == 2
    assert cell("A1", "x").startswith("<c")


def test_derived_columns_are_worked_out_when_read(spark, grid, tmp_path):
    """A query that names no derived column parses no text; one that does gets the same values from a saved lake and a fresh one."""
    texts = ["5%", "\n=A1*5", "10-30%", "0,25", "n/a", "от 11% до 80%", "7", None]
    cells = grid({"Fees": {"A1": "id", "B1": "fee_rate", **{f"A{i}": i for i in range(2, 10)}, **{f"B{i}": t for i, t in enumerate(texts, 2) if t}}})
    cells = cells.withColumns({"raw_kind": F.when(F.col("raw_text").startswith("="), "text").otherwise(F.col("raw_kind")), "formula": F.lit(None).cast("string")})
    cells = cells.withColumns({"val_kind": F.coalesce("val_kind", "raw_kind"), "val_text": F.coalesce("val_text", "raw_text")})
    name = Lake(cells).regions.first()["table_name"]
    ask = f"select id, fee_rate__kind as k, round(fee_rate__num, 4) as n, fee_rate__min as lo, fee_rate__max as hi from {name}"
    want = {2: ("percent", 0.05, 0.05, 0.05), 3: ("formula", None, None, None), 4: ("range", None, 0.1, 0.3), 5: ("number", 0.25, 0.25, 0.25), 6: ("other", None, None, None),
            7: ("range", None, 0.11, 0.8), 8: ("percent", 0.07, 0.07, 0.07), 9: ("empty", None, None, None)}
    saved = Lake(cells).save(url(tmp_path / "lake"))
    for lake in (Lake(cells), saved):
        assert {int(r.id): (r.k, r.n, r.lo, r.hi) for r in lake.sql(ask).collect()} == want
        plain = lake.sql(f"select id, fee_rate from {name}")
        assert "regexp_extract_all" not in plain._jdf.queryExecution().optimizedPlan().toString() and plain.count() == 8
    stored = spark.read.option("recursiveFileLookup", "true").parquet(url(tmp_path / "lake/_views"))
    assert not [c for c in stored.columns if "__" in c]


def test_moments_print_as_before(spark):
    rows = spark.sql("select explode(array(timestamp'2024-01-02 03:04:05', timestamp'0999-12-31 00:00:00.000120', timestamp'1900-06-07 08:09:10.5', timestamp'+12345-01-02 03:04:05')) as t")
    from gridloom.functions import text as tx

    got = rows.select(tx.iso_timestamp(F.col("t")).alias("i"), tx.spaced_timestamp(F.col("t")).alias("s"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("w")).collect()
    assert [r.i for r in got] == ["2024-01-02T03:04:05", "0999-12-31T00:00:00.000120", "1900-06-07T08:09:10.500000", got[3].w]
    assert [r.s for r in got] == [r.i.replace("T", " ") for r in got]
