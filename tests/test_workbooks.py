import zipfile

from gridloom.lake import Lake

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'

SHEET = f"""<worksheet {NS}><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><r><t>Am</t></r><r><t>ount</t></r></is></c><c r="C1" t="s"><v>1</v></c></row>
<row r="2"><c r="A2" s="1"><v>45658</v></c><c r="B2"><v>100</v></c><c r="C2"><f t="shared" ref="C2:C3" si="0">B2*$B$1</f><v>7</v></c></row>
<row r="3"><c r="A3" s="1"><v>45659.5</v></c><c r="B3"><v>2.50</v></c><c r="C3"><f t="shared" si="0"/></c></row>
<row r="4"><c r="A4" t="b"><v>1</v></c><c r="B4" t="e"><v>#DIV/0!</v></c><c r="C4"><f t="array" ref="C4">SUM(B2:B3)</f><v>102.5</v></c></row>
</sheetData><sheetProtection sheet="1"/><mergeCells count="1"><mergeCell ref="E1:F2"/></mergeCells>
<hyperlinks><hyperlink ref="B2" r:id="rId1"/></hyperlinks></worksheet>"""


def write_book(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS}><sheets><sheet name="Led ger" sheetId="1" r:id="rId1"/><sheet name="Hid" sheetId="2" state="hidden" r:id="rId2"/></sheets>'
                   "<definedNames><definedName name=\"Spend\">'Led ger'!$B$2:$B$3</definedName></definedNames></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships {PKG}><Relationship Id="rId1" Type="{REL}/worksheet" Target="worksheets/sheet1.xml"/>'
                   f'<Relationship Id="rId2" Type="{REL}/worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}><si><t>Date</t></si><si><t>Calc</t><rPh><t>x</t></rPh></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", f'<Relationships {PKG}><Relationship Id="rId1" Type="{REL}/hyperlink" Target="http://x.test" TargetMode="External"/>'
                   f'<Relationship Id="rId2" Type="{REL}/comments" Target="../comments1.xml"/><Relationship Id="rId3" Type="{REL}/table" Target="../tables/table1.xml"/></Relationships>')
        z.writestr("xl/comments1.xml", f'<comments {NS}><commentList><comment ref="B3"><text><t>check me</t></text></comment></commentList></comments>')
        z.writestr("xl/tables/table1.xml", f'<table {NS} displayName="Book" ref="A1:C3"/>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet {NS}><sheetData><row><c><v>5</v></c></row></sheetData></worksheet>')


def test_scan_folder(spark, tmp_path):
    (tmp_path / "lake").mkdir()
    write_book(tmp_path / "lake" / "book.xlsx")
    (tmp_path / "lake" / "broken.xlsx").write_bytes(b"not a zip")
    lake = Lake.from_workbooks(spark, str(tmp_path / "lake"))
    cells = {(r["sheet"], r["r"], r["c"]): r for r in lake.cells.collect()}
    at = lambda r, c: cells["Led ger", r, c]
    assert (at(1, 1)["raw_text"], at(1, 2)["raw_text"], at(1, 3)["raw_text"]) == ("Date", "Amount", "Calc")
    assert (at(2, 1)["raw_kind"], at(2, 1)["val_text"]) == ("date", "2025-01-01T00:00:00")
    assert at(3, 1)["raw_text"] == "2025-01-02 12:00:00"
    assert (at(2, 2)["raw_kind"], at(3, 2)["raw_kind"], at(3, 2)["raw_num"]) == ("int", "float", 2.5)
    assert (at(2, 3)["formula"], at(2, 3)["val_num"], at(3, 3)["formula"], at(3, 3)["val_kind"]) == ("=B2*$B$1", 7.0, "=B3*$B$1", None)
    assert (at(4, 1)["val_bool"], at(4, 2)["raw_text"], at(4, 3)["raw_kind"], at(4, 3)["val_num"]) == (True, "#DIV/0!", "array_formula", 102.5)
    assert at(3, 2)["comment"] == "check me" and at(2, 2)["hyperlink"] == "http://x.test"
    assert cells["Hid", 1, 1]["raw_num"] == 5.0
    assert [r["workbook"].rsplit("/", 1)[1] for r in lake.scan.errors.collect()] == ["broken.xlsx"]
    profile = {r["sheet"]: r for r in lake.profile.collect()}
    ledger = profile["Led ger"]
    assert (ledger["formula_count"], ledger["named_ranges"], ledger["excel_tables"], ledger["merged_ranges_sample"]) == (2, ["Spend"], ["Book"], ["E1:F2"])
    assert profile["Hid"]["hidden"] and not ledger["hidden"]
    read = lake.read(ledger["workbook"], "Led ger", "E2:G2", ("values", "merged")).first()
    assert [x["merged"] for x in read["cells"]] == [True, True, False]
