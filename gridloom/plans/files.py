"""File queries (S1, S4, F1): catalogue, name suggestions, workbook scan."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from gridloom.operators.fuzzy import did_you_mean
from gridloom.plans.inputs import table
from gridloom.session import configure
from gridloom.sources.catalog import list_workbooks
from gridloom.sources.workbooks import WorkbookScan

# Parts per generated workbook: a file is one unit of work, so its size is bounded.
PARTS_PER_BOOK = 250


def catalog(spark, sf):
    """S4 over the data folder (its files are Parquet, so the suffix is given)."""
    configure(spark)
    files = list_workbooks(spark, sf, glob="*.parquet", limit=None, suffix=".parquet")
    return files.select(F.substring_index("path", "/", -1).alias("name"), "size", F.col("modified").cast("string").alias("modified"))


def suggestions(spark, sf):
    """customers as a catalogue of files, a few misspelt names."""
    names = table(spark, sf, "customer").select(F.concat(F.lit("/lake/"), F.col("c_mktsegment"), F.lit("/"), F.col("c_name"), F.lit(".xlsx")).alias("path"))
    return did_you_mean(names, ["Custmer#000000042.xlsx", "customer#00000010", "Costumer_000000077.xlsx"]).withColumn("ratio", F.round("ratio", 6))


def _minimal_books(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Smallest workbook files the scan can read: one sheet of inline strings, numbers and a formula per row."""
    for batch in batches:
        out = []
        for book, rows in zip(batch["book"], batch["rows"]):
            lines = []
            for i, x in enumerate(rows, start=2):
                lines.append(
                    f'<row r="{i}"><c r="A{i}"><v>{x["p_partkey"]}</v></c><c r="B{i}" t="inlineStr"><is><t>{escape(x["p_name"])}</t></is></c>'
                    f'<c r="C{i}"><v>{x["p_retailprice"]!r}</v></c><c r="D{i}"><f>A{i}*2</f><v>{x["p_partkey"] * 2}</v></c></row>')
            head = "".join(f'<c r="{c}1" t="inlineStr"><is><t>{t}</t></is></c>' for c, t in zip("ABCD", ("key", "name", "price", "twice")))
            ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
            rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="Parts" sheetId="1" r:id="rId1"/></sheets></workbook>')
                z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
                           f'<Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
                z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1">{head}</row>{"".join(lines)}</sheetData></worksheet>')
            out.append((f"/lake/parts_{book}.xlsx", buffer.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


def workbook_scan(spark, sf):
    """Parts written as many small workbook files, scanned back to cells."""
    part = table(spark, sf, "part")
    books = part.groupBy(F.expr(f"p_partkey div {PARTS_PER_BOOK}").alias("book")).agg(
        F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_retailprice"))).alias("rows"))
    files = books.mapInPandas(_minimal_books, "path string, content binary")
    return WorkbookScan(files).cells.select(
        "workbook", "sheet", "r", F.col("c").cast("bigint").alias("c"), "raw_kind", "raw_text", "val_kind", "val_text", "val_num")


WORKBOOK_SCAN = f"""
with p as (select *, p_partkey // {PARTS_PER_BOOK} as b, row_number() over (partition by p_partkey // {PARTS_PER_BOOK} order by p_partkey) + 1 as r from part),
m as (
  select b, r, 1 as c, 'int' as k, cast(p_partkey as varchar) as t, 'int' as vk, cast(p_partkey as varchar) as v, cast(p_partkey as double) as n from p
  union all select b, r, 2, 'text', p_name, 'text', p_name, null from p
  union all select b, r, 3, 'float', cast(p_retailprice as varchar), 'float', cast(p_retailprice as varchar), p_retailprice from p
  union all select b, r, 4, 'formula', '=A' || r || '*2', 'int', cast(p_partkey * 2 as varchar), p_partkey * 2.0 from p
  union all select b, 1, h.c, 'text', h.t, 'text', h.t, null from (select distinct b from p), (values (1, 'key'), (2, 'name'), (3, 'price'), (4, 'twice')) h(c, t))
select '/lake/parts_' || b || '.xlsx' as workbook, 'Parts' as sheet, r, cast(c as bigint) as c, k as raw_kind, t as raw_text, vk as val_kind, v as val_text,
  cast(n as double) as val_num from m
"""

QUERIES = {"catalog": catalog, "did_you_mean": suggestions, "workbook_scan": workbook_scan}
ORACLES = {"workbook_scan": WORKBOOK_SCAN}
