"""Cell scan of workbook files, many files per job, a bad file gives an error row.

Spark distributes the files and receives Arrow batches of cells; inside a task one workbook is
streamed sheet by sheet with the standard library. One pass gives formulas and stored results.
"""

from __future__ import annotations

import datetime as dt
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.a1 import letters_to_number, number_to_letters, parse_range
from gridloom.session import cut_lineage, ship_package
from gridloom.sources.catalog import changed_files, workbook_files
from gridloom.sources.grid import CELL_COLUMNS, CELL_SCHEMA

# One scan row is a cell, or one piece of workbook metadata (see ``rec``).
SCAN_SCHEMA = T.StructType([
    T.StructField("rec", T.StringType()),          # cell sheet merged name table error
    *CELL_SCHEMA.fields,
    T.StructField("text", T.StringType()),          # name, range or error text
    T.StructField("refers_to", T.StringType()),
    T.StructField("hidden", T.BooleanType()),
    T.StructField("protected", T.BooleanType()),
    T.StructField("pos", T.IntegerType()),
])
_FIELDS = SCAN_SCHEMA.fieldNames()
BATCH_ROWS = 20_000

# Built-in number formats that show dates, and the letters that mark a custom one.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}
_NOT_DATE_TEXT = re.compile(r'"[^"]*"|\\.|_.|\[(?!hh?\]|mm?\]|ss?\])[^\]]*\]')
_ELAPSED = re.compile(r"\[(hh?|mm?|ss?)\]", re.IGNORECASE)
_REF = re.compile(r"(\$?)([A-Z]{1,3})(\$?)(\d+)(?![A-Za-z0-9_(])")


def _tag(el) -> str:
    return el.tag.rsplit("}", 1)[-1]


def _rels(book: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationship id -> (kind, target part) of one part."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in book.namelist():
        return {}
    out = {}
    for el in ET.fromstring(book.read(path)):
        target = el.get("Target", "")
        if el.get("TargetMode") != "External":
            target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[el.get("Id")] = (el.get("Type", "").rsplit("/", 1)[-1], target)
    return out


def _string_of(el) -> str:
    """Text of a shared or inline string, without phonetic runs."""
    parts = []
    for child in el:
        if _tag(child) == "t":
            parts.append(child.text or "")
        elif _tag(child) == "r":
            parts += [t.text or "" for t in child if _tag(t) == "t"]
    return "".join(parts)


def _formats(book: zipfile.ZipFile) -> list[tuple[int, str]]:
    """(format id, format text) per cell style."""
    if "xl/styles.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/styles.xml"))
    codes, styles = {}, []
    for group in root:
        if _tag(group) == "numFmts":
            codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in group}
        if _tag(group) == "cellXfs":
            styles = [int(x.get("numFmtId", 0)) for x in group]
    return [(i, codes.get(i, "General" if i == 0 else "")) for i in styles]


def _is_date(fmt: tuple[int, str]) -> bool:
    if fmt[1] and fmt[1] != "General":
        return bool(re.search(r"[dmhysDMHYS]", _NOT_DATE_TEXT.sub("", fmt[1].split(";")[0])))
    return fmt[0] in _DATE_FORMATS


def _date_value(days: float, fmt: tuple[int, str], base_1904: bool):
    """(kind, printed, iso) of a serial day number."""
    if fmt[0] == 46 or _ELAPSED.search(fmt[1]):
        return "text", str(dt.timedelta(days=days)), str(dt.timedelta(days=days))
    whole, part = divmod(days, 1)
    span = dt.timedelta(milliseconds=round(part * 86_400_000))
    if 0 <= days < 1 and span.days == 0:
        moment = (dt.datetime.min + span).time()
    else:
        base = dt.datetime(1904, 1, 1) if base_1904 else dt.datetime(1899, 12, 30)
        if 0 < days < 60 and not base_1904:
            whole += 1
        moment = base + dt.timedelta(days=whole) + span
    return "date", str(moment), moment.isoformat()


def _value(kind: str, text: str | None, fmt, shared, base_1904):
    """(kind, printed text, iso text, number, flag) of a stored value; kind None when there is none."""
    if text is None:
        return None, None, None, None, None
    if kind == "s":
        text = shared[int(text)]
        return "text", text, text, None, None
    if kind in ("str", "inlineStr", "e"):
        return "text", text, text, None, None
    if kind == "b":
        flag = text.strip() == "1"
        return "bool", str(flag), str(flag), None, flag
    if kind == "d":
        return "date", text.replace("T", " "), text, None, None
    number = float(text)
    if _is_date(fmt):
        kind, printed, iso = _date_value(number, fmt, base_1904)
        return kind, printed, iso, None, None
    if re.fullmatch(r"[+-]?\d+", text.strip()):
        return "int", str(int(text)), str(int(text)), number, None
    return "float", str(number), str(number), number, None


def _moved(formula: str, down: int, right: int) -> str:
    """A shared formula at another cell: relative references move, text in quotes does not."""
    def shift(m):
        col = m[2] if m[1] else number_to_letters(max(1, letters_to_number(m[2]) + right))
        row = m[4] if m[3] else str(int(m[4]) + down)
        return f"{m[1]}{col}{m[3]}{row}"

    pieces = re.split(r'("[^"]*"|\'[^\']*\')', formula)
    return "".join(p if i % 2 else _REF.sub(shift, p) for i, p in enumerate(pieces))


def _sheet_rows(book, part, sheet, sheet_idx, hidden, formats, shared, base_1904) -> Iterator[dict]:
    rels = _rels(book, part)
    comments = {}
    for kind, target in rels.values():
        if kind == "comments" and target in book.namelist():
            for el in ET.fromstring(book.read(target)).iter():
                if _tag(el) == "comment":
                    comments[el.get("ref")] = "".join(t.text or "" for t in el.iter() if _tag(t) == "t")
        if kind == "table" and target in book.namelist():
            table = ET.fromstring(book.read(target))
            yield {"rec": "table", "text": table.get("displayName") or table.get("name"), "refers_to": table.get("ref")}
    shared_formulas: dict[str, tuple[str, int, int]] = {}
    protected, merged, links, later = False, [], {}, []
    with book.open(part) as stream:
        r, c = 0, 0
        for event, el in ET.iterparse(stream, events=("start", "end")):
            tag = _tag(el)
            if event == "start":
                if tag == "row":
                    r, c = int(el.get("r") or r + 1), 0
                continue
            if tag == "c":
                at = el.get("r")
                if at:
                    r, c, _, _ = parse_range(at)
                else:
                    c += 1
                    at = f"{number_to_letters(c)}{r}"
                style = int(el.get("s") or 0)
                fmt = formats[style] if style < len(formats) else (0, "General")
                stored, formula, array = None, None, False
                for child in el:
                    name = _tag(child)
                    if name == "v":
                        stored = child.text
                    elif name == "is":
                        stored = _string_of(child)
                    elif name == "f":
                        formula = "=" + (child.text or "")
                        kind = child.get("t")
                        if kind == "shared":
                            if child.text:
                                shared_formulas[child.get("si")] = (formula, r, c)
                            else:
                                text, r0, c0 = shared_formulas[child.get("si")]
                                formula = _moved(text, r - r0, c - c0)
                        array = kind in ("array", "dataTable")
                kind, printed, iso, number, flag = _value(el.get("t", "n"), stored, fmt, shared, base_1904)
                row = {"rec": "cell", "r": r, "c": c, "number_format": fmt[1] or None, "comment": comments.pop(at, None),
                       "val_kind": kind, "val_text": iso, "val_num": number, "val_bool": flag}
                if formula is not None:
                    row.update(raw_kind="array_formula" if array else "formula", raw_text=formula,
                               formula=formula if len(formula) > 1 else None)
                else:
                    row.update(raw_kind=kind, raw_text=printed, raw_num=number)
                if formula is not None or kind is not None or row["comment"]:
                    yield row
                el.clear()
            elif tag == "row":
                el.clear()
            elif tag == "sheetProtection":
                protected = el.get("sheet") in ("1", "true")
            elif tag == "mergeCell":
                merged.append(el.get("ref"))
            elif tag == "hyperlink":
                links[el.get("ref")] = rels.get(next((v for k, v in el.attrib.items() if k.endswith("}id")), None), ("", None))[1]
    for pos, ref in enumerate(merged):
        yield {"rec": "merged", "text": ref, "pos": pos}
    for ref, target in links.items():
        later.append({"rec": "link", "text": ref, "refers_to": target})
    yield from later
    yield {"rec": "sheet", "text": sheet, "hidden": hidden, "protected": protected}


def _workbook_rows(path: str, content: bytes) -> Iterator[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_string_of(si) for si in ET.fromstring(book.read("xl/sharedStrings.xml"))]
        formats = _formats(book)
        root = ET.fromstring(book.read("xl/workbook.xml"))
        rels = _rels(book, "xl/workbook.xml")
        base_1904 = any(_tag(el) == "workbookPr" and el.get("date1904") in ("1", "true") for el in root)
        for group in root:
            if _tag(group) == "definedNames":
                for el in group:
                    yield {"rec": "name", "text": el.get("name"), "refers_to": el.text or ""}
            if _tag(group) != "sheets":
                continue
            for i, el in enumerate(group):
                kind, part = rels[next(v for k, v in el.attrib.items() if k.endswith("}id"))]
                if kind != "worksheet":
                    continue
                sheet, hidden = el.get("name"), el.get("state", "visible") != "visible"
                for row in _sheet_rows(book, part, sheet, i, hidden, formats, shared, base_1904):
                    yield {**row, "sheet": sheet, "sheet_idx": i}


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def frame(rows):
        return pd.DataFrame(rows, columns=_FIELDS).astype(object).where(lambda d: d.notna(), None)

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows = []
            try:
                for row in _workbook_rows(path, content):
                    rows.append({"workbook": path, **row})
                    if len(rows) >= BATCH_ROWS:
                        yield frame(rows)
                        rows = []
            except Exception as exc:  # a damaged file must not fail the job
                rows.append({"rec": "error", "workbook": path, "text": f"{type(exc).__name__}: {exc}"})
            if rows:
                yield frame(rows)


def scan_workbooks(files: DataFrame) -> DataFrame:
    """Scan rows of a (path, content) DataFrame. Rows of a file that fails half way carry an error row too."""
    return files.select("path", "content").mapInPandas(_scan, SCAN_SCHEMA)


class WorkbookScan:
    """Tables of one scan, stored once so that cells and metadata come from the same pass."""

    def __init__(self, files: DataFrame):
        ship_package(files.sparkSession)
        self.rows = cut_lineage(scan_workbooks(files), "scan", "rec")
        self.failed = self.rows.where("rec = 'error'").select("workbook").distinct()

    @staticmethod
    def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(path)
        return workbook_files(files, path)

    @classmethod
    def versions(cls, spark: SparkSession, path: str | list[str]) -> DataFrame:
        """(path, size, modified) of the workbooks below a folder. Contents are not read."""
        return cls._files(spark, path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))

    @classmethod
    def of_folder(cls, spark: SparkSession, path: str | list[str], seen: DataFrame | None = None) -> WorkbookScan:
        """All workbooks below a folder. ``seen``: versions (path, size, modified) that need no new scan."""
        files = cls._files(spark, path)
        if seen is not None:
            files = files.join(changed_files(cls.versions(spark, path), seen).select("path"), "path", "left_semi")
        return cls(files)

    def _part(self, rec: str) -> DataFrame:
        return self.rows.where(F.col("rec") == rec).join(self.failed, "workbook", "left_anti")

    @property
    def errors(self) -> DataFrame:
        return self.rows.where("rec = 'error'").select("workbook", F.col("text").alias("error"))

    @property
    def cells(self) -> DataFrame:
        """The cell table; hyperlink targets are joined in by address."""
        cells = self._part("cell").where(F.col("raw_kind").isNotNull()).select(*CELL_COLUMNS)
        links = self._bounds(self._part("link")).select(
            "workbook", "sheet", F.col("min_r").alias("r"), F.col("min_c").alias("c"), F.col("refers_to").alias("_link"))
        merged = self.merged.select(
            "workbook", "sheet", F.col("min_r").alias("r"), F.col("min_c").alias("c"), F.col("range").alias("_merged"))
        key = ["workbook", "sheet", "r", "c"]
        out = cells.join(links.dropDuplicates(key), key, "left").join(merged, key, "left")
        return out.withColumn("hyperlink", F.col("_link")).withColumn("merged_range", F.col("_merged")).select(*CELL_COLUMNS)

    @staticmethod
    def _bounds(rows: DataFrame) -> DataFrame:
        from gridloom.operators.ranges import ranges_with_bounds

        return ranges_with_bounds(rows.drop("r", "c"), "text")

    @property
    def sheets(self) -> DataFrame:
        return self._part("sheet").select("workbook", "sheet", "sheet_idx", "hidden", "protected")

    @property
    def merged(self) -> DataFrame:
        return self._bounds(self._part("merged")).select(
            "workbook", "sheet", F.col("text").alias("range"), "pos", "min_r", "min_c", "max_r", "max_c")

    @property
    def names(self) -> DataFrame:
        return self._part("name").select("workbook", F.col("text").alias("name"), F.col("refers_to").alias("text"))

    @property
    def tables(self) -> DataFrame:
        return self._part("table").select("workbook", "sheet", F.col("text").alias("name"), F.col("refers_to").alias("range"))
