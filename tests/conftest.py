import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from gridloom.functions import text as tx  # noqa: E402
from gridloom.session import build_session  # noqa: E402
from gridloom.sources.grid import complete_cells  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("gridloom-tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def grid(spark):
    """Cells from {sheet: {A1: value}}; a text starting with = is a formula without stored result."""
    from gridloom.functions.a1 import parse_range

    def build(sheets: dict, workbook: str = "book.xlsx"):
        rows = []
        for i, (sheet, cells) in enumerate(sheets.items()):
            for at, value in cells.items():
                r, c, _, _ = parse_range(at)
                formula = value if isinstance(value, str) and value.startswith("=") else None
                kind = ("formula" if formula else "bool" if isinstance(value, bool) else "int" if isinstance(value, int)
                        else "float" if isinstance(value, float) else "text")
                num = float(value) if kind in ("int", "float") else None
                rows.append((workbook, sheet, i, r, c, kind, str(value), num, formula, value if kind == "bool" else None))
        df = spark.createDataFrame(rows, "workbook string, sheet string, sheet_idx int, r long, c int, raw_kind string, raw_text string, "
                                         "raw_num double, formula string, val_bool boolean")
        literal = F.col("formula").isNull()
        return complete_cells(
            df.withColumn("val_kind", F.when(literal, F.col("raw_kind"))).withColumn("val_text", F.when(literal, F.col("raw_text")))
            .withColumn("val_num", F.when(literal, F.col("raw_num"))))

    return build
