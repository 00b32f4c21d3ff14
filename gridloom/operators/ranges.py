"""Reading and summarising rectangles of cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import a1
from gridloom.functions.sql_guard import GuardError
from gridloom.operators.bands import SHEET
from gridloom.sources.grid import computed_value_unavailable, numeric_value

# Default limits of a range read.
MAX_READ_CELLS = 10_000
READ_ROW_LIMIT = 200

# Height of the row blocks by which ranges find their cells.
RANGE_BLOCK = 1_024
# Ranges with at most this many row blocks in all are sent to every task; more are shuffled.
BROADCAST_PIECES = 100_000


def read_range(cells: DataFrame, workbook: str, sheet: str, range_text: str,
               include: Sequence[str] = ("values",), *, full: bool = False,
               max_cells: int | None = MAX_READ_CELLS, row_limit: int | None = READ_ROW_LIMIT,
               merged: DataFrame | None = None, sheets: DataFrame | None = None) -> DataFrame:
    """Row-major slice of a sheet: one row per grid row with an array of cells, blanks included.

    ``truncated``, ``rows_returned`` and ``rows_scanned`` describe the row limit (off when ``full`` or None).
    ``unavailable`` of a value: a formula without a stored result. ``sheets``: all known sheets, some perhaps empty.
    """
    min_r, min_c, max_r, max_c = a1.parse_range(range_text)
    if max_cells is not None and (max_r - min_r + 1) * (max_c - min_c + 1) > max_cells:
        raise GuardError("range_too_large", f"{range_text} has more than {max_cells} cells")
    on_sheet = cells.where((F.col("workbook") == workbook) & (F.col("sheet") == sheet))
    listed = None if sheets is None else sheets.where((F.col("workbook") == workbook) & (F.col("sheet") == sheet))
    if on_sheet.limit(1).isEmpty() and (listed is None or listed.limit(1).isEmpty()):
        raise GuardError("sheet_not_found", f"no sheet {sheet!r} in {workbook!r}")
    total = max_r - min_r + 1
    cut = not full and row_limit is not None and total > row_limit
    last = min_r + row_limit - 1 if cut else max_r
    wanted = on_sheet.where(F.col("r").between(min_r, last) & F.col("c").between(min_c, max_c))
    stored = wanted.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct(
        F.col("c"), F.struct("val_text", "val_kind", "formula", "raw_kind", "number_format", "comment", "hyperlink",
                             "merged_range")))).alias("m"))
    rows = cells.sparkSession.range(min_r, last + 1).withColumnRenamed("id", "r").join(stored, "r", "left")
    rects = None
    if "merged" in include and merged is not None:
        # Merged areas do not overlap, so at most max_cells of them meet the range.
        hits = merged.where(
            (F.col("workbook") == workbook) & (F.col("sheet") == sheet)
            & (F.col("min_r") <= last) & (F.col("max_r") >= min_r) & (F.col("min_c") <= max_c) & (F.col("max_c") >= min_c))
        rects = [tuple(x) for x in hits.select("min_r", "min_c", "max_r", "max_c").collect()]

    def cell(c):
        x = F.try_element_at(F.col("m"), c)
        fields = [a1.cell_a1(F.col("r"), c).alias("address")]
        if "values" in include:
            fields += [x["val_text"].alias("value"), x["val_kind"].alias("kind"),
                       F.coalesce(computed_value_unavailable(x["raw_kind"], x["val_kind"]), F.lit(False)).alias("unavailable")]
        if "formulas" in include:
            fields.append(F.when(x["raw_kind"] == "formula", x["formula"]).alias("formula"))
        if "number_formats" in include:
            fields.append(F.coalesce(x["number_format"], F.lit("General")).alias("number_format"))
        if "comments" in include:
            fields.append(x["comment"].alias("comment"))
        if "hyperlinks" in include:
            fields.append(x["hyperlink"].alias("hyperlink"))
        if "merged" in include:
            inside = x["merged_range"].isNotNull()
            for r1, c1, r2, c2 in rects or []:
                inside = inside | (F.col("r").between(r1, r2) & (c >= c1) & (c <= c2))
            fields.append(F.coalesce(inside, F.lit(False)).alias("merged"))
        return F.struct(*fields)

    return rows.select(
        "r", F.transform(F.sequence(F.lit(min_c), F.lit(max_c)), cell).alias("cells"),
        F.lit(cut).alias("truncated"), F.lit(row_limit if cut else total).cast("long").alias("rows_returned"),
        F.lit(total).cast("long").alias("rows_scanned"),
    )


def ranges_with_bounds(ranges: DataFrame, range_col: str = "range") -> DataFrame:
    """Add min_r, min_c, max_r, max_c to a DataFrame of A1 range texts."""
    return ranges.withColumn("_b", a1.range_bounds(F.col(range_col))).select("*", "_b.*").drop("_b")


def range_cells(cells: DataFrame, ranges: DataFrame, block: int = RANGE_BLOCK) -> DataFrame:
    """Cells of many ranges at once: (range_id, block, r, c, value columns).

    Ranges (range_id, workbook, sheet, bounds) are cut at row-block edges, so the join is on equal
    (sheet, block) and never pairs a cell with a range of another block. The number of pieces is
    counted first: the pieces are broadcast only when there are few.
    """
    n_pieces = ranges.agg(F.sum(F.expr(f"max_r div {block} - min_r div {block} + 1"))).first()[0] or 0
    pieces = ranges.select(
        "range_id", *SHEET, "min_r", "max_r", "min_c", "max_c",
        F.explode(F.expr(f"sequence(min_r div {block}, max_r div {block})")).alias("block"))
    pieces = F.broadcast(pieces) if n_pieces <= BROADCAST_PIECES else pieces.hint("merge")
    values = cells.where(F.col("val_kind").isNotNull()).select(
        *SHEET, F.expr(f"r div {block}").alias("block"), "r", "c", "val_kind", "val_text",
        numeric_value(F.col("val_kind"), F.col("val_num")).alias("num"))
    return values.join(pieces, [*SHEET, "block"]).where(
        F.col("r").between(F.col("min_r"), F.col("max_r")) & F.col("c").between(F.col("min_c"), F.col("max_c"))
    ).select("range_id", "block", "r", "c", "val_kind", "val_text", "num")


def range_summary(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """A1 for many ranges: count, skipped, total, mean, min, max; ranges without numbers give nulls."""
    skipped = F.col("num").isNull() & ((F.col("val_kind") != "text") | (F.col("val_text") != ""))
    stats = range_cells(cells, ranges).groupBy("range_id").agg(
        F.count("num").alias("count"), F.count_if(skipped).alias("skipped"),
        F.sum("num").alias("total"), F.avg("num").alias("mean"), F.min("num").alias("min"), F.max("num").alias("max"))
    return ranges.select("range_id").join(stats, "range_id", "left").select(
        "range_id", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("skipped", F.lit(0)).alias("skipped"),
        "total", "mean", "min", "max")


def growth_pct(prev, cur):
    """A2: percent change to one decimal; 0.0 after a zero."""
    return F.when(prev == 0, F.lit(0.0)).otherwise(F.bround((cur - prev) / F.nullif(prev, F.lit(0.0)) * 100, 1))


def range_growth(cells: DataFrame, ranges: DataFrame) -> DataFrame:
    """A2 for many ranges: change between consecutive numbers in row-major order.

    The previous number is looked up inside the row block; only the last number of each block is
    carried over to the next, so a long range is not sorted in one task.
    """
    numbers = range_cells(cells, ranges).where(F.col("num").isNotNull()).select("range_id", "block", "r", "c", "num")
    spot = F.struct("r", "c")
    carried = numbers.groupBy("range_id", "block").agg(F.max_by("num", spot).alias("last")).withColumn(
        "carry", F.lag("last").over(Window.partitionBy("range_id").orderBy("block"))).drop("last")
    inside = F.lag("num").over(Window.partitionBy("range_id", "block").orderBy("r", "c"))
    first = F.row_number().over(Window.partitionBy("range_id", "block").orderBy("r", "c")) == 1
    pairs = numbers.withColumn("inside", inside).withColumn("first", first).join(carried, ["range_id", "block"])
    prev = F.when(F.col("first"), F.col("carry")).otherwise(F.col("inside"))
    return pairs.withColumn("prev", prev).where(F.col("prev").isNotNull()).select(
        "range_id", "r", "c", F.col("num").alias("value"), growth_pct(F.col("prev"), F.col("num")).alias("growth_pct"))


def summarize_range(cells: DataFrame, workbook: str, sheet: str, range_text: str, growth: bool = False,
                    max_cells: int | None = None) -> DataFrame:
    """A1/A2 of one range as a single row; the growth array is ordered row by row. ``max_cells`` refuses larger ranges."""
    min_r, min_c, max_r, max_c = a1.parse_range(range_text)
    if max_cells is not None and (max_r - min_r + 1) * (max_c - min_c + 1) > max_cells:
        raise GuardError("range_too_large", f"{range_text} has more than {max_cells} cells")
    one = cells.sparkSession.range(1).select(
        F.lit(range_text).alias("range_id"), F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"),
        *[F.lit(v).cast(t).alias(n) for n, v, t in (
            ("min_r", min_r, "long"), ("min_c", min_c, "int"), ("max_r", max_r, "long"), ("max_c", max_c, "int"))])
    cells = cells.where((F.col("workbook") == workbook) & (F.col("sheet") == sheet) & F.col("r").between(min_r, max_r))
    summary = range_summary(cells, one)
    if not growth:
        return summary
    steps = range_growth(cells, one).groupBy("range_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("r", "c", "growth_pct"))), lambda x: x["growth_pct"]).alias("growth_pct"))
    return summary.join(steps, "range_id", "left")


def period_extremes(long: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """A3: first positive, lowest and closing period of each line item in a long (period, value) table."""
    at = F.struct(F.col(order), F.col(value))
    positive = F.col(value) > 0
    return long.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(F.when(positive, F.col(order))).alias("first_positive"),
        F.min_by(F.col(order), F.struct(F.col(value), F.col(order))).alias("lowest_period"),
        F.min(value).alias("lowest_value"),
        F.max_by(F.col(order), F.struct(F.col(value), -F.col(order))).alias("highest_period"),
        F.max(value).alias("highest_value"),
        F.max_by(F.col(value), at).alias("closing_value"),
    )
