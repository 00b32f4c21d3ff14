"""Regions as typed rows, one view per table name or one long table for all regions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.percent import PERCENT_SUFFIXES, parse_percent
from gridloom.operators import bands
from gridloom.operators.bands import SHEET
from gridloom.operators.structure import MONTHS, REGION, Structure
from gridloom.sources.grid import NUMERIC_KINDS

# Fixed value: name of the first-year total on matrix tables.
YEAR_TOTAL = "year_1_total"


def cell_text() -> Column:
    """Spelling of a value inside a text column; booleans read ``true``/``false`` there."""
    return F.when(F.col("val_kind") == "bool", F.lower("val_text")).otherwise(F.col("val_text"))


@dataclass(frozen=True)
class ViewColumn:
    name: str
    sql_type: str
    percent_like: bool


def _merge_types(types: set[str]) -> str:
    if len(types) == 1:
        return next(iter(types))
    return "double" if types <= {"bigint", "double"} else "varchar"


def view_columns(regions: DataFrame) -> list[ViewColumn]:
    """Columns of one table name, over all workbooks that have it (a few names, not data)."""
    rows = (
        regions.select(F.inline("columns")).groupBy("name")
        .agg(F.min("idx").alias("idx"), F.collect_set("sql_type").alias("types"),
             F.max("percent_like").alias("percent_like"))
        .orderBy("idx", "name").collect()
    )
    return [ViewColumn(r["name"], _merge_types(set(r["types"])), r["percent_like"]) for r in rows]


def _pick(name: str, value: Column) -> Column:
    return F.max(F.when(F.col("name") == name, value))


def region_view(cells: DataFrame, regions: DataFrame, keep_keys: bool = False, columns: list[ViewColumn] | None = None,
                provenance: str | None = None) -> DataFrame:
    """Typed rows of one table name. ``regions`` holds only the regions with that name.

    ``columns``: those of the view, by default those of ``regions``. ``provenance``: name of a column for the workbook.
    """
    columns = view_columns(regions) if columns is None else columns
    return view_of(wide_rows(cells, regions, columns), columns, keep_keys, provenance)


def wide_rows(cells: DataFrame, regions: DataFrame, columns: list[ViewColumn]) -> DataFrame:
    """The values of the rows of a table, from which ``view_of`` makes its columns. Every (workbook, sheet, column) of the table
    is one lookup row, so cells find their column by an equi-join and rows come from one grouping by grid row."""
    spots = regions.select(
        *SHEET, "data_start_row", "max_r", "orientation", F.inline("columns")
    ).select(*SHEET, F.col("c"), "name", "data_start_row", "max_r", "orientation")
    sheets = regions.select(*SHEET).distinct().limit(2).collect()
    if len(sheets) == 1:
        # One sheet: say so as literals, so the scan can prune by partition and row group.
        span = regions.agg(F.min("data_start_row"), F.max("max_r"), F.min("min_c"), F.max("max_c")).first()
        cells = cells.where(
            (F.col("workbook") == sheets[0]["workbook"]) & (F.col("sheet") == sheets[0]["sheet"])
            & F.col("r").between(span[0], span[1]) & F.col("c").between(span[2], span[3]))
    placed = (
        cells.where(F.col("val_kind").isNotNull())
        .select(*SHEET, "r", "c", "val_kind", "val_text", "val_num", "val_bool")
        .join(spots, [*SHEET, "c"])
        .where(F.col("r").between(F.col("data_start_row"), F.col("max_r")))
    )
    aggs: list[Column] = []
    for i, col in enumerate(columns):
        if col.sql_type in ("double", "bigint"):
            aggs.append(_pick(col.name, F.col("val_num")).alias(f"v{i}"))
        elif col.sql_type == "boolean":
            aggs.append(_pick(col.name, F.col("val_bool")).alias(f"v{i}"))
        else:
            aggs.append(_pick(col.name, cell_text()).alias(f"v{i}"))
            if col.percent_like:
                aggs.append(_pick(col.name, F.struct("val_kind", "val_text", "val_num")).alias(f"p{i}"))
    months = _months(columns)
    if months:
        in_year = F.col("name").isin(*months) & F.col("val_kind").isin(*NUMERIC_KINDS) & (F.col("orientation") == "matrix")
        aggs.append(F.sum(F.when(in_year, F.col("val_num"))).alias("y1"))
        aggs.append(F.max(F.col("orientation") == "matrix").alias("is_matrix"))
    filled = F.count_if(bands.cell_non_empty(F.col("val_kind"), F.col("val_text"))).alias("filled")
    return placed.groupBy(*SHEET, "r").agg(filled, *aggs).where(F.col("filled") > 0)


def _months(columns: list[ViewColumn]) -> list[str]:
    """Month columns that add up to a year; a single one does not."""
    names = {c.name for c in columns}
    months = [m for m in MONTHS if m in names]
    return months if len(months) >= 2 else []


def view_of(wide: DataFrame, columns: list[ViewColumn], keep_keys: bool = False, provenance: str | None = None) -> DataFrame:
    """The columns of a table over ``wide_rows``. Derived ones are worked out where they are read: a query that names none parses
    no text."""
    out: list[Column] = [F.col(k) for k in (*SHEET, "r")] if keep_keys else []
    if provenance:
        out.append(F.col("workbook").alias(provenance))
    derived: list[Column] = []
    parsed: dict[str, Column] = {}
    for i, col in enumerate(columns):
        value = F.col(f"v{i}")
        out.append((value.cast("bigint") if col.sql_type == "bigint" else value).alias(col.name))
        if not col.percent_like:
            continue
        if col.sql_type in ("double", "bigint"):
            parsed[f"d{i}"] = parse_percent(f"if(v{i} is null, null, 'float')", "cast(null as string)", f"v{i}")
        elif col.sql_type == "boolean":
            parsed[f"d{i}"] = parse_percent(f"if(v{i} is null, null, 'bool')", "cast(null as string)", "null")
        else:
            parsed[f"d{i}"] = parse_percent(f"p{i}.val_kind", f"p{i}.val_text", f"p{i}.val_num")
        derived += [F.col(f"d{i}.{part}").alias(f"{col.name}__{part}") for part in PERCENT_SUFFIXES]
    out += derived
    if _months(columns):
        out.append(F.col("y1").alias(YEAR_TOTAL))
    return wide.withColumns(parsed).select(*out) if parsed else wide.select(*out)


def region_cells(structure: Structure) -> DataFrame:
    """Data cells of all regions with their column names (long form)."""
    cells = structure.cells.select(*SHEET, "r", "c", "val_kind", "val_text", "val_num")
    spots = structure.columns.select(*REGION, "c", "idx", "name", "is_matrix", "data_start_row")
    return (
        bands.label_cells(cells, structure.index).join(spots, [*REGION, "c"])
        .where((F.col("r") >= F.col("data_start_row")) & F.col("val_kind").isNotNull())
    )


def region_rows(structure: Structure) -> DataFrame:
    """Every data row of every region as a map of column name to text, with its Year-1 total.

    One job for any number of distinct table shapes.
    """
    numeric_month = F.col("is_matrix") & F.col("name").isin(*MONTHS)
    months = structure.columns.where(numeric_month).groupBy(*REGION).agg(F.count(F.lit(1)).alias("n_months"))
    cells = region_cells(structure)
    rows = cells.groupBy(*REGION, "r").agg(
        F.count_if(bands.cell_non_empty(F.col("val_kind"), F.col("val_text"))).alias("filled"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", cell_text().alias("v"))))).alias("values"),
        F.sum(F.when(numeric_month & F.col("val_kind").isin(*NUMERIC_KINDS), F.col("val_num"))).alias("y1"),
    ).where(F.col("filled") > 0)
    return rows.join(months, REGION, "left").select(
        *REGION, "r", "values", F.when(F.col("n_months") >= 2, F.col("y1")).alias(YEAR_TOTAL))


def year_totals(structure: Structure) -> DataFrame:
    """P4 alone: Year-1 total per data row of every matrix region with at least two month columns."""
    matrix = structure.columns.where("is_matrix").groupBy(*REGION).agg(
        F.count_if(F.col("name").isin(*MONTHS)).alias("n_months")).where("n_months >= 2").drop("n_months")
    cells = region_cells(structure).join(matrix, REGION, "left_semi")
    numeric = F.col("name").isin(*MONTHS) & F.col("val_kind").isin(*NUMERIC_KINDS)
    return (
        cells.groupBy(*REGION, "r").agg(
            F.count_if(bands.cell_non_empty(F.col("val_kind"), F.col("val_text"))).alias("filled"),
            F.sum(F.when(numeric, F.col("val_num"))).alias(YEAR_TOTAL))
        .where("filled > 0").drop("filled")
    )
