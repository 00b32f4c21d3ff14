"""Headers, periods, columns, types, kinds of every region on every sheet.

Cells are read three times, each time narrow: coordinates for the bands, kinds for the column
counts, and full values only for the few head rows of regions and sheets. Everything after that
works on region-sized data.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import a1, percent
from gridloom.functions import text as tx
from gridloom.operators import bands
from gridloom.operators.bands import SHEET, cell_non_empty
from gridloom.session import cut_lineage
from gridloom.sources.grid import ROW_BLOCK

REGION = [*SHEET, "min_r", "min_c"]

# Header weights and limits.
FILL_WEIGHT, STRING_WEIGHT, UNIQUE_WEIGHT, SHORT_WEIGHT = 0.3, 0.3, 0.25, 0.15
HEADER_MIN_SCORE = 0.35
HEADER_SCAN_ROWS = 5
SHORT_TEXT = 60
PERIOD_SCAN_ROWS = 7
MIN_PERIOD_HITS = 3
SAMPLE_ROWS = 3

# Texts that mark a period when a cell starts with one of them.
PERIOD_TOKENS = (
    "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec",
    "q1", "q2", "q3", "q4", "year", "month", "week", "fy",
)
# Month columns of the first year.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
# Words in column names that decide the kind of a region.
LEDGER_WORDS = ("amount", "debit", "credit", "transaction", "vendor", "invoice", "date")
SUMMARY_WORDS = ("total", "summary", "variance", "month")
# confidence = density share plus a bonus for a header.
DENSITY_WEIGHT, HEADER_BONUS = 0.8, 0.2

_PERIOD_START = "^(" + "|".join(PERIOD_TOKENS) + ")"
_HEAD_ROWS = HEADER_SCAN_ROWS + SAMPLE_ROWS


def is_period(text: Column) -> Column:
    """The text starts with a period token (so ``Marketing`` counts)."""
    return F.coalesce(F.lower(tx.strip(text)).rlike(_PERIOD_START), F.lit(False))


def header_scores(head: DataFrame) -> DataFrame:
    """Score of each of the first rows of a region. ``head`` holds labelled head cells."""
    rows = head.where(F.col("filled") & (F.col("r") < F.col("min_r") + HEADER_SCAN_ROWS))
    kind, text = F.col("raw_kind"), F.col("raw_text")
    facts = rows.select(
        *REGION, "max_c", "r", F.lower(tx.strip(text)).alias("_text"), kind.isin("text", "formula").alias("_str"),
        ((F.length(text) <= SHORT_TEXT) & (kind != "array_formula")).alias("_short"))
    # The few rows of a region meet once, in one shuffle: distinct texts first, then rows.
    texts = facts.repartition(*REGION).groupBy(*REGION, "max_c", "r", "_text").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_str").alias("n_str"), F.count_if("_short").alias("n_short"))
    agg = texts.groupBy(*REGION, "max_c", "r").agg(
        F.sum("n").alias("n"), F.sum("n_str").alias("n_str"), F.count("_text").alias("n_uniq"), F.sum("n_short").alias("n_short"))
    n = F.col("n")
    score = (
        F.lit(FILL_WEIGHT) * (n / (F.col("max_c") - F.col("min_c") + 1))
        + F.lit(STRING_WEIGHT) * (F.col("n_str") / n)
        + F.lit(UNIQUE_WEIGHT) * (F.col("n_uniq") / n)
        + F.lit(SHORT_WEIGHT) * (F.col("n_short") / n)
    )
    return agg.select(*REGION, "r", score.alias("score"))


def header_rows(scores: DataFrame) -> DataFrame:
    """Best-scoring row, the earliest on ties, if it reaches the minimum."""
    best = scores.groupBy(*REGION).agg(
        F.max_by(F.struct("r", "score"), F.struct(F.col("score"), -F.col("r"))).alias("best"))
    good = F.col("best.score") >= HEADER_MIN_SCORE
    return best.where(good).select(*REGION, F.col("best.r").alias("header_row"), F.col("best.score").alias("header_score"))


def sheet_bounds(cells: DataFrame) -> DataFrame:
    """Used range and formula count per sheet, over stored cells."""
    return cells.groupBy(*SHEET).agg(
        F.min("sheet_idx").alias("sheet_idx"),
        F.min("r").alias("min_r"), F.min("c").alias("min_c"),
        F.max("r").alias("max_r"), F.max("c").alias("max_c"),
        F.count_if(F.col("raw_kind") == "formula").alias("formula_count"),
    )


def dedupe_names(columns: DataFrame, base: str, name: str) -> DataFrame:
    """The second ``x`` becomes ``x_2``; a generated name that hits another gets ``_c<index>``."""
    nth = F.row_number().over(Window.partitionBy(*REGION, base).orderBy("idx"))
    first = columns.withColumn("_nth", nth).withColumn(
        "_try", F.when(F.col("_nth") == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), F.col("_nth"))))
    clash = F.row_number().over(Window.partitionBy(*REGION, "_try").orderBy("_nth", "idx"))
    return (
        first.withColumn("_clash", clash)
        .withColumn(name, F.when(F.col("_clash") == 1, F.col("_try")).otherwise(
            F.concat("_try", F.lit("_c"), F.col("idx"))))
        .drop("_nth", "_try", "_clash")
    )


def static_type(n: Column, n_bool: Column, n_int: Column, n_num: Column, n_date: Column) -> Column:
    """R10, from counts of non-blank raw values."""
    return (
        F.when(n == 0, F.lit("text")).when(n_bool == n, F.lit("boolean")).when(n_int == n, F.lit("integer"))
        .when(n_num == n, F.lit("decimal")).when(n_date == n, F.lit("date")).otherwise(F.lit("text"))
    )


def computed_type(n: Column, n_bool: Column, n_num: Column, static: Column) -> Column:
    """R11, from counts of non-blank computed values; blank columns keep the static type."""
    fallback = (
        F.when(static == "boolean", F.lit("boolean")).when(static == "integer", F.lit("bigint"))
        .when(static == "decimal", F.lit("double")).otherwise(F.lit("varchar"))
    )
    return (
        F.when(n == 0, fallback).when(n_bool == n, F.lit("boolean"))
        .when(n_num == n, F.lit("double")).otherwise(F.lit("varchar"))
    )


def region_kind(names: Column, height: Column, width: Column, samples: Column) -> Column:
    """R18, on the column names of a region."""
    text = F.lower(F.array_join(names, " "))
    mentions = lambda words: text.rlike("|".join(words))
    return (
        F.when(mentions(LEDGER_WORDS), F.lit("ledger"))
        .when((height <= 7) & (width <= 4), F.lit("parameters"))
        .when(mentions(SUMMARY_WORDS), F.lit("summary"))
        .when((samples >= 1) & (width >= 2), F.lit("table"))
        .otherwise(F.lit("unknown"))
    )


def _counters() -> dict[str, Column]:
    """Counters over data rows; "filled" marks a non-blank raw value."""
    filled, raw = F.col("filled"), F.col("raw_kind")
    val_filled, val = F.col("val_filled"), F.col("val_kind")
    return {
        "n": filled,
        "n_bool": filled & (raw == "bool"),
        "n_int": filled & (raw == "int"),
        "n_num": filled & raw.isin("int", "float"),
        "n_date": filled & (raw == "date"),
        "v_n": val_filled,
        "v_bool": val_filled & (val == "bool"),
        "v_num": val_filled & val.isin("int", "float"),
        "p_counted": F.col("pct_counted"),
        "p_usable": F.col("pct_usable"),
    }


def _value_flags(cells: DataFrame) -> DataFrame:
    val_kind, val_text = F.col("val_kind"), F.col("val_text")
    return (
        cells.withColumn("val_filled", F.coalesce(cell_non_empty(val_kind, val_text), F.lit(False)))
        .withColumn("pct_counted", percent.percent_counted(val_kind, val_text))
        .withColumn("pct_usable", percent.percent_usable(val_kind, val_text))
    )


class Structure:
    """All structure tables of a cell table, built on demand.

    Intermediates that several tables share are region- or block-sized; they are written once to
    the shared folder, so every later plan starts from a small scan.
    """

    def __init__(self, cells: DataFrame, block_rows: int = ROW_BLOCK):
        self.cells = cells
        self.block_rows = block_rows

    # -- rectangles -------------------------------------------------------------------------
    @cached_property
    def runs(self) -> DataFrame:
        return cut_lineage(bands.row_runs(self.cells, self.block_rows), "runs")

    @cached_property
    def layout(self) -> DataFrame:
        """One row per row band with its column bands."""
        return cut_lineage(bands.band_layout(self.runs), "layout")

    @cached_property
    def index(self) -> DataFrame:
        """Row index of all bands; ``head_end``: the last row of each that headers and periods are looked for in."""
        top = self.bounds.select(*SHEET, F.col("min_r").alias("sheet_top"))
        last = F.greatest(F.col("band_start") + (_HEAD_ROWS - 1), F.col("sheet_top") + (PERIOD_SCAN_ROWS - 1))
        banded = bands.banded_runs(self.runs, self.layout).join(top, SHEET).withColumn("head_end", last)
        return cut_lineage(bands.row_index(banded, "head_end"), "row_index")

    @cached_property
    def rectangles(self) -> DataFrame:
        return bands.number_regions(self.layout, self.block_rows)

    @cached_property
    def bounds(self) -> DataFrame:
        return cut_lineage(sheet_bounds(self.cells), "bounds")

    # -- cell passes ------------------------------------------------------------------------
    @cached_property
    def column_counts(self) -> DataFrame:
        """Per region column: counts over the rows below the header scan, plus totals."""
        flagged = _value_flags(self.cells.withColumn("filled", cell_non_empty())).select(
            *SHEET, "r", "c", "filled", "raw_kind", "val_filled", "val_kind", "pct_counted", "pct_usable")
        below = F.col("r") >= F.col("min_r") + HEADER_SCAN_ROWS
        return cut_lineage(bands.label_cells(flagged, self.index).groupBy(*REGION, "max_r", "max_c", "c").agg(
            F.count_if("filled").alias("total_n"),
            F.count_if(F.col("filled") & F.col("raw_kind").isin("text", "formula")).alias("total_str"),
            *[F.count_if(below & cond).alias(k) for k, cond in _counters().items()],
        ), "column_counts")

    @cached_property
    def head(self) -> DataFrame:
        """Stored cells in the first rows of each region, and in the first rows of each sheet."""
        # Only head cells are looked at closer.
        head = bands.label_cells(self.cells.drop("sheet_idx"), self.index, "head_end")
        return cut_lineage(head.select(
            *REGION, "max_r", "max_c", "r", "c", "raw_kind", "raw_text", "raw_num", "val_kind", "val_text", cell_non_empty().alias("filled")), "head")

    # -- headers and periods ----------------------------------------------------------------
    @cached_property
    def scores(self) -> DataFrame:
        return header_scores(self.head)

    @cached_property
    def headers(self) -> DataFrame:
        return header_rows(self.scores)

    @cached_property
    def period_rows(self) -> DataFrame:
        """(sheet, period_row), the first of a sheet's first rows with enough period texts."""
        hits = (
            self.head.where(F.col("filled") & is_period(F.col("raw_text")))
            .groupBy(*SHEET, "r").agg(F.count(F.lit(1)).alias("hits"))
            .where(F.col("hits") >= MIN_PERIOD_HITS)
        )
        top = self.bounds.select(*SHEET, F.col("min_r").alias("sheet_top"))
        return (
            hits.join(top, SHEET).where(F.col("r") < F.col("sheet_top") + PERIOD_SCAN_ROWS)
            .groupBy(*SHEET).agg(F.min("r").alias("period_row"))
        )

    @cached_property
    def period_cells(self) -> DataFrame:
        """Texts of the period row by sheet column."""
        return cut_lineage(
            self.head.join(self.period_rows, SHEET)
            .where((F.col("r") == F.col("period_row")) & F.col("filled"))
            .select(*SHEET, "c", F.col("raw_text").alias("period_text"), is_period(F.col("raw_text")).alias("hit")),
            "period_cells")

    @cached_property
    def shapes(self) -> DataFrame:
        """R14, R16, R19 inputs: orientation, header and data start of each region."""
        return cut_lineage(self._shapes(), "shapes")

    def _shapes(self) -> DataFrame:
        facts = (
            self.column_counts.join(self.period_cells, [*SHEET, "c"], "left")
            .groupBy(*REGION, "max_r", "max_c").agg(
                F.sum("total_n").alias("filled"),
                F.count_if(F.coalesce("hit", F.lit(False))).alias("period_hits"),
                F.sum(F.when(F.col("c") == F.col("min_c"), F.col("total_str")).otherwise(0)).alias("label_strings"),
            )
        )
        matrix = (F.col("period_hits") >= MIN_PERIOD_HITS) & (F.col("label_strings") > 0)
        shaped = facts.join(self.headers, REGION, "left").withColumn("is_matrix", matrix)
        header = F.when(~F.col("is_matrix"), F.col("header_row"))
        height = F.col("max_r") - F.col("min_r") + 1
        width = F.col("max_c") - F.col("min_c") + 1
        density = F.col("filled") / (height * width)
        shaped = (
            shaped.withColumn("header_row", header)
            .withColumn("data_start_row", F.coalesce(F.col("header_row") + 1, F.col("min_r")))
            .withColumn("row_count", F.when(F.col("is_matrix"), height).otherwise(
                F.col("max_r") - F.coalesce("header_row", "min_r")))
            .withColumn("column_count", width)
            .withColumn("orientation", F.when(F.col("is_matrix"), F.lit("matrix")).otherwise(F.lit("tabular")))
        )
        bonus = F.when(F.col("header_row").isNotNull(), F.lit(HEADER_BONUS)).otherwise(F.lit(0.0))
        raw_confidence = F.least(F.lit(1.0), density * DENSITY_WEIGHT + bonus)
        return (
            shaped.withColumn("raw_confidence", raw_confidence)
            .withColumn("confidence", F.bround(F.col("raw_confidence"), 2))
            .drop("period_hits", "label_strings", "header_score")
        )

    # -- columns ----------------------------------------------------------------------------
    @cached_property
    def columns(self) -> DataFrame:
        """One row per region column with name, types and percent flag."""
        start = self.shapes.select(*REGION, "header_row", "data_start_row", "is_matrix")
        counters = _counters()
        # Values are looked at closer here, where they are counted: headers and periods need no such flags.
        head = _value_flags(self.head).join(start, REGION)
        data_head = (F.col("r") >= F.col("data_start_row")) & (F.col("r") < F.col("min_r") + HEADER_SCAN_ROWS)
        falsy = (
            ((F.col("raw_kind").isin("int", "float")) & (F.col("raw_num") == 0))
            | ((F.col("raw_kind") == "bool") & (F.col("raw_text") == "False"))
            | (F.col("raw_text") == "")
        )
        head_part = head.groupBy(*REGION, "c").agg(
            F.max(F.when((F.col("r") == F.col("header_row")) & ~falsy, F.col("raw_text"))).alias("header_text"),
            *[F.count_if(data_head & cond).alias(f"h_{k}") for k, cond in counters.items()],
        )
        cols = (
            self.column_counts.join(start, REGION)
            .join(head_part, [*REGION, "c"], "left")
            .join(self.period_cells.drop("hit"), [*SHEET, "c"], "left")
            .withColumn("idx", F.col("c") - F.col("min_c") + 1)
        )
        for k in counters:
            cols = cols.withColumn(k, F.col(k) + F.coalesce(f"h_{k}", F.lit(0))).drop(f"h_{k}")
        numbered = F.concat(F.lit("column_"), F.col("idx"))
        label = (
            F.when(F.col("is_matrix") & (F.col("idx") == 1), F.lit("line_item"))
            .when(F.col("is_matrix"), F.coalesce("period_text", numbered))
            .otherwise(F.coalesce("header_text", numbered))
        )
        cols = cols.withColumn("_label", label).withColumn("base", tx.safe_identifier(F.col("_label"), "column")).drop("_label")
        cols = dedupe_names(cols, "base", "name")
        static = static_type(*[F.col(k) for k in ("n", "n_bool", "n_int", "n_num", "n_date")])
        cols = cols.withColumn("type", static)
        return cut_lineage(cols.select(
            *REGION, "max_r", "max_c", "c", "idx", "name", "type",
            computed_type(F.col("v_n"), F.col("v_bool"), F.col("v_num"), F.col("type")).alias("sql_type"),
            percent.percent_like(F.col("name"), F.col("p_usable"), F.col("p_counted")).alias("percent_like"),
            "is_matrix", "header_row", "data_start_row",
            F.col("n").alias("filled"),
        ), "columns")

    @cached_property
    def sample_rows(self) -> DataFrame:
        """Up to three rows from the data start, as maps of column name to raw value."""
        value = F.when(F.col("raw_kind").isin("formula", "array_formula"), F.col("raw_text")).otherwise(F.col("val_text"))
        cols = self.columns.select(*REGION, "c", "idx", "name", "data_start_row")
        cells = self.head.join(cols, [*REGION, "c"]).where(
            (F.col("r") >= F.col("data_start_row")) & (F.col("r") < F.col("data_start_row") + SAMPLE_ROWS))
        rows = cells.groupBy(*REGION, "r").agg(F.array_sort(F.collect_list(
            F.struct("idx", "name", value.alias("value"), F.col("raw_kind").isin("text", "formula").alias("is_text")))).alias("cells"))
        return rows.groupBy(*REGION).agg(F.array_sort(F.collect_list(F.struct("r", "cells"))).alias("sample"))

    # -- regions ----------------------------------------------------------------------------
    @cached_property
    def regions(self) -> DataFrame:
        """One row per region with names, kind, confidence, columns and samples."""
        columns = self.columns.groupBy(*REGION).agg(F.array_sort(F.collect_list(
            F.struct("idx", "name", "type", "sql_type", "percent_like", "c"))).alias("columns"))
        joined = (
            self.rectangles
            .join(self.shapes.drop("max_r", "max_c"), REGION)
            .join(columns, REGION)
            .join(self.sample_rows, REGION, "left")
            .join(self.bounds.select(*SHEET, "sheet_idx"), SHEET)
        )
        height = F.col("max_r") - F.col("min_r") + 1
        kind = region_kind(F.col("columns.name"), height, F.col("column_count"),
                           F.size(F.coalesce("sample", F.array())))
        named = (
            joined.withColumn("region_kind", kind).withColumn("_numbered", F.concat_ws("_", "sheet", "region_kind", F.col("region_no").cast("string")))
            .withColumn("region_id", F.concat(tx.safe_identifier(F.col("sheet"), "sheet"), F.lit("_r"), F.col("region_no")))
            .withColumn("_name", tx.safe_identifier(
                F.col("_numbered"),
                F.concat(F.lit("region_"), F.col("region_no"))))
            .withColumn("bounds", a1.bounds_a1(F.col("min_r"), F.col("min_c"), F.col("max_r"), F.col("max_c")))
        )
        # Two sheets may clean up to the same name; the later one gets a suffix.
        nth = F.row_number().over(Window.partitionBy("workbook", "_name").orderBy("sheet_idx", "sheet", "region_no"))
        named = named.withColumn("_nth", nth).withColumn(
            "table_name", F.when(F.col("_nth") == 1, F.col("_name")).otherwise(F.concat("_name", F.lit("_"), F.col("_nth"))))
        samples = F.transform(F.coalesce("sample", F.array().cast(joined.schema["sample"].dataType)), lambda s: F.map_from_entries(
            F.transform(s["cells"], lambda x: F.struct(x["name"], x["value"]))))
        label_text = F.array_join(F.flatten(F.transform(F.col("sample"), lambda s: F.transform(
            F.filter(s["cells"], lambda x: x["is_text"]), lambda x: F.lower(x["value"])))), " ")
        file_name = F.substring_index("workbook", "/", -1)
        return cut_lineage(named.select(
            *SHEET, "sheet_idx", "region_no", "region_id", "table_name", "min_r", "min_c", "max_r", "max_c", "bounds",
            "header_row", "data_start_row", "row_count", "column_count", "region_kind", "orientation",
            "confidence", "raw_confidence", "columns", samples.alias("sample_rows"),
            F.coalesce(label_text, F.lit("")).alias("sample_text"),
            a1.source_ref(file_name, F.col("sheet"), F.col("bounds")).alias("source_ref"),
        ), "regions")
