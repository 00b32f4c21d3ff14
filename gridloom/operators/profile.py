"""Sheet profiles, best-source ranking, listings of tables and sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import a1
from gridloom.functions.percent import PERCENT_SUFFIXES
from gridloom.operators.bands import SHEET

# Ranking weight of each region kind, and words that make a table a summary.
KIND_WEIGHTS = {"summary": 100, "table": 60, "ledger": 40, "parameters": 20, "metadata": 5, "unknown": 0}
SUMMARY_TEXTS = ("total", "summary")
BEST_SOURCES = 3
MERGED_SAMPLE = 10


def with_empty_sheets(bounds: DataFrame, sheets: DataFrame) -> DataFrame:
    """Bounds of all known sheets; one without a stored cell has the bounds of A1 and no formula."""
    one = {"min_r": 1, "min_c": 1, "max_r": 1, "max_c": 1, "formula_count": 0}
    known = sheets.select(*SHEET, F.col("sheet_idx").alias("_idx")).join(bounds, SHEET, "full_outer")
    return known.withColumn("sheet_idx", F.coalesce("sheet_idx", "_idx")).drop("_idx").fillna(one)


def sheet_profile(bounds: DataFrame, regions: DataFrame, sheets: DataFrame | None = None,
                  merged: DataFrame | None = None, names: DataFrame | None = None,
                  tables: DataFrame | None = None) -> DataFrame:
    """One row per sheet. ``sheets``/``merged``/``names``/``tables`` are the scan's metadata."""
    file_name = F.substring_index("workbook", "/", -1)
    area = a1.bounds_a1(F.col("min_r"), F.col("min_c"), F.col("max_r"), F.col("max_c"))
    counts = regions.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("region_count"))
    out = bounds.withColumn("bounds", area).join(counts, SHEET, "left").withColumn(
        "source_ref", a1.source_ref(file_name, F.col("sheet"), F.col("bounds")))
    if sheets is not None:
        out = out.join(sheets.select(*SHEET, "hidden"), SHEET, "left")
    else:
        out = out.withColumn("hidden", F.lit(False))
    if merged is not None:
        nth = F.row_number().over(Window.partitionBy(*SHEET).orderBy("pos"))
        few = merged.withColumn("nth", nth).groupBy(*SHEET).agg(
            F.count(F.lit(1)).alias("merged_ranges_count"),
            F.array_sort(F.collect_list(F.when(F.col("nth") <= MERGED_SAMPLE, F.struct("nth", "range")))).alias("_s"))
        out = out.join(few, SHEET, "left").withColumn("merged_ranges_sample", F.col("_s.range")).drop("_s")
    if names is not None:
        # A name belongs to a sheet when its text mentions that sheet; names and sheets of one
        # workbook meet on the workbook key only.
        mention = F.col("text").contains(F.concat(F.lit("'"), F.col("sheet"), F.lit("'!"))) | F.col("text").contains(
            F.concat(F.col("sheet"), F.lit("!")))
        found = bounds.select(*SHEET).join(names, "workbook").where(mention).groupBy(*SHEET).agg(
            F.array_sort(F.collect_set("name")).alias("named_ranges"))
        out = out.join(found, SHEET, "left")
    if tables is not None:
        found = tables.groupBy(*SHEET).agg(F.array_sort(F.collect_set("name")).alias("excel_tables"))
        out = out.join(found, SHEET, "left")
    for name, empty in (("merged_ranges_count", F.lit(0).cast("long")),
                        ("merged_ranges_sample", F.array().cast("array<string>")),
                        ("named_ranges", F.array().cast("array<string>")),
                        ("excel_tables", F.array().cast("array<string>"))):
        out = out.withColumn(name, F.coalesce(F.col(name), empty) if name in out.columns else empty)
    return out.select(
        *SHEET, "sheet_idx", "bounds", F.coalesce("hidden", F.lit(False)).alias("hidden"), "merged_ranges_count",
        "merged_ranges_sample", "formula_count", "named_ranges", "excel_tables",
        F.coalesce("region_count", F.lit(0)).alias("region_count"), "source_ref")


def effective_kind(kind: Column, sample_text: Column) -> Column:
    summary_like = (kind == "table") & sample_text.rlike("|".join(SUMMARY_TEXTS))
    return F.when(summary_like, F.lit("summary")).otherwise(kind)


def kind_weight(kind: Column) -> Column:
    weight = F.lit(0)
    for name, value in KIND_WEIGHTS.items():
        weight = F.when(kind == name, F.lit(value)).otherwise(weight)
    return weight


def best_source(bounds: DataFrame, regions: DataFrame, top: int = BEST_SOURCES) -> DataFrame:
    """Sheets of each workbook ranked by their best region (kind weight, then confidence)."""
    kind = effective_kind(F.col("region_kind"), F.col("sample_text"))
    best = regions.select(*SHEET, "region_no", "confidence", kind.alias("kind")).groupBy(*SHEET).agg(
        F.max_by(F.struct("kind", "confidence"),
                 F.struct(kind_weight(F.col("kind")), F.col("confidence"), -F.col("region_no"))).alias("best"))
    score = F.coalesce(F.round(kind_weight(F.col("best.kind")) + F.col("best.confidence"), 3), F.lit(0.0))
    reason = F.when(F.col("best").isNull(), F.lit("no detected regions")).otherwise(
        F.concat(F.col("best.kind"), F.lit(" region (conf "), F.format_string("%.2f", F.col("best.confidence")), F.lit(")")))
    ranked = bounds.join(best, SHEET, "left").select(*SHEET, "sheet_idx", reason.alias("reason"), score.alias("score"))
    rank = F.row_number().over(Window.partitionBy("workbook").orderBy(F.desc("score"), "sheet_idx", "sheet"))
    return ranked.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).select(
        *SHEET, "rank", "reason", "score")


def list_tables(regions: DataFrame, sheet: str | None = None) -> DataFrame:
    """Tables with their columns and the derived percent columns they expose."""
    out = regions if sheet is None else regions.where(F.col("sheet") == sheet)
    derived = F.flatten(F.transform(
        F.filter("columns", lambda c: c["percent_like"]),
        lambda c: F.array(*[F.concat(c["name"], F.lit(f"__{part}")) for part in PERCENT_SUFFIXES])))
    return out.select(
        *SHEET, "table_name", "bounds", F.col("region_kind").alias("kind"), "orientation",
        F.col("row_count").alias("rows"), F.col("columns.name").alias("columns"), derived.alias("derived_columns"))


def list_sheets(profile: DataFrame) -> DataFrame:
    """R25."""
    return profile.select(*SHEET, "bounds", "hidden", "formula_count", "region_count")
