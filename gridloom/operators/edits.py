"""Ordered edits on cell tables - validate, warn, diff, apply, commit.

A batch is applied in one pass over the touched sheets. Every edit coordinate is first traced back through the inserts and
deletes before it to a stable row id (a base row, or "k-th row of insert n"), so the last write per stable cell wins and
rows move only once, at the end (see ``shifts``).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import a1
from gridloom.functions.sql_guard import GuardError
from gridloom.operators.bands import SHEET
from gridloom.operators.joins import last_before
from gridloom.operators.ranges import RANGE_BLOCK, range_cells
from gridloom.operators.shifts import RowShifts, final_rows, sheet_ends, shift_ranks
from gridloom.operators.structure import sheet_bounds
from gridloom.session import cut_lineage
from gridloom.sources.grid import CELL_COLUMNS, complete_cells
from gridloom.sources.store import PART_SCHEMAS, of_books

# The edit types.
EDIT_TYPES = (
    "set_values", "set_formula", "clear_range", "append_rows", "insert_rows", "delete_rows", "copy_range",
)

# The place that an operation names, by type. Appends, inserts and deletes name none.
_PLACES = {"set_values": "start", "set_formula": "cell", "clear_range": "range", "copy_range": "target"}

_VALUES = T.ArrayType(T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("num", T.DoubleType())])))
EDIT_SCHEMA = T.StructType([
    T.StructField("workbook", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("sheet", T.StringType()),
    *[T.StructField(n, T.StringType()) for n in ("start", "cell", "range", "source", "target", "formula")],
    T.StructField("values", _VALUES),
    T.StructField("rows", _VALUES),
    T.StructField("idx", T.LongType()),
    T.StructField("amount", T.LongType()),
])

# What a write leaves in a cell. A formula has no computed value until something computes it.
_CONTENT = ["raw_kind", "raw_text", "raw_num", "val_kind", "val_text", "val_num", "val_bool", "formula"]
_STABLE = [*SHEET, "origin", "row", "c"]


def edit_value(value) -> tuple | None:
    """A Python value as an edit value (kind, text, num)."""
    if value is None:
        return None
    if isinstance(value, bool):
        return ("bool", str(value), None)
    if isinstance(value, (int, float)):
        return ("int" if isinstance(value, int) else "float", str(value), float(value))
    if hasattr(value, "isoformat"):
        return ("date", value.isoformat(), None)
    return ("text", str(value), None)


def edits_frame(spark: SparkSession, workbook: str, operations: list[dict]) -> DataFrame:
    """A request's operations (list of dicts, in order) as an edits DataFrame."""
    def block(rows):
        if not isinstance(rows, list) or not all(isinstance(r, list) for r in rows):
            return None
        return [[edit_value(v) for v in row] for row in rows]

    records = [
        (workbook, i, op.get("type"), op.get("sheet"), *[op.get(k) for k in ("start", "cell", "range", "source", "target", "formula")],
         block(op.get("values")), block(op.get("rows")), op.get("idx"), op.get("amount"))
        for i, op in enumerate(operations)
    ]
    return spark.createDataFrame(records, EDIT_SCHEMA)


# -- staging --------------------------------------------------------------------------------------

def _height(block: Column) -> Column:
    return F.size(block).cast("long")


def _width(block: Column) -> Column:
    return F.array_max(F.transform(block, lambda row: F.size(row)))


def stage(edits: DataFrame, cells: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Every operation with its error code (null when accepted) and touched rectangle.

    ``sheets``: all known sheets, where some may have no stored cell.
    """
    bounds = sheet_bounds(cells).select(
        *SHEET, F.col("max_r").alias("sheet_max_r"), F.col("max_c").alias("sheet_max_c"))
    if sheets is not None:
        empty = sheets.select(*SHEET).join(bounds, SHEET, "left_anti")
        bounds = bounds.unionByName(empty.select(*SHEET, F.lit(0).cast("long").alias("sheet_max_r"), F.lit(1).alias("sheet_max_c")))
    # An operation names one place, a copy its source too. Each reference is matched once, in steps of their own.
    named = edits.join(bounds, SHEET, "left").withColumns({"_hit": a1.range_hit(F.when(F.col("sheet_max_r").isNotNull(), F.coalesce(*[
        F.when(F.col("type") == kind, F.col(place)) for kind, place in _PLACES.items()]))),
        "_hit_src": a1.range_hit(F.when(F.col("sheet_max_r").isNotNull() & (F.col("type") == "copy_range"), F.col("source")))})
    known = named.withColumns({"_at": a1.hit_bounds(F.col("_hit")), "_at_src": a1.hit_bounds(F.col("_hit_src"))})
    is_type = lambda *names: F.col("type").isin(*names)
    area, source = F.col("_at"), F.col("_at_src")
    start = cell = target = F.when(~F.contains(F.col("_hit"), F.lit(":")), area)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    empty = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    amount = F.coalesce("amount", F.lit(1))
    idx = F.coalesce("idx", F.lit(0))
    error = (
        F.when(F.col("sheet_max_r").isNull(), "sheet_not_found")
        .when(~F.coalesce(is_type(*EDIT_TYPES), F.lit(False)), "unsupported_operation")
        .when(is_type("set_values") & empty(F.col("values")), "invalid_values")
        .when(is_type("set_values") & blank(F.col("start")), "invalid_cell")
        .when(is_type("set_values") & start.isNull(), "invalid_operation")
        .when(is_type("set_formula") & (F.col("cell").isNull() | ~F.coalesce(F.col("formula").startswith("="), F.lit(False))), "invalid_formula")
        .when(is_type("set_formula") & cell.isNull(), "invalid_operation")
        .when(is_type("clear_range") & area.isNull(), "invalid_operation")
        .when(is_type("append_rows") & empty(F.col("rows")), "invalid_rows")
        .when(is_type("insert_rows", "delete_rows") & ((idx < 1) | (amount < 1)), "invalid_row_operation")
        .when(is_type("copy_range") & source.isNull(), "invalid_operation")
        .when(is_type("copy_range") & blank(F.col("target")), "invalid_cell")
        .when(is_type("copy_range") & target.isNull(), "invalid_operation")
    )
    rect = lambda r1, c1, r2, c2: F.struct(
        r1.cast("long").alias("min_r"), c1.cast("int").alias("min_c"), r2.cast("long").alias("max_r"), c2.cast("int").alias("max_c"))
    one = F.lit(1)
    touched = (
        F.when(is_type("set_values"), rect(start["min_r"], start["min_c"], start["min_r"] + _height(F.col("values")) - 1,
                                           start["min_c"] + F.greatest(_width(F.col("values")), one) - 1))
        .when(is_type("set_formula"), cell)
        .when(is_type("clear_range"), area)
        .when(is_type("append_rows"), rect(F.col("sheet_max_r") + 1, one, F.col("sheet_max_r") + _height(F.col("rows")),
                                           F.greatest(_width(F.col("rows")), one)))
        .when(is_type("insert_rows"), rect(idx, one, idx + amount - 1, F.col("sheet_max_c")))
        .when(is_type("delete_rows"), rect(idx, one, F.least(F.col("sheet_max_r"), idx + amount - 1), F.col("sheet_max_c")))
        .when(is_type("copy_range"), rect(
            target["min_r"], target["min_c"], target["min_r"] + source["max_r"] - source["min_r"],
            target["min_c"] + source["max_c"] - source["min_c"]))
    )
    staged = known.withColumn("error", error).withColumn("amount", amount).withColumn("idx", idx)
    staged = staged.withColumn("touched", F.when(F.col("error").isNull(), touched)).withColumn(
        "src", F.when(F.col("error").isNull() & is_type("copy_range"), source))
    staged = staged.drop("_hit", "_hit_src", "_at", "_at_src")
    text = a1.bounds_a1(F.col("touched.min_r"), F.col("touched.min_c"), F.col("touched.max_r"), F.col("touched.max_c"))
    return staged.withColumn("touched_range", F.when(F.col("touched").isNotNull(), F.concat_ws("!", "sheet", text)))


def accepted(staged: DataFrame) -> DataFrame:
    return staged.where(F.col("error").isNull())


def rejected(staged: DataFrame) -> DataFrame:
    return staged.where(F.col("error").isNotNull()).select("workbook", "seq", "sheet", "type", F.col("error").alias("code"))


def touched_ranges(staged: DataFrame) -> DataFrame:
    """Ranges that the accepted operations touch, each once, in order of first use."""
    return accepted(staged).where(F.col("touched_range").isNotNull()).groupBy("workbook", "touched_range").agg(F.min("seq").alias("seq"))


def _blocks(df: DataFrame, lo: str, hi: str) -> DataFrame:
    return df.withColumn("block", F.explode(F.expr(f"sequence({lo} div {RANGE_BLOCK}, {hi} div {RANGE_BLOCK})")))


def warnings(staged: DataFrame, cells: DataFrame, merged: DataFrame | None = None,
             sheets: DataFrame | None = None) -> DataFrame:
    """(workbook, seq, warning) for touched formulas, merged areas and protected sheets."""
    ops = accepted(staged).where(~F.col("type").isin("append_rows", "insert_rows")).select(
        "workbook", "sheet", "seq", "touched_range", "touched.*")
    rects = ops.withColumn("range_id", F.struct("workbook", "seq"))
    formulas = cells.where(F.col("raw_kind") == "formula").withColumn("val_kind", F.lit("text"))
    n = range_cells(formulas, rects).groupBy("range_id").agg(F.count(F.lit(1)).alias("n"))
    out = rects.join(n, "range_id").select("workbook", "seq", F.concat(
        "touched_range", F.lit(" touches "), "n", F.lit(" formula cell(s).")).alias("warning"))
    if merged is not None:
        left = _blocks(ops, "min_r", "max_r")
        right = _blocks(merged.select(*SHEET, *[F.col(k).alias(f"m_{k}") for k in ("min_r", "min_c", "max_r", "max_c")]), "m_min_r", "m_max_r")
        # Both sides are exploded, so larger than their estimates: never broadcast on those.
        meet = left.hint("merge").join(right.hint("merge"), [*SHEET, "block"]).where(
            (F.col("m_min_r") <= F.col("max_r")) & (F.col("m_max_r") >= F.col("min_r"))
            & (F.col("m_min_c") <= F.col("max_c")) & (F.col("m_max_c") >= F.col("min_c")))
        out = out.union(meet.select("workbook", "seq", F.concat("touched_range", F.lit(" intersects merged cells.")).alias("warning")).distinct())
    if sheets is not None:
        locked = ops.join(sheets.where("protected").select(*SHEET), SHEET, "left_semi")
        out = out.union(locked.select("workbook", "seq", F.concat("sheet", F.lit(" is protected.")).alias("warning")))
    return out


# -- writes as cell events ------------------------------------------------------------------------

def _literal(value: Column) -> Column:
    """Cell content of an edit value; a text starting with = is a formula."""
    formula = (value["kind"] == "text") & value["text"].startswith("=") & (F.length(value["text"]) > 1)
    kind = F.when(formula, F.lit("formula")).otherwise(value["kind"])
    val = lambda x: F.when(~F.coalesce(formula, F.lit(False)), x)
    return F.struct(
        kind.alias("raw_kind"), value["text"].alias("raw_text"), value["num"].alias("raw_num"),
        val(value["kind"]).alias("val_kind"), val(value["text"]).alias("val_text"), val(value["num"]).alias("val_num"),
        val(value["kind"] == "bool").cast("boolean").alias("_is_bool"),
        F.when(formula, value["text"]).alias("formula"),
    )


def _content_of(lit: Column) -> Column:
    flag = F.when(lit["_is_bool"], F.lower(lit["raw_text"]) == "true")
    return F.struct(*[(flag if k == "val_bool" else lit[k]).alias(k) for k in _CONTENT])


def _null_content() -> Column:
    types = {"raw_num": "double", "val_num": "double", "val_bool": "boolean"}
    return F.struct(*[F.lit(None).cast(types.get(k, "string")).alias(k) for k in _CONTENT])


def _block_writes(ops: DataFrame, column: str, top: Column, left: Column) -> DataFrame:
    rows = ops.select("workbook", "sheet", "seq", top.alias("_top"), left.alias("_left"), F.posexplode(column).alias("_i", "_row"))
    return rows.select("workbook", "sheet", "seq", "_top", "_left", "_i", F.posexplode("_row").alias("_j", "_v")).select(
        "workbook", "sheet", "seq", (F.col("_top") + F.col("_i")).cast("long").alias("r"),
        (F.col("_left") + F.col("_j")).cast("int").alias("c"), _content_of(_literal(F.col("_v"))).alias("new"),
        F.lit(None).cast("long").alias("src_r"), F.lit(None).cast("int").alias("src_c"))


def _area_writes(ops: DataFrame) -> DataFrame:
    """Single cells of clears and copies. Tall areas are cut into row blocks and spread over tasks first."""
    blocks = _blocks(ops, "min_r", "max_r").repartition("workbook", "sheet", "seq", "block")
    lo = F.greatest(F.col("min_r"), F.col("block") * RANGE_BLOCK)
    hi = F.least(F.col("max_r"), F.col("block") * RANGE_BLOCK + (RANGE_BLOCK - 1))
    rows = blocks.withColumn("r", F.explode(F.sequence(lo, hi)))
    return rows.withColumn("c", F.explode(F.sequence("min_c", "max_c"))).select(
        "workbook", "sheet", "seq", "r", "c", _null_content().alias("new"),
        (F.col("r") + F.col("down")).alias("src_r"), (F.col("c") + F.col("right")).cast("int").alias("src_c"))


def cell_writes(ops: DataFrame, appends: DataFrame) -> DataFrame:
    """(workbook, sheet, seq, r, c, new, src_r, src_c); src_* only on copies.

    ``ops`` are accepted operations, ``appends`` those of type append_rows with their ``top`` row.
    """
    sets = _block_writes(ops.where("type = 'set_values'"), "values", F.col("touched.min_r"), F.col("touched.min_c"))
    added = _block_writes(appends, "rows", F.col("top"), F.lit(1))
    formula = ops.where("type = 'set_formula'").select(
        "workbook", "sheet", "seq", F.col("touched.min_r").alias("r"), F.col("touched.min_c").alias("c"),
        F.struct(*[(F.col("formula") if k in ("raw_text", "formula") else F.lit("formula") if k == "raw_kind"
                    else _null_content()[k]).alias(k) for k in _CONTENT]).alias("new"),
        F.lit(None).cast("long").alias("src_r"), F.lit(None).cast("int").alias("src_c"))
    flat = ["workbook", "sheet", "seq", "touched.*"]
    clears = _area_writes(ops.where("type = 'clear_range'").select(
        *flat, F.lit(None).cast("long").alias("down"), F.lit(None).cast("int").alias("right")))
    copies = _area_writes(ops.where("type = 'copy_range'").select(
        *flat, (F.col("src.min_r") - F.col("touched.min_r")).alias("down"), (F.col("src.min_c") - F.col("touched.min_c")).alias("right")))
    return sets.unionByName(added).unionByName(formula).unionByName(clears).unionByName(copies)


def diff(staged: DataFrame, cells: DataFrame) -> DataFrame:
    """before/after per operation and cell; every operation sees the base values.

    Inserts and deletes give one record for their row range.
    """
    ops = accepted(staged)
    limit_r, limit_c = F.col("sheet_max_r"), F.col("sheet_max_c")
    clip = F.when(F.col("type") == "clear_range", F.struct(
        F.col("touched.min_r").alias("min_r"), F.col("touched.min_c").alias("min_c"),
        F.least(F.col("touched.max_r"), limit_r).alias("max_r"), F.least(F.col("touched.max_c"), limit_c).alias("max_c"),
    )).otherwise(F.col("touched"))
    clipped = ops.withColumn("touched", clip).where(
        (F.col("touched.min_r") <= F.col("touched.max_r")) & (F.col("touched.min_c") <= F.col("touched.max_c")))
    appends = ops.where("type = 'append_rows'").withColumn("top", F.col("sheet_max_r") + 1)
    types = ops.select("workbook", "sheet", "seq", "type")
    writes = cell_writes(clipped, appends).join(types, ["workbook", "sheet", "seq"])
    base = cells.select(*SHEET, "r", "c", F.coalesce("formula", F.when(F.col("raw_kind") == "date", F.col("val_text")).otherwise(F.col("raw_text"))).alias("text"))
    out = (
        writes.join(base.withColumnRenamed("text", "before"), [*SHEET, "r", "c"], "left")
        .join(base.select(*SHEET, F.col("r").alias("src_r"), F.col("c").alias("src_c"), F.col("text").alias("source_text")),
              [*SHEET, "src_r", "src_c"], "left")
    )
    after = F.when(F.col("src_r").isNotNull(), F.col("source_text")).otherwise(F.coalesce("new.formula", "new.raw_text"))
    before = F.when(F.col("type") != "append_rows", F.col("before"))
    cellwise = out.where((F.col("type") != "clear_range") | F.col("before").isNotNull()).select(
        "workbook", "seq", "sheet", "type", a1.cell_a1(F.col("r"), F.col("c")).alias("cell"), before.alias("before"), after.alias("after"))
    rows = ops.where(F.col("type").isin("insert_rows", "delete_rows")).select(
        "workbook", "seq", "sheet", "type", F.substring_index("touched_range", "!", -1).alias("cell"),
        F.when(F.col("type") == "delete_rows", F.concat("amount", F.lit(" row(s)"))).alias("before"),
        F.when(F.col("type") == "insert_rows", F.concat("amount", F.lit(" inserted row(s)"))).alias("after"))
    return cellwise.unionByName(rows)


# -- applying -------------------------------------------------------------------------------------

# Operations per stretch when the end of a sheet is followed through a batch.
SEQ_BLOCK = 65_536


def _append_tops(ops: DataFrame, shifts: RowShifts) -> DataFrame:
    """First row of each append_rows: below the last row the sheet has at that point of the batch.

    The sheet end e follows e = max(e, end of write) and e = e + appended rows. Both are carried as
    (sum, max) pairs per stretch of the batch, then the stretches of a sheet are chained with its shifts.
    """
    growing = ops.join(ops.where("type = 'append_rows'").select(*SHEET).distinct(), SHEET, "left_semi")
    added = F.when(F.col("type") == "append_rows", _height(F.col("rows"))).otherwise(F.lit(0))
    end = F.when(F.col("type").isin("set_values", "set_formula", "copy_range"), F.col("touched.max_r"))
    steps = growing.where(~F.col("type").isin("insert_rows", "delete_rows")).select(
        *SHEET, "seq", "type", "sheet_max_r", "rank", F.expr(f"seq div {SEQ_BLOCK}").alias("part"), added.alias("added"), end.alias("end"))
    inside = Window.partitionBy(*SHEET, "rank", "part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("sum_before", F.coalesce(F.sum("added").over(inside), F.lit(0)))
    steps = steps.withColumn("rel_end", F.col("end") - F.col("sum_before"))
    steps = cut_lineage(steps.withColumn("max_before", F.max("rel_end").over(inside)), "append_steps")
    totals = steps.groupBy(*SHEET, "rank", "part").agg(
        F.max("sheet_max_r").alias("sheet_max_r"), F.sum("added").alias("added"), F.max("rel_end").alias("rel_end"))
    starts = sheet_ends(totals, shifts.shifts)
    tops = steps.where("type = 'append_rows'").join(starts, [*SHEET, "rank", "part"]).select(
        *SHEET, "seq", (F.col("sum_before") + F.greatest("at", F.coalesce("max_before", "at")) + 1).alias("top"))
    return ops.where("type = 'append_rows'").join(tops, [*SHEET, "seq"])


def _clip_clears(ops: DataFrame) -> DataFrame:
    """Clears stop at the farthest cell the sheet can have during the batch; beyond it nothing is stored."""
    reach = ops.groupBy(*SHEET).agg(
        (F.max(F.greatest("sheet_max_r", F.when(F.col("type") != "clear_range", F.col("touched.max_r"))))
         + F.sum(F.when(F.col("type") == "insert_rows", F.col("amount"))
                 .when(F.col("type") == "append_rows", _height(F.col("rows"))).otherwise(0))).alias("reach_r"),
        F.max(F.greatest("sheet_max_c", F.when(F.col("type") != "clear_range", F.col("touched.max_c")))).alias("reach_c"))
    clear = F.col("type") == "clear_range"
    rect = F.struct(
        F.col("touched.min_r").alias("min_r"), F.col("touched.min_c").alias("min_c"),
        F.when(clear, F.least(F.col("touched.max_r"), "reach_r")).otherwise(F.col("touched.max_r")).alias("max_r"),
        F.when(clear, F.least(F.col("touched.max_c"), "reach_c")).otherwise(F.col("touched.max_c")).alias("max_c"))
    out = ops.join(reach, SHEET).withColumn("touched", rect).drop("reach_r", "reach_c")
    return out.where(~clear | ((F.col("touched.min_r") <= F.col("touched.max_r")) & (F.col("touched.min_c") <= F.col("touched.max_c"))))


def _resolve_copies(events: DataFrame, base: DataFrame) -> DataFrame:
    """Give every copy the content its source cell has just before it.

    The source is the latest earlier write of that cell, or the base cell. When that write is a copy
    too, pointers are followed by doubling, so a chain of n copies takes log2(n) rounds.
    """
    key = [*SHEET, "origin", "row", "c"]
    eid = F.struct("seq", "origin", "row", "c")
    # A copy sees what was written before its own operation: the state just before its number.
    written = events.select(*key, (F.col("seq") * 2).alias("at"), F.struct(eid.alias("eid"), "is_copy", "new", "fmt").alias("write"))
    probes = events.where("is_copy").select(
        *SHEET, F.col("src.origin").alias("origin"), F.col("src.row").alias("row"), F.col("src_c").alias("c"), (F.col("seq") * 2 - 1).alias("at"), eid.alias("asker"))
    found = last_before(probes, written, key, ["at"], "write", "seen").drop("at")
    stored = base.select(*key, F.struct(*_CONTENT).alias("base_new"), F.col("number_format").alias("base_fmt"))
    links = found.join(stored, key, "left").select(
        *SHEET, "asker", F.when(F.col("seen.is_copy"), F.col("seen.eid")).alias("next"),
        F.when(F.col("seen").isNotNull(), F.col("seen.new")).otherwise(F.col("base_new")).alias("new"),
        F.when(F.col("seen").isNotNull(), F.col("seen.fmt")).otherwise(F.col("base_fmt")).alias("fmt"))
    links = cut_lineage(links, "copy_links")
    while not links.where(F.col("next").isNotNull()).limit(1).isEmpty():
        hop = links.select(*SHEET, F.col("asker").alias("next"), F.col("next").alias("hop_next"), F.col("new").alias("hop_new"), F.col("fmt").alias("hop_fmt"))
        links = cut_lineage(
            links.join(hop, [*SHEET, "next"], "left").select(
                *SHEET, "asker", F.when(F.col("next").isNotNull(), F.col("hop_next")).alias("next"),
                F.when(F.col("next").isNotNull(), F.col("hop_new")).otherwise(F.col("new")).alias("new"),
                F.when(F.col("next").isNotNull(), F.col("hop_fmt")).otherwise(F.col("fmt")).alias("fmt")), "copy_links")
    # A copied formula arrives as text without a computed value.
    lost = F.col("new.raw_kind").isin("formula", "array_formula")
    content = F.struct(*[
        (F.when(~F.coalesce(lost, F.lit(False)), F.col(f"new.{k}")) if k.startswith("val_") else F.col(f"new.{k}")).alias(k) for k in _CONTENT])
    done = links.select(*SHEET, "asker", content.alias("got"), F.col("fmt").alias("got_fmt"))
    asked = events.withColumn("asker", F.when(F.col("is_copy"), eid))
    return asked.join(done, [*SHEET, "asker"], "left").select(
        *key, "seq", F.when(F.col("is_copy"), F.col("got")).otherwise(F.col("new")).alias("new"),
        F.when(F.col("is_copy"), F.col("got_fmt")).alias("fmt"))


def _stable(writes: DataFrame, ops: DataFrame, shifts: RowShifts) -> DataFrame:
    """Where the written and the copied rows come from: adds origin and row, and ``src`` (row, origin) on copies."""
    zero = F.lit(0).cast("long")
    source = lambda row, origin: F.when(F.col("src_r").isNotNull(), F.struct(row.cast("long").alias("row"), origin.alias("origin")))
    plain = lambda df: df.withColumns({"origin": zero, "row": F.col("r"), "src": source(F.col("src_r"), zero)})
    if not shifts.any:
        return plain(writes)
    still = plain(writes.join(shifts.sheets, SHEET, "left_anti"))
    moving = cut_lineage(writes.join(shifts.sheets, SHEET, "left_semi").join(ops.select(*SHEET, "seq", "rank"), [*SHEET, "seq"]), "moving")
    asked = moving.select(*SHEET, "rank", "r").union(moving.where("src_r is not null").select(*SHEET, "rank", "src_r"))
    found = cut_lineage(shifts.origins(asked), "origins")
    sources = found.select(*SHEET, "rank", F.col("r").alias("src_r"), F.col("origin").alias("_src_origin"), F.col("row").alias("_src_row"))
    placed = moving.join(found, [*SHEET, "rank", "r"]).join(sources, [*SHEET, "rank", "src_r"], "left")
    return still.unionByName(placed.withColumn("src", source(F.col("_src_row"), F.col("_src_origin"))).select(*still.columns))


def apply(staged: DataFrame, cells: DataFrame) -> DataFrame:
    """The cell table after all accepted operations, in order of seq; the last write of a cell wins.

    Sheets without edits pass through unshuffled. Formulas are not rewritten when rows move.
    """
    ops = cut_lineage(shift_ranks(_clip_clears(accepted(staged))), "edit_ops")
    shifts = RowShifts(ops)
    touched = ops.select(*SHEET).distinct()
    cells = complete_cells(cells)
    untouched = cells.join(touched, SHEET, "left_anti")
    base = cells.join(touched, SHEET, "left_semi").withColumn("origin", F.lit(0).cast("long")).withColumnRenamed("r", "row")
    has_appends = not ops.where("type = 'append_rows'").isEmpty()
    appends = _append_tops(ops, shifts) if has_appends else ops.where("false").withColumn("top", F.lit(0).cast("long"))
    events = _stable(cell_writes(ops, appends), ops, shifts).select(
        *SHEET, "origin", "row", "c", "seq", "new", F.col("src_c").isNotNull().alias("is_copy"), "src", "src_c", F.lit(None).cast("string").alias("fmt"))
    events = cut_lineage(events, "edit_events")
    if not events.where("is_copy").limit(1).isEmpty():
        events = _resolve_copies(events, base)
    latest = events.groupBy(*_STABLE).agg(F.max_by(F.struct("new", "fmt"), F.col("seq")).alias("w"))
    merged = base.join(latest, _STABLE, "full_outer")
    wrote = F.col("w").isNotNull()
    content = [F.when(wrote, F.col(f"w.new.{k}")).otherwise(F.col(k)).alias(k) for k in _CONTENT]
    fmt = F.when(wrote, F.coalesce("w.fmt", "number_format")).otherwise(F.col("number_format")).alias("number_format")
    index = cells.join(touched, SHEET, "left_semi").groupBy(*SHEET).agg(F.min("sheet_idx").alias("_idx"))
    kept = merged.select(*_STABLE, "sheet_idx", *content, fmt, "comment", "hyperlink", "merged_range").where(F.col("raw_kind").isNotNull())
    out = final_rows(kept, shifts).join(index, SHEET, "left").withColumn("sheet_idx", F.coalesce("sheet_idx", "_idx"))
    return untouched.unionByName(out.select(*CELL_COLUMNS))


# -- committing -----------------------------------------------------------------------------------

@dataclass
class Parts:
    """Sheets, merged areas, names and tables that go with some cells."""

    sheets: DataFrame
    merged: DataFrame
    names: DataFrame
    tables: DataFrame


def parts_of(scan, cells: DataFrame, books: DataFrame) -> Parts:
    """What is known about some workbooks beside their cells; without a scan their sheets are those with a cell."""
    if scan is not None:
        return Parts(*[of_books(getattr(scan, kind), books) for kind in ("sheets", "merged", "names", "tables")])
    spark = cells.sparkSession
    sheets = of_books(cells, books).groupBy(*SHEET).agg(F.min("sheet_idx").alias("sheet_idx")).withColumns({"hidden": F.lit(False), "protected": F.lit(False)})
    return Parts(sheets, *[spark.createDataFrame([], PART_SCHEMAS[kind]) for kind in ("merged", "names", "tables")])


def commit_path(source: str) -> str:
    """Default output next to the source: ``<name>.updated``."""
    return f"{source.rstrip('/')}.updated"


#: Tables of a staged batch: the operations with their verdicts, the cells before and after, and the warnings.
STAGED = ("staged", "changes", "warnings")


def stage_batch(cells: DataFrame, edits: DataFrame, path: str, scan=None) -> str:
    """Validate a batch and keep it with its diff and warnings below ``path``; returns its id.

    Nothing is changed. What was shown stays what is committed: all three tables are those of the base at this time.
    """
    own = of_books(cells, edits)
    merged, sheets = (None, None) if scan is None else (of_books(scan.merged, edits), of_books(scan.sheets, edits))
    found = "s" + uuid.uuid4().hex
    stage(edits, own, sheets).write.parquet(f"{path}/{found}/staged")
    staged = staged_batch(cells.sparkSession, path, found, ("staged",))["staged"]
    diff(staged, own).write.parquet(f"{path}/{found}/changes")
    warnings(staged, own, merged, sheets).write.parquet(f"{path}/{found}/warnings")
    return found


def staged_batch(spark: SparkSession, path: str, found: str, tables: tuple[str, ...] = STAGED) -> dict[str, DataFrame]:
    """The tables of a staged batch, in this or any later session."""
    try:
        return {name: spark.read.parquet(f"{path}/{found}/{name}") for name in tables}
    except AnalysisException as exc:
        raise GuardError("staged_not_found", f"no staged batch {found!r}") from exc


def edited(staged: DataFrame, cells: DataFrame, scan=None) -> tuple[DataFrame, Parts]:
    """Cells and parts of the touched workbooks after the accepted operations; a sheet stays when its last cell goes."""
    own = of_books(cells, staged)
    return apply(staged, own), parts_of(scan, cells, staged)
