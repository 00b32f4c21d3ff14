"""The long cell table and the adapter that melts any DataFrame into it."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions import text as tx
from gridloom.session import shuffle_width

# One row per stored cell. raw_* is what the cell holds (a formula cell holds its formula text),
# val_* is the computed value. raw_text is the printed spelling, val_text the ISO spelling.
CELL_SCHEMA = T.StructType([
    T.StructField("workbook", T.StringType()),
    T.StructField("sheet", T.StringType()),
    T.StructField("sheet_idx", T.IntegerType()),
    T.StructField("r", T.LongType()),
    T.StructField("c", T.IntegerType()),
    T.StructField("raw_kind", T.StringType()),   # text int float bool date formula array_formula
    T.StructField("raw_text", T.StringType()),
    T.StructField("raw_num", T.DoubleType()),
    T.StructField("val_kind", T.StringType()),   # text int float bool date, null when not computed
    T.StructField("val_text", T.StringType()),
    T.StructField("val_num", T.DoubleType()),
    T.StructField("val_bool", T.BooleanType()),
    T.StructField("formula", T.StringType()),
    T.StructField("number_format", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("hyperlink", T.StringType()),
    T.StructField("merged_range", T.StringType()),
])
CELL_COLUMNS = CELL_SCHEMA.fieldNames()

NUMERIC_KINDS = ("int", "float")
FORMULA_KINDS = ("formula", "array_formula")

# Rows of one key are numbered in blocks of this many, so no task sorts a whole key.
ROW_BLOCK = 65_536


def complete_cells(df: DataFrame) -> DataFrame:
    """Bring any DataFrame with some of the cell columns to the full schema (missing ones null)."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in CELL_SCHEMA
    ])


def literal_cell_columns(kind: Column, value_text: Column, num: Column, boolean: Column,
                         printed_text: Column | None = None) -> list[Column]:
    """The raw_*/val_* columns of a cell that holds a literal: both views are the same value."""
    printed = value_text if printed_text is None else printed_text
    return [
        kind.alias("raw_kind"), printed.alias("raw_text"), num.alias("raw_num"),
        kind.alias("val_kind"), value_text.alias("val_text"), num.alias("val_num"),
        boolean.alias("val_bool"),
    ]


def block_row_number(df: DataFrame, part: Sequence[str], block: Column, order: Sequence[Column],
                     name: str = "rn") -> DataFrame:
    """Row number within ``part``, ordered by ``order``, when ``block`` grows with that order.

    Rows are numbered inside (part, block); the per-block counts are summed up over the far
    smaller list of blocks and joined back. A part holding most of the rows is never sorted whole.
    """
    part = list(part)
    blocked = df.withColumn("_block", block)
    counts = blocked.groupBy(*part, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(p).alias(f"_p_{i}") for i, p in enumerate(part)], F.col("_block").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    within = Window.partitionBy(*part, "_block").orderBy(*order)
    numbered = blocked.withColumn("_k", F.row_number().over(within).cast("long"))
    on = F.col("_block") == F.col("_b")
    for i, p in enumerate(part):
        on = on & F.col(p).eqNullSafe(F.col(f"_p_{i}"))
    return numbered.join(offsets, on).select(*df.columns, (F.col("_k") + F.col("_offset")).alias(name))


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index",
                   buckets: int | None = None) -> DataFrame:
    """Exact global row number (1-based) in ``order_by`` order, without sorting in one task.

    Bucket edges come from a fixed-size sample of keys (the smallest key hashes, so a rerun picks
    the same ones). Edges only decide the balance of the buckets, never the numbering.
    """
    spark = df.sparkSession
    buckets = buckets or shuffle_width(spark)
    keys = list(order_by)
    if buckets <= 1:
        return block_row_number(df, [], F.lit(0), [F.col(k) for k in keys], name)
    sample = (
        df.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(min(20 * buckets, 50_000)).collect()
    )
    rows = sorted({tuple(r) for r in sample if all(v is not None for v in r)})
    edges = [rows[i * len(rows) // buckets] for i in range(1, buckets)] if rows else []
    edges = sorted(set(edges))
    if not edges:
        return block_row_number(df, [], F.lit(0), [F.col(k) for k in keys], name)
    # Edges travel as one JSON constant, in chunks: a row is compared with the chunk heads, then
    # with the edges of one chunk.
    fields = ", ".join(f"k{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(keys))
    step = math.isqrt(len(edges)) or 1
    chunks = [[_edge(e) for e in edges[i:i + step]] for i in range(0, len(edges), step)]
    heads = F.from_json(F.lit(json.dumps([c[0] for c in chunks[1:]])), f"array<struct<{fields}>>")
    inner = F.from_json(F.lit(json.dumps(chunks)), f"array<array<struct<{fields}>>>")
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    placed = df.withColumn("_key", key).withColumn("_chunk", F.size(F.filter(heads, lambda e: e <= F.col("_key"))))
    bucket = F.col("_chunk") * step + F.size(F.filter(F.get(inner, F.col("_chunk")), lambda e: e <= F.col("_key")))
    numbered = placed.withColumn("_bucket", bucket).drop("_key", "_chunk")
    return block_row_number(numbered, [], F.col("_bucket"), [F.col(k) for k in keys], name).drop("_bucket")


def _edge(values: tuple) -> dict:
    return {f"k{i}": v if isinstance(v, (bool, int, float, str)) else str(v) for i, v in enumerate(values)}


def _kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "float"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text"


def to_grid(df: DataFrame, sheet: str | Column, order_by: Sequence[str] | None = None, *,
            workbook: str | Column = "lake", sheet_idx: int = 0, row: Column | None = None,
            columns: Sequence[str] | None = None, header: bool = True) -> DataFrame:
    """Melt a DataFrame into cells: header names in row 1, data from row 2 (row 1 without header).

    Rows are numbered by ``order_by`` (unique keys), or placed at ``row`` when the caller has one.
    Null values give no cell. A DataFrame column becomes one grid column, in the given order.
    """
    columns = list(columns or df.columns)
    first = 2 if header else 1
    if row is None:
        if not order_by:
            raise ValueError("to_grid needs order_by or row")
        placed = with_row_index(df, order_by, "_r").withColumn("_r", F.col("_r") + (first - 1))
    else:
        placed = df.withColumn("_r", row.cast("long"))
    sheet_col = F.lit(sheet) if isinstance(sheet, str) else sheet
    book_col = F.lit(workbook) if isinstance(workbook, str) else workbook

    def entry(i: int, name: str) -> Column:
        data_type = df.schema[name].dataType
        kind = _kind_of(data_type)
        day = isinstance(data_type, T.DateType)
        value = F.col(name)
        null = F.lit(None)
        return F.struct(
            F.lit(i).alias("c"),
            F.when(value.isNotNull(), F.lit(kind)).alias("kind"),
            (value.cast("string") if kind in ("text", "int") or day else null.cast("string")).alias("txt"),
            (value.cast("double") if kind in NUMERIC_KINDS else null.cast("double")).alias("num"),
            (value if kind == "bool" else null.cast("boolean")).alias("flag"),
            (value.cast("timestamp") if kind == "date" and not day else null.cast("timestamp")).alias("ts"),
        )

    long = placed.select(
        book_col.alias("workbook"), sheet_col.alias("sheet"), F.col("_r").alias("r"),
        F.explode(F.array(*[entry(i, n) for i, n in enumerate(columns, start=1)])).alias("x"),
    ).where(F.col("x.kind").isNotNull())
    kind = F.col("x.kind")
    moment = F.col("x.ts").isNotNull()
    shared = (
        F.when(kind == "float", tx.float_text(F.col("x.num")))
        .when(kind == "bool", F.when(F.col("x.flag"), F.lit("True")).otherwise(F.lit("False")))
        .otherwise(F.col("x.txt"))
    )
    # Each text is worked out once; the printed spelling of a moment has a blank instead of the only letter.
    spelled = long.withColumn("text", F.when(moment, tx.iso_timestamp(F.col("x.ts"))).otherwise(shared))
    data = spelled.select(
        "workbook", "sheet", F.lit(sheet_idx).alias("sheet_idx"), "r", F.col("x.c").alias("c"),
        *literal_cell_columns(
            kind,
            F.col("text"),
            F.col("x.num"),
            F.col("x.flag"),
            printed_text=F.when(moment, F.translate(F.col("text"), "T", " ")).otherwise(F.col("text")),
        ),
    )
    data = complete_cells(data)
    if not header:
        return data
    if isinstance(sheet, str) and isinstance(workbook, str):
        sheets = df.sparkSession.range(1).select(F.lit(workbook).alias("workbook"), F.lit(sheet).alias("sheet"))
    else:
        sheets = df.select(book_col.alias("workbook"), sheet_col.alias("sheet")).distinct()
    names = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(n).alias("t")) for i, n in enumerate(columns, start=1)])
    head = sheets.select("workbook", "sheet", F.explode(names).alias("h")).select(
        "workbook", "sheet", F.lit(sheet_idx).alias("sheet_idx"), F.lit(1).cast("long").alias("r"), F.col("h.c").alias("c"),
        *literal_cell_columns(F.lit("text"), F.col("h.t"), F.lit(None), F.lit(None)),
    )
    return complete_cells(head).unionByName(data)


def is_formula(raw_kind: Column) -> Column:
    """P6."""
    return raw_kind.isin(*FORMULA_KINDS)


def computed_value_unavailable(raw_kind: Column, val_kind: Column) -> Column:
    """P5: a formula without a stored result; its value stays null."""
    return is_formula(raw_kind) & val_kind.isNull()


def numeric_value(val_kind: Column, val_num: Column) -> Column:
    """The value as a double when it is a number, else null (booleans are not numbers)."""
    return F.when(val_kind.isin(*NUMERIC_KINDS), val_num)
