"""Grids made from the tables. A lake is stored once per session and data folder, then shared."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.lake import Lake
from gridloom.session import configure, cut_lineage, shared_folder, ship_package
from gridloom.sources.grid import block_row_number, complete_cells, literal_cell_columns, to_grid
from gridloom.sources.store import FORMAT, LakeStore

_LAKES: dict[tuple, Lake] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    configure(spark)
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def forget_lakes() -> None:
    """Drop the shared lakes, so the next query builds its own again (used for timing)."""
    _LAKES.clear()


def lake(spark: SparkSession, sf: str, build: Callable[[SparkSession, str], DataFrame]) -> Lake:
    key = (spark.sparkContext.applicationId, sf.rstrip("/"), build.__name__)
    if key not in _LAKES:
        configure(spark)
        _LAKES[key] = Lake(cut_lineage(build(spark, sf.rstrip("/")), "cells"))
    return _LAKES[key]


def stored_lake(spark: SparkSession, sf: str, build: Callable[[SparkSession, str], DataFrame]) -> Lake:
    """The lake of a grid, saved under the versions of the tables it is made of: later sessions that share the folder, and
    later queries, open it and find its regions and typed tables there."""
    configure(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(sf.rstrip("/"))
    # Names and versions of all files in one number; contents are not read.
    seen = files.select(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)").alias("h")).agg(F.sum("h"), F.count(F.lit(1))).first()
    key = hashlib.sha256(f"{FORMAT}/{build.__name__}/{seen[0]}/{seen[1]}".encode()).hexdigest()[:24]
    root = f"{shared_folder(spark)}/gridloom/lakes/{build.__name__}-{key}"
    if LakeStore.at(spark, root) is None:
        return Lake(build(spark, sf.rstrip("/"))).save(root)
    return Lake.open(spark, root)


def four_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, Customer, Supplier, Nation as four sheets of one workbook."""
    parts = [("Orders", "orders", "o_orderkey"), ("Customer", "customer", "c_custkey"),
             ("Supplier", "supplier", "s_suppkey"), ("Nation", "nation", "n_nationkey")]
    grids = [to_grid(table(spark, sf, t), s, [k], sheet_idx=i) for i, (s, t, k) in enumerate(parts)]
    return grids[0].unionByName(grids[1]).unionByName(grids[2]).unionByName(grids[3])


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders and per-order line sums as two sheets to reconcile."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("line_sum"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    return to_grid(orders, "Orders", ["o_orderkey"]).unionByName(to_grid(lines, "Lines", ["l_orderkey"], sheet_idx=1))


def _literal(kind: Column, text: Column, num: Column, flag: Column, printed: Column | None = None) -> list[Column]:
    return literal_cell_columns(kind, text, num, flag, printed)


def sparse_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as a sparse grid: sheet = return flag, row = order, column = line number.

    The kind of a cell depends on its column, so regions mix texts, numbers, booleans and dates.
    """
    line = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_orderkey", "l_linenumber").agg(
        F.min("l_linestatus").alias("status"), F.max("l_extendedprice").alias("price"),
        F.max("l_quantity").alias("qty"), F.max("l_discount").alias("disc"), F.min("l_shipdate").alias("ship"))
    c = F.col("l_linenumber")
    kind = F.when(c <= 2, "text").when(c <= 4, "float").when(c == 5, "int").when(c == 6, "bool").otherwise("date")
    flag = F.when(c == 6, F.col("disc") > 0.05)
    num = F.when(c.isin(3, 4), F.col("price")).when(c == 5, F.col("qty"))
    shared = (
        F.when(c <= 2, F.concat_ws("-", "status", c.cast("string"))).when(c <= 4, tx.float_text(F.col("price")))
        .when(c == 5, F.col("qty").cast("long").cast("string")).when(c == 6, F.when(flag, "True").otherwise("False")))
    # Each text is worked out once; the printed spelling of a moment has a blank instead of the only letter.
    line = line.withColumn("shared", shared).withColumn("moment", F.when(F.col("shared").isNull(), tx.iso_timestamp(F.col("ship"))))
    iso = F.coalesce("shared", "moment")
    printed = F.coalesce("shared", F.translate("moment", "T", " "))
    return complete_cells(line.select(
        F.lit("lake").alias("workbook"), F.col("l_returnflag").alias("sheet"), F.lit(0).alias("sheet_idx"),
        (F.col("l_orderkey") + 1).alias("r"), c.alias("c"), *_literal(kind, iso, num, flag, printed)))


MONTH_NAMES = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def _header_cells(sheets: DataFrame, title: str) -> DataFrame:
    names = F.array(*[F.struct(F.lit(i).alias("c"), F.lit(n).alias("t")) for i, n in enumerate([title, *MONTH_NAMES], start=1)])
    return sheets.select("sheet", F.inline(names)).select(
        F.lit("lake").alias("workbook"), "sheet", F.lit(1).cast("long").alias("r"), "c",
        *_literal(F.lit("text"), F.col("t"), F.lit(None), F.lit(None)))


def _month_grid(sums: DataFrame, title: str) -> DataFrame:
    """(sheet, r, label, month, v) to cells: labels in column A, months in B..M, period row 1."""
    labels = sums.select("sheet", "r", "label").distinct().select(
        F.lit("lake").alias("workbook"), "sheet", "r", F.lit(1).alias("c"), *_literal(F.lit("text"), F.col("label"), F.lit(None), F.lit(None)))
    values = sums.select(
        F.lit("lake").alias("workbook"), "sheet", "r", (F.col("month") + 1).alias("c"),
        *_literal(F.lit("float"), tx.float_text(F.col("v")), F.col("v"), F.lit(None)))
    heads = _header_cells(sums.select("sheet").distinct(), title)
    return complete_cells(complete_cells(labels).unionByName(complete_cells(values)).unionByName(complete_cells(heads)))


def customer_months(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals by customer and month, a sheet per year: sparse matrix sheets with a period row."""
    orders = table(spark, sf, "orders")
    sums = orders.groupBy(
        F.concat(F.lit("Y"), F.year("o_orderdate")).alias("sheet"), (F.col("o_custkey") + 3).alias("r"),
        F.month("o_orderdate").alias("month"),
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return _month_grid(sums.withColumn("label", F.concat(F.lit("Customer "), F.col("r") - 3)), "Customer")


def priority_months(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals by priority and month: one dense matrix below a period row."""
    orders = table(spark, sf, "orders")
    sums = orders.groupBy("o_orderpriority", F.month("o_orderdate").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    rows = orders.select("o_orderpriority").distinct()
    # One row per order priority, a fixed list of classes.
    ranked = rows.select("o_orderpriority", (F.substring("o_orderpriority", 1, 1).cast("long") + 2).alias("r"))
    return _month_grid(sums.join(ranked, "o_orderpriority").select(
        F.lit("Revenue").alias("sheet"), "r", F.col("o_orderpriority").alias("label"), "month", "v"), "Priority")


def percent_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a free-text rate column, as a grid of three columns."""
    rows = rate_texts(table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("rate_text").alias("yield_text"))
    return to_grid(rows, "Rates", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "yield_text"],
                   columns=["l_orderkey", "l_linenumber", "yield_text"])


def rate_texts(lineitem: DataFrame) -> DataFrame:
    """Seven spellings of a rate, by line number."""
    disc = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    tax = F.round(F.col("l_tax") * 100).cast("int").cast("string")
    n = F.col("l_linenumber")
    text = (
        F.when(n == 1, F.concat(disc, F.lit("%"))).when(n == 2, F.concat(disc, F.lit("-"), tax, F.lit("%")))
        .when(n == 3, F.concat(F.lit("0,"), F.lpad(disc, 2, "0"))).when(n == 4, F.lit("n/a"))
        .when(n == 5, F.concat(F.lit("=D"), disc, F.lit("*2"))).when(n == 6, F.concat(F.lit("от "), disc, F.lit(" до "), tax, F.lit(" процент")))
        .otherwise(F.concat(F.lit("about "), disc)))
    return lineitem.withColumn("rate_text", text)


def formula_model(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas built from keys: line item -> order -> customer -> nation -> region."""
    def literal(df, sheet, r, c, text):
        return complete_cells(df.select(F.lit("lake").alias("workbook"), F.lit(sheet).alias("sheet"), r.alias("r"), F.lit(c).alias("c"),
                                        *_literal(F.lit("text"), text, F.lit(None), F.lit(None))))

    def formula(df, sheet, r, c, text):
        return complete_cells(df.select(
            F.lit("lake").alias("workbook"), F.lit(sheet).alias("sheet"), r.alias("r"), F.lit(c).alias("c"),
            F.lit("formula").alias("raw_kind"), text.alias("raw_text"), text.alias("formula"),
            F.lit("float").alias("val_kind"), F.lit("1.0").alias("val_text"), F.lit(1.0).alias("val_num")))

    row = lambda k: (F.col(k) + 1).cast("string")
    line = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation, region, part = table(spark, sf, "nation"), table(spark, sf, "region"), table(spark, sf, "part")
    own = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    line_text = F.concat(F.lit("=orders!B"), row("l_orderkey"), F.lit("*part!$C$"), row("l_partkey"),
                         F.lit("+SUM(orders!B"), row("l_orderkey"), F.lit(":C"), row("l_orderkey"), F.lit(")"))
    cells = [
        formula(line, "lineitem", own, 1, line_text),
        formula(orders, "orders", F.col("o_orderkey") + 1, 2, F.concat(F.lit("=customer!B"), row("o_custkey"))),
        literal(orders, "orders", F.col("o_orderkey") + 1, 3, F.col("o_orderpriority")),
        formula(customer, "customer", F.col("c_custkey") + 1, 2, F.concat(F.lit("='nation list'!B"), row("c_nationkey"))),
        formula(nation, "nation list", (F.col("n_nationkey") + 1).cast("long"), 2, F.concat(F.lit("=region!$B$"), row("n_regionkey"))),
        literal(region, "region", (F.col("r_regionkey") + 1).cast("long"), 2, F.col("r_name")),
        literal(part, "part", F.col("p_partkey") + 1, 3, F.col("p_name")),
    ]
    out = cells[0]
    for more in cells[1:]:
        out = out.unionByName(more)
    return out


def wide_model(spark: SparkSession, sf: str) -> DataFrame:
    """A total per region over the span of its customers, who stand in order of region; a customer names its nation."""
    text = lambda v: literal_cell_columns(F.lit("text"), v, F.lit(None), F.lit(None))

    def formula(df, sheet, r, c, f):
        return complete_cells(df.select(
            F.lit("lake").alias("workbook"), F.lit(sheet).alias("sheet"), r.cast("long").alias("r"), F.lit(c).alias("c"), F.lit("formula").alias("raw_kind"),
            f.alias("raw_text"), f.alias("formula"), F.lit("float").alias("val_kind"), F.lit("1.0").alias("val_text"), F.lit(1.0).alias("val_num")))

    nation, customer = table(spark, sf, "nation"), table(spark, sf, "customer")
    people = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "n_regionkey")
    placed = block_row_number(people.withColumn("all", F.lit(1)), ["all"], F.expr("n_regionkey * 1048576L + c_custkey div 65536"),
                              [F.col("n_regionkey"), F.col("c_custkey")], "at")
    spans = placed.groupBy("n_regionkey").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    total = F.concat(F.lit("=SUM(people!C"), F.col("lo"), F.lit(":$C$"), F.col("hi"), F.lit(")"))
    names = nation.select(F.lit("lake").alias("workbook"), F.lit("nations").alias("sheet"), (F.col("n_nationkey") + 1).cast("long").alias("r"), F.lit(2).alias("c"),
                          *text(F.col("n_name")))
    return (formula(spans, "totals", F.col("n_regionkey") + 1, 1, total)
            .unionByName(formula(placed, "people", F.col("at"), 3, F.concat(F.lit("=nations!B"), F.col("n_nationkey") + 1)))
            .unionByName(complete_cells(names)))


def rings_model(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as formulas: those of one nation refer to the next of it in order of keys, the last of an even nation to the
    first one (a ring); all refer to their nation, and the nations of a region to the first ring member of the region's
    first nation, which makes larger cycles where that nation is even."""
    def formula(df, sheet, r, f):
        return complete_cells(df.select(F.lit("rings").alias("workbook"), F.lit(sheet).alias("sheet"), r.cast("long").alias("r"), F.lit(1).alias("c"),
                                        F.lit("formula").alias("raw_kind"), f.alias("raw_text"), f.alias("formula")))

    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    spans = customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("first"))
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    chained = customer.withColumn("next", F.lead("c_custkey").over(order)).join(spans, "c_nationkey")
    after = F.coalesce("next", F.when(F.col("c_nationkey") % 2 == 0, F.col("first")))
    people = formula(chained, "people", F.col("c_custkey"), F.concat(
        F.lit("=nations!A"), F.col("c_nationkey") + 1, F.coalesce(F.concat(F.lit("+A"), after), F.lit(""))))
    head = nation.join(spans, F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg(F.min_by("first", "n_nationkey").alias("head"))
    return people.unionByName(formula(nation.join(head, "n_regionkey"), "nations", F.col("n_nationkey") + 1, F.concat(F.lit("=people!A"), F.col("head"))))


def part_sheets(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as one sheet per brand."""
    part = table(spark, sf, "part")
    ranked = part_ranks(part)
    return to_grid(ranked, F.col("p_brand"), workbook="parts", row=F.col("r"),
                   columns=["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"])


def part_ranks(part: DataFrame) -> DataFrame:
    """Sheet row of each part in its brand's sheet (data from row 2), numbered in key blocks."""
    return block_row_number(part, ["p_brand"], F.expr("p_partkey div 65536"), [F.col("p_partkey")], "k").withColumn("r", F.col("k") + 1)
