"""Range reads, range aggregates and percent parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.percent import parse_percent
from gridloom.operators import ranges
from gridloom.plans import inputs
from gridloom.plans.inputs import lake, table

BIG = "bigint"


def _part_cells(spark, sf):
    return inputs.to_grid(table(spark, sf, "part"), "Part", ["p_partkey"])


def read_range(spark, sf):
    """Columns B to D of the whole part sheet."""
    cells = lake(spark, sf, _part_cells)
    last = cells.structure.bounds.first()["max_r"]
    rows = ranges.read_range(cells.cells, "lake", "Part", f"B1:D{last}", ("values", "formulas"), full=True, max_cells=None)
    return rows.select("r", F.explode("cells").alias("x")).select("r", "x.address", "x.value", "x.kind")


READ_RANGE = """
with p as (select *, row_number() over (order by p_partkey) + 1 as r from part)
select r, 'B' || r as address, p_name as value, 'text' as kind from p union all select r, 'C' || r, p_brand, 'text' from p
union all select r, 'D' || r, p_type, 'text' from p union all select 1, 'B1', 'p_name', 'text' union all select 1, 'C1', 'p_brand', 'text'
union all select 1, 'D1', 'p_type', 'text'
"""


def read_range_capped(spark, sf):
    """The row limit of a read is the feature; the flags tell what was left out."""
    cells = lake(spark, sf, _part_cells)
    last = cells.structure.bounds.first()["max_r"]
    rows = ranges.read_range(cells.cells, "lake", "Part", f"A1:A{last}", max_cells=None)
    return rows.select("r", F.col("cells")[0]["value"].alias("value"), "truncated", "rows_returned", "rows_scanned")


READ_RANGE_CAPPED = """
with p as (select cast(p_partkey as varchar) as value, row_number() over (order by p_partkey) + 1 as r from part union all select 'p_partkey', 1)
select r, value, count(*) over () > 200 as truncated, least(count(*) over (), 200) as rows_returned, count(*) over () as rows_scanned
from p qualify r <= 200
"""


def _order_blocks(book):
    """One rectangle of columns B to D per 500 sheet rows of the orders sheet."""
    last = F.col("max_r")
    spans = book.structure.bounds.where("sheet = 'Orders'").select(
        "workbook", "sheet", last.alias("last"), F.explode(F.expr("sequence(0L, max_r div 500)")).alias("range_id"))
    return spans.select(
        "range_id", "workbook", "sheet", F.greatest(F.col("range_id") * 500, F.lit(1)).alias("min_r"), F.lit(2).alias("min_c"),
        F.least(F.col("range_id") * 500 + 499, F.col("last")).alias("max_r"), F.lit(4).alias("max_c"))


def range_summary(spark, sf):
    book = lake(spark, sf, inputs.four_sheets)
    out = ranges.range_summary(book.cells, _order_blocks(book))
    return out.select("range_id", "count", "skipped", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "min", "max")


RANGE_SUMMARY = """
with o as (select *, row_number() over (order by o_orderkey) + 1 as r from orders),
c as (select r // 500 as range_id, cast(o_custkey as double) as v from o union all select r // 500, null from o
      union all select r // 500, o_totalprice from o union all select 0, null union all select 0, null union all select 0, null)
select range_id, count(v) as count, count(*) - count(v) as skipped, round(sum(v), 2) as total, round(avg(v), 4) as mean, min(v) as min, max(v) as max
from c group by range_id
"""


def range_growth(spark, sf):
    """A2 over the whole price column of the orders sheet."""
    book = lake(spark, sf, inputs.four_sheets)
    span = book.structure.bounds.where("sheet = 'Orders'").select(
        F.lit("D").alias("range_id"), "workbook", "sheet", "min_r", F.lit(4).alias("min_c"), "max_r", F.lit(4).alias("max_c"))
    return ranges.range_growth(book.cells, span).select("r", "value", "growth_pct")


RANGE_GROWTH = """
with o as (select o_totalprice as v, row_number() over (order by o_orderkey) + 1 as r from orders),
g as (select r, v, lag(v) over (order by r) as p from o)
select r, v as value, case when p = 0 then 0.0 else round((v - p) / p * 100, 1) end as growth_pct from g where p is not null
"""


def period_extremes(spark, sf):
    """A3: per customer, monthly totals against a fixed budget."""
    months = table(spark, sf, "orders").groupBy("o_custkey", F.month("o_orderdate").cast(BIG).alias("month")).agg(
        F.round(F.sum("o_totalprice") - 300000, 2).alias("net"))
    out = ranges.period_extremes(months, ["o_custkey"], "month", "net")
    return out.select("o_custkey", "first_positive", "lowest_period", "lowest_value", "highest_period", "highest_value", "closing_value")


PERIOD_EXTREMES = """
with m as (select o_custkey, cast(month(o_orderdate) as bigint) as month, round(sum(o_totalprice) - 300000, 2) as net from orders group by 1, 2)
select o_custkey, min(month) filter (where net > 0) as first_positive,
  first(month order by net, month) as lowest_period, min(net) as lowest_value,
  first(month order by net desc, month) as highest_period, max(net) as highest_value, last(net order by month) as closing_value
from m group by o_custkey
"""


def percent_parse(spark, sf):
    """P1 on every line item: the spelled rate, and the plain number."""
    rows = inputs.rate_texts(table(spark, sf, "lineitem"))
    spelled = parse_percent("'text'", "rate_text", "null")
    number = parse_percent("'float'", "cast(null as string)", "l_discount")
    parsed = rows.select("rate_text", "l_discount", spelled.alias("p"), number.alias("n"))
    return parsed.groupBy("rate_text", F.col("p.kind").alias("kind"), F.round("p.num", 6).alias("num"), F.round("p.min", 6).alias("low"),
                          F.round("p.max", 6).alias("high"), F.col("n.kind").alias("n_kind"), F.round("n.num", 6).alias("n_num")).agg(F.count(F.lit(1)).alias("n"))


PERCENT_PARSE = """
with t as (
  select l_linenumber as k, cast(round(l_discount * 100) as int) as d, cast(round(l_tax * 100) as int) as x, l_discount from lineitem),
s as (
  select *, case k when 1 then d || '%' when 2 then d || '-' || x || '%' when 3 then '0,' || lpad(cast(d as varchar), 2, '0') when 4 then 'n/a'
    when 5 then '=D' || d || '*2' when 6 then 'от ' || d || ' до ' || x || ' процент' else 'about ' || d end as rate_text from t),
f as (select *, list_transform(regexp_extract_all(replace(rate_text, ',', '.'), '[0-9]+(\\.[0-9]+)?'), lambda v: cast(v as double)) as nums,
        contains(rate_text, '%') or contains(rate_text, 'процент') as marked from s),
p as (
  select rate_text, l_discount,
    case when starts_with(rate_text, '=') then 'formula' when len(nums) = 0 then 'other' when len(nums) >= 2 then 'range'
      when marked or nums[1] > 1 then 'percent' else 'number' end as kind,
    case when marked or (len(nums) >= 2 and greatest(nums[1], nums[2]) > 1) or nums[1] > 1 then 100.0 else 1.0 end as scale, nums from f)
select rate_text, kind, round(case when kind in ('percent', 'number') then nums[1] / scale end, 6) as num,
  round(case when kind = 'range' then least(nums[1], nums[2]) / scale when kind in ('percent', 'number') then nums[1] / scale end, 6) as low,
  round(case when kind = 'range' then greatest(nums[1], nums[2]) / scale when kind in ('percent', 'number') then nums[1] / scale end, 6) as high,
  'number' as n_kind, round(l_discount, 6) as n_num, count(*) as n
from p group by all
""".replace("\\\\", "\\")


def percent_columns(spark, sf):
    """P2 on every column of the four sheets."""
    cols = lake(spark, sf, inputs.four_sheets).structure.columns
    return cols.select("sheet", "name", "percent_like", "type", "sql_type")


def _percent_columns_sql():
    tables = {"Orders": ("orders", "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority"),
              "Customer": ("customer", "c_custkey c_name c_nationkey c_acctbal c_mktsegment"),
              "Supplier": ("supplier", "s_suppkey s_name s_nationkey s_acctbal"), "Nation": ("nation", "n_nationkey n_name n_regionkey")}
    parts = []
    for sheet, (name, cols) in tables.items():
        for col in cols.split():
            number = f"typeof(any_value({col}))"
            parts.append(f"select '{sheet}' as sheet, '{col}' as name, "
                         f"(count(*) filter (where regexp_matches(cast({col} as varchar), '[0-9]')) >= greatest(2, count({col}) // 2)) "
                         f"or regexp_matches('{col}', 'apy|apr|yield|rate|pct|percent') as percent_like, {number} as t from {name}")
    return f"""with c as ({' union all '.join(parts)})
select sheet, name, percent_like, case when t in ('BIGINT', 'INTEGER') then 'integer' when t = 'DOUBLE' then 'decimal'
  when t like 'TIMESTAMP%' then 'date' else 'text' end as type,
  case when t in ('BIGINT', 'INTEGER', 'DOUBLE') then 'double' else 'varchar' end as sql_type from c"""


QUERIES = {
    "read_range": read_range, "read_range_capped": read_range_capped, "range_summary": range_summary, "range_growth": range_growth,
    "first_positive_period": period_extremes, "percent_parse": percent_parse, "percent_columns": percent_columns,
}
ORACLES = {
    "read_range": READ_RANGE, "read_range_capped": READ_RANGE_CAPPED, "range_summary": RANGE_SUMMARY, "range_growth": RANGE_GROWTH,
    "first_positive_period": PERIOD_EXTREMES, "percent_parse": PERCENT_PARSE, "percent_columns": _percent_columns_sql(),
}
