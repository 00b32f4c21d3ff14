"""SQL surface over region views (Q0-Q23) and materialised rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import joins, materialize
from gridloom.plans import inputs
from gridloom.plans.inputs import lake, stored_lake, table

# Each text runs on the region views of a lake; the SQL after it runs on the base tables.
_ON_VIEWS = {
    "query_top_vendors": (inputs.four_sheets, """
        select o_custkey as vendor, round(sum(o_totalprice), 2) as total, count(*) as n from "orders_ledger_1"
        group by o_custkey order by total desc, vendor limit 20""", """
        select cast(o_custkey as double) as vendor, round(sum(o_totalprice), 2) as total, count(*) as n from orders
        group by o_custkey order by total desc, vendor limit 20"""),
    "filters": (inputs.four_sheets, """
        select c_custkey, trim(c_name) as name, c_acctbal from customer_table_1
        where c_acctbal is not null and c_acctbal < 5000 and c_mktsegment like '%U%' and trim(c_mktsegment) <> 'FURNITURE'""", """
        select cast(c_custkey as double) as c_custkey, trim(c_name) as name, c_acctbal from customer
        where c_acctbal is not null and c_acctbal < 5000 and c_mktsegment like '%U%' and trim(c_mktsegment) <> 'FURNITURE'"""),
    "global_totals": (inputs.four_sheets, """
        select count(*) as n, round(sum(o_totalprice), 2) as total, min(o_totalprice) as lo, max(o_totalprice) as hi from orders_ledger_1""", """
        select count(*) as n, round(sum(o_totalprice), 2) as total, min(o_totalprice) as lo, max(o_totalprice) as hi from orders"""),
    "dup_candidates": (inputs.four_sheets, """
        select substr(o_orderdate, 1, 10) as day, o_orderpriority as vendor, o_orderstatus as status, count(*) as n from orders_ledger_1
        group by 1, 2, 3 having count(*) > 1""", """
        select strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority as vendor, o_orderstatus as status, count(*) as n from orders
        group by 1, 2, 3 having count(*) > 1"""),
    "monthly_totals": (inputs.four_sheets, """
        select substr(o_orderdate, 1, 7) as month, o_orderpriority as category, round(sum(o_totalprice), 2) as total
        from orders_ledger_1 group by month, category order by month, total desc""", """
        select strftime(o_orderdate, '%Y-%m') as month, o_orderpriority as category, round(sum(o_totalprice), 2) as total
        from orders group by 1, 2"""),
    "rev_mix_union": (inputs.four_sheets, """
        select 'urgent' as k, round(sum(o_totalprice), 2) as v from orders_ledger_1 where o_orderpriority like '1-%'
        union all select 'open', round(sum(o_totalprice), 2) from orders_ledger_1 where o_orderstatus = 'O'
        union all select 'balance', round(sum(c_acctbal), 2) from customer_table_1""", """
        select 'urgent' as k, round(sum(o_totalprice), 2) as v from orders where o_orderpriority like '1-%'
        union all select 'open', round(sum(o_totalprice), 2) from orders where o_orderstatus = 'O'
        union all select 'balance', round(sum(c_acctbal), 2) from customer"""),
    "scalar_ratio": (inputs.four_sheets, """
        select round((select sum(c_acctbal) from customer_table_1) / nullif((select sum(o_totalprice) from orders_ledger_1), 0), 6) as v""", """
        select round((select sum(c_acctbal) from customer) / nullif((select sum(o_totalprice) from orders), 0), 6) as v"""),
    "cte_query": (inputs.four_sheets, """
        with spend as (select o_custkey, sum(o_totalprice) as total from orders_ledger_1 group by o_custkey)
        select c_mktsegment as segment, count(*) as n, round(avg(total), 2) as mean
        from spend join customer_table_1 on o_custkey = c_custkey group by c_mktsegment""", """
        with spend as (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey)
        select c_mktsegment as segment, count(*) as n, round(avg(total), 2) as mean
        from spend join customer on o_custkey = c_custkey group by c_mktsegment"""),
    "reconcile_join": (inputs.order_lines, """
        select coalesce(o_orderkey, l_orderkey) as k, round(o_totalprice, 2) as booked, line_sum,
          case when l_orderkey is null then 'no lines' when o_orderkey is null then 'no order'
               when abs(o_totalprice - line_sum) <= 1000 then 'ok' else 'differs' end as state
        from orders_summary_1 full outer join lines_table_1 on o_orderkey = l_orderkey""", """
        with l as (select l_orderkey, round(sum(l_extendedprice), 2) as line_sum from lineitem group by l_orderkey)
        select cast(coalesce(o_orderkey, l_orderkey) as double) as k, round(o_totalprice, 2) as booked, line_sum,
          case when l_orderkey is null then 'no lines' when o_orderkey is null then 'no order'
               when abs(o_totalprice - line_sum) <= 1000 then 'ok' else 'differs' end as state
        from orders full outer join l on o_orderkey = l_orderkey"""),
    "left_right_joins": (inputs.order_lines, """
        select 'left' as side, o_orderkey as k, n_lines from orders_summary_1 left join lines_table_1 on o_orderkey = l_orderkey and n_lines > 3
        union all select 'right', l_orderkey, n_lines from (select * from orders_summary_1 where o_totalprice > 100000) right join lines_table_1 on o_orderkey = l_orderkey
        where o_orderkey is null""", """
        with l as (select l_orderkey, count(*) as n_lines from lineitem group by l_orderkey)
        select 'left' as side, cast(o_orderkey as double) as k, cast(n_lines as double) as n_lines from orders left join l on o_orderkey = l_orderkey and n_lines > 3
        union all select 'right', cast(l_orderkey as double), cast(n_lines as double) from (select * from orders where o_totalprice > 100000) right join l on o_orderkey = l_orderkey
        where o_orderkey is null"""),
    "nested_functions": (inputs.four_sheets, """
        select o_orderkey, size(split(o_orderpriority, '-')) as parts, element_at(split(o_orderpriority, '-'), 2) as name,
          array_join(transform(sequence(1, 3), x -> x * length(o_orderstatus)), '+') as scaled,
          map('s', o_orderstatus, 'p', o_orderpriority)['s'] as status,
          get_json_object(to_json(named_struct('a', named_struct('b', o_orderstatus))), '$.a.b') as inner,
          array_contains(array('O', 'F'), o_orderstatus) as known, from_json('{"x": 7}', 'x int').x as seven
        from orders_ledger_1""", """
        select cast(o_orderkey as double) as o_orderkey, len(string_split(o_orderpriority, '-')) as parts, string_split(o_orderpriority, '-')[2] as name,
          '1+2+3' as scaled, o_orderstatus as status, o_orderstatus as inner, o_orderstatus in ('O', 'F') as known, 7 as seven from orders"""),
    "missing_semi_anti": (inputs.order_lines, """
        select 'without lines' as kind, o_orderkey from orders_summary_1 o where not exists (select 1 from lines_table_1 where l_orderkey = o.o_orderkey)
        union all select 'with many lines', o_orderkey from orders_summary_1 where o_orderkey in (select l_orderkey from lines_table_1 where n_lines >= 7)""", """
        with l as (select l_orderkey, count(*) as n_lines from lineitem group by l_orderkey)
        select 'without lines' as kind, cast(o_orderkey as double) as o_orderkey from orders o where not exists (select 1 from l where l_orderkey = o.o_orderkey)
        union all select 'with many lines', cast(o_orderkey as double) from orders where o_orderkey in (select l_orderkey from l where n_lines >= 7)"""),
    "distinct_counts": (inputs.four_sheets, """
        select o_orderpriority as priority, count(distinct o_custkey) as customers,
          count(*) filter (where o_orderstatus = 'F') as finished from orders_ledger_1 group by o_orderpriority""", """
        select o_orderpriority as priority, count(distinct o_custkey) as customers,
          count(*) filter (where o_orderstatus = 'F') as finished from orders group by o_orderpriority"""),
    "rollup_totals": (inputs.four_sheets, """
        select o_orderpriority as priority, o_orderstatus as status, count(*) as n, round(sum(o_totalprice), 2) as total
        from orders_ledger_1 group by rollup (o_orderpriority, o_orderstatus)""", """
        select o_orderpriority as priority, o_orderstatus as status, count(*) as n, round(sum(o_totalprice), 2) as total
        from orders group by rollup (o_orderpriority, o_orderstatus)"""),
    "cube_counts": (inputs.four_sheets, """
        select c_mktsegment as segment, c_nationkey as nation, count(*) as n from customer_table_1
        group by grouping sets ((c_mktsegment, c_nationkey), (c_mktsegment), (c_nationkey), ())""", """
        select c_mktsegment as segment, cast(c_nationkey as double) as nation, count(*) as n from customer
        group by cube (c_mktsegment, c_nationkey)"""),
    "rank_frames": (inputs.four_sheets, """
        select o_orderkey, rank() over w as spend_rank, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as prev,
          round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), 2) as last3
        from orders_ledger_1 window w as (partition by o_custkey order by o_totalprice desc)""", """
        select cast(o_orderkey as double) as o_orderkey, rank() over w as spend_rank, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as prev,
          round(sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row), 2) as last3
        from orders window w as (partition by o_custkey order by o_totalprice desc)"""),
    "set_diff": (inputs.four_sheets, """
        select * from (select 'never ordered' as kind, c_custkey as k from customer_table_1 except select 'never ordered', o_custkey from orders_ledger_1)
        union select * from (select 'both' as kind, c_custkey as k from customer_table_1 intersect select 'both', o_custkey from orders_ledger_1)""", """
        (select 'never ordered' as kind, cast(c_custkey as double) as k from customer except select 'never ordered', cast(o_custkey as double) from orders)
        union (select 'both' as kind, cast(c_custkey as double) as k from customer intersect select 'both', cast(o_custkey as double) from orders)"""),
    "offset_correlated": (inputs.four_sheets, """
        select s_suppkey, s_acctbal, (select count(*) from customer_table_1 where c_nationkey = s_nationkey) as customers
        from supplier_table_1 order by s_acctbal desc, s_suppkey limit 50 offset 5""", """
        select cast(s_suppkey as double) as s_suppkey, s_acctbal, (select count(*) from customer where c_nationkey = s_nationkey) as customers
        from supplier order by s_acctbal desc, s_suppkey limit 50 offset 5"""),
    "scalar_functions": (inputs.four_sheets, """
        select o_orderkey, upper(o_orderpriority) as pri, length(o_orderdate) as len, cast(substr(o_orderdate, 1, 4) as int) as year,
          round(sqrt(o_totalprice), 3) as root, greatest(o_custkey, 100) as g, coalesce(nullif(o_orderstatus, 'P'), 'pending') as st,
          concat(o_orderstatus, '/', substr(o_orderpriority, 3)) as tag, replace(o_orderpriority, ' ', '_') as slug
        from orders_ledger_1""", """
        select cast(o_orderkey as double) as o_orderkey, upper(o_orderpriority) as pri, 19 as len, cast(year(o_orderdate) as int) as year,
          round(sqrt(o_totalprice), 3) as root, cast(greatest(o_custkey, 100) as double) as g, coalesce(nullif(o_orderstatus, 'P'), 'pending') as st,
          concat(o_orderstatus, '/', substr(o_orderpriority, 3)) as tag, replace(o_orderpriority, ' ', '_') as slug
        from orders"""),
    "least_months": (inputs.priority_months, """
        select trim(line_item) as line_item, least(jan,feb,mar,apr,may,jun,jul,aug,sep,oct,nov,dec) as v,
          (least(jan,feb,mar,apr,may,jun,jul,aug,sep,oct,nov,dec) < 0) as negative, round(year_1_total, 2) as year_total
        from revenue_table_2""", """
        with m as (select o_orderpriority as p, month(o_orderdate) as m, round(sum(o_totalprice), 2) as v from orders group by all)
        select p as line_item, min(v) as v, min(v) < 0 as negative, round(sum(v), 2) as year_total from m group by p"""),
}


def _view_query(build, sql):
    return lambda spark, sf: stored_lake(spark, sf, build).sql(sql)


def range_pairs(spark, sf):
    """Q15: orders whose total lies within 500 of fifty times a supplier's balance."""
    book = stored_lake(spark, sf, inputs.four_sheets)
    suppliers = book.table("supplier_table_1").select("s_suppkey", (F.col("s_acctbal") * 50 - 500).alias("lo"), (F.col("s_acctbal") * 50 + 500).alias("hi"))
    orders = book.table("orders_ledger_1").select("o_totalprice", F.lit(1).cast("long").alias("n"), F.col("o_totalprice").alias("total"))
    pairs = joins.range_lookup(orders, suppliers, "o_totalprice", "lo", "hi", 1000.0, combine={"n": "sum", "total": "sum"})
    return pairs.groupBy("s_suppkey").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


RANGE_PAIRS = """
select cast(s_suppkey as double) as s_suppkey, count(*) as n, round(sum(o_totalprice), 2) as total
from orders join supplier on o_totalprice between s_acctbal * 50 - 500 and s_acctbal * 50 + 500 group by s_suppkey
"""


def asof_lookup(spark, sf):
    events = table(spark, sf, "events")
    right = events.where("event_type = 'view'").select("user_id", "ts", "event_id", "value")
    left = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    return joins.asof_lookup(left, right, "user_id", "ts", "value", "event_id", "view_value").select("event_id", "user_id", "view_value")


ASOF_LOOKUP = """
select l.event_id, l.user_id, r.value as view_value
from (select * from events where event_type = 'purchase') l
asof left join (select user_id, ts, value from events where event_type = 'view') r on l.user_id = r.user_id and l.ts >= r.ts
"""


def asof_busy(spark, sf):
    """Q16 where one key on one day has half of all rows: every event asks for the last view of its user before it."""
    busy = F.col("event_id") % 2 == 0
    second = F.expr("event_id * 7919 % 86400")
    events = table(spark, sf, "events").select(
        "event_id", "event_type", "value", F.when(busy, F.lit(0)).otherwise(F.col("user_id")).alias("key"),
        F.when(busy, F.timestamp_seconds(second)).otherwise(F.col("ts")).alias("at"))
    views = events.where("event_type = 'view'")
    return joins.asof_lookup(events.where("event_type <> 'view'"), views, "key", "at", "value", "event_id", "view_value").select("event_id", "view_value")


ASOF_BUSY = """
with e as (
  select event_id, event_type, value, case when event_id % 2 = 0 then 0 else user_id end as key,
    case when event_id % 2 = 0 then make_timestamp(event_id * 7919 % 86400 * 1000000) else ts end as moment from events),
o as (
  select event_id, event_type, key, last_value(case when event_type = 'view' then {'v': value} end ignore nulls) over (
    partition by key order by moment, event_type <> 'view', event_id rows between unbounded preceding and current row) as seen from e)
select event_id, seen.v as view_value from o where event_type <> 'view'
"""


def range_nested(spark, sf):
    """Q15 with spans from one unit to the whole domain: customers as spans around their balance, wider by key; orders as points,
    a third of them at one value. Pairs are counted per span."""
    reach = F.pow(F.lit(2.0), F.col("c_custkey") % 20)
    spans = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") * 20 - reach).alias("lo"), (F.col("c_acctbal") * 20 + reach).alias("hi"))
    points = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(50_000.0)).otherwise(F.col("o_totalprice")).alias("p"))
    # Equal points meet the same spans, so each value is looked up once.
    values = points.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    pairs = joins.range_lookup(values, spans, "p", "lo", "hi", 1.0, combine={"n": "sum", "p": "max"})
    return pairs.groupBy("c_custkey").agg(F.sum("n").alias("n"), F.round(F.max("p"), 2).alias("highest"))


RANGE_NESTED = """
with s as (select c_custkey, c_acctbal * 20 - pow(2, c_custkey % 20) as lo, c_acctbal * 20 + pow(2, c_custkey % 20) as hi from customer),
p as (select case when o_orderkey % 3 = 0 then 50000.0::double else o_totalprice end as p, count(*) as n from orders group by 1)
select c_custkey, cast(sum(n) as bigint) as n, round(max(p), 2) as highest from p join s on p between lo and hi group by c_custkey
"""


def months_unpivot(spark, sf):
    wide = lake(spark, sf, inputs.priority_months).table("revenue_table_2")
    months = [m.lower() for m in inputs.MONTH_NAMES]
    return wide.unpivot("line_item", months, "month", "v").where("v is not null")


MONTHS_UNPIVOT = """
with m as (select o_orderpriority as line_item, month(o_orderdate) as m, round(sum(o_totalprice), 2) as v from orders group by all)
select line_item, lower(strftime(make_date(2000, cast(m as int), 1), '%b')) as month, v from m
"""


def months_pivot(spark, sf):
    orders = lake(spark, sf, inputs.four_sheets).table("orders_ledger_1")
    years = [str(y) for y in range(1995, 2002)]
    year = F.substring("o_orderdate", 1, 4)
    # Years that have no column of their own share one, so no order is left out.
    return orders.withColumn("year", F.when(year.isin(*years), year).otherwise("other")).groupBy("o_orderpriority").pivot("year", [*years, "other"]).agg(
        F.count(F.lit(1))).select("o_orderpriority", *[F.coalesce(F.col(y), F.lit(0)).alias(f"y_{y}" if y == "other" else f"y{y}") for y in [*years, "other"]])


MONTHS_PIVOT = "select o_orderpriority, " + ", ".join(
    f"count(*) filter (where year(o_orderdate) = {y}) as y{y}" for y in range(1995, 2002)) + (
    ", count(*) filter (where coalesce(year(o_orderdate), 0) not between 1995 and 2001) as y_other from orders group by o_orderpriority")


def region_materialize(spark, sf):
    """S3: the orders grid back as typed rows."""
    df = lake(spark, sf, inputs.four_sheets).table("orders_ledger_1")
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
                     "o_totalprice__kind", "o_orderpriority__num", "o_orderdate__max")


REGION_MATERIALIZE = """
select cast(o_orderkey as double) as o_orderkey, cast(o_custkey as double) as o_custkey, o_orderstatus, o_totalprice,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as o_orderdate, o_orderpriority, 'number' as o_totalprice__kind,
  case when o_orderpriority like '1-%' then 1.0 else cast(substr(o_orderpriority, 1, 1) as double) / 100.0 end as o_orderpriority__num,
  greatest(year(o_orderdate), month(o_orderdate)) / 100.0 as o_orderdate__max
from orders
"""


def region_row_maps(spark, sf):
    """S3 in long form: every region of the sparse grid in one job."""
    rows = materialize.region_rows(lake(spark, sf, inputs.sparse_lines).structure)
    return rows.select("sheet", "min_r", F.col("min_c").cast("bigint").alias("min_c"), "r", F.size("values").cast("bigint").alias("n"),
                       F.array_join(F.array_sort(F.map_values("values")), "|").alias("texts"))


def _row_maps_sql():
    from gridloom.plans.structure import SPARSE

    return f"""with {SPARSE}
select l.sheet, l.min_r, cast(l.min_c as bigint) as min_c, l.r, count(*) as n,
  array_to_string(list_sort(list(case kind when 'date' then replace(txt, ' ', 'T') when 'bool' then lower(txt) else txt end)), '|') as texts
from labelled l left join headers h using (sheet, min_r, min_c)
where l.r >= coalesce(h.header_row + 1, l.min_r) group by l.sheet, l.min_r, l.min_c, l.r"""


def year1_total(spark, sf):
    st = lake(spark, sf, inputs.customer_months).structure
    return materialize.year_totals(st).select("sheet", "r", F.round("year_1_total", 2).alias("year_1_total"))


def _year1_sql():
    from gridloom.plans.structure import MONTHS_GRID

    return f"""with {MONTHS_GRID}
select c.sheet, c.r, round(sum(c.v), 2) as year_1_total from cells c join rband b using (sheet, r)
join matrix m on m.sheet = c.sheet and m.min_r = b.b0 and m.is_matrix and c.c between m.min_c and m.max_c
group by c.sheet, c.r"""


def percent_view(spark, sf):
    """Derived columns of a free-text rate column, as a view over the whole grid."""
    book = stored_lake(spark, sf, inputs.percent_lines)
    return book.sql("""
        select yield_text__kind as kind, l_linenumber as line, count(*) as n, round(sum(yield_text__num), 4) as num,
          round(sum(yield_text__min), 4) as lo, round(sum(yield_text__max), 4) as hi
        from rates_table_1 group by 1, 2""")


PERCENT_VIEW = """
with t as (select l_linenumber as n, cast(round(l_discount * 100) as int) as d, cast(round(l_tax * 100) as int) as x from lineitem),
p as (
  select n, case when n in (2, 6) then 'range' when n = 3 then 'number' when n = 4 then 'other' when n = 5 then 'formula'
      when n = 1 or d > 1 then 'percent' else 'number' end as kind,
    case when n = 1 or n = 3 or (n = 7 and d > 1) then d / 100.0 when n = 7 then cast(d as double) end as num,
    case when n in (2, 6) then least(d, x) / 100.0 end as lo, case when n in (2, 6) then greatest(d, x) / 100.0 end as hi from t)
select kind, cast(n as double) as line, count(*) as n, round(sum(num), 4) as num, round(sum(coalesce(lo, num)), 4) as lo,
  round(sum(coalesce(hi, num)), 4) as hi from p group by 1, 2
"""

QUERIES = {name: _view_query(build, sql) for name, (build, sql, _) in _ON_VIEWS.items()}
QUERIES |= {
    "range_lookup": range_pairs, "asof_lookup": asof_lookup, "asof_busy": asof_busy, "range_nested": range_nested, "months_unpivot": months_unpivot, "years_pivot": months_pivot,
    "region_materialize": region_materialize, "region_row_maps": region_row_maps, "year1_total": year1_total, "percent_view": percent_view,
}
ORACLES = {name: check for name, (_, _, check) in _ON_VIEWS.items()}
ORACLES |= {
    "range_lookup": RANGE_PAIRS, "asof_lookup": ASOF_LOOKUP, "asof_busy": ASOF_BUSY, "range_nested": RANGE_NESTED, "months_unpivot": MONTHS_UNPIVOT, "years_pivot": MONTHS_PIVOT,
    "region_materialize": REGION_MATERIALIZE, "region_row_maps": _row_maps_sql(), "year1_total": _year1_sql(), "percent_view": PERCENT_VIEW,
}
