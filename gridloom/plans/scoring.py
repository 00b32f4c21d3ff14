"""Scoring queries (V1-V7, P7-P10, P12, S9, S10): order totals against sums of their lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.functions import matching as m
from gridloom.functions import text as tx
from gridloom.functions.numbers import check_number, gold_number
from gridloom.operators import checks as ck
from gridloom.operators import scoring as sc
from gridloom.plans import inputs
from gridloom.plans.inputs import lake, table
from gridloom.session import shared_folder
from gridloom.sources import jsonlines as jl


def _line_sums(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("got"))


_SUMS = "s as (select l_orderkey, round(sum(l_extendedprice), 2) as got from lineitem group by l_orderkey)"


def check_matches(spark, sf):
    """V1-V3 for every order with lines."""
    both = table(spark, sf, "orders").join(_line_sums(spark, sf), F.col("o_orderkey") == F.col("l_orderkey"))
    got, want = F.col("got"), F.col("o_totalprice")
    return both.select(
        "o_orderkey", m.relative_match(got, want, F.lit(0.2)).alias("relative"), m.absolute_match(got, want, F.lit(5000.0)).alias("absolute"),
        m.percent_or_fraction_match(got / 100, want, F.lit(500.0)).alias("percent"), m.bool_match(got > 100000, want > 100000).alias("flag"))


CHECK_MATCHES = f"""with {_SUMS}
select o_orderkey, abs(got - o_totalprice) <= 0.2 * greatest(1.0, abs(o_totalprice)) as relative, abs(got - o_totalprice) <= 5000 as absolute,
  abs(got / 100 - o_totalprice) <= 500 or abs(got / 100 - o_totalprice / 100.0) <= 500 as percent, (got > 100000) = (o_totalprice > 100000) as flag
from orders join s on o_orderkey = l_orderkey"""


def check_map(spark, sf):
    """V4: per customer, sums by status against expected ones; a customer may lack a status."""
    orders = table(spark, sf, "orders")
    per = orders.groupBy("o_custkey", "o_orderstatus").agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    maps = per.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("got"))
    want = F.create_map(F.lit("O"), F.try_element_at("got", F.lit("O")) * 1.005, F.lit("F"), F.lit(250000.0))
    return maps.select("o_custkey", m.map_match(F.col("got"), F.map_filter(want, lambda k, v: v.isNotNull()), F.lit(0.5)).alias("ok"))


CHECK_MAP = """
with v as (select o_custkey, round(sum(o_totalprice) filter (where o_orderstatus = 'F'), 2) as f from orders group by o_custkey)
select o_custkey, coalesce(abs(f - 250000.0) <= 0.5 * 250000.0, false) as ok from v
"""


def _renderings(spark, sf):
    """Order totals as people write them."""
    k, v = F.col("o_orderkey") % 7, F.col("o_totalprice")
    whole = F.floor(v)
    text = (
        F.when(k == 0, F.concat(F.lit("$"), F.format_string("%.1f", F.round(v / 1000, 1)), F.lit("k"))).when(k == 1, F.concat(whole, F.lit(" USD")))
        .when(k == 2, F.concat(F.lit("about "), F.floor(whole / 1000), F.lit(","), F.lpad((whole % 1000).cast("string"), 3, "0")))
        .when(k == 3, F.concat((whole % 100), F.lit("%"))).when(k == 4, F.concat(F.lit("-"), whole % 10, F.lit(" months")))
        .when(k == 5, F.lit("n/a")).otherwise(F.concat(whole, F.lit(".50"))))
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice", text.alias("answer"))


_TEXTS = """t as (
  select o_orderkey, o_totalprice, cast(floor(o_totalprice) as bigint) as w, o_orderkey % 7 as k,
    case o_orderkey % 7 when 0 then '$' || printf('%.1f', round(o_totalprice / 1000, 1)) || 'k' when 1 then cast(floor(o_totalprice) as bigint) || ' USD'
      when 2 then 'about ' || (cast(floor(o_totalprice) as bigint) // 1000) || ',' || lpad(cast(cast(floor(o_totalprice) as bigint) % 1000 as varchar), 3, '0')
      when 3 then (cast(floor(o_totalprice) as bigint) % 100) || '%' when 4 then '-' || (cast(floor(o_totalprice) as bigint) % 10) || ' months'
      when 5 then 'n/a' else cast(floor(o_totalprice) as bigint) || '.50' end as answer from orders),
n as (select *, case k when 0 then cast(regexp_extract(answer, '[0-9.]+') as double) * 1000 when 1 then w when 2 then w when 3 then w % 100
      when 4 then -(w % 10) * 1000000.0 when 6 then w + 0.5 end as gold from t)"""


def gold_parse(spark, sf):
    """P8, P9 on every rendering."""
    return _renderings(spark, sf).select("o_orderkey", "answer", F.round(gold_number(F.col("answer")), 3).alias("gold"), check_number(F.col("answer")).alias("plain"))


GOLD_PARSE = f"with {_TEXTS} select o_orderkey, answer, round(cast(gold as double), 3) as gold, case when k = 6 then w + 0.5 end as plain from n"


def text_normalize(spark, sf):
    """P10, P7 on whole documents and order dates."""
    docs = table(spark, sf, "documents").select(F.lit("doc").alias("kind"), "doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("value"))
    dates = table(spark, sf, "orders").select(F.lit("iso").alias("kind"), F.col("o_orderkey").alias("doc_id"), tx.iso_timestamp(F.col("o_orderdate")).alias("value"))
    stamps = table(spark, sf, "events").select(F.lit("micro").alias("kind"), F.col("event_id").alias("doc_id"), tx.iso_timestamp(F.col("ts")).alias("value"))
    return docs.union(dates).union(stamps)


TEXT_NORMALIZE = r"""
select 'doc' as kind, doc_id, md5(lower(trim(regexp_replace(text, '[\s\x0B\x{85}\p{Z}]+', ' ', 'g')))) as value from documents
union all select 'iso', o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') from orders
union all select 'micro', event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') from events
"""


def enum_match(spark, sf):
    """V5, V6, P12 on whole conversation texts."""
    talk = table(spark, sf, "conversations")
    accept = F.array(F.lit("the"), F.lit(" Que  LA"), F.col("role"))
    groups = F.array(F.array(F.lit("THE"), F.lit("la")), F.array(F.lit("an"), F.lit("zzz")))
    return talk.select("conv_id", "turn", m.enum_match(F.col("text"), accept).alias("enum_ok"), m.all_groups_match(F.col("text"), groups).alias("groups_ok"),
                       m.formula_contains(F.col("text"), F.array(F.lit("th"), F.lit("."))).alias("tokens_ok"))


ENUM_MATCH = r"""
with n as (select *, lower(trim(regexp_replace(text, '[\s\x0B\x{85}\p{Z}]+', ' ', 'g'))) as g from conversations)
select conv_id, turn, contains(g, 'the') or contains('the', g) or contains(g, 'que la') or contains('que la', g) or contains(g, role) or contains(role, g) as enum_ok,
  (contains(g, 'the') or contains(g, 'la')) and (contains(g, 'an') or contains(g, 'zzz')) as groups_ok, contains(text, 'th') and contains(text, '.') as tokens_ok
from n
"""


def _gold(spark, sf):
    orders = table(spark, sf, "orders")
    k = F.col("o_orderkey") % 5
    kinds = F.array(*[F.lit(x) for x in ("relative", "absolute", "percent_or_fraction", "enum", "contains_all_groups")])
    return orders.select(
        F.concat(F.lit("q"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("id"),
        F.when(k == 3, F.lit("high")).otherwise(F.round("o_totalprice", 2).cast("decimal(18,2)").cast("string")).alias("expected"),
        F.get(kinds, k.cast("int")).alias("match"), F.when(k == 0, F.lit(0.3)).when(k == 1, F.lit(20000.0)).when(k == 2, F.lit(2000.0)).alias("tolerance"),
        F.lit("USD").alias("unit"), F.when(k == 3, F.array(F.lit("High"), F.lit("urgent"))).alias("accept"),
        F.when(k == 4, F.array(F.array(F.lit("LOW"), F.lit("urgent")), F.array(F.lit("5"), F.lit("1")))).alias("groups"), F.lit("book").alias("source_ref"))


def _answers(spark, sf):
    both = table(spark, sf, "orders").join(_line_sums(spark, sf), F.col("o_orderkey") == F.col("l_orderkey"))
    k = F.col("o_orderkey") % 5
    text = F.when(k >= 3, F.col("o_orderpriority")).otherwise(F.format_string("$%.2f", F.col("got")))
    return both.select(F.concat(F.lit("q"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0")).alias("id"), text.alias("answer"),
                       F.lit("s").alias("source_ref"), F.lit("m").alias("method"))


def score(spark, sf):
    """V7: every order is a question; orders without lines have no answer."""
    return sc.score_answers(_gold(spark, sf), _answers(spark, sf)).select("id", "verdict", "got")


_SCORE = f"""{_SUMS},
j as (select 'q' || lpad(cast(o_orderkey as varchar), 12, '0') as id, o_orderkey % 5 as k, round(o_totalprice, 2) as e, got, l_orderkey, lower(o_orderpriority) as p, o_orderpriority
      from orders left join s on o_orderkey = l_orderkey),
v as (
  select id, case when l_orderkey is null then null when k >= 3 then o_orderpriority else '$' || printf('%.2f', got) end as got,
    case when l_orderkey is null then 'missing' when case k when 0 then abs(got - e) <= 0.3 * greatest(1.0, abs(e)) when 1 then abs(got - e) <= 20000
      when 2 then abs(got - e) <= 2000 or abs(got - e / 100.0) <= 2000 when 3 then contains(p, 'high') or contains(p, 'urgent')
      else (contains(p, 'low') or contains(p, 'urgent')) and (contains(p, '5') or contains(p, '1')) end then 'pass' else 'fail' end as verdict from j)"""
SCORE = f"with {_SCORE} select id, verdict, got from v"


def score_report(spark, sf):
    """Gold and answers as JSON lines, loaded with their schemas, scored, reported, read back."""
    base = f"{shared_folder(spark)}/gridloom/suite-{uuid.uuid4().hex}"
    _gold(spark, sf).write.json(f"{base}/gold")
    _answers(spark, sf).write.json(f"{base}/answers")
    gold = jl.read_json_lines(spark, f"{base}/gold", jl.GOLD_SCHEMA)
    answers = jl.read_json_lines(spark, f"{base}/answers", jl.ANSWER_SCHEMA)
    jl.write_report(sc.score_answers(gold, answers), f"{base}/report")
    report = spark.read.schema("id string, verdict string").json(f"{base}/report")
    return sc.score_total(report)


SCORE_REPORT = f"""with {_SCORE}
select count(*) filter (where verdict = 'pass') as passed, count(*) as total, (count(*) filter (where verdict = 'pass')) || '/' || count(*) as score from v"""

def check_suite(spark, sf):
    """Three checks for every customer formula (value, formula text, precedents), extracted over the lake and scored.

    The checks are written and loaded as JSON lines. Some expect what is not there, some name a missing sheet.
    """
    k, cell = F.col("c_custkey"), F.concat(F.lit("$B$"), F.col("c_custkey") + 1)
    ref = lambda more: F.concat(F.lit("B"), (F.col("c_nationkey") + 1 + more).cast("string"))
    spec = lambda kind, sheet: F.struct(F.lit(kind).alias("type"), sheet.alias("sheet"), cell.alias("cell"))
    here, customers = F.lit("customer"), table(spark, sf, "customer")
    name = lambda kind: F.concat(F.lit("c"), k, F.lit(f"-{kind}")).alias("id")
    kinds = [
        (name("cell"), spec("cell", here).alias("extract"), F.struct(
            F.when(k % 7 == 0, 2.0).otherwise(1.0).alias("value"), F.lit("absolute").alias("match"), F.lit(0.5).alias("tol")).alias("expect")),
        (name("formula"), spec("formula", here).alias("extract"), F.struct(
            F.lit("formula_contains").alias("match"), F.array(F.lit("nation list"), ref(F.when(k % 5 == 0, 1).otherwise(0))).alias("contains")).alias("expect")),
        (name("trace"), spec("trace", F.when(k % 3 == 0, F.lit("nowhere")).otherwise(here)).alias("extract"), F.struct(
            F.lit("trace_formula").alias("match"), F.concat(F.lit("='nation list'!"), ref(0)).alias("formula"), F.array(ref(0)).alias("precedents")).alias("expect"))]
    base = f"{shared_folder(spark)}/gridloom/checks-{uuid.uuid4().hex}"
    for columns in kinds:
        customers.select(*columns).write.mode("append").json(base)
    checks = jl.read_json_lines(spark, base, jl.CHECK_SCHEMA)
    return ck.check_suite(lake(spark, sf, inputs.formula_model), checks, "lake")


CHECK_SUITE = """
select 'c' || c_custkey || '-cell' as id, case when c_custkey % 7 = 0 then 'fail' else 'pass' end as verdict from customer
union all select 'c' || c_custkey || '-formula', case when c_custkey % 5 = 0 then 'fail' else 'pass' end from customer
union all select 'c' || c_custkey || '-trace', case when c_custkey % 3 = 0 then 'fail' else 'pass' end from customer
"""

QUERIES = {"check_suite": check_suite, "check_matches": check_matches, "check_map": check_map, "gold_parse": gold_parse, "text_normalize": text_normalize,
           "enum_match": enum_match, "score": score, "score_report": score_report}
ORACLES = {"check_suite": CHECK_SUITE, "check_matches": CHECK_MATCHES, "check_map": CHECK_MAP, "gold_parse": GOLD_PARSE, "text_normalize": TEXT_NORMALIZE,
           "enum_match": ENUM_MATCH, "score": SCORE, "score_report": SCORE_REPORT}
