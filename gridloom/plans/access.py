"""Access log, SQL guard and file queries."""

from __future__ import annotations

import uuid
from contextlib import suppress

from pyspark.sql import functions as F

from gridloom.functions.sql_guard import BLOCKED_WORDS, GuardError, sql_verdict
from gridloom.lake import Lake
from gridloom.operators import audit
from gridloom.plans import inputs
from gridloom.plans.inputs import lake, table
from gridloom.session import shared_folder
from gridloom.streaming.repeat_reads import stream_repeat_reads


def _reads(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("key"))


def repeat_reads(spark, sf):
    """Sessions are users, the read key is the event type."""
    out = audit.repeat_reads(_reads(spark, sf), ["created_at", "event_id"], F.date_trunc("day", F.col("created_at")))
    return out.select("event_id", "session_id", "times_read", "warn")


REPEAT_READS = """
with n as (select *, row_number() over (partition by user_id order by ts, event_id) as n from events)
select event_id, cast(user_id as varchar) as session_id,
  1 + count(*) over (partition by user_id, event_type order by n range between 200 preceding and 1 preceding) as times_read,
  1 + count(*) over (partition by user_id, event_type order by n range between 200 preceding and 1 preceding) >= 3 as warn from n
"""


def small_repeat_reads(spark, sf):
    """T1 with its size rule: a read has as many cells as its event says, larger reads do not count; with the warning text.

    One user in the log is busy far beyond the others: half of all events are dealt to one session.
    """
    reads = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 2 == 0, F.lit("busy")).otherwise(F.col("user_id").cast("string")).alias("session_id"), "event_id",
        F.col("ts").alias("created_at"), F.col("event_type").alias("key"), (F.col("event_id") * 7 % 100 + 1).alias("n_cells"))
    out = audit.repeat_reads(audit.small_reads(reads, F.col("n_cells")), ["created_at", "event_id"], F.date_trunc("hour", F.col("created_at")))
    return out.select("event_id", "session_id", "times_read", F.when(F.col("warn"), audit.repeat_read_warning(F.col("key"), F.col("times_read"))).alias("warning"))


SMALL_REPEAT_READS = """
with r as (select event_id, ts, event_type, case when event_id % 2 = 0 then 'busy' else cast(user_id as varchar) end as s from events where event_id * 7 % 100 + 1 <= 64),
n as (select *, row_number() over (partition by s order by ts, event_id) as n from r),
c as (select event_id, s, event_type, 1 + count(*) over (partition by s, event_type order by n range between 200 preceding and 1 preceding) as t from n)
select event_id, s as session_id, t as times_read, case when t >= 3 then 'Range ' || event_type || ' has been read ' || t || ' times this session.' end as warning from c
"""


def repeat_reads_stream(spark, sf):
    """T1 as a stream over the same log, run to its end, result read back."""
    base = f"{shared_folder(spark)}/gridloom/reads-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(sf)
    reads = stream.select(F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("ts").alias("created_at"), F.col("event_type").alias("key"))
    query = (
        stream_repeat_reads(reads).writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "session_id", "times_read", "warn")


def _audit_events(spark, sf):
    """The event table in audit form: small values are failures."""
    events = table(spark, sf, "events")
    failed = F.col("value") < 2
    return events.select(
        F.concat(F.lit("evt_"), F.col("event_id")).alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("created_at"),
        F.col("event_type").alias("operation"), F.concat(F.lit("s"), F.col("user_id")).alias("session_id"),
        F.concat(F.lit("book_"), F.col("user_id") % 7, F.lit(".xlsx")).alias("path"), F.col("props").alias("input_summary"),
        F.array(F.lit("a")).alias("source_refs"), F.array().cast("array<string>").alias("touched_ranges"),
        F.array().cast("array<string>").alias("warnings"), (~failed).alias("ok"),
        F.when(failed, F.lit("mutating_sql_rejected")).alias("error_code"), F.floor("value").alias("elapsed_ms"))


def audit_latest(spark, sf):
    """Append the log, read it back, newest first for one workbook. The limit is the feature."""
    path = f"{shared_folder(spark)}/gridloom/audit-{uuid.uuid4().hex}"
    audit.append_audit(_audit_events(spark, sf), path)
    return audit.latest_audit(audit.read_audit(spark, path), path="book_3.xlsx").select("event_id", "operation", "session_id", "ok", "elapsed_ms")


AUDIT_LATEST = """
select 'evt_' || event_id as event_id, event_type as operation, 's' || user_id as session_id, value >= 2 as ok, cast(floor(value) as bigint) as elapsed_ms
from events where user_id % 7 = 3 order by ts desc, event_id desc limit 100
"""


def audit_from_use(spark, sf):
    """What a session leaves behind that reads each brand's sheet one to three times and asks two refused things."""
    book = Lake(lake(spark, sf, inputs.part_sheets).cells)
    brands = [r[0] for r in table(spark, sf, "part").groupBy("p_brand").agg((F.count(F.lit(1)) % 3 + 1).alias("n")).select(
        F.explode(F.expr("array_repeat(p_brand, cast(n as int))"))).orderBy("col").collect()]  # brands are few
    for brand in brands:
        book.read("parts", brand, "A1:B3")
    for sql in ("drop table parts", "select * from nowhere"):
        with suppress(GuardError):
            book.sql(sql)
    mine = book.audit(book.trail.session_id, limit=None)
    return mine.groupBy("operation", F.coalesce(F.get("source_refs", F.lit(0)), F.lit("-")).alias("ref"), F.coalesce("error_code", F.lit("ok")).alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.get("warnings", F.lit(0))).alias("warning"))


AUDIT_FROM_USE = """
select 'read-range' as operation, p_brand || '!A1:B3' as ref, 'ok' as code, count(*) % 3 + 1 as n,
  case when count(*) % 3 = 2 then 'Range ' || p_brand || '!A1:B3 has been read 3 times this session.' end as warning from part group by p_brand
union all select 'query', '-', 'mutating_sql_rejected', 1, null union all select 'query', '-', 'table_not_found', 1, null
"""


def audit_stats(spark, sf):
    out = audit.audit_stats(_audit_events(spark, sf))
    return out.select("operation", F.coalesce("error_code", F.lit("-")).alias("error_code"), "n", "n_ok", "min_ms", F.round("avg_ms", 4).alias("avg_ms"), "max_ms")


AUDIT_STATS = """
select event_type as operation, case when value < 2 then 'mutating_sql_rejected' else '-' end as error_code, count(*) as n,
  count(*) filter (where value >= 2) as n_ok, cast(min(floor(value)) as bigint) as min_ms, round(avg(floor(value)), 4) as avg_ms, cast(max(floor(value)) as bigint) as max_ms
from events group by 1, 2
"""


def sql_guard(spark, sf):
    """P11 over whole conversation texts behind different first words."""
    turn = F.col("turn") % 5
    head = (F.when(turn == 0, F.lit("select ")).when(turn == 1, F.lit("  WITH x ")).when(turn == 2, F.lit("delete from t; "))
            .when(turn == 3, F.lit("")).otherwise(F.lit("select 1 -- drop ")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(head, F.when(turn == 3, F.lit("  ; ")).otherwise(F.col("text"))).alias("sql"),
                                                    F.col("text"))
    return rows.select("conv_id", "turn", sql_verdict(F.col("sql")).alias("verdict"), sql_verdict(F.col("text")).alias("bare"))


_WORDS = "|".join(BLOCKED_WORDS)
_BLOCK = r"(?i)(^|[^\p{L}\p{N}_])(" + _WORDS + r")($|[^\p{L}\p{N}_])"
_FIRST = r"(?i)^(select|with)(\s|$)"


def _verdict(col):
    return f"""case when trim(rtrim({col}, ';')) = '' then 'empty_sql' when regexp_matches({col}, '{_BLOCK}') then 'mutating_sql_rejected'
    when not regexp_matches(trim({col}), '{_FIRST}') then 'unsupported_sql' else 'ok' end"""


SQL_GUARD = f"""
with t as (
  select conv_id, turn, text, case turn % 5 when 0 then 'select ' when 1 then '  WITH x ' when 2 then 'delete from t; ' when 3 then '' else 'select 1 -- drop ' end
    || case when turn % 5 = 3 then '' else text end as sql from conversations)
select conv_id, turn, {_verdict('sql')} as verdict, {_verdict('text')} as bare from t
"""

QUERIES = {"small_repeat_reads": small_repeat_reads, "repeat_reads": repeat_reads, "repeat_reads_stream": repeat_reads_stream, "audit_latest": audit_latest,
           "audit_stats": audit_stats, "audit_from_use": audit_from_use, "sql_guard": sql_guard}
ORACLES = {"small_repeat_reads": SMALL_REPEAT_READS, "repeat_reads": REPEAT_READS, "repeat_reads_stream": REPEAT_READS, "audit_latest": AUDIT_LATEST,
           "audit_stats": AUDIT_STATS, "audit_from_use": AUDIT_FROM_USE, "sql_guard": SQL_GUARD}
