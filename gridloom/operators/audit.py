"""The access log - append, list, repeated small reads, per-operation statistics."""

from __future__ import annotations

import json
import time
import uuid
from collections import deque
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.sources.grid import block_row_number

AUDIT_SCHEMA = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("created_at", T.DoubleType()),
    T.StructField("operation", T.StringType()),
    T.StructField("session_id", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("input_summary", T.StringType()),
    T.StructField("source_refs", T.ArrayType(T.StringType())),
    T.StructField("touched_ranges", T.ArrayType(T.StringType())),
    T.StructField("warnings", T.ArrayType(T.StringType())),
    T.StructField("ok", T.BooleanType()),
    T.StructField("error_code", T.StringType()),
    T.StructField("elapsed_ms", T.LongType()),
])

# Repeat-read rule.
SMALL_READ_CELLS = 64
READ_MEMORY = 200
REPEAT_THRESHOLD = 3
AUDIT_LIMIT = 100
#: Events that a session holds before it writes them.
AUDIT_BATCH = 64

# Reads of one session are compared inside blocks of this many, each with a copy of the last
# READ_MEMORY reads before it.
READ_BLOCK = 8_192


class Trail:
    """The calls of one session as audit events, and its memory of small reads.

    Events are held by the driver and appended in batches, one folder per batch: a batch that is written again after a
    failure replaces itself. A full batch is written at once, the rest by ``flush`` and ``events``.
    """

    def __init__(self, spark: SparkSession, folder: Callable[[], str], session_id: str | None = None, batch: int = AUDIT_BATCH):
        self.spark, self._folder, self.batch = spark, folder, batch
        self.session_id = session_id or f"sess_{uuid.uuid4().hex}"
        self._held: list[tuple] = []
        self._written, self._numbered = 0, 0
        self._reads: deque[str] = deque(maxlen=READ_MEMORY)
        #: Warnings of the last call.
        self.warnings: list[str] = []

    @contextmanager
    def call(self, operation: str, path: str | None = None, **summary):
        """Record what happens inside; the event that is yielded takes ``source_refs``, ``touched_ranges`` and ``warnings``."""
        event = {"source_refs": [], "touched_ranges": [], "warnings": []}
        created, started, code = time.time(), time.perf_counter(), None
        try:
            yield event
        except Exception as exc:
            code = getattr(exc, "code", None) or type(exc).__name__
            raise
        finally:
            self._numbered += 1
            said = {k: v for k, v in summary.items() if v is not None}
            self.warnings = event["warnings"]
            self._held.append((
                f"evt_{self.session_id}_{self._numbered:09d}", created, operation, self.session_id, path, json.dumps(said, ensure_ascii=False, default=str),
                *[event[k] for k in ("source_refs", "touched_ranges", "warnings")], code is None, code, int((time.perf_counter() - started) * 1000)))
            if len(self._held) >= self.batch:
                self.flush()

    def small_read(self, key: str, n_cells: int) -> str | None:
        """Remember a read; the warning when a small one comes again too often."""
        if n_cells > SMALL_READ_CELLS:
            return None
        times = self._reads.count(key) + 1
        self._reads.append(key)
        return f"Range {key} has been read {times} times this session." if times >= REPEAT_THRESHOLD else None

    def flush(self) -> None:
        if self._held:
            rows = self.spark.createDataFrame(self._held, AUDIT_SCHEMA).coalesce(1)
            rows.write.mode("overwrite").parquet(f"{self._folder()}/batch={self.session_id}-{self._written:09d}")
            self._held, self._written = [], self._written + 1

    def events(self) -> DataFrame:
        """All events below the folder, of this and earlier sessions."""
        if not self._written and not self._held:
            return self.spark.createDataFrame([], AUDIT_SCHEMA)
        self.flush()
        return read_audit(self.spark, self._folder())


def append_audit(events: DataFrame, path: str) -> None:
    events.select(*AUDIT_SCHEMA.fieldNames()).write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(AUDIT_SCHEMA).parquet(path)


def latest_audit(events: DataFrame, session_id: str | None = None, path: str | None = None,
                 limit: int | None = AUDIT_LIMIT, time_col: str = "created_at", tie: str = "event_id") -> DataFrame:
    """Newest events first, optionally of one session and/or path."""
    if session_id is not None:
        events = events.where(F.col("session_id") == session_id)
    if path is not None:
        events = events.where(F.col("path") == path)
    newest = events.orderBy(F.desc(time_col), F.desc(tie))
    return newest if limit is None else newest.limit(limit)


def audit_stats(events: DataFrame) -> DataFrame:
    """Counts and elapsed times per operation and error code."""
    return events.groupBy("operation", "error_code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"),
        F.min("elapsed_ms").alias("min_ms"), F.avg("elapsed_ms").alias("avg_ms"), F.max("elapsed_ms").alias("max_ms"))


def small_reads(reads: DataFrame, n_cells: Column, most: int = SMALL_READ_CELLS) -> DataFrame:
    """The reads that the repeat rule looks at: those of at most ``most`` cells."""
    return reads.where(n_cells <= most)


def repeat_reads(reads: DataFrame, order: list[str], time_block: Column, memory: int = READ_MEMORY,
                 threshold: int = REPEAT_THRESHOLD, read_block: int = READ_BLOCK) -> DataFrame:
    """T1 over a stored log: per small read, how often its key was read among the last ``memory`` ones.

    ``reads`` has session_id, key and the order columns (small reads only). ``time_block`` grows with
    the order and cuts a long session into numbering blocks. Counting runs per (session, key, read
    block) over a range of read numbers; each block also gets the few reads just before it, so no
    session and no key is handled whole by one task.
    """
    numbered = block_row_number(reads, ["session_id"], time_block, [F.col(o) for o in order], "n")
    home = F.expr(f"n div {read_block}")
    spread = numbered.withColumn("home", home).withColumn("block", F.explode(F.array_distinct(F.array(
        F.col("home"), F.expr(f"(n + {memory}) div {read_block}")))))
    same = Window.partitionBy("session_id", "key", "block").orderBy("n").rangeBetween(-memory, -1)
    counted = spread.withColumn("prior", F.count(F.lit(1)).over(same)).where("block = home")
    seen = F.col("prior") + 1
    return counted.select(*reads.columns, F.col("n"), seen.alias("times_read"), (seen >= threshold).alias("warn"))


def repeat_read_warning(key: Column, times: Column) -> Column:
    return F.concat(F.lit("Range "), key, F.lit(" has been read "), times, F.lit(" times this session."))
