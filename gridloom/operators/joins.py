"""Q15, Q16: range lookups and as-of lookups, which need more than an equality join."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import cut_lineage, ship_package, shuffle_width

#: Points of one cell that one task pairs with the spans there.
HOT_POINTS = 100_000
#: Cells are numbered within plus or minus this.
_MOST_CELLS = 1 << 52
#: Cells are halved at most so often where points stand close together.
_MOST_HALVINGS = 30


def _cell(value: Column, width: float) -> Column:
    return F.floor(F.greatest(F.least(value / F.lit(float(width)), F.lit(float(_MOST_CELLS))), F.lit(-float(_MOST_CELLS)))).cast("long")


def range_lookup(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: float, hot_points: int = HOT_POINTS,
                 combine: dict[str, str] | None = None) -> DataFrame:
    """Pairs with low <= point <= high, as an equality join on a hierarchy of cells; ``width`` is that of the smallest.

    Cells of level l are 2^l wide and aligned. A span is cut into the fewest cells that cover it, at most two of a level, so
    a span over everything is a handful of rows. A point lies in one cell of each level and so meets a span at most once.
    Cells with many points are dealt over several tasks, each with the spans of the cell. Null and NaN match nothing.

    Pairs grow with points times spans. A caller who only aggregates them names ``combine``: columns of the points and how they
    merge (sum, max, ...). Points of a cell that lies inside a span then meet it as one merged row, so a span has a few rows a
    level, which merge to the same totals; the result has the columns of the spans and those of ``combine``.
    """
    known = F.col(point).isNotNull() & ~F.isnan(F.col(point).cast("double"))
    points = points.where(known)
    if combine is not None:
        points, width = _merged_points(points, point, width, combine)
    ends = spans.where(F.col(low) <= F.col(high)).withColumns({"_lo": _cell(F.col(low), width), "_hi": _cell(F.col(high), width)})
    if combine is None:
        pieces = _span_cells(ends, spans.columns)
        asked = points.withColumn("_at", _cell(F.col(point), width))
        pairs = _met(_at_levels(asked, pieces), pieces, ["_level", "_at"], hot_points)
        return pairs.where(F.col(point).between(F.col(low), F.col(high))).drop("_level", "_at")
    # Points in the cells of both ends are compared one by one; cells between them lie inside.
    outer = ends.withColumn("_at", F.explode(F.array_distinct(F.array("_lo", "_hi")))).drop("_lo", "_hi")
    rim = _met(points, outer, ["_at"], hot_points).where(F.col("_point").between(F.col(low), F.col(high)))
    pieces = _span_cells(ends.withColumns({"_lo": F.col("_lo") + 1, "_hi": F.col("_hi") - 1}), spans.columns)
    merge = [getattr(F, how)(name).alias(name) for name, how in combine.items()]
    cells = points.groupBy("_at").agg(*merge)
    inner = _at_levels(cells, pieces).groupBy("_level", "_at").agg(*merge).join(pieces, ["_level", "_at"])
    out = [f"`{c}`" for c in (*spans.columns, *combine)]
    return rim.select(*out).unionByName(inner.select(*out))


def _merged_points(points: DataFrame, point: str, width: float, combine: dict[str, str]) -> tuple[DataFrame, float]:
    """Equal points as one row with its cell, and the width of cells: ``width`` halved until a point shares its cell with few."""
    merge = [getattr(F, how)(name).alias(name) for name, how in combine.items()]
    merged = cut_lineage(points.withColumn("_point", F.col(point)).groupBy("_point").agg(*merge), "merged_points")
    sizes = merged.groupBy(_cell(F.col("_point"), width).alias("_at")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    crowd = sizes.agg(F.sum(F.col("_n") * F.col("_n")) / F.sum("_n")).first()[0] or 1.0
    width /= 2.0 ** min(_MOST_HALVINGS, math.ceil(math.log2(crowd)))
    return merged.withColumn("_at", _cell(F.col("_point"), width)), width


def _span_cells(ends: DataFrame, names: Sequence[str]) -> DataFrame:
    """Spans from cell ``_lo`` to ``_hi``, one stored row per cell (``_level``, ``_at``) of the fewest that cover them."""
    widest = ends.agg(F.max(F.col("_hi") - F.col("_lo") + 1)).first()[0] or 1
    last = int(max(widest, 1)).bit_length()
    begin = lambda level: -F.call_function("shiftright", -F.col("_lo"), level)
    end = lambda level: F.call_function("shiftright", F.col("_hi") + 1, level)

    # Of a level, a cell at either edge belongs to the cover where its parent sticks out: an odd first one, an even last one.
    listed = ends.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(last)))).withColumns(
        {"_begin": begin(F.col("_level")), "_end": end(F.col("_level"))}).where("_begin < _end")
    first, final = F.expr("if(_begin & 1 = 1, _begin, null)"), F.expr("if(_end & 1 = 1 and not (_begin & 1 = 1 and _begin = _end - 1), _end - 1, null)")
    cells = listed.withColumn("_at", F.explode(F.array(first, final))).where("_at is not null")
    return cut_lineage(cells.select(*[F.col(f"`{c}`") for c in names], "_level", "_at"), "span_cells")


def _at_levels(cells: DataFrame, pieces: DataFrame) -> DataFrame:
    """Rows with a cell (``_at``) once for each level that spans use, with their cell there."""
    used = [r["_level"] for r in pieces.select("_level").distinct().collect()]  # at most 54
    spread = cells.withColumn("_level", F.explode(F.array(*[F.lit(i) for i in used]).cast("array<int>")))
    return spread.withColumn("_at", F.call_function("shiftright", F.col("_at"), F.col("_level")))


def _met(asked: DataFrame, pieces: DataFrame, on: list[str], hot_points: int) -> DataFrame:
    """Points and spans of the same cell; a cell of many points is dealt over several tasks."""
    hot = asked.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_points)
    hot = cut_lineage(hot.select(*on, F.ceil(F.col("_n") / F.lit(hot_points)).cast("int").alias("_salts")), "hot_cells")
    if hot.isEmpty():
        return asked.join(pieces, on)
    salts = F.coalesce("_salts", F.lit(1))
    dealt = asked.join(hot, on, "left").withColumn("_salt", F.floor(F.rand(7) * salts).cast("int")).drop("_salts")
    copied = pieces.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copied, [*on, "_salt"]).drop("_salt")


# ---- as-of ---------------------------------------------------------------------------------------------------------

def _key_text(keys: Sequence[str]) -> Column:
    """One text per key that no other key has; null where a part is null, as null equals nothing."""
    return F.concat(*[x for k in keys for x in (F.length(F.col(k).cast("string")), F.lit(":"), F.col(k).cast("string"))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, then order -> rows of the left side with the last right value of their key in this partition.

    A last row tells how the partition ends: its last key, that key's last value, and whether it has no other key.
    """
    key, value, has, first, rest = None, None, False, None, True
    place = TaskContext.get().partitionId()
    schema = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        schema = batch.schema
        keys, values, right = batch.column("_key"), batch.column("_value"), batch.column("_right").to_numpy(zero_copy_only=False).astype(bool)
        changes = np.ones(n, dtype=bool)
        changes[1:] = pc.not_equal(keys[1:], keys[:-1]).fill_null(True).to_numpy(zero_copy_only=False)
        changes[0] = key is None or keys[0].as_py() != key
        if first is None:
            first = keys[0].as_py()
        at = np.arange(n)
        begun = np.maximum.accumulate(np.where(changes, at, -1))  # -1: the key of the batch before goes on
        seen = np.maximum.accumulate(np.where(right, at, -1))
        own = seen >= np.maximum(begun, 0)
        before = ~own & (begun < 0) & has
        # Place 0 holds the value carried from the batch before.
        held = pa.concat_arrays([value if value is not None else pa.nulls(1, values.type), values])
        found = held.take(pa.array(np.where(own, seen + 1, 0), mask=~(own | before)))
        runs = np.cumsum(changes)
        in_first = rest & (runs == (1 if changes[0] and key is None else 0))
        open_ = in_first & ~own & ~before
        if rest and (changes[1:].any() or (changes[0] and key is not None)):
            rest = False
        kept = pa.array(~right)
        columns = [found if name == "_value" else batch.column(name) for name in schema.names]
        out = pa.RecordBatch.from_arrays([*columns, pa.array(open_), pa.array(np.full(n, place, np.int32)), pa.array(np.zeros(n, bool))],
                                         names=[*schema.names, "_open", "_place", "_end"])
        key = keys[n - 1].as_py()
        has = bool(own[-1] or before[-1])
        value = found.slice(n - 1, 1) if has else None
        yield out.filter(kept)
    if schema is not None:
        columns = [pa.array([key], schema.field(c).type) if c == "_key" else value if c == "_value" and has else pa.nulls(1, schema.field(c).type) for c in schema.names]
        columns[schema.names.index("_right")] = pa.array([has])
        yield pa.RecordBatch.from_arrays([*columns, pa.array([rest]), pa.array([place], pa.int32()), pa.array([True])], names=[*schema.names, "_open", "_place", "_end"])


def last_before(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """For each left row the value of the last right row of the same key that is not behind it in ``order``; at equal order
    right rows come first.

    Both sides are dealt into ranges of (key, order), so neither a key nor a point in time is held by one task. Each range is
    scanned once; what a range cannot know, the last value of its first key before it, is carried over from the few values
    that the ranges end with, one per range.
    """
    spark = left.sparkSession
    ship_package(spark)
    value_type = right.schema[value].dataType
    rows = [F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_row"), F.lit(None).cast(value_type).alias("_value"), F.lit(False).alias("_right")]
    row_type = T.StructType(left.schema.fields)
    ordered = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]
    both = left.select(_key_text(keys).alias("_key"), *ordered, *rows).unionByName(
        right.select(_key_text(keys).alias("_key"), *ordered, F.lit(None).cast(row_type).alias("_row"), F.col(value).alias("_value"), F.lit(True).alias("_right")))
    known = both.where("_key is not null")
    by = [F.col("_key"), *[F.col(f"_o{i}") for i in range(len(order))], F.col("_right").desc()]
    dealt = known.repartitionByRange(shuffle_width(spark), *by).sortWithinPartitions(*by).select("_key", "_row", "_value", "_right")
    schema = T.StructType([*dealt.schema.fields, T.StructField("_open", T.BooleanType()), T.StructField("_place", T.IntegerType()), T.StructField("_end", T.BooleanType())])
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
    scanned = cut_lineage(dealt.mapInArrow(_scan, schema), "asof")
    ends = scanned.where("_end").select("_key", "_value", "_right", "_open", "_place").orderBy("_place").collect()  # one per range
    carried, key, held, has = [], None, None, False
    for end in ends:
        if has:
            carried.append((end["_place"], key, held))
        if not (end["_open"] and end["_key"] == key):  # another key than before: what was carried ends here
            held, has = None, False
        if end["_right"]:
            held, has = end["_value"], True
        key = end["_key"]
    carry_schema = T.StructType([T.StructField("_at", T.IntegerType()), T.StructField("_carry_key", T.StringType()), T.StructField("_carry", value_type)])
    carry = F.broadcast(spark.createDataFrame(carried, carry_schema))
    found = scanned.where("not _end").join(carry, (F.col("_place") == F.col("_at")) & (F.col("_key") == F.col("_carry_key")) & F.col("_open"), "left")
    out = found.select("_row.*", F.when(F.col("_open"), F.col("_carry")).otherwise(F.col("_value")).alias(name))
    return out.unionByName(left.where(_key_text(keys).isNull()).withColumn(name, F.lit(None).cast(value_type)))


def asof_lookup(left: DataFrame, right: DataFrame, key: str, time: str, value: str, tie: str, name: str = "asof_value") -> DataFrame:
    """For each left row the value of the latest right row of the same key at or before its time; on equal times ``tie``
    orders right rows."""
    # Left rows come after all right rows of their time, whatever the ties.
    after = left.withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType)).withColumn("_side", F.lit(1))
    before = right.where(F.col(time).isNotNull()).withColumn("_tie", F.col(tie)).withColumn("_side", F.lit(0))
    return last_before(after, before, [key], [time, "_side", "_tie"], value, name).drop("_tie", "_side")
