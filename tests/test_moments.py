"""Moments with and without a time zone are spelled alike, and line items of both kinds make the same grid."""

import datetime

import pytest
from pyspark.sql import functions as F

from gridloom.functions import text as tx
from gridloom.plans import inputs

MOMENTS = ["2024-03-01 00:00:00", "2024-03-01 10:11:12.000001", "1969-12-31 23:59:59.5", "0099-01-02 03:04:05", None]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_spelling_of_moments(spark, kind):
    df = spark.createDataFrame([(i, m) for i, m in enumerate(MOMENTS)], "i int, m string").withColumn("m", F.col("m").cast(kind))
    got = df.orderBy("i").select(tx.iso_timestamp(F.col("m")), tx.spaced_timestamp(F.col("m"))).collect()
    assert [r[0] for r in got] == ["2024-03-01T00:00:00", "2024-03-01T10:11:12.000001", "1969-12-31T23:59:59.500000", "0099-01-02T03:04:05", None]
    assert [r[1] for r in got] == [r[0] and r[0].replace("T", " ") for r in got]


def test_line_items_of_either_kind_make_the_same_grid(spark, tmp_path):
    rows = [(k, 1, 1, n, 2.0, 3.5 + n, 0.07, 0.01, "A", "F", datetime.datetime(2024, 1, n, 5, 6, 7)) for k in (1, 2) for n in range(1, 8)]
    schema = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
              "l_tax double, l_returnflag string, l_linestatus string, l_shipdate ")
    made = []
    for kind in ("timestamp", "timestamp_ntz"):
        spark.createDataFrame(rows, schema + kind).write.parquet(f"{tmp_path}/{kind}/lineitem.parquet")
        made.append(sorted(map(tuple, inputs.sparse_lines(spark, f"{tmp_path}/{kind}").select("sheet", "r", "c", "raw_kind", "raw_text", "val_text").collect())))
    assert made[0] == made[1]
    assert ("A", 3, 7, "date", "2024-01-07 05:06:07", "2024-01-07T05:06:07") in made[1]
