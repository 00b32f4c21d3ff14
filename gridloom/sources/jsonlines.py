"""Check, gold and answer files in; score reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECK_SCHEMA = (
    "id string, question string, "
    "extract struct<type:string,sql:string,key:string,val:string,sheet:string,cell:string,depth:int>, "
    "expect struct<value:string,values:map<string,double>,match:string,tol:double,contains:array<string>,"
    "formula:string,precedents:array<string>,precedent_sheet:string>"
)
GOLD_SCHEMA = (
    "id string, expected string, match string, tolerance double, unit string, accept array<string>, "
    "groups array<array<string>>, source_ref string"
)
ANSWER_SCHEMA = "id string, answer string, source_ref string, method string"


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record per line; blank lines are skipped. Scalars may be numbers, booleans or texts."""
    return spark.read.schema(schema).json(path)


def write_report(results: DataFrame, path: str, key: str = "id", overwrite: bool = True) -> None:
    """Sorted, stable report: a global sort keeps file order equal to key order for any size."""
    results.orderBy(key).write.mode("overwrite" if overwrite else "errorifexists").json(path)
