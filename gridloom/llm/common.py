"""Shared pieces of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import cut_lineage, ship_package

#: A word is a run of characters other than blank, tab, line feed, vertical tab, form feed and return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate to the cluster's shared checkpoint folder and read it back."""
    ship_package(df.sparkSession)
    return cut_lineage(df, f"llm-{label}")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Key of a document row: its id and a hash of its text. Repeated rows share it and are treated alike."""
    return [F.col(id_col), F.xxhash64(text_or_empty(text_col)).alias("_text_key")]


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each value; null is empty. Yields one value at a time, as one text can be large."""
    column = column.cast(pa.binary() if column.type != pa.large_string() else pa.large_binary())
    for value in column:
        yield value.as_py() or b""


def as_text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


@lru_cache(maxsize=8)
def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
