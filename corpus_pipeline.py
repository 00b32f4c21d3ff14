"""From raw documents to packed training sequences: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents:

* quality: documents outside the fertility bands of their language, or failing the base rules, go;
* line dedup: lines that repeat a template of an earlier document go; a document keeps its row even if none is left;
* near dedup: of every group of near duplicates (fingerprints of three-word shingles that differ in at most 3 bits) the
  document with the least id stays;
* mix: every source is taken to its target, documents repeated or left out as whole documents; those without words go;
* pack: what is left is cut and packed into sequences; one row per piece.

Nulls, empty tables, repeated rows and extra columns are handled as each operator states it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.line_dedup import drop_recurring_lines
from gridloom.llm.mixing import mixed_documents
from gridloom.llm.packing import pack
from gridloom.llm.quality import keep_good
from gridloom.llm.simhash import keep_one
from gridloom.session import owned_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = drop_recurring_lines(docs)
    if "n_chars" not in docs.columns:
        return out
    # The count of characters follows the text.
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [("quality", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix_sources), ("pack", pack_sequences)]

#: Fingerprints and token ids are beyond SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again. The folder goes when the application ends."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = owned_folder(spark, "pipeline")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{base}/{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
