"""Mixing sources to target weights (operator 7), DataFrame functions only.

Capped water-filling: every source gets a share of the whole by weight, no more than ``max_epochs`` times its size; what
is cut off is shared again by weight until no source is above. The level is found in closed form: with the sources in
order of cap / weight, the first k are capped and the others get ``(total - caps before) / (weights from here)`` each
per weight. Only the table of sources is sorted for that, one row per source.

A source's target is then taken as whole repetitions of every document plus a seeded sample for the fraction: the
documents in order of a seeded hash, until their sizes come nearest to what is left. The order is cut in hash buckets
whose sums are accumulated first, so no task sorts a whole source, however large, and reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own, in last place; documents of size 0 are
not taken; ties of the hash are ordered by id, then by text hash, and equal rows are interchangeable; an empty table gives
an empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD_PATTERN, stored

SEED = "mix-1"
#: Hex digits of the hash that name a bucket. Buckets bound the rows that one task has to sort.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD_PATTERN))).cast("long")


def water_fill(sizes: DataFrame, weights: Column, share: float = 1.0, max_epochs: float = 3.0) -> DataFrame:
    """(source, source_size) and a weight by ``place`` (from 0, null last) -> the same with ``target``."""
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = placed.select("source", "source_size", weights.cast("double").alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    rows = rows.select("*", (F.sum("source_size").over(whole) * share).alias("total"),
                       F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("caps_before"),
                       F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("weights_from"))
    rows = rows.withColumn("level", (F.col("total") - F.col("caps_before")) / F.col("weights_from"))
    open_ = F.col("level") * F.col("w") <= F.col("cap")
    # The level of the first source that is not capped holds for all from there on; none: every source is capped.
    level = F.min_by(F.when(open_, F.col("level")), F.when(open_, F.col("cap") / F.col("w"))).over(whole)
    return rows.withColumn("level", level).select(
        "source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(
            F.least(F.col("cap"), F.col("level") * F.col("w"))).alias("target"))


def cycled_weights(*weights: float) -> Column:
    """Weights repeated over the places of the sources."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("draw"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"))


def mix(docs: DataFrame, weights: Column | None = None, share: float = 1.0, max_epochs: float = 3.0, seed: str = SEED,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, text_key, source, size, source_size, target, taken (words), copies."""
    sized = stored(_sized(docs, id_col, text_col, source_col, seed), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(water_fill(sizes, cycled_weights(1, 2, 3) if weights is None else weights, share, max_epochs), "mix-targets")
    # A source of size 0 has nothing to repeat.
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = targets.withColumn("whole", F.floor(epochs).cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    bucketed = sized.withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")).withColumn(
        "before", F.coalesce(F.sum("bucket_size").over(order), F.lit(0)))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    edges = buckets.join(targets, same(buckets, targets)).select(
        buckets["source"].alias("b_source"), "bucket", "before", "bucket_size", "source_size", "target", "whole", "rest")
    edges = stored(edges, "mix-buckets")
    joined = bucketed.join(edges, bucketed["source"].eqNullSafe(edges["b_source"]) & (bucketed["bucket"] == edges["bucket"])).drop(
        edges["bucket"], edges["b_source"])
    below = F.col("before") + F.col("bucket_size") <= F.col("rest")
    beyond = F.col("before") >= F.col("rest")
    sure = joined.where(below | beyond).withColumn("extra", F.when(below, 1).otherwise(0))
    # One bucket per source holds the end of its sample: only there documents are put in order.
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "text_key")
    end = joined.where(~below & ~beyond).withColumn(
        "upto", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.col("upto") - F.col("rest")
    end = end.withColumn("extra", F.when((over <= 0) | (over * 2 < F.col("size")), 1).otherwise(0)).drop("upto")
    # A document without words adds nothing to its source, however often: it is not taken.
    copies = F.when(F.col("size") > 0, F.col("whole") + F.col("extra")).otherwise(F.lit(0).cast("long"))
    return sure.unionByName(end).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns. Equal rows are taken equally often."""
    keys = ["_mix_id", "_mix_key"]
    taken = mix(docs, id_col=id_col, text_col=text_col, **options).where("copies > 0").groupBy(
        F.col("doc_id").alias(keys[0]), F.col("text_key").alias(keys[1])).agg(
        F.max("copies").alias("_mix_max"))
    own = docs.withColumn("_mix_text", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = own.join(taken, own[id_col].eqNullSafe(taken[keys[0]]) & (own["_mix_text"] == taken[keys[1]]))
    return joined.select(*[own[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_mix_max"))).alias("_mix_n")).select(
        *[F.col(f"`{c}`") for c in docs.columns])
