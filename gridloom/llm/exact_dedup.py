"""Exact deduplication (operator 1), DataFrame functions only.

Two passes over a narrow table of keys (id, SHA-256), for which each text is read once. The first pass builds a counting
Bloom filter: every key sets ``hashes`` bits, bits are counted with partial sums, and only the bits set by at least two
keys stay. The second pass tests each key: unless all of its bits stay, its text is surely unique and the row passes
straight through. Only the other rows, the repeated ones and a few false positives, are shuffled on their SHA-256.

The filter is a table of 64-bit words, about 16 bits per document. While it has at most ``broadcast_words`` words (8 MB)
it is broadcast; beyond that it is merged with the keys by word, 16 bytes a key: texts never move in either case.

Defined cases: a null text counts as empty, so all empty texts are one group; of equal texts the row with the largest id
stays, null ids last, and of repeated rows with that id just one; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored

BITS_PER_KEY = 16
HASHES = 2
#: The filter is broadcast up to so many 64-bit words, 16 bytes each with their number.
BROADCAST_WORDS = 1 << 19


def _bits(key: Column, bits: int, hashes: int) -> Column:
    """Bit numbers of a key, in one word block each: array<long>."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(hashes)])


def repeated_bits(keys: DataFrame, key: str, bits: int, hashes: int = HASHES) -> DataFrame:
    """(word, set): the filter of bits that at least two rows set."""
    hit = keys.select(F.explode(_bits(F.col(key), bits, hashes)).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n"))
    return hit.where("n > 1").groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("set"))


def _tested(keys: DataFrame, key: str, words: DataFrame, bits: int, hashes: int, broadcast: bool) -> DataFrame:
    """Adds ``maybe``: whether all bits of the key are in the filter."""
    out = keys.withColumn("maybe", F.lit(True))
    for i in range(hashes):
        side = words.select(F.col("word").alias("_word"), F.col("set").alias("_set"))
        out = out.withColumn("_bit", F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits)))
        out = out.join(F.broadcast(side) if broadcast else side.hint("merge"), F.shiftright("_bit", 6) == F.col("_word"), "left")
        hit = F.expr("_set is not null and (shiftrightunsigned(_set, cast(_bit & 63 as int)) & 1) = 1")
        out = out.withColumn("maybe", F.col("maybe") & hit).drop("_word", "_set", "_bit")
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits_per_key: int = BITS_PER_KEY,
                     hashes: int = HASHES, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = stored(docs.select(
        F.col(id_col).alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("row")), "exact-keys")
    n = keys.count()
    bits = 1 << max(10, math.ceil(math.log2(max(1, n) * bits_per_key)))
    words = stored(repeated_bits(keys, "digest", bits, hashes), "exact-filter")
    tested = _tested(keys, "digest", words, bits, hashes, words.count() <= broadcast_words)

    alone = tested.where(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    maybe = tested.where("maybe").drop("maybe")
    # Stored, so that the join below shuffles plain scans: those the planner can split where one group is large.
    groups = stored(maybe.groupBy(F.col("digest").alias("_digest")).agg(
        F.max(F.struct("doc_id", "row")).alias("_best"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    shared = maybe.join(groups, maybe["digest"] == groups["_digest"]).select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("_best.row")).alias("kept"), "digest")
    return alone.unionByName(shared).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
