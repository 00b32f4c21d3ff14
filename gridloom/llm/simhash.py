"""SimHash near-duplicates (operator 9).

A 64-bit fingerprint per text, from the XXH64 hashes of its word shingles. Fingerprints that differ in at most 3 bits are
linked. They are found by an inverted index over byte positions: 3 bits touch at most 3 of the 8 bytes, so a pair to find
shares at least 5 bytes in place. A posting list holds the fingerprints that agree on a set of positions. Of any 5
positions, 3 lie in one half of the fingerprint, so the 8 sets of three positions inside a half reach every pair. Within a
list the shared positional bytes of each pair are tallied, pairs with 5 or more are retained and their bits verified.

Only distinct fingerprints are indexed, so exact copies cost nothing. A list over ``list_limit`` is dealt anew by two more
of the other positions (the guaranteed 5); its lists then vary in 24 bits only, and one that is still large is searched
through the 2324 patterns of up to 3 bits in a table of 2^24 places. So the work is linear in large groups of near
copies, bounded in memory and exact. A list emits a spanning forest of its links, never all pairs.

Defined cases: a null or empty text has fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; repeated rows share a component; null ids take part and never name a component unless alone; an empty table
gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import raw_texts, stored
from gridloom.llm.components import components
from gridloom.session import ship_package

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 3
#: Lists up to this size are compared pair by pair; about as much work as the patterns of 3 bits for each member.
LIST_LIMIT = 2048
BYTES = 8
LEAST_SHARED = BYTES - MOST_BITS
#: Every 5 of 8 positions hold three positions of one half.
TRIPLES = [(*t,) for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
_PAIRS_AT_ONCE = 1 << 21


def fingerprint(raw: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64 bits as a signed integer. ASCII letters are lower-cased; a bit is set if over half the shingles set it."""
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())], dtype="<u8")
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", drop_text: bool = False, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` (without the text on request) and ``_fp``, the fingerprint as a long."""
    ship_package(docs.sparkSession)
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text_col)]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.schema.get_field_index(text_col)
            found = pa.array([fingerprint(raw, shingle, seed) for raw in raw_texts(part.column(at))], pa.int64())
            columns = [c for i, c in enumerate(part.columns) if not (drop_text and i == at)]
            names = [n for i, n in enumerate(part.schema.names) if not (drop_text and i == at)]
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*names, "_fp"])

    return docs.mapInArrow(batches, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + (", " if kept else "") + "_fp long")


# ---- the index -----------------------------------------------------------------------------------------------------

def _byte(position: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(0xFF).cast("long"))


def _key(number: int, positions: tuple[int, ...]) -> Column:
    """One posting list: the number of its set of positions, then the bytes there."""
    key = F.lit(number).cast("long")
    for position in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(position))
    return key


def _refined(key: Column) -> Column:
    """Keys with two more positions, for the lists of one set of three."""
    sets = [(t, more) for t in TRIPLES for more in combinations([p for p in range(BYTES) if p not in t], 2)]
    by_triple = []
    for number, triple in enumerate(TRIPLES):
        keys = F.array(*[_key(i, (*t, *more)) for i, (t, more) in enumerate(sets) if t == triple])
        by_triple.append((number, keys))
    out = by_triple[0][1]
    for number, keys in by_triple[1:]:
        out = F.when(F.shiftright(key, 24) == number, keys).otherwise(out)
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each member's component; a, b: links between members 0..n-1."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            return label
        label = new[label]


def _close(x: np.ndarray) -> np.ndarray:
    """Tally the bytes that pairs share, retain those with enough, verify their bits. x: the pairs' differences."""
    shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
    near = shared >= LEAST_SHARED
    near[near] = np.bitwise_count(x[near]) <= MOST_BITS
    return near


def _small_lists(fp: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Forest of the lists in fp; end: where each member's list ends. Pairs at distance 1, 2, ... in their list."""
    left, right, members, step = [], [], np.arange(len(fp)), 1
    while len(members := members[end[members] > members + step]):
        near = _close(fp[members] ^ fp[members + step])
        left.append(members[near]), right.append(members[near] + step)
        step += 1
    if not left:
        return np.arange(len(fp))
    return _roots(len(fp), np.concatenate(left), np.concatenate(right))


def _wide_list(fp: np.ndarray) -> np.ndarray:
    """Forest of one large list, whose members differ in at most three byte positions."""
    differs = np.bitwise_or.reduce(fp ^ fp[0])
    places = [p for p in range(BYTES) if (int(differs) >> (8 * p)) & 0xFF]
    if len(places) > MOST_BITS:
        raise ValueError("the members of a list differ in too many positions")
    value = np.zeros(len(fp), dtype=np.int64)
    for i, p in enumerate(places):
        value |= ((fp >> np.uint64(8 * p)) & np.uint64(0xFF)).astype(np.int64) << (8 * i)
    at = np.full(1 << (8 * max(1, len(places))), -1, dtype=np.int32)
    at[value] = np.arange(len(fp), dtype=np.int32)
    label = np.arange(len(fp))
    patterns = [sum(1 << b for b in bits) for k in range(1, MOST_BITS + 1) for bits in combinations(range(8 * len(places)), k)]
    for pattern in patterns:
        partner = at[value ^ pattern]
        a = np.flatnonzero(partner >= 0)
        b = partner[a]
        a, b = a[apart := label[a] != label[b]], b[apart]
        if len(a):
            label = _roots(len(fp), label[a], label[b])[label]
    return label


def _linked(parts: Iterator[pa.RecordBatch], list_limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key -> (a, b): each member and the least of its component in the list."""
    def forest(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(edges, len(key)))
        out = []
        narrow = sizes <= list_limit
        # Lists in turns of bounded work.
        turn = np.cumsum(np.where(narrow, sizes * sizes, 0)) // _PAIRS_AT_ONCE
        for t in np.unique(turn[narrow & (sizes > 1)]):
            chosen = np.flatnonzero(narrow & (sizes > 1) & (turn == t))
            own = sizes[chosen]
            members = np.repeat(edges[chosen] - np.append(0, np.cumsum(own)[:-1]), own) + np.arange(own.sum())
            out.append((fp[members], _small_lists(fp[members], np.repeat(np.cumsum(own), own))))
        for start, n in zip(edges[~narrow], sizes[~narrow]):
            out.append((fp[start:start + n], _wide_list(fp[start:start + n])))
        for values, root in out:
            moved = np.flatnonzero(root != np.arange(len(root)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(values[moved].view(np.int64)), pa.array(values[root[moved]].view(np.int64))], names=["a", "b"])

    key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    for part in parts:
        key = np.append(key, part.column(0).to_numpy(zero_copy_only=False))
        fp = np.append(fp, part.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
        if len(key) and key[0] != key[-1]:  # the last list may go on
            last = int(np.searchsorted(key, key[-1]))
            yield from forest(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
    if len(key):
        yield from forest(key, fp)


def links(distinct: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(fp) distinct fingerprints -> (a, b): links that connect exactly those within ``MOST_BITS`` of each other."""
    postings = distinct.select("fp", F.explode(F.array(*[_key(i, t) for i, t in enumerate(TRIPLES)])).alias("key"))
    large = stored(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > list_limit).select("key"), "simhash-large")
    narrow = postings.join(large, "key", "left_anti")
    wide = postings.join(large, "key", "left_semi").select("fp", F.explode(_refined(F.col("key"))).alias("key"))
    out = []
    for lists in (narrow, wide):
        dealt = lists.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        out.append(dealt.mapInArrow(partial(_linked, list_limit=list_limit), "a long, b long"))
    return out[0].unionByName(out[1]).distinct()


def near_duplicates(prints: DataFrame, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(doc_id, _fp), stored -> (fp, component_id, best): one row per distinct fingerprint."""
    own = stored(prints.groupBy(F.col("_fp").alias("fp")).agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = stored(components(stored(links(own.select("fp"), list_limit), "simhash-links")), "simhash-roots")
    joined = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = joined.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    return stored(joined.join(named, F.col("root") == F.col("_root")).select("fp", "root", "component_id"), "simhash-components")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = LIST_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = stored(fingerprints(narrow, drop_text=True), "simhash-prints")
    found = near_duplicates(prints, list_limit)
    return prints.join(found, prints["_fp"] == found["fp"]).select(
        "doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", list_limit: int = LIST_LIMIT) -> DataFrame:
    """One document of every group of near duplicates, that with the least id, with its own columns.

    Only narrow rows are stored; texts are joined to the ids that stay. Of repeated rows one stays.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    narrow = docs.select(F.col(id_col).alias("doc_id"), key.alias("text_key"), F.col(text_col).alias("text"))
    prints = stored(fingerprints(narrow, drop_text=True), "simhash-prints")
    found = near_duplicates(prints, list_limit)
    # Null ids come last, so that a document with an id stays where there is one.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    best = stored(prints.join(found, prints["_fp"] == found["fp"]).groupBy("root").agg(first.alias("b")).select(
        F.col("b.doc_id").alias("_best_id"), F.col("b.text_key").alias("_best_key")), "simhash-kept")
    keyed = docs.withColumn("_own_key", key)
    kept = keyed.join(best, keyed[id_col].eqNullSafe(best["_best_id"]) & (keyed["_own_key"] == best["_best_key"]))
    # One row of each best document, in the partitions of the join.
    nth = F.row_number().over(Window.partitionBy(F.coalesce(F.col("_best_id"), F.lit(0)), F.col("_best_id").isNull(), "_best_key").orderBy(F.lit(0)))
    return kept.withColumn("_nth", nth).where("_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
