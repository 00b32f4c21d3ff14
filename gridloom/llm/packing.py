"""Packing documents into sequences of fixed length (operator 5).

Each document becomes its ids and an end id. Longer ones are cut: the remainder comes first, then whole sequences. What is
to pack is therefore a histogram of piece lengths with at most ``capacity`` entries, whatever the corpus size. Only that
histogram reaches the driver, which plans how many sequences of which lengths to make:

* Martello-Toth reduction: for the largest length left, a set of one to three pieces that dominates every other set with
  that piece is fixed for good (it fills the sequence, or nothing else fits, or every other choice is no larger piece by
  piece), with its multiplicity at once; passes repeat while the instance shrinks.
* What no set dominates is packed best-fit, longest first, again with multiplicities.

The plan is a bounded list of rank ranges per length. Pieces are ranked within their length on the cluster (in salted
groups, so one length may hold most of the rows) and look their place up.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import as_text, raw_texts, stored
from gridloom.llm.tokens import BYTE_BPE, BYTE_BPE_RANKS, token_ids
from gridloom.session import ship_package

#: Pieces of one length are ranked in salted groups of about this many rows.
GROUP_ROWS = 20_000
LEAST_SALTS = 64


@dataclass(frozen=True)
class PackRules:
    capacity: int = 1024
    end_id: int = 2
    vocabulary: str = BYTE_BPE
    ranks: str | None = BYTE_BPE_RANKS


# ---- planning over a histogram of lengths ----------------------------------------------------------------------------

class _Lengths:
    """A multiset of lengths 1..capacity."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.present = {s: n for s, n in counts.items() if n > 0}, sorted(s for s, n in counts.items() if n > 0)
        self.capacity = capacity

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            self.present.remove(length)

    def largest(self, room: int, used: tuple[int, ...] = ()) -> int:
        """The largest length up to ``room`` of which a piece is left besides ``used``; 0 if none."""
        at = bisect_right(self.present, room) - 1
        while at >= 0 and self.left[self.present[at]] <= used.count(self.present[at]):
            at -= 1
        return self.present[at] if at >= 0 else 0

    def smallest(self, n: int, used: tuple[int, ...], above: int = 0) -> list[int]:
        """The n smallest pieces longer than ``above`` besides ``used``."""
        out: list[int] = []
        for s in self.present[bisect_right(self.present, above):]:
            out += [s] * min(n - len(out), max(0, self.left[s] - used.count(s)))
            if len(out) == n:
                break
        return out


def _dominating(pool: _Lengths, j: int) -> tuple[int, ...] | None:
    """A set with one piece of length j that dominates every feasible set with it, or None."""
    room = pool.capacity - j
    small = pool.smallest(3, (j,))
    fitting = sum(1 for i in range(len(small)) if sum(small[:i + 1]) <= room)
    if not fitting:
        return (j,)
    best = pool.largest(room, (j,))
    if best == room or fitting == 1:
        return (j, best)
    if fitting > 2:
        return None
    pair, top = (0, 0), best  # at most two more pieces fit: the two that fill most
    while top:
        second = pool.largest(min(top, room - top), (j, top))
        if second and top + second > sum(pair):
            pair = (top, second)
        if 2 * top <= sum(pair):
            break
        top = pool.largest(top - 1, (j,))
    if best >= sum(pair):
        return (j, best)
    if pair[0] == best:  # any other pair has a piece no larger than each of these, unless both are above the second
        above = pool.smallest(2, (j, best), pair[1])
        if len(above) < 2 or sum(above) > room:
            return (j, *pair)
    return None


Pattern = tuple[tuple[int, int], ...]  # (length, pieces of it in a row), ...


def _runs(lengths: tuple[int, ...]) -> Pattern:
    return tuple((s, lengths.count(s)) for s in dict.fromkeys(lengths))


def reduce_lengths(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed (pattern, sequences) and the histogram that is left."""
    pool, fixed, shrunk = _Lengths(counts, capacity), [], True
    while shrunk:
        shrunk = False
        for j in reversed(list(pool.present)):
            while pool.left.get(j):
                found = _dominating(pool, j)
                if found is None:
                    break
                pattern = _runs(found)
                times = min(pool.left[s] // n for s, n in pattern)
                fixed.append((pattern, times))
                for s, n in pattern:
                    pool.take(s, n * times)
                shrunk = True
    return fixed, dict(pool.left)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit-decreasing over a histogram: (pattern, sequences)."""
    groups: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []  # sorted rooms that have groups

    def put(room: int, pattern: Pattern, n: int) -> None:
        if room not in groups:
            groups[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        groups[room].append((pattern, n))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_right(rooms, s - 1)
            if at == len(rooms):  # new sequences
                room, pattern, there = capacity, (), -(-n // (capacity // s))
            else:
                room = rooms[at]
                pattern, there = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            each = min(n, room // s)
            used = min(there, n // each)
            put(room - each * s, (*pattern, (s, each)), used)
            if there > used and pattern:
                put(room, pattern, there - used)
            n -= each * used
    return [g for room in rooms for g in groups[room]]


def plan(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    fixed, rest = reduce_lengths(counts, capacity)
    return fixed + best_fit(rest, capacity)


def _places(patterns: list[tuple[Pattern, int]]) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """By length, in order of rank: (first rank, end rank, first sequence, pieces per sequence, offset)."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    first = 0
    for pattern, n in patterns:
        offset = 0
        for s, each in pattern:
            rows = out.setdefault(s, [])
            start = rows[-1][1] if rows else 0
            rows.append((start, start + n * each, first, each, offset))
            offset += s * each
        first += n
    return out


# ---- on the cluster ------------------------------------------------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: the remainder first, then whole sequences."""
    head = n % capacity
    return ([(0, head)] if head else []) + [(at, capacity) for at in range(head, n, capacity)]


def pieces(docs: DataFrame, rules: PackRules = PackRules(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece, with its ids on request."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            owner, piece, start, length, crc, own = [], [], [], [], [], []
            for doc, raw in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                ids = np.append(token_ids(as_text(raw), rules.vocabulary, rules.ranks), np.uint32(rules.end_id)).astype("<u4")
                for i, (at, n) in enumerate(cut(len(ids), rules.capacity)):
                    owner.append(doc), piece.append(i), start.append(at), length.append(n)
                    crc.append(zlib.crc32(ids[at:at + n].tobytes()))
                    if with_ids:
                        own.append(ids[at:at + n].astype(np.int32))
            columns = [pa.array(owner, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(own, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(batches, PIECES + (", ids array<int>" if with_ids else ""))


def place(cut_pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to (stored) pieces."""
    # At most ``capacity`` rows, one per length.
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [(s, [tuple(r) for r in places]) for s, places in _places(plan(counts, capacity)).items()]
    schema = "_length long, _places array<struct<lo: long, hi: long, first: long, each: long, offset: long>>"
    lookup = cut_pieces.sparkSession.createDataFrame(rows, schema)
    salts = max(LEAST_SALTS, -(-sum(counts.values()) // GROUP_ROWS))
    salted = cut_pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sums = salted.groupBy(F.col("length").alias("_sum_length"), F.col("_salt").alias("_sum_salt")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_sum_length").orderBy("_sum_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1)
    ranked = ranked.join(before, (F.col("length") == F.col("_sum_length")) & (F.col("_salt") == F.col("_sum_salt")))
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before"))
    found = ranked.join(F.broadcast(lookup), F.col("length") == F.col("_length")).withColumn(
        "_at", F.filter("_places", lambda p: (p["lo"] <= F.col("_rank")) & (F.col("_rank") < p["hi"]))[0])
    nth = F.col("_rank") - F.col("_at.lo")
    return found.select(
        *cut_pieces.columns, (F.col("_at.first") + F.floor(nth / F.col("_at.each"))).cast("long").alias("sequence_id"),
        (F.col("_at.offset") + nth % F.col("_at.each") * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, rules: PackRules = PackRules(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    return place(stored(pieces(docs, rules, id_col, text_col, with_ids), "pack-pieces"), rules.capacity)
