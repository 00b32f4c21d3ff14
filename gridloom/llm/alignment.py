"""Alignment of two tokenizers over the same bytes (operator 13).

Tokenizer A reads a blank and the text, B the text (it puts the blank itself). Both sides are lists of byte offsets where
tokens end. Offsets where both end are cuts. They are found by divide and conquer: a common end near the middle of an
interval is located by bisecting the ends of B for the ends of A, from the middle outwards; both halves follow; an interval
without a cut inside is a group. A gap without cuts is walked once when it is met, so the work stays linear.

Within a group every A token is linked to every B token. The count of an id pair is the number of documents that hold it
linked, over the whole corpus. Per document only its distinct pairs and how often each occurs are stored; counts are one
aggregation of them. Getting the counts back to the documents meets very frequent pairs: those at or above a count that at
most ``frequent_pairs`` pairs reach are broadcast, and only links of rarer pairs are shuffled by pair, where no key can be
hot. The highest count of an A id is one row per id of the vocabulary.

Defined cases: a text that is null, empty, or not given back byte by byte by both tokenizers has no tokens: zeros, and
groups_sha256 is ''. Null ids stay null; repeated rows are documents of their own; ties for the highest count all count;
very long texts are aligned whole, their links expanded in bounded parts; an empty table gives an empty result; other
columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_text, raw_texts, stored, vocabulary_path
from gridloom.session import ship_package

#: Documents and tokens of A that are aligned together, and links that are expanded at once.
DOCS_AT_ONCE, TOKENS_AT_ONCE, LINKS_AT_ONCE = 2_000, 1 << 18, 1 << 20
#: An id pair is one number, the id of A above that of B; inside a task the document stands above both.
ID_BITS = 24


@dataclass(frozen=True)
class AlignRules:
    vocabulary_a: str = "byte_bpe_50k.json"
    #: The same vocabulary as ranks, read by a faster library; None: the JSON file alone.
    ranks_a: str | None = "byte_bpe_50k.tiktoken"
    vocabulary_b: str = "piece_bpe_32k.model"
    #: Pairs that are broadcast at most, 24 bytes each.
    frequent_pairs: int = 1 << 20


# ---- tokens and their bytes ------------------------------------------------------------------------------------------

def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters are their byte, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _side_a(vocabulary: str, ranks: str | None):
    """(encode, bytes of every id)"""
    with open(vocabulary_path(vocabulary), encoding="utf-8") as file:
        listed = json.load(file)
    letters = _byte_letters()
    entries = {i: bytes(letters[c] for c in entry) for entry, i in listed["model"]["vocab"].items() if all(c in letters for c in entry)}
    table = [entries.get(i, b"") for i in range(max(entries) + 1)]
    if ranks is None:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(vocabulary_path(vocabulary))
        library.encode_special_tokens = True
        return (lambda text: library.encode(text, add_special_tokens=False).ids), table
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(ranks), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("align", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary, table


@lru_cache(maxsize=2)
def _side_b(vocabulary: str):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
    table = []
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        single = re.fullmatch("<0x([0-9A-F]{2})>", piece) if library.is_byte(i) else None
        table.append(bytes([int(single[1], 16)]) if single else piece.replace("▁", " ").encode())
    return library.encode, table


# ---- documents, many at a time ---------------------------------------------------------------------------------------

def _common(a: np.ndarray, b: np.ndarray, i: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether ends a[i] are ends of b before place b1, and where (bisected)."""
    j = np.searchsorted(b, a[i])
    return (j < b1) & (b[np.minimum(j, len(b) - 1)] == a[i]), j


def _outwards(a: np.ndarray, b: np.ndarray, a0: int, a1: int, b1: int, middle: int) -> tuple[int, int]:
    """As below for one interval that has no common end close to its middle: windows that double."""
    step, seen_lo, seen_hi = 64, middle, middle
    while seen_lo > a0 or seen_hi < a1:
        lo, hi = max(a0, middle - step), min(a1, middle + step)
        places = np.concatenate([np.arange(lo, seen_lo), np.arange(seen_hi, hi)])
        hit, j = _common(a, b, places, np.full(len(places), b1))
        if hit.any():
            places, j = places[hit], j[hit]
            nearest = np.argmin(np.abs(places - middle))
            return int(places[nearest]), int(j[nearest])
        seen_lo, seen_hi, step = lo, hi, step * 2
    return -1, -1


def _near_middle(a: np.ndarray, b: np.ndarray, a0: np.ndarray, a1: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each interval the places in a and b of a common end of a[a0:a1] near the middle; -1 if there is none."""
    middle = (a0 + a1) // 2
    found, there = np.full(len(a0), -1), np.full(len(a0), -1)
    waiting, step = np.flatnonzero(a0 < a1), 0
    while len(waiting):
        if step == 16:
            for w in waiting:
                found[w], there[w] = _outwards(a, b, int(a0[w]), int(a1[w]), int(b1[w]), int(middle[w]))
            break
        for i in (middle[waiting] + step, middle[waiting] - step - 1):
            inside = (i >= a0[waiting]) & (i < a1[waiting]) & (found[waiting] < 0)
            at, own = i[inside], waiting[inside]
            hit, j = _common(a, b, at, b1[own])
            found[own[hit]], there[own[hit]] = at[hit], j[hit]
        step += 1
        left = waiting[found[waiting] < 0]
        waiting = left[(middle[left] + step < a1[left]) | (middle[left] - step - 1 >= a0[left])]
    return found, there


def shared_cuts(a: np.ndarray, b: np.ndarray, a_docs: np.ndarray, b_docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a, b: ends of tokens, ascending over all documents; a_docs, b_docs: tokens up to the end of each document.

    Returns the tokens of a and of b up to every common end, in order. All intervals of one depth are divided together.
    """
    a0, b0, a1, b1 = np.append(0, a_docs[:-1]), np.append(0, b_docs[:-1]), a_docs, b_docs
    a_cuts, b_cuts = [], []
    while len(a0):
        # The last end of an interval is common by definition, and no cut inside it.
        i, j = _near_middle(a, b, a0, np.where(b1 - b0 > 1, a1 - 1, a0), b1 - 1)
        leaf, cut = i < 0, i >= 0
        a_cuts.append(a1[leaf]), b_cuts.append(b1[leaf])
        i, j = i[cut] + 1, j[cut] + 1
        a0, b0, a1, b1 = np.append(a0[cut], i), np.append(b0[cut], j), np.append(i, a1[cut]), np.append(j, b1[cut])
    return np.sort(np.concatenate(a_cuts)) if a_cuts else a0, np.sort(np.concatenate(b_cuts)) if b_cuts else b0


def _merged(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, times = pairs[order], times[order]
    first = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1])) if len(pairs) else np.empty(0, np.int64)
    return pairs[first], np.add.reduceat(times, first) if len(first) else times


def linked_pairs(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, at_once: int = LINKS_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``a | b`` of all groups, ascending, and how often each is linked. a: keys that leave the bits of b free."""
    a_starts, b_starts = np.append(0, a_ends[:-1]), np.append(0, b_ends[:-1])
    m, k = a_ends - a_starts, b_ends - b_starts
    links = m * k
    pairs, times = np.empty(0, np.int64), np.empty(0, np.int64)
    small = np.flatnonzero(links <= at_once)
    turn = np.cumsum(links[small]) // at_once
    for t in np.unique(turn):
        g = small[turn == t]
        own = links[g]
        nth = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        wide = np.repeat(k[g], own)
        new = a[np.repeat(a_starts[g], own) + nth // wide] | b[np.repeat(b_starts[g], own) + nth % wide]
        pairs, times = _merged(np.append(pairs, new), np.append(times, np.ones(len(new), np.int64)))
    for g in np.flatnonzero(links > at_once):  # equal ids of a large group are taken together
        left, n_left = np.unique(a[a_starts[g]:a_ends[g]], return_counts=True)
        right, n_right = np.unique(b[b_starts[g]:b_ends[g]], return_counts=True)
        step = max(1, at_once // len(right))
        for at in range(0, len(left), step):
            new = (left[at:at + step, None] | right).ravel()
            pairs, times = _merged(np.append(pairs, new), np.append(times, (n_left[at:at + step, None] * n_right).ravel()))
    return pairs, times


@lru_cache(maxsize=4)
def _printed(size: int, after: str, last: str) -> np.ndarray:
    """Ids as text with what follows them: ``after`` inside a group, ``last`` (from ``size`` on) at its end."""
    return np.array([f"{i}{after}" for i in range(size)] + [f"{i}{last}" for i in range(size)], dtype=object)


class _Side:
    """One tokenizer: its ids of a text, the bytes of every id, their lengths."""

    def __init__(self, encode, table: list[bytes]):
        self.encode, self.table = encode, table
        self.lengths = np.array([len(t) for t in table], np.int64)
        if len(table) >= 1 << ID_BITS:
            raise ValueError("ids need more bits than a pair has for them")

    def gives_back(self, ids: list[int], whole: bytes) -> bool:
        return b"".join(map(self.table.__getitem__, ids)) == whole


@lru_cache(maxsize=2)
def _sides(rules: AlignRules) -> tuple[_Side, _Side]:
    return _Side(*_side_a(rules.vocabulary_a, rules.ranks_a)), _Side(*_side_b(rules.vocabulary_b))


def _encoded(raw: bytes, rules: AlignRules) -> tuple[list[int], list[int]] | None:
    """Ids of A and of B of one text; None if it has none, or a side does not give it back."""
    if not raw:
        return None
    left, right = _sides(rules)
    text, whole = as_text(raw), b" " + raw
    a, b = left.encode(" " + text), right.encode(text)
    return (a, b) if left.gives_back(a, whole) and right.gives_back(b, whole) else None


# ---- on the cluster --------------------------------------------------------------------------------------------------

DIGEST = "_row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_TYPES = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
_NAMES = [c.split()[0] for c in DIGEST.split(", ")]
#: Distinct pairs in one stored row; a document with more has further rows.
PAIRS_A_ROW = 1 << 16


def _aligned(docs: list[tuple[int, int | None]], ids: list[tuple[list[int], list[int]] | None], rules: AlignRules) -> Iterator[tuple]:
    """Rows of ``DIGEST`` of some documents: (number, doc_id) and ids of each."""
    held = [x for x in ids if x is not None]
    if not held:
        yield from ((number, doc, 0, 0, 0, 0, "", [], []) for number, doc in docs)
        return
    left, right = _sides(rules)
    a = np.fromiter(chain.from_iterable(x for x, _ in held), np.int64)
    b = np.fromiter(chain.from_iterable(x for _, x in held), np.int64)
    a_docs, b_docs = [np.cumsum([len(x[side]) for x in held], dtype=np.int64) for side in (0, 1)]
    a_cuts, b_cuts = shared_cuts(np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b]), a_docs, b_docs)
    group_docs = np.searchsorted(a_cuts, a_docs, "right")  # groups up to the end of each document
    m, k = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
    link_docs = np.append(0, np.cumsum(m * k))[group_docs]
    owner = np.repeat(np.arange(len(held)), np.diff(a_docs, prepend=0))
    pairs, times = linked_pairs((owner << (2 * ID_BITS)) | (a << ID_BITS), b, a_cuts, b_cuts)
    pair_docs = np.searchsorted(pairs >> (2 * ID_BITS), np.arange(len(held)), "right")
    pairs &= (1 << (2 * ID_BITS)) - 1
    # Ids as text in place: the ids of A of a group, then those of B.
    line = np.empty(len(a) + len(b), dtype=object)
    a_last, b_last = [np.bincount(cuts - 1, minlength=n) for cuts, n in ((a_cuts, len(a)), (b_cuts, len(b)))]
    a_group, b_group = np.repeat(np.arange(len(m)), m), np.repeat(np.arange(len(k)), k)
    line[np.arange(len(a)) + (b_cuts - k)[a_group]] = _printed(len(left.table), ",", "|")[a + len(left.table) * a_last]
    line[np.arange(len(b)) + a_cuts[b_group]] = _printed(len(right.table), ",", ";")[b + len(right.table) * b_last]
    at, n = 0, [np.diff(x, prepend=0) for x in (a_docs, b_docs, group_docs, link_docs)]
    for (number, doc), own in zip(docs, ids):
        if own is None:
            yield number, doc, 0, 0, 0, 0, "", [], []
            continue
        whole = "".join(line[a_docs[at] + b_docs[at] - n[0][at] - n[1][at]:a_docs[at] + b_docs[at]].tolist())[:-1]
        first, end = pair_docs[at - 1] if at else 0, pair_docs[at]
        facts = (*[int(x[at]) for x in n], hashlib.sha256(whole.encode()).hexdigest())
        for part in range(first, max(end, first + 1), PAIRS_A_ROW):
            stop = min(end, part + PAIRS_A_ROW)
            yield number, doc, *facts, pairs[part:stop], times[part:stop]
            facts = (None,) * 5
        at += 1


def _digests(rules: AlignRules):
    def batch(docs: list, ids: list) -> pa.RecordBatch:
        columns = zip(*_aligned(docs, ids, rules))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, docs, ids, held = TaskContext.get().partitionId() << 33, [], [], 0
        for part in parts:
            for doc, raw in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                docs.append((number, doc))
                ids.append(_encoded(raw, rules))
                held += len(ids[-1][0]) if ids[-1] else 0
                number += 1
                if len(docs) == DOCS_AT_ONCE or held > TOKENS_AT_ONCE:
                    yield batch(docs, ids)
                    docs, ids, held = [], [], 0
        if docs:
            yield batch(docs, ids)

    return batches


def _frequent_from(counts: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` pairs reach with their count."""
    level = F.floor(F.log2("n")).cast("int").alias("level")
    found = {r["level"]: r["pairs"] for r in counts.groupBy(level).agg(F.count(F.lit(1)).alias("pairs")).collect()}  # at most 63 rows
    total, least = 0, max(found, default=0) + 1
    while least and total + found.get(least - 1, 0) <= most:
        least -= 1
        total += found.get(least, 0)
    return 1 << least


def align_tokenizers(docs: DataFrame, rules: AlignRules = AlignRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = stored(narrow.mapInArrow(_digests(rules), DIGEST), "align-digests")
    counted = made.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counted = stored(counted, "align-counts")
    side_a = F.shiftright("pair", ID_BITS)
    # One row per id of A's vocabulary.
    highest = counted.groupBy(side_a.alias("_a")).agg(F.max("n").alias("_most"))
    counts = counted.join(F.broadcast(highest), side_a == F.col("_a")).select(
        F.col("pair").alias("_pair"), "n", (F.col("n") == F.col("_most")).alias("best"))
    least = _frequent_from(counted, rules.frequent_pairs)
    links = made.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("_link")).select("_row", "_link.pairs", "_link.times")
    frequent = F.broadcast(counts.where(F.col("n") >= least))
    resolved = links.join(frequent, F.col("pairs") == F.col("_pair"))
    if least > 1:
        rest = links.join(F.broadcast(counts.where(F.col("n") >= least).select("_pair")), F.col("pairs") == F.col("_pair"), "left_anti")
        resolved = resolved.unionByName(rest.join(counts.where(F.col("n") < least), F.col("pairs") == F.col("_pair")))
    sums = resolved.groupBy(F.col("_row").alias("_sum_row")).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    first = made.where("n_a is not null").drop("pairs", "times")
    return first.join(sums, F.col("_row") == F.col("_sum_row"), "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
