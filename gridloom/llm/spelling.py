"""Spelling variants of the words of a corpus (operator 11).

Words are counted per batch of documents first, so the shuffle carries distinct words, not occurrences. Near words are
found in blocks: a word is a vector of letter counts, and one edit changes at most two counts by one, so near words have a
squared distance of at most two. A block holds the words of one length and one split of it over six groups of letters.
An edit moves between blocks of the same or an adjacent length, and there only to those one letter apart: a block meets
itself, the blocks with one letter moved between groups, and those with a letter more. Of each the matrix of inner
products (NumPy) gives all squared distances; pairs at most two are kept and the edit itself is verified, also in whole
arrays.

Blocks over ``tile`` words are cut in tiles. The words that a tile can meet stream past it in parts of that size: memory
is bounded by the tile, and a block with most of the words is spread over many tiles. Words are shuffled to the tiles they
can meet, pairs are not: a tile emits verified near pairs only. Forms and roots are joins over words; pointers are
doubled, so the rounds grow with the logarithm of the longest chain.

Defined cases: a null or empty text has no words; a null id is written as an empty string where the id enters; repeated
rows count each; ties go to the larger n, then to the smaller word in code-point order; very long texts are searched
whole; very long words are compared in smaller parts; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_text, raw_texts, stored
from gridloom.session import ship_package

#: Letters of a text whose A-Z are lower-cased.
RUN_OF = "[a-zÀ-ÿ]{%d,}"
#: Places of a vector: a to z, and six that share U+00C0 to U+00FF. Sharing only shortens distances.
_HIGH_PLACES = 6
_PLACES = 26 + _HIGH_PLACES
#: Groups of letters that split the words of European languages evenly; all others are the sixth.
_GROUPS = ("ae", "iou", "rs", "tn", "cdl")
#: Distinct words that are held before they are handed on.
WORDS_AT_ONCE = 300_000
#: Letters of a tile, and of the pairs that are verified at once.
LETTERS_AT_ONCE = 1 << 22


@dataclass(frozen=True)
class SpellingRules:
    least_letters: int = 7
    least_count: int = 2
    #: One run in so many, by the crc32 of id and run, loses a letter. 0: none.
    damage_every: int = 31
    #: A form is at least this many times as frequent.
    ratio: int = 10
    tile: int = 4096


# ---- counting --------------------------------------------------------------------------------------------------------

def _damaged(run: str, start: int, every: int) -> str:
    """The run, or the run without one letter where the crc32 (from ``start``, that of the id) says so."""
    h = zlib.crc32(run.encode(), start)
    if h % every == 0:
        at = h % len(run)
        return run[:at] + run[at + 1:]
    return run


def _counts(rules: SpellingRules):
    # A run that is too short stays so, damaged or not.
    runs = re.compile(RUN_OF % rules.least_letters)

    def batch(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for part in parts:
            for doc, raw in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # Lower-casing bytes changes A-Z alone.
                for run, n in Counter(runs.findall(as_text(raw.lower()))).items():
                    word = _damaged(run, start, rules.damage_every) if rules.damage_every else run
                    if len(word) >= rules.least_letters:
                        held[word] += n
                if len(held) > WORDS_AT_ONCE:
                    yield batch(held)
                    held = Counter()
        yield batch(held)

    return batches


def word_counts(docs: DataFrame, rules: SpellingRules = SpellingRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n), words of at least ``least_letters`` that occur ``least_count`` times."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = narrow.mapInArrow(_counts(rules), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= rules.least_count)


# ---- blocks ----------------------------------------------------------------------------------------------------------

def _split() -> Column:
    """Letters of the word in each group."""
    length = F.length("word")
    parts = [length - F.length(F.translate("word", g, "")) for g in _GROUPS]
    rest = length
    for part in parts:
        rest = rest - part
    return F.array(*parts, rest).cast("array<int>")


def _steps() -> list[tuple[int, ...]]:
    """From a block to those one edit away, each unordered pair of blocks once: a letter of another group, a letter more."""
    places = range(len(_GROUPS) + 1)
    moved = [tuple((i == a) - (i == b) for i in places) for a in places for b in places if a < b]
    return moved + [tuple(int(i == a) for i in places) for a in places]


#: What a word is to a tile: one of its own, one of the same length that it meets, one that is a letter longer.
_OWN, _SAME, _LONGER = 0, 1, 2


def tiles(words: DataFrame, tile: int) -> DataFrame:
    """(word) stored -> (tile, kind, word): the words of each tile, and those it meets."""
    blocked = words.select("word", _split().alias("block"))
    size = F.greatest(F.count(F.lit(1)) / F.lit(tile), F.sum(F.length("word")) / F.lit(LETTERS_AT_ONCE))
    sizes = stored(blocked.groupBy("block").agg(F.ceil(size).cast("int").alias("tiles")), "spelling-blocks")
    # The blocks that meet a block, one row of at most 22 entries per block.
    before = [F.struct(F.lit(_LONGER if sum(step) else _SAME).alias("kind"), F.array(*[F.element_at("block", i + 1) - F.lit(d) for i, d in enumerate(step)]).alias("base"))
              for step in _steps()]
    wanted = sizes.select("block", "tiles", F.explode(F.array(F.struct(F.lit(_OWN).alias("kind"), F.col("block").alias("base")), *before)).alias("p"))
    bases = sizes.select(F.col("block").alias("_base"), F.col("tiles").alias("base_tiles"))
    found = wanted.select("block", "tiles", "p.*").join(bases, F.col("base") == F.col("_base"))
    places = stored(found.groupBy("block", "tiles").agg(F.collect_list(F.struct("kind", "base", "base_tiles")).alias("places")), "spelling-places")
    dealt = blocked.join(places, "block").withColumn("own", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    # Of its own block a word meets the tiles up to its own.
    last = F.when(F.col("p.kind") == _OWN, F.col("own")).otherwise(F.col("p.base_tiles") - 1)
    placed = dealt.select("word", "own", F.explode("places").alias("p")).select("word", "own", "p.kind", "p.base", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    kind = F.when((F.col("kind") == _OWN) & (F.col("at") < F.col("own")), _SAME).otherwise(F.col("kind"))
    return placed.select(F.concat_ws(",", F.concat_ws(",", F.col("base").cast("array<string>")), F.col("at").cast("string")).alias("tile"), kind.alias("kind"), "word")


class Words:
    """Words of one length: code points, and vectors of letter counts with what turns a product into a distance."""

    def __init__(self, words: list[str]):
        self.words, width = words, len(words[0])
        self.codes = np.array(words, dtype=f"<U{width}").view("<u4").reshape(len(words), width)
        # Products of counts stay exact: below 2^24 in single precision.
        self.counts = np.zeros((len(words), _PLACES), dtype=np.float32 if width < 1024 else np.float64)
        step = max(1, LETTERS_AT_ONCE // width)
        for at in range(0, len(words), step):
            codes = self.codes[at:at + step].astype(np.int64)
            place = np.where(codes < 0xC0, codes - ord("a"), 26 + codes % _HIGH_PLACES) + np.arange(len(codes))[:, None] * _PLACES
            self.counts[at:at + step] = np.bincount(place.ravel(), minlength=len(codes) * _PLACES).reshape(-1, _PLACES)
        squares, ones = (self.counts ** 2).sum(axis=1, keepdims=True), np.ones((len(words), 1), self.counts.dtype)
        self.left, self.right = np.hstack([self.counts, squares, ones]), np.hstack([-2 * self.counts, ones, squares])


def _one_edit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x, y: rows of code points of equal length, or y one longer -> whether one edit apart."""
    if x.shape[1] == y.shape[1]:
        return (x != y).sum(axis=1) == 1
    lead = np.cumprod(x == y[:, :-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    trail = np.cumprod((x == y[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
    return lead + trail >= x.shape[1]


def near_in(left: Words, right: Words) -> Iterator[tuple[str, str]]:
    """Near pairs between two lists, the right one as long or one letter longer; of a list with itself each pair once."""
    step = max(1, LETTERS_AT_ONCE // left.codes.shape[1])
    rows = max(1, (1 << 21) // len(right.words))
    for at in range(0, len(left.words), rows):
        # Columns hold |u|^2 and |v|^2 too, so the product is the squared distance.
        i, j = np.nonzero(left.left[at:at + rows] @ right.right.T <= 2)
        i += at
        if left is right:
            i, j = i[i < j], j[i < j]
        for s in range(0, len(i), step):
            x, y = i[s:s + step], j[s:s + step]
            near = _one_edit(left.codes[x], right.codes[y])
            yield from zip([left.words[k] for k in x[near]], [right.words[k] for k in y[near]])


def _near(tile: int):
    def batch(found: list[tuple[str, str]]) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.string()) for i in (0, 1)], names=["a", "b"])
        found.clear()
        return made

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (tile, kind, word) sorted by tile and kind -> (a, b), near words."""
        current, kind, own, waiting, found = None, None, None, [], []

        def meet() -> None:  # what waits, with the tile or as the tile
            nonlocal own
            if kind == _OWN:
                own = Words(waiting) if waiting else None
                if own is not None and len(waiting) > 1:
                    found.extend(near_in(own, own))
            elif waiting and own is not None:
                found.extend(near_in(own, Words(waiting)))

        for part in parts:
            for name, what, word in zip(*[part.column(i).to_pylist() for i in range(3)]):
                if name != current or what != kind or (what != _OWN and (len(waiting) >= tile or len(waiting) * len(word) > LETTERS_AT_ONCE)):
                    meet()
                    if name != current:
                        own = None
                    current, kind, waiting = name, what, []
                    if len(found) > 20_000:
                        yield batch(found)
                waiting.append(word)
        meet()
        yield batch(found)

    return batches


def near_words(words: DataFrame, tile: int = SpellingRules.tile) -> DataFrame:
    """(word) distinct, stored -> (a, b), every pair that one edit connects, once."""
    dealt = tiles(words, tile).repartition("tile").sortWithinPartitions("tile", "kind")
    return dealt.mapInArrow(_near(tile), "a string, b string")


# ---- forms and roots -------------------------------------------------------------------------------------------------

def spelling_variants(docs: DataFrame, rules: SpellingRules = SpellingRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = stored(word_counts(docs, rules, id_col, text_col), "spelling-words")
    pairs = stored(near_words(words.select("word"), rules.tile), "spelling-near")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = words.select(F.col("word").alias("_near"), F.col("n").alias("_near_n"))
    best = both.join(named, F.col("b") == F.col("_near")).groupBy(F.col("a").alias("_word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("_near_n")).alias("minus"), F.col("b").alias("form"))).alias("best"))
    is_form = -F.col("best.minus") >= F.col("n") * rules.ratio
    made = words.join(best, F.col("word") == F.col("_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.form")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n"))
    made = stored(made, "spelling-forms")
    to = stored(made.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:  # every round doubles the steps followed
        further = to.select(F.col("word").alias("_from"), F.col("root").alias("_to"))
        moved = stored(to.join(further, F.col("root") == F.col("_from"), "left").select(
            "word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("moved")), "spelling-roots")
        to = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    named = to.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
    return made.join(named, F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("_root", "word").alias("root"), "n", "n_near", "form_n")
