"""Harmonic packing of documents into sequences (operator 12).

Class k holds the lengths in ``(capacity / (k + 1), capacity / k]``; a sequence of class k takes exactly k pieces, whatever
their lengths, so it can be filled by counting. Documents may be cut, so they are cut such that this wastes little: a
length is *good* if k of it leave at most ``slack`` of a sequence empty, and a document becomes whole sequences, then the
longest good length that is left, and so on. Powers of two are good, 1 is, and so nothing is left over.

Workers fill sequences of every class from their own pieces, independently. What a worker cannot complete, fewer than k
pieces a class, goes on to a next round with ``fan_in`` times fewer workers, until one worker gets the open pieces of at
most ``fan_in``: a number bounded by the classes alone. That one closes them first-fit, longest first. Pieces of complete
sequences are never moved, and no row passes through the driver.

A sequence number is made of its round, its worker's partition and a running number, so a task that runs again after a
lost executor makes the same ones; each round is stored before the next reads it.

Defined cases: a null or empty text is the end id alone; null ids stay null; repeated rows are packed each; ties do not
arise, as pieces are taken in the order of the rows; very long texts are encoded in stretches between blanks, which gives
the same ids; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_text, raw_texts, stored, vocabulary_path
from gridloom.session import ship_package

WORD_BPE = "word_bpe_49k.json"
#: Bytes of a text that are taken apart at once; a longer text is cut at blanks.
STRETCH = 1 << 20
#: Distinct words whose ids are remembered in a worker (twice as many at most), and the longest word that is.
WORDS_HELD, LONGEST_HELD = 500_000, 64
_BLANK = re.compile(rb"[ \t\n]")
#: A control character: a word of its own between blanks.
_MARK = b"\x01"
_BETWEEN = b" " + _MARK + b" "


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [c.split()[0] for c in PIECES.split(", ")]


@dataclass(frozen=True)
class HarmonicRules:
    capacity: int = 2048
    end_id: int = 1
    vocabulary: str = WORD_BPE
    #: The share of a sequence that may stay empty for the sake of fewer cuts.
    slack: float = 1 / 64
    fan_in: int = 8


@lru_cache(maxsize=8)
def good_lengths(capacity: int, slack: float) -> list[int]:
    """Lengths whose class is filled by them up to ``slack`` of the capacity, ascending."""
    return [s for s in range(1, capacity + 1) if capacity % s <= slack * capacity]


@lru_cache(maxsize=1 << 14)
def remainder_cuts(n: int, capacity: int, slack: float) -> tuple[int, ...]:
    """Lengths of the pieces of a document's last n < capacity ids."""
    good, out = good_lengths(capacity, slack), []
    while n:
        out.append(good[bisect_right(good, n) - 1])
        n -= out[-1]
    return tuple(out)


def cuts(n: int, rules: HarmonicRules) -> tuple[int, ...]:
    return (rules.capacity,) * (n // rules.capacity) + remainder_cuts(n % rules.capacity, rules.capacity, rules.slack)


# ---- ids ---------------------------------------------------------------------------------------------------------------

@lru_cache(maxsize=2)
def _library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one task a core already
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Ids of texts, by the ids of their words.

    No token spans an ASCII blank, and nothing the vocabulary does to a word depends on what stands beyond one. So each
    distinct run between blanks is encoded once, by the library, and remembered; a text is put together from its runs.
    Unknown runs are encoded many at a time: those of letters one after the other, the others with a word between them that
    stands in no run and has one id.
    """

    def __init__(self, vocabulary: str = WORD_BPE, remembered: int = WORDS_HELD):
        self._encode = _library(vocabulary_path(vocabulary)).encode_batch_fast
        self._mark = self._ids([_MARK.decode()])[0]
        if len(self._mark) != 1:
            raise ValueError("the vocabulary has no entry for the mark between words")
        vocab = _library(vocabulary_path(vocabulary)).get_vocab()
        self._last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self._last[[i for entry, i in vocab.items() if entry.endswith("</w>")]] = True
        self._runs, self._older, self._most = {}, {}, remembered

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(found.ids, "<u4") for found in self._encode(texts, add_special_tokens=False)]

    def raws(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text in UTF-8, four little-endian bytes an id. Texts of about ``STRETCH`` bytes are looked up together."""
        group, held = [], 0
        for text in texts:
            if group and held + len(text) > STRETCH:
                yield from self._group(group)
                group, held = [], 0
            if len(text) > STRETCH:
                yield b"".join([ids for part in stretches(text) for ids in self._group([part])])
            else:
                group.append(text)
                held += len(text)
        yield from self._group(group)

    def _remember(self, words: list[bytes], ids: np.ndarray, ends: list[int], starts: list[int]) -> None:
        if len(ends) != len(words):
            raise ValueError("the vocabulary divides words in another way")
        raw = ids.tobytes()
        self._runs.update(zip(words, [raw[4 * lo:4 * hi] for lo, hi in zip(starts, ends)]))

    def _group(self, texts: list[bytes]) -> list[bytes]:
        if len(self._runs) > self._most:  # those in use come back from the older half
            self._older, self._runs = self._runs, {}
        lists, older = [text.split() for text in texts], self._older
        missing = set().union(*lists).difference(self._runs)
        new = [w for w in missing if w not in older]
        self._runs.update((w, older[w]) for w in missing if w in older)
        if any(_MARK in text for text in texts):
            odd = [w for w in new if _MARK in w]
            new = [w for w in new if _MARK not in w]
            self._runs.update(zip(odd, (ids.tobytes() for ids in self._ids([as_text(w) for w in odd]))))
        # A run of letters is one word, and the entry that ends a word says so; other runs need the mark.
        letters = [w for w in new if w.isalpha()]
        new = [w for w in new if not w.isalpha()]
        if letters:
            ids = self._ids([b" ".join(letters).decode()])[0]
            ends = (np.flatnonzero(self._last[ids]) + 1).tolist()
            self._remember(letters, ids, ends, [0, *ends])
        if new:
            ids = self._ids([as_text(_BETWEEN.join(new))])[0]
            ends = [*np.flatnonzero(ids == self._mark[0]).tolist(), len(ids)]
            self._remember(new, ids, ends, [0, *[e + 1 for e in ends]])
        out = [b"".join(map(self._runs.__getitem__, words)) for words in lists]
        for word in missing:
            if len(word) > LONGEST_HELD:
                del self._runs[word]
        return out


@lru_cache(maxsize=2)
def _words_of(vocabulary: str) -> WordIds:
    """Kept by a Python worker from task to task."""
    return WordIds(vocabulary)


def stretches(raw: bytes, size: int = STRETCH) -> Iterator[bytes]:
    """The text cut at blanks, into parts of about ``size`` bytes."""
    at = 0
    while len(raw) - at > size and (found := _BLANK.search(raw, at + size)):
        yield raw[at:found.start()]
        at = found.start()
    yield raw[at:]


# ---- filling -----------------------------------------------------------------------------------------------------------

class _Filler:
    """Sequences of one worker: of every class one is open, and complete once it has its count of pieces."""

    def __init__(self, rules: HarmonicRules, number: int):
        self.rules, self.next = rules, (number << 56) | (TaskContext.get().partitionId() << 32)
        self.open: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def add(self, piece: tuple) -> None:
        """piece: doc_id, start, length, ids_crc32, doc_tokens."""
        k = self.rules.capacity // piece[2]
        pieces = self.open.setdefault(k, [])
        pieces.append(piece)
        if len(pieces) == k:
            self.close(self.open.pop(k))

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.done.append((*piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def left_open(self) -> Iterator[tuple]:
        for pieces in self.open.values():
            for piece in pieces:
                yield (*piece, None, None)

    def first_fit(self) -> None:
        """Close all that is open, longest pieces first."""
        sequences: list[list] = []  # [room, pieces]; few, as open pieces are few
        for piece in sorted((p for pieces in self.open.values() for p in pieces), key=lambda p: -p[2]):
            found = next((s for s in sequences if s[0] >= piece[2]), None)
            if found is None:
                sequences.append(found := [self.rules.capacity, []])
            found[0] -= piece[2]
            found[1].append(piece)
        for _, pieces in sequences:
            self.close(pieces)
        self.open.clear()

    def batch(self, more: Iterator[tuple] = ()) -> pa.RecordBatch:
        rows = [*self.done, *more]
        self.done.clear()
        columns = list(zip(*rows)) if rows else [[]] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_NAMES)


def _from_texts(rules: HarmonicRules):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler, ids, end = _Filler(rules, 0), _words_of(rules.vocabulary), rules.end_id.to_bytes(4, "little")
        for part in parts:
            for doc, raw in zip(part.column(0).to_pylist(), ids.raws(list(raw_texts(part.column(1))))):
                raw, start = raw + end, 0
                n = len(raw) // 4
                for length in cuts(n, rules):
                    filler.add((doc, start, length, zlib.crc32(raw[4 * start:4 * (start + length)]), n))
                    start += length
            yield filler.batch()
        yield filler.batch(filler.left_open())

    return batches


def _from_open(rules: HarmonicRules, number: int, last: bool):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filler = _Filler(rules, number)
        for part in parts:
            for piece in zip(*[part.column(i).to_pylist() for i in range(5)]):
                filler.add(piece)
            yield filler.batch()
        if last:
            filler.first_fit()
        yield filler.batch(filler.left_open())

    return batches


def pack_harmonic(docs: DataFrame, rules: HarmonicRules = HarmonicRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = stored(narrow.mapInArrow(_from_texts(rules), PIECES), "harmonic")
    closed, number = made.where("sequence_id is not null"), 0
    while True:
        # One file a worker of the round before.
        number, workers = number + 1, max(1, -(-len(made.inputFiles()) // rules.fan_in))
        waiting = made.where("sequence_id is null")
        dealt = waiting.repartition(workers) if workers > 1 else waiting.coalesce(1)
        made = stored(dealt.mapInArrow(_from_open(rules, number, workers == 1), PIECES), "harmonic")
        closed = closed.unionByName(made.where("sequence_id is not null"))
        if workers == 1:
            return closed
