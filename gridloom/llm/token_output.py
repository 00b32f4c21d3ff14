"""Token-id output in binary matrices (operator 3).

Every task tokenises its documents, cuts overlong ones without loss, and packs the pieces of a bounded block best-fit
longest first. The sequence with the least room that still suffices is found in a segment tree over room values, in
log(capacity) steps. Nothing is shuffled: a block of some million tokens already packs almost without gaps, and blocks do
not depend on each other, so a lost executor costs only its own blocks.

One output row is a matrix of up to ``rows`` sequences: ids as little-endian integers in row order (two bytes while the
vocabulary allows), the cumulative segment lengths over the flat matrix (the gap at the end of a sequence is a segment of
its own, marked by piece -1), and the flat places where positions restart at 0. ``unpack`` restores the documents.

Defined cases: a null or empty text is the end id alone; a null id stays null; repeated rows are written each; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_text, raw_texts
from gridloom.llm.tokens import BYTE_BPE, BYTE_BPE_RANKS, token_ids
from gridloom.session import ship_package

MATRICES = ("n_rows int, n_tokens long, id_bytes int, ids binary, cu_seqlens array<int>, position_resets array<int>, "
            "doc_ids array<long>, pieces array<int>")


@dataclass(frozen=True)
class MatrixRules:
    length: int = 1024
    rows: int = 64
    end_id: int = 50256
    pad_id: int = 50256
    id_bytes: int = 2
    block_tokens: int = 4_000_000   # tokens that a task holds before it packs and writes them
    vocabulary: str = BYTE_BPE
    ranks: str | None = BYTE_BPE_RANKS


class RoomTree:
    """Sequences by room left. A segment tree over 0..capacity counts them; the first room >= x is found top down."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.width
        while at:
            self.counts[at] += n
            at >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.bins[room].append(sequence)
        self._add(room, 1)

    def best(self, size: int) -> tuple[int, int] | None:
        """Takes out (room, sequence) with the least room >= size."""
        at = size + self.width
        while not self.counts[at]:  # up to the first subtree on the right that holds a sequence
            while at & 1:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
        while at < self.width:
            at *= 2
            if not self.counts[at]:
                at += 1
        room = at - self.width
        self._add(room, -1)
        return room, self.bins[room].pop()


def fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit-decreasing: item numbers by sequence."""
    tree, sequences = RoomTree(capacity), []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        found = tree.best(size)
        if found is None:
            found = (capacity, len(sequences))
            sequences.append([])
        sequences[found[1]].append(item)
        tree.put(found[0] - size, found[1])
    return sequences


def _matrices(block: list[tuple], rules: MatrixRules) -> Iterator[dict]:
    """block: (doc_id, piece, ids)."""
    sequences = fit(np.array([len(ids) for _, _, ids in block], dtype=np.int64), rules.length)
    for first in range(0, len(sequences), rules.rows):
        chosen = sequences[first:first + rules.rows]
        ids = np.full((len(chosen), rules.length), rules.pad_id, dtype=f"<u{rules.id_bytes}")
        edges, resets, doc_ids, numbers, used = [0], [], [], [], 0
        for row, items in enumerate(chosen):
            at = 0
            for item in items:
                doc, piece, own = block[item]
                ids[row, at:at + len(own)] = own
                resets.append(row * rules.length + at)
                at += len(own)
                edges.append(row * rules.length + at)
                doc_ids.append(doc), numbers.append(piece)
            used += at
            if at < rules.length:
                resets.append(row * rules.length + at)
                edges.append((row + 1) * rules.length)
                doc_ids.append(None), numbers.append(-1)
        yield {"n_rows": len(chosen), "n_tokens": used, "id_bytes": rules.id_bytes, "ids": ids.tobytes(), "cu_seqlens": edges,
               "position_resets": resets, "doc_ids": doc_ids, "pieces": numbers}


_ARROW = pa.schema([
    ("n_rows", pa.int32()), ("n_tokens", pa.int64()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
    ("position_resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32()))])


def packed_matrices(docs: DataFrame, rules: MatrixRules = MatrixRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per matrix of packed sequences."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0

        def flush():
            for row in _matrices(block, rules):
                yield pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for part in parts:
            for doc, raw in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
                ids = np.append(token_ids(as_text(raw), rules.vocabulary, rules.ranks), np.uint32(rules.end_id)).astype(f"<u{rules.id_bytes}")
                block += [(doc, i, ids[at:at + rules.length]) for i, at in enumerate(range(0, len(ids), rules.length))]
                held += len(ids)
                if held >= rules.block_tokens:
                    yield from flush()
                    block, held = [], 0
        yield from flush()

    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(batches, MATRICES)


def write_matrices(matrices: DataFrame, path: str) -> None:
    matrices.write.mode("errorifexists").parquet(path)


def matrix_ids(row, length: int = 1024) -> np.ndarray:
    """The id matrix of a row."""
    return np.frombuffer(row["ids"], dtype=f"<u{row['id_bytes']}").reshape(row["n_rows"], length)


def position_ids(row, length: int = 1024) -> np.ndarray:
    """Positions within segments, in the shape of the matrix."""
    flat = np.arange(row["n_rows"] * length)
    edges = np.asarray(row["cu_seqlens"])
    return (flat - np.repeat(edges[:-1], np.diff(edges))).reshape(row["n_rows"], length)


def unpack(row) -> list[tuple]:
    """(doc_id, piece, ids) of every segment of a matrix, without the gaps."""
    flat, edges = np.frombuffer(row["ids"], dtype=f"<u{row['id_bytes']}"), row["cu_seqlens"]
    return [(doc, piece, flat[a:b]) for doc, piece, a, b in zip(row["doc_ids"], row["pieces"], edges[:-1], edges[1:]) if piece >= 0]
