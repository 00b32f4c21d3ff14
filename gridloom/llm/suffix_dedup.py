"""Repeated byte strings by prefix-free parsing (operator 2).

Every byte covered by a string of ``length`` bytes that also starts earlier in the corpus is removed. The method is a
prefix-free parse, dealt out over a cluster:

* *Triggers.* A rolling hash of ``gram`` bytes is taken at every byte; the least hash in each stretch of
  ``length - gram + 1`` places is a trigger. Any string of ``length`` bytes therefore holds a trigger that depends on that
  string alone, so two equal strings are cut at the same place (a modulus would give no such bound on the gap).
* *Phrases.* The phrase of a trigger reaches ``length - gram`` bytes before and ``length`` bytes after it, so phrases overlap
  enough to hold every string around their trigger. The parse is the list of triggers of a document, each with the hash of
  its phrase. Where a phrase occurred before, all strings in it repeat: the parse alone decides, no bytes are compared.
* *Dictionary.* Distinct phrases of one trigger are compared by suffix arrays: their suffixes from the trigger are sorted, and
  their prefixes up to it backwards, each with the lengths of common prefixes between neighbours. A string that starts d
  bytes before the trigger is equal in two phrases if they share d bytes to the left and ``length - d`` to the right.
  Together with the corpus order of the phrases this tells, for every d, which string came first.

Parse, dictionary and answers travel as Arrow batches in binary columns: by trigger hash to compare, by document to apply.
Within a batch only the first of equal phrases travels, so a phrase in a third of all documents is one entry per batch. A
trigger with more than ``class_limit`` distinct phrases (the edge of a passage that very many documents share) is dealt
out again by the strings themselves, one entry per string and task. No document, key or group is held whole anywhere.

Corpus order is doc_id (null last), then a checksum of the text where ids repeat, then the place. Defined cases: a null or
empty text has no bytes; texts shorter than ``length`` keep all; strings never cross documents; repeated rows (same id and
text) are one document and get equal results; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import raw_texts, stored
from gridloom.session import ship_package, shuffle_width

LAST = np.iinfo(np.int64).max
REPEATED, COMPARED, DEALT = 1, 2, 3   # what is known of a phrase: seen before, to compare, to deal out by strings
ANSWERS, PARTIAL, TEXTS = 0, 1, 2     # kinds of rows that meet by document
_P = [np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@dataclass(frozen=True)
class RepeatRules:
    length: int = 100
    gram: int = 24                  # bytes of the rolling hash, a multiple of 8
    class_limit: int = 50_000       # distinct phrases of a trigger that one task compares
    bucket_bytes: int = 24_000_000  # text per bucket of triggers or documents

    @property
    def before(self) -> int:
        return self.length - self.gram

    @property
    def phrase(self) -> int:
        return self.before + self.length


# ---- parsing ---------------------------------------------------------------------------------------------------------

def _words(raw: np.ndarray) -> np.ndarray:
    """The 8-byte word at every byte."""
    return np.ndarray((max(0, len(raw) - 7),), dtype="<u8", buffer=raw, strides=(1,))


def _mix(h: np.ndarray, word: np.ndarray, p: np.uint64) -> np.ndarray:
    h = (h ^ word) * p
    h ^= h >> np.uint64(29)
    return h


def _window_least(h: np.ndarray, n: int) -> np.ndarray:
    """Least value of every n values in a row."""
    size = 1
    while 2 * size <= n:
        h, size = np.minimum(h[:-size], h[size:]), 2 * size
    rest = n - size
    return np.minimum(h[:len(h) - rest], h[rest:]) if rest else h


def triggers(raw: bytes, rules: RepeatRules) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the triggers of a text."""
    if len(raw) < rules.length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    words = _words(np.frombuffer(raw, np.uint8))
    n = len(raw) - rules.gram + 1
    h = np.full(n, _P[3])
    for i in range(0, rules.gram, 8):
        h = _mix(h, words[i:i + n], _P[(i // 8) % 3])
    h *= _P[1]
    h ^= h >> np.uint64(32)
    width = rules.before + 1
    least = _window_least(h, width)
    pad = np.zeros(width - 1, np.uint64)
    # A place is a trigger if its hash is the least of some stretch around it: the greatest of the least ones is its own.
    most = ~_window_least(~np.concatenate([pad, least, pad]), width)
    at = np.flatnonzero(most == h)
    return at, h[at]


def _padded(raw: bytes, rules: RepeatRules) -> np.ndarray:
    out = np.zeros(rules.before + len(raw) + rules.length + 8, np.uint8)
    out[rules.before:rules.before + len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def _reach(at: np.ndarray, size: int, rules: RepeatRules) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a phrase that the text has before and after its trigger."""
    return np.minimum(at, rules.before), np.minimum(size - at, rules.length)


def phrase_hashes(raw: bytes, at: np.ndarray, rules: RepeatRules) -> np.ndarray:
    words, (left, right) = _words(_padded(raw, rules)), _reach(at, len(raw), rules)
    h = _mix(np.full(len(at), _P[0]), (left * 256 + right).astype(np.uint64), _P[2])
    for i in range(0, rules.phrase, 8):
        word = words[at + i]
        if rules.phrase - i < 8:
            word = word & np.uint64((1 << 8 * (rules.phrase - i)) - 1)
        h = _mix(h, word, _P[(i // 8) % 4])
    h *= _P[1]
    return h ^ (h >> np.uint64(32))


def phrases(raw: bytes, at: np.ndarray, rules: RepeatRules) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(_padded(raw, rules), rules.phrase)[at]


# ---- rows of Arrow batches ---------------------------------------------------------------------------------------------

_OUT = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])
ROWS = "bucket long, kind int, body binary"


def _body(**columns) -> bytes:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    batch = pa.RecordBatch.from_arrays(arrays, names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _table(bodies: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in bodies])


def _numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table[n].to_numpy() for n in names]


def _fixed(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.types)], schema=_OUT)


def _by_bucket(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, members), members in their order."""
    order = np.argsort(buckets, kind="stable")
    edges = np.flatnonzero(np.append(True, buckets[order][1:] != buckets[order][:-1])) if len(order) else []
    for a, b in zip(edges, [*edges[1:], len(order)]):
        yield int(buckets[order[a]]), order[a:b]


def _documents(part: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """(order, check, text): null ids come last, the checksum tells texts of one id apart."""
    for doc, raw in zip(part.column(0).to_pylist(), raw_texts(part.column(1))):
        yield LAST if doc is None else doc, zlib.crc32(raw), raw


def _home(doc: np.ndarray, check: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of a document."""
    h = _mix(doc.astype(np.int64).view(np.uint64), check.astype(np.uint64) << np.uint64(17), _P[0])
    return ((h >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)


def _dealt(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str = ROWS) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(work, schema)


def _buckets(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for part in parts:
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist(), (v.as_py() for v in part.column(2)))


# ---- the rounds ----------------------------------------------------------------------------------------------------

def _answers(doc, check, at, state, mask, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """What is known of phrases, by bucket of their document."""
    for bucket, own in _by_bucket(_home(doc, check, buckets)):
        yield bucket, ANSWERS, _body(doc=doc[own], check=check[own], at=at[own], state=state[own], mask=_fixed(mask[own]))


def _no_mask(n: int, rules: RepeatRules) -> np.ndarray:
    return np.zeros((n, -(-(rules.before + 1) // 8)), np.uint8)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Mask of the first member of each group; keys from the last to the first sort key, groups by all but ``order``."""
    order, groups = keys[0], keys[1:]
    by = np.lexsort((order, *groups))
    new = np.zeros(len(by), bool)
    for g in groups:
        new[1:] |= g[by][1:] != g[by][:-1]
    new[:1] = True
    out = np.zeros(len(by), bool)
    out[by[new]] = True
    return out


def _order(doc: np.ndarray, check: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank in corpus order."""
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((at, check, doc))] = np.arange(len(doc))
    return rank


def _parse(parts: Iterator[pa.RecordBatch], rules: RepeatRules, buckets: int) -> Iterator[pa.RecordBatch]:
    """Documents -> triggers with phrase hashes, by trigger; repeats inside the batch are answered at once."""
    for part in parts:
        found, seen = [], set()
        for doc, check, raw in _documents(part):
            at, key = triggers(raw, rules)
            if len(at) and (doc, check) not in seen:  # repeated rows are one document
                seen.add((doc, check))
                found.append((np.full(len(at), doc), np.full(len(at), check, np.uint32), at.astype(np.int32), key, phrase_hashes(raw, at, rules)))
        if not found:
            continue
        doc, check, at, key, phrase = (np.concatenate(c) for c in zip(*found))
        first = _first(_order(doc, check, at), phrase, key)
        again = ~first
        rows = list(_answers(doc[again], check[again], at[again], np.full(again.sum(), REPEATED, np.int8), _no_mask(again.sum(), rules), buckets))
        doc, check, at, key, phrase = (c[first] for c in (doc, check, at, key, phrase))
        for bucket, own in _by_bucket((key % np.uint64(buckets)).astype(np.int64)):
            rows.append((buckets + bucket, PARTIAL, _body(doc=doc[own], check=check[own], at=at[own], key=key[own], phrase=phrase[own])))
        for row in rows:
            yield _rows([row])


def _class_answers(bodies: list[bytes], rules: RepeatRules, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    doc, check, at, key, phrase = _numbers(_table(bodies), "doc", "check", "at", "key", "phrase")
    order = _order(doc, check, at)
    # One document can be in two batches as repeated rows: the same place counts once.
    first = _first(order, phrase, key)
    same_place = _same_as_first(first, doc, check, at, phrase, key)
    lone = np.flatnonzero(first)
    _, inverse, variants = np.unique(key[lone], return_inverse=True, return_counts=True)
    state = np.full(len(key), REPEATED, np.int8)
    state[lone] = np.where(variants[inverse] == 1, 0, np.where(variants[inverse] > rules.class_limit, DEALT, COMPARED))
    told = (state > 0) & ~same_place
    yield from _answers(doc[told], check[told], at[told], state[told], _no_mask(told.sum(), rules), buckets)


def _same_as_first(first: np.ndarray, doc, check, at, phrase, key) -> np.ndarray:
    """Members other than the first of their phrase that stand in the very place of it."""
    by = np.lexsort((~first, phrase, key))
    group = np.cumsum(first[by]) - 1
    lead = by[first[by]][group]
    out = np.zeros(len(first), bool)
    out[by] = (doc[by] == doc[lead]) & (check[by] == check[lead]) & (at[by] == at[lead]) & ~first[by]
    return out


def _per_bucket(parts: Iterator[pa.RecordBatch], buckets: int, solve: Callable[[list[bytes]], Iterator[tuple[int, int, bytes]]]) -> Iterator[pa.RecordBatch]:
    """Answers pass through; the bodies of one bucket are solved together."""
    current, bodies = None, []
    for bucket, kind, body in _buckets(parts):
        if kind == ANSWERS:
            yield _rows([(bucket, ANSWERS, body)])
            continue
        if bucket != current and bodies:
            for row in solve(bodies):
                yield _rows([row])
            bodies = []
        current = bucket
        bodies.append(body)
    if bodies:
        for row in solve(bodies):
            yield _rows([row])


def _texts(parts: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Documents by their bucket, compressed together."""
    for part in parts:
        rows = list(_documents(part))
        if not rows:
            continue
        doc, check = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.uint32)
        for bucket, own in _by_bucket(_home(doc, check, buckets)):
            yield _rows([(bucket, TEXTS, _body(doc=doc[own], check=check[own], text=pa.array([rows[i][2] for i in own], pa.large_binary())))])


def _met(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict, Iterator]]:
    """(bucket, answers by document, its texts) in turn. A document's answers: places, states, masks."""
    current, answers, known = None, [], {}

    def by_document() -> dict:
        if not answers:
            return {}
        table = _table(answers)
        doc, check, at, state = _numbers(table, "doc", "check", "at", "state")
        mask = table["mask"].combine_chunks()
        width = mask.type.byte_width
        mask = np.frombuffer(mask.buffers()[1], np.uint8)[mask.offset * width:(mask.offset + len(mask)) * width].reshape(-1, width)
        by = np.lexsort((check, doc))
        new = np.append(True, (doc[by][1:] != doc[by][:-1]) | (check[by][1:] != check[by][:-1]))
        edges = np.append(np.flatnonzero(new), len(by))
        return {(int(doc[by[a]]), int(check[by[a]])): (at[by[a:b]], state[by[a:b]], mask[by[a:b]]) for a, b in zip(edges[:-1], edges[1:])}

    for bucket, kind, body in _buckets(parts):
        if bucket != current:
            current, answers, known = bucket, [], None
        if kind == ANSWERS:
            answers.append(body)
            continue
        if known is None:
            known, answers = by_document(), []
        table = pa.ipc.open_stream(body).read_all()
        for doc, check, text in zip(table["doc"].to_pylist(), table["check"].to_pylist(), table["text"]):
            yield bucket, known.get((doc, check)), (doc, check, text.as_py())


def _dictionary(parts: Iterator[pa.RecordBatch], rules: RepeatRules, buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts and answers by document -> the phrases to compare, by trigger; by strings where a trigger has too many."""
    held, size, seen, current = [], 0, set(), None

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        doc, check, at, key, left, right, dealt = (np.concatenate([h[i] for h in held]) for i in range(7))
        body = np.concatenate([h[7] for h in held])
        rows = []
        if dealt.any():
            chosen = np.flatnonzero(dealt)
            pieces = []
            for d in range(rules.before + 1):
                own = chosen[(left[chosen] >= d) & (right[chosen] >= rules.length - d)]
                if len(own):
                    string = np.zeros((len(own), rules.phrase), np.uint8)
                    a = rules.before - d
                    string[:, a:a + rules.length] = body[own, a:a + rules.length]
                    pieces.append((doc[own], check[own], at[own], _row_hashes(string) ^ key[own] ^ np.uint64(d + 1), np.full(len(own), d), np.full(len(own), rules.length - d), string))
            doc2, check2, at2, key2, left2, right2, body2 = (np.concatenate(c) for c in zip(*pieces))
            order = _order(doc2, check2, at2)
            first = _first(order, key2)
            # Equal strings of this task: all but the first are known to repeat.
            again = ~first
            mask = _no_mask(again.sum(), rules)
            mask[np.arange(len(mask)), left2[again] // 8] = 1 << (left2[again] % 8)
            rows += list(_answers(doc2[again], check2[again], at2[again], np.full(len(mask), COMPARED, np.int8), mask, buckets))
            whole = ~dealt
            doc, check, at, key, left, right = (np.concatenate([a[whole], b[first]]) for a, b in (
                (doc, doc2), (check, check2), (at, at2), (key, key2), (left, left2), (right, right2)))
            body = np.concatenate([body[whole], body2[first]])
        for bucket, own in _by_bucket((key % np.uint64(buckets)).astype(np.int64)):
            rows.append((buckets + bucket, PARTIAL, _body(
                doc=doc[own], check=check[own], at=at[own], key=key[own], left=left[own].astype(np.uint8), right=right[own].astype(np.uint8), body=_fixed(body[own]))))
        held.clear()
        for row in rows:
            yield _rows([row])

    for bucket, known, (doc, check, raw) in _met(parts):
        if bucket != current:
            current, seen = bucket, set()
        if known is None or (doc, check) in seen:  # a repeated row
            continue
        seen.add((doc, check))
        at, state, _ = known
        at, state = at[state >= COMPARED].astype(np.int64), state[state >= COMPARED]
        if not len(at):
            continue
        places, keys = triggers(raw, rules)
        left, right = _reach(at, len(raw), rules)
        held.append((np.full(len(at), doc), np.full(len(at), check, np.uint32), at.astype(np.int32), keys[np.searchsorted(places, at)], left, right, state == DEALT, phrases(raw, at, rules)))
        size += len(at) * rules.phrase
        if size > rules.bucket_bytes:
            yield from flush()
            size = 0
    yield from flush()


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(r.tobytes(), digest_size=8).digest(), "little") for r in rows], np.uint64)


def _sorted_contexts(key: np.ndarray, bytes_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the contexts within their trigger, and the common prefix of each with the one before (-1: other trigger)."""
    width = -(-bytes_.shape[1] // 8) * 8
    full = np.zeros((len(bytes_), width), np.uint8)
    full[:, :bytes_.shape[1]] = bytes_
    words = full.view(">u8").astype(np.uint64)
    by = np.lexsort((*[words[:, i] for i in reversed(range(words.shape[1]))], key))
    differs = bytes_[by][1:] != bytes_[by][:-1]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), bytes_.shape[1])
    return by, np.append(-1, np.where(key[by][1:] == key[by][:-1], common, -1))


def repeated_strings(order: np.ndarray, key: np.ndarray, left: np.ndarray, right: np.ndarray, body: np.ndarray, rules: RepeatRules) -> np.ndarray:
    """(phrases x d): whether the string d bytes before the trigger starts earlier in another phrase of that trigger."""
    by_right, common_right = _sorted_contexts(key, body[:, rules.before:])
    by_left, common_left = _sorted_contexts(key, body[:, :rules.before][:, ::-1])
    out = np.zeros((len(key), rules.before + 1), bool)
    earliest = np.argsort(order, kind="stable")
    group_right, group_left = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    for d in range(rules.before + 1):
        there = earliest[(left[earliest] >= d) & (right[earliest] >= rules.length - d)]
        if len(there) < 2:
            continue
        group_right[by_right] = np.cumsum(common_right < rules.length - d)
        group_left[by_left] = np.cumsum(common_left < d)
        _, first = np.unique(group_right[there] * (len(key) + 1) + group_left[there], return_index=True)
        again = np.ones(len(there), bool)
        again[first] = False
        out[there[again], d] = True
    return out


def _compare(bodies: list[bytes], rules: RepeatRules, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    table = _table(bodies)
    doc, check, at, key, left, right = _numbers(table, "doc", "check", "at", "key", "left", "right")
    body = np.concatenate([np.frombuffer(c.buffers()[1], np.uint8)[c.offset * rules.phrase:(c.offset + len(c)) * rules.phrase].reshape(-1, rules.phrase)
                           for c in table["body"].chunks])
    found = repeated_strings(_order(doc, check, at), key, left.astype(np.int64), right.astype(np.int64), body, rules)
    told = found.any(axis=1)
    mask = np.packbits(found[told], axis=1, bitorder="little")
    yield from _answers(doc[told], check[told], at[told], np.full(told.sum(), COMPARED, np.int8), mask, buckets)


def removed_spans(size: int, known, rules: RepeatRules) -> np.ndarray:
    """Maximal removed runs [start, end) of a text from what is known of its phrases."""
    edges = np.zeros(size + 1, np.int32)
    if known is not None:
        at, state, mask = known
        whole = at[state == REPEATED].astype(np.int64)
        left, right = _reach(whole, size, rules)
        fits = left + right >= rules.length
        np.add.at(edges, (whole - left)[fits], 1)
        np.add.at(edges, (whole + right)[fits], -1)
        some = state != REPEATED
        rows, d = np.nonzero(np.unpackbits(mask[some], axis=1, bitorder="little"))
        start = at[some].astype(np.int64)[rows] - d
        np.add.at(edges, start, 1)
        np.add.at(edges, start + rules.length, -1)
    covered = np.diff(np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(covered == 1), np.flatnonzero(covered == -1)], axis=1)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(parts: Iterator[pa.RecordBatch], rules: RepeatRules, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Texts and answers by document -> results."""
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.string()] + ([pa.binary(), pa.list_(pa.int64())] if with_text else [])
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept", "spans"] if with_text else [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for _, known, (doc, _, raw) in _met(parts):
        spans = removed_spans(len(raw), known, rules)
        kept = raw
        if len(spans):
            edges = [0, *spans.reshape(-1).tolist(), len(raw)]
            kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
        own = (None if doc == LAST else doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
        rows.append((*own, kept, spans.reshape(-1).tolist()) if with_text else own)
        if len(rows) == 512:
            yield batch()
            rows = []
    if rows:
        yield batch()


def remove_repeats(docs: DataFrame, rules: RepeatRules = RepeatRules(), id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; on request the bytes kept and the removed
    spans (start and end in turn)."""
    ship_package(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_width(docs.sparkSession), -(-total // rules.bucket_bytes))
    parsed = narrow.mapInArrow(partial(_parse, rules=rules, buckets=buckets), ROWS)
    solve = partial(_class_answers, rules=rules, buckets=buckets)
    known = stored(_dealt(parsed, partial(_per_bucket, buckets=buckets, solve=solve)), "repeats-parse")
    texts = narrow.mapInArrow(partial(_texts, buckets=buckets), ROWS)
    compared = _dealt(known.unionByName(texts), partial(_dictionary, rules=rules, buckets=buckets))
    solve = partial(_compare, rules=rules, buckets=buckets)
    more = stored(_dealt(compared, partial(_per_bucket, buckets=buckets, solve=solve)), "repeats-dictionary")
    meeting = known.unionByName(more).unionByName(texts)
    return _dealt(meeting, partial(_apply, rules=rules, with_text=with_text), RESULT + (", kept binary, spans array<long>" if with_text else ""))
