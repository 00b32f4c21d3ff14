"""Exact, byte-string, line and near duplicates against plain versions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash

import corpus_pipeline
from gridloom.llm import components, exact_dedup, line_dedup, simhash, suffix_dedup
from gridloom.llm.suffix_dedup import RepeatRules, remove_repeats


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


# ---- exact -----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("options", [{}, {"broadcast_words": 0}, {"bits_per_key": 1}])
def test_exact_duplicates(nasty, options):
    own = rows_of(nasty, "doc_id", "text")
    groups = defaultdict(list)
    for doc, text in own:
        groups[text or ""].append(doc)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()] += 1
    got = rows_of(exact_dedup.exact_duplicates(nasty, **options), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter((d, k, g, s) for d, k, g, _, s in got) == want
    # Just one row of each group stays, one with the id to keep.
    kept = [(d, k, s) for d, k, _, stays, s in got if stays]
    assert len(kept) == len(groups) == len({s for *_, s in kept}) and all(d == k for d, k, _ in kept)


def test_exact_empty(empty):
    assert exact_dedup.exact_duplicates(empty).count() == 0


# ---- byte strings ----------------------------------------------------------------------------------------------------

def plain_repeats(rows, length):
    seen, out = set(), {}
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, __import__("zlib").crc32((r[1] or "").encode()))):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, int)
        for i in range(len(raw) - length + 1):
            s = raw[i:i + length]
            if s in seen:
                gone[i] += 1
                gone[i + length] -= 1
            seen.add(s)
        gone = np.cumsum(gone[:-1]) > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[doc, text] = (len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("rules", [RepeatRules(), RepeatRules(class_limit=1), RepeatRules(length=40, gram=16), RepeatRules(bucket_bytes=20_000)])
def test_repeated_strings(nasty, rules):
    own = rows_of(nasty, "doc_id", "text")
    want = plain_repeats(own, rules.length)
    got = rows_of(remove_repeats(nasty, rules), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(got) == Counter((d, *want[d, t]) for d, t in own)


def test_repeats_text_and_spans(nasty):
    for row in remove_repeats(nasty, with_text=True).collect():
        assert hashlib.sha256(row.kept).hexdigest() == row.kept_sha256 and len(row.spans) == 2 * row.n_spans
        assert len(row.kept) + sum(b - a for a, b in zip(row.spans[::2], row.spans[1::2])) == row.n_bytes


def test_repeats_empty(empty):
    assert remove_repeats(empty).count() == 0


def test_suffix_arrays_hold_sorted_contexts():
    rng = np.random.default_rng(1)
    body, key = rng.integers(0, 3, (200, 20)).astype(np.uint8), rng.integers(0, 4, 200).astype(np.uint64)
    by, common = suffix_dedup._sorted_contexts(key, body)
    listed = [(int(key[i]), body[i].tobytes()) for i in by]
    assert listed == sorted(listed)
    for i in range(1, len(by)):
        (k, a), (m, b) = listed[i - 1], listed[i]
        assert common[i] == (-1 if k != m else next((n for n in range(20) if a[n] != b[n]), 20))


# ---- lines -----------------------------------------------------------------------------------------------------------

UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}"


def plain_line(line):
    """Leaf and parts of a line; short lines have none."""
    if len(line.encode()) > 2 * len(line):
        tokens = regex.findall(rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+", re.sub("[0-9]+", "<*>", line))
    else:
        tokens = ["<*>" if re.search("[0-9]", t) else t for t in re.findall(r"[^\x20\x09-\x0D]+", line)]
    if len(tokens) < 4:
        return (line, []) if tokens else None
    n = len(tokens) - 3
    m = min(n, 8)
    return (n, *tokens[:3]), [tuple(tokens[3 + g * n // m:3 + (g + 1) * n // m]) for g in range(m)]


def plain_lines(rows):
    """Texts without the lines that share three quarters of their parts with one line of an earlier document."""
    seen = defaultdict(list)
    for doc, text in rows:
        for line in set((text or "").split("\n")):
            if doc is not None and (p := plain_line(line)):
                seen[p[0]].append((doc, p[1]))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        keep = []
        for line in lines:
            p = plain_line(line)
            if p and doc is not None and any(
                    other < doc and sum(x == y for x, y in zip(p[1], parts)) >= 0.75 * len(parts) for other, parts in seen[p[0]]):
                continue
            keep.append(line)
        out.append((doc, len(lines), len(lines) - len(keep), text if len(keep) == len(lines) else "\n".join(keep)))
    return out


def test_recurring_lines(nasty):
    want = plain_lines(rows_of(nasty, "doc_id", "text"))
    assert sum(n for _, _, n, _ in want) > 11
    got = rows_of(line_dedup.drop_recurring_lines(nasty, report=True), "doc_id", "n_lines", "n_dropped", "text")
    assert Counter(got) == Counter(want)


def test_recurring_lines_keep_columns(nasty, empty):
    out = line_dedup.drop_recurring_lines(nasty)
    assert out.columns == nasty.columns and out.count() == nasty.count()
    assert line_dedup.drop_recurring_lines(empty).count() == 0


def test_recurring_lines_by_one_template(spark):
    rng = np.random.default_rng(9)
    long = [f"the report of {a} {b} was sent by {c} to {d} on day {e} for the usual reason" for a, b, c, d, e in rng.choice(list("pqrs"), (60, 5))]
    texts = ["it is a red house by the sea", "it is a big car by our road", "it is a new lamp near the road", "it is a big house near our sea",
             "Read more\nit is a red house by the lake", "All rights reserved\nRead more", "2024 12\nAll rights reserved\n本站内容版权所有不得转载",
             "2024 13\n本站内容版权所有不得转载", "本站内容版权归有不得转载\nRead  more", "a b c d\na b c e", "a b c d", "\n\n", *long]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = rows_of(line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), report=True), "doc_id", "n_lines", "n_dropped", "text")
    assert Counter(got) == Counter(plain_lines(rows))
    left = {d: t for d, _, _, t in got}
    assert left[3] == texts[3] and left[4] == "Read more" and left[5] == "All rights reserved" and left[7] == "2024 13" and left[8] == "Read  more"
    assert 10 < sum(left[i] == "" for i in range(12, 72)) < 60


# ---- near duplicates -------------------------------------------------------------------------------------------------

def plain_fingerprint(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not found:
        return 0
    shingles = [b" ".join(found[i:i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, most=3):
    """Least member index of each member's group."""
    lead = list(range(len(prints)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                a, b = sorted((root(i), root(j)))
                lead[b] = a
    return [root(i) for i in range(len(prints))]


def test_simhash_components(nasty):
    own = rows_of(nasty, "doc_id", "text")
    prints = [plain_fingerprint(t) for _, t in own]
    groups, least = plain_groups(prints), {}
    for (doc, _), g in zip(own, groups):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    want = Counter((doc, f"{p:016x}", least.get(g)) for (doc, _), p, g in zip(own, prints, groups))
    assert Counter(rows_of(simhash.near_duplicate_components(nasty), "doc_id", "fingerprint", "component_id")) == want


@pytest.mark.parametrize("limit", [2048, 8, 1])
def test_simhash_dense_group(spark, limit):
    rng = np.random.default_rng(2)
    centre, prints = int(rng.integers(0, 1 << 62)), []
    for _ in range(500):  # a large group of near copies, with chains beyond 3 bits
        value = centre
        for bit in rng.choice(64, rng.integers(0, 7), replace=False):
            value ^= 1 << int(bit)
        prints.append(value)
    prints += [int(x) for x in rng.integers(0, 1 << 63, 200, dtype=np.uint64)] + [0, 7]
    signed = np.array(prints, dtype=np.uint64).view(np.int64)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(signed)], "doc_id long, _fp long")
    got = {r.fp: r.component_id for r in simhash.near_duplicates(df, limit).collect()}
    assert [got[int(v)] for v in signed] == plain_groups(prints)


def test_simhash_keeps_one(nasty, empty):
    out = simhash.keep_one(nasty)
    assert out.columns == nasty.columns
    own = rows_of(nasty, "doc_id", "text")
    groups = plain_groups([plain_fingerprint(t) for _, t in own])
    best = {}
    for (doc, _), g in zip(own, groups):
        best[g] = min(best.get(g, (True, 0)), (doc is None, doc or 0))
    assert Counter(rows_of(out, "doc_id")) == Counter((None if none else d,) for none, d in best.values())
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicate_components(empty).count() == 0


def test_stage_keeps_one_of_each_group(nasty):
    got = dict(corpus_pipeline.STAGES)["near_dedup"](nasty.sparkSession, nasty, "")
    assert Counter(rows_of(got, "doc_id")) == Counter(rows_of(simhash.keep_one(nasty), "doc_id")) and got.columns == nasty.columns


def test_triples_reach_every_pair():
    from itertools import combinations
    assert all(any(set(t) <= set(five) for t in simhash.TRIPLES) for five in combinations(range(8), 5))


def test_components(spark):
    rng = np.random.default_rng(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, int(x)) for x in rng.integers(8, 60, 40)] + [(5, 5), (200, 90), (201, 90)]
    lead = {}

    def root(x):
        while lead.setdefault(x, x) != x:
            x = lead[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((root(a), root(b)))
            lead[hi] = lo
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in lead}
