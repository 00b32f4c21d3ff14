"""Spelling variants, harmonic packing and tokenizer alignment against plain versions."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm import alignment, harmonic, queries, spelling

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def pairs_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


# ---- spelling variants -----------------------------------------------------------------------------------------------

def plain_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def plain_variants(rows):
    n = plain_words(rows)
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    near = defaultdict(list)
    for size, words in by_length.items():
        for w in words:
            for other in words + by_length.get(size + 1, []):
                if plain_near(w, other):
                    near[w].append(other)
                    if len(other) > size:
                        near[other].append(w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o))
        if n[best] >= 10 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def variants(df, **rules):
    rows = [tuple(r) for r in spelling.spelling_variants(df, spelling.SpellingRules(**rules)).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture(scope="session")
def misspelled(spark):
    rng = random.Random(11)
    roots = ["".join(rng.choice("abcdeilmnorstu") for _ in range(rng.randint(7, 11))) for _ in range(12)] + ["überraschung", "ÉCLAIRAGE", "aaaaaaa"]
    rows = []
    for doc in range(160):
        words = []
        for _ in range(60):
            w = list(rng.choice(roots))
            while rng.random() < 0.25:
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at:at + (kind != 0)] = [] if kind == 1 else [rng.choice("aeé")]
            words.append("".join(w))
        rows.append((doc, rng.choice([" ", "-", "\n"]).join(words)))
    long = "abcdefg" * 500
    rows += [(2003, "wonderful " * 400 + "wonderfu " * 30 + "wonderf " * 3)]
    rows += [(1000, f"{long} {long} {long[:-1]} {long[:-1]} x{long}"), (1001, f"{long} " * 20), (None, None), (7, ""), (7, rows[7][1]), (None, rows[3][1])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_spelling(misspelled, nasty):
    want = plain_variants(pairs_of(misspelled))
    assert variants(misspelled) == want and variants(misspelled, tile=7) == want
    assert any(form for _, form, *_ in want) and any(root not in (w, form) for w, form, root, *_ in want)
    assert variants(nasty) == plain_variants(pairs_of(nasty))


def test_spelling_empty(empty):
    assert spelling.spelling_variants(empty).count() == 0


@needs_tables
def test_spelling_query(spark):
    got = {tuple(r) for r in queries.op11_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(pairs_of(spark.read.parquet(f"{SF}/documents.parquet")))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abé÷", min_size=4, max_size=4), min_size=1, max_size=30, unique=True), st.lists(st.text("abé÷", min_size=5, max_size=5), min_size=1, max_size=30, unique=True))
def test_near_in(four, five):
    short, long = spelling.Words(four), spelling.Words(five)
    assert set(spelling.near_in(short, long)) == {(b, a) for a in five for b in four if plain_near(a, b)}
    assert sorted(spelling.near_in(short, short)) == sorted((a, b) for i, a in enumerate(four) for b in four[i + 1:] if plain_near(a, b))


# ---- harmonic packing ------------------------------------------------------------------------------------------------

WORD_LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def word_ids(text):
    return WORD_LIBRARY.encode(text, add_special_tokens=False).ids


def check_harmonic(df, rows):
    made = df.toPandas()
    want, whole = Counter(), Counter()
    ids_by_doc = defaultdict(list)
    for doc, text in rows:
        ids = np.array(word_ids(text or "") + [1], "<u4")
        whole[doc, len(ids)] += 1
        ids_by_doc[doc, len(ids)].append(ids)
    got = Counter()
    keyed = made.assign(doc_id=made.doc_id.map(lambda d: None if d != d else int(d)))
    for r in keyed.itertuples():
        doc = None if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id)
        assert any(zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for ids in ids_by_doc[doc, r.doc_tokens])
        got[doc, r.doc_tokens, r.start, r.length] += 1
    for (doc, n), times in whole.items():
        at = 0
        for length in harmonic.cuts(n, harmonic.HarmonicRules()):
            want[doc, n, at, length] += times
            at += length
        assert at == n
    assert got == want
    for _, own in made.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset.values == np.append(0, np.cumsum(own.length.values)[:-1])).all() and own.length.sum() <= 2048
    return made


def test_harmonic(spark, nasty, empty):
    rows = pairs_of(nasty)
    check_harmonic(harmonic.pack_harmonic(nasty), rows)
    check_harmonic(harmonic.pack_harmonic(nasty.repartition(40), harmonic.HarmonicRules(fan_in=3)), rows)
    assert harmonic.pack_harmonic(empty).count() == 0


@needs_tables
def test_harmonic_query(spark):
    made = check_harmonic(queries.op12_harmonic_pack(spark, SF), pairs_of(spark.read.parquet(f"{SF}/documents.parquet")))
    sums = made.groupby("sequence_id").length.sum()
    padded = sums[[n & (n - 1) != 0 for n in sums]]
    assert (2048 - padded).sum() <= 0.01 * sums.sum() + 2048


def test_lengths():
    rules = harmonic.HarmonicRules()
    for n in [*range(1, 2100), 10_000, 10_240]:
        lengths = harmonic.cuts(n, rules)
        assert sum(lengths) == n and all((2048 // s) * s >= 2048 * (1 - rules.slack) for s in lengths)
        assert len(lengths) <= n // 2048 + 4


def test_stretches():
    rng = random.Random(5)
    odd = ["don't", "We'Ll", "''s", "<|endoftext|>x", "a1b22", "--'ve", "\x1c", "\x7f", "\x01", "x\x01y", "é", "́x", "Σίσυφος", "<|endoftext|>", "日本語", " ", "12", "--", "İ", "\x0b", "\x0c", "\u2003", "\u3000", "ΑΣ", "Σ", "a" * 90, "ﬁ", "한국", "ก็", "🙂"]
    for _ in range(40):
        text = "".join(rng.choice(odd) + rng.choice([" ", "  ", "\n", "\t", "", " ́"]) for _ in range(60))
        again = [text, "", "ab cd", text.upper(), text]
        for few in (3, 10_000):
            got = list(harmonic.WordIds(remembered=few).raws([t.encode() for t in again]))
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [word_ids(t) for t in again]
        for size in (7, 40):
            parts = list(harmonic.stretches(text.encode(), size))
            assert b"".join(parts) == text.encode() and [i for p in parts for i in word_ids(p.decode())] == word_ids(text)


# ---- alignment -------------------------------------------------------------------------------------------------------

def plain_alignment(rows):
    a_lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = alignment._byte_letters()
    entries = {i: t for t, i in a_lib.get_vocab().items()}
    piece = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc, text in rows:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_bytes, b_bytes = [bytes(letters[c] for c in entries[i]) for i in a], [piece(i) for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            docs.append((doc, [], [], []))
            continue
        a_ends, b_ends = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        common, groups = sorted(set(a_ends) & set(b_ends)), []
        place = {end: i for i, end in enumerate(common)}
        groups = [([], []) for _ in common]
        for side, ids, ends in ((0, a, a_ends), (1, b, b_ends)):
            at = 0
            for i, end in zip(ids, ends):
                groups[at][side].append(i)
                at += end in place
        docs.append((doc, a, b, groups))
        counts.update({(x, y) for g, h in groups for x in g for y in h})
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = Counter()
    for doc, a, b, groups in docs:
        links = Counter()
        for g, h in groups:
            for x in g:
                for y in h:
                    links[x, y] += 1
        line = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out[doc, len(a), len(b), len(groups), sum(links.values()), sum(t for (x, y), t in links.items() if counts[x, y] == most[x]),
            sum(t * counts[p] for p, t in links.items()), hashlib.sha256(line.encode()).hexdigest() if groups else ""] += 1
    return out


def aligned(df, **rules):
    return Counter(tuple(r) for r in alignment.align_tokenizers(df, alignment.AlignRules(**rules)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


@pytest.fixture(scope="session")
def odd_texts(spark):
    texts = ["<|endoftext|> and <s> </s> <unk> <0x41>", "▁ is no blank", "a\u0000b", " \t leading", "日本語のテキスト", "naïve Überraschung 🙂🙂🏽", " wide",
             "line\r\nline\n\n\n  x   y", "a" * 3000, "ab" * 2000, "ﬁ ligature ① ﾊﾝｶｸ", "q", "0123456789" * 30, "﻿bom", "éé"]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_alignment(nasty, odd_texts):
    for df in (nasty, odd_texts):
        want = plain_alignment(pairs_of(df))
        assert aligned(df) == want
        assert aligned(df, frequent_pairs=40) == want  # most pairs are shuffled
        assert aligned(df, frequent_pairs=0, ranks_a=None) == want


def test_alignment_empty(empty):
    assert alignment.align_tokenizers(empty).count() == 0


@needs_tables
def test_alignment_query(spark):
    got = Counter(tuple(r) for r in queries.op13_align_tokenizers(spark, SF).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == plain_alignment(pairs_of(spark.read.parquet(f"{SF}/documents.parquet")))


LENGTHS = st.lists(st.integers(1, 9), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(LENGTHS, LENGTHS), min_size=1, max_size=4))
def test_cuts_and_links(docs):
    left, right, a_docs, b_docs = [], [], [], []
    for one, other in docs:  # both sides of a document end together
        short = sum(one) - sum(other)
        left += one + [max(0, -short) + 1]
        right += other + [max(0, short) + 1]
        a_docs.append(len(left)), b_docs.append(len(right))
    a, b = np.cumsum(left), np.cumsum(right)
    a_cuts, b_cuts = alignment.shared_cuts(a, b, np.array(a_docs), np.array(b_docs))
    common = sorted(set(a.tolist()) & set(b.tolist()))
    assert a[a_cuts - 1].tolist() == b[b_cuts - 1].tolist() == common
    ids_a, ids_b = np.array(left) << 24, np.array(right)
    want, i, j = Counter(), 0, 0
    for i1, j1 in zip(a_cuts, b_cuts):
        want.update(int(x | y) for x in ids_a[i:i1] for y in ids_b[j:j1])
        i, j = i1, j1
    for at_once in (1, 5, 1 << 20):
        pairs, times = alignment.linked_pairs(ids_a, ids_b, a_cuts, b_cuts, at_once)
        assert dict(zip(pairs.tolist(), times.tolist())) == want


def test_long_gaps():
    rng = np.random.default_rng(2)
    a = np.cumsum(rng.integers(1, 3, 20_000)) * 2
    b = np.unique(np.concatenate([a[rng.integers(0, 20_000, 20)], a[:50], a[9_000:] + 1, a[-1:]]))
    b = b[b <= a[-1]]
    a_cuts, b_cuts = alignment.shared_cuts(a, b, np.array([len(a)]), np.array([len(b)]))
    assert a[a_cuts - 1].tolist() == b[b_cuts - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
