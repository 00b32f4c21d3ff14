"""Quality, language, extraction, tokens, packing and mixing against plain versions."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import html_extract, language, mixing, packing, quality, token_output, tokens
from tests.llm.conftest import nasty_rows, words
from tests.llm.test_dedup import rows_of

SPACE = r"[^\x20\x09-\x0D]+"


# ---- quality ---------------------------------------------------------------------------------------------------------

def plain_counts(text):
    text = text or ""
    found = re.findall(SPACE, text)
    windows = Counter(tuple(found[i:i + 8]) for i in range(len(found) - 7))
    covered = {j for i in range(len(found) - 7) if windows[tuple(found[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    n = len(found)
    failed = n < 20 or 100 * len(covered) > 30 * n
    return n, sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(nasty, empty):
    got = rows_of(quality.quality(nasty), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(got) == Counter((d, *plain_counts(t)) for d, t in rows_of(nasty, "doc_id", "text"))
    assert quality.quality(empty).count() == 0 and quality.keep_good(empty).columns == empty.columns


def test_quality_verdicts(spark):
    """The whole verdict against numpy medians, on a table with two languages, junk and a large group of near copies."""
    rng = random.Random(8)
    texts = [words(rng, rng.randint(30, 400), "aeiounrst") for _ in range(150)]
    texts += [" ".join(w + "###" for w in words(rng, 200).split()) for _ in range(4)] + [words(rng, 200).upper() for _ in range(4)]
    near = words(rng, 200, "aeiounrst")
    texts += [near + f" {words(rng, 1)}" for _ in range(120)]
    rows = [(i, t, ["en", None][i % 2]) for i, t in enumerate(texts)]
    rules = quality.QualityRules()
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rules).collect()}
    group, values = {}, {}
    for i, t, lang in rows:
        m = quality.measure_text(t.encode(), rules)
        group[i] = (lang or f"script:{m['script']}", int(np.floor(np.log2(m["n_tokens"]) * 2)))
        values[i] = (m["n_tokens"], *[int(np.floor(m[k] * 1000 + 0.5)) for k in ("chars_per_token", "entropy", "byte_share")], m)
    good = {(group[i], values[i][:4]) for i, *_ in rows if not got[i].base_failed}
    median = lambda xs: sorted(xs)[(len(xs) - 1) // 2]
    wrong = []
    for i, *_ in rows:
        n, m = values[i][0], values[i][4]
        lang, bin_ = group[i]
        pick = lambda k, whole: [v[k] for g, v in good if g[0] == lang and (whole or g[1] == bin_)]
        c, h, b = median(pick(1, True)), median(pick(2, False)), median(pick(3, True))
        dev = lambda k, mid, whole: median([abs(x - mid) for x in pick(k, whole)]) * 1.4826 / 1000
        out = (abs(m["chars_per_token"] - c / 1000) > 5 * max(dev(1, c, False), 0.8 / n**0.5)
               or h / 1000 - m["entropy"] > 5 * max(dev(2, h, False), 2 / n**0.5) or m["byte_share"] - b / 1000 > 5 * max(dev(3, b, True), 0.02))
        if got[i].kept != (not got[i].base_failed and not out):
            wrong.append(i)
    assert wrong == []
    assert not any(got[i].kept for i in range(150, 154)) and sum(got[i].kept for i in range(150)) > 145


def test_quality_of_thin_lengths_and_languages(spark):
    """Bad texts alone in their half octave, or in a rare language, do not set their own band; good ones there stay."""
    rng = random.Random(15)
    texts = [(words(rng, rng.randint(100, 140), "aeiounrst"), "en") for _ in range(80)]
    texts += [(words(rng, n, "aeiounrst"), "en") for n in (1500, 4000)] + [(words(rng, 120, "aeiounrst"), "xx")]
    first_bad = len(texts)
    junk = lambda n: " ".join(w + "#####" for w in words(rng, n).split())
    texts += [(junk(900), "en"), (junk(3000), "en"), (junk(9000), "en"), (junk(120), "yy"), (words(rng, 500).upper(), "zz")]
    rows = [(i, *r) for i, r in enumerate(texts)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert sum(got[i].kept for i in range(80)) > 76 and all(got[i].kept for i in range(80, first_bad))
    assert not any(got[i].kept for i in range(first_bad, len(rows)))


def test_repeated_words_of_random_texts():
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        assert quality.repeated_words(text.encode().split(), 8) == plain_counts(text)[4]


# ---- language --------------------------------------------------------------------------------------------------------

def test_language_nasty(nasty, empty):
    got = rows_of(language.identify(nasty), "doc_id", "held_out", "lang_pred", "score")
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 4 == 2
    assert Counter((d, h) for d, h, *_ in got) == Counter((d, held(d)) for d, _ in rows_of(nasty, "doc_id", "text"))
    blank = sum(1 for _, t in rows_of(nasty, "doc_id", "text") if not re.search(r"[^\W\d_]", t or ""))
    assert sum(1 for *_, p, s in got if p == "und" and s == 0) == blank and all(0 <= s <= 1 for *_, s in got)
    assert language.identify(empty).count() == 0


def test_language_learns_and_ignores_held_out(spark):
    rng = random.Random(6)
    alphabets = {"aa": "abcdef", "bb": "efghij", "cc": "жщюяэ"}
    rows = [(i, words(rng, 30, alphabets[lang]), lang) for i in range(600) for lang in [sorted(alphabets)[i % 3]]]
    rows = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]  # held-out labels are wrong
    got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == set(alphabets)
    assert all(r.lang_pred == sorted(alphabets)[r.doc_id % 3] for r in got)


def test_kernel_is_the_share_of_common_grams():
    a, b = language.grams("Abc abd", "abcd"), language.grams("abd!", "abcd")
    value = language._counts([a], b, np.full((len(b), 1), 1 / np.sqrt(len(b)), np.float32))[0, 0]
    assert abs(value - len(set(a) & set(b)) / np.sqrt(len(a) * len(b))) < 1e-6
    assert len(language.grams("12 3!", "abcd")) == 0


def test_language_tells_scripts_with_many_letters_apart(spark):
    rng = random.Random(14)
    latin = [words(rng, 30, "abcdefghijklmnopqrstuvwxyzàâäçèéêëîïôöûüßñ") for _ in range(600)]
    han = lambda first: "".join(chr(rng.randint(first, first + 300)) + rng.choice(["", "", "，"]) for _ in range(80))
    cyrillic = [words(rng, 30, "абвгдежзийклмнопрстуфхцчшщъыьэюя") for _ in range(600)]
    texts = [(t, "aa") for t in latin] + [(t, "ru") for t in cyrillic] + [(han(0x4E00), "x1") for _ in range(120)] + [(han(0x6000), "x2") for _ in range(120)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(texts)]
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i] == lang for i, _, lang in rows)
    assert not set(language.grams("漢字")) & set(language.grams("かな")) - {language.BOUNDARY}


# ---- extraction ------------------------------------------------------------------------------------------------------

def test_best_run_is_maximal():
    rng = random.Random(7)
    for _ in range(300):
        xs = [rng.choice([-3, -2, -1, 0, 1, 2, 4]) * 1.0 for _ in range(rng.randint(0, 12))]
        a, b = html_extract.best_run(xs)
        best = max([0.0, *(sum(xs[i:j]) for i, j in combinations(range(len(xs) + 1), 2))])
        assert sum(xs[a:b]) == best


PAGE = ('<!DOCTYPE html><html><head><title>T {n}</title><style>p>a{{}}</style><script>var t="<p>no</p>";</script></head><body><header><h1>Site</h1></header>'
        '<nav><ul><li><a href="/">Home page</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site</p></div>{open}<h2>Title &amp; more {n}</h2>'
        '<p>One\n  two&nbsp;three <a href="x>y">link</a> and <b>bold.<br><p>Next &lt;p&gt; part<script>x()</script> of it.</p><div class="ad">Buy this now</div>'
        '<p>Last one.</p>{close}<aside><p>Related story about things</p></aside><div id="comments"><p>Great post, thank you all</p></div>'
        '<form><p>Subscribe to us</p></form><footer><p>Copyright by us &copy;</p></footer>')
TEXT = "Title & more {n}\nOne two three link and bold.\nNext <p> part of it.\nLast one."


def test_pages(spark):
    rows = [(i, f"u{i}", PAGE.format(n=i, open="<article>", close="</article>"), "clash") for i in range(20)]
    rows += [(100 + i, None, PAGE.format(n=i, open="<div>", close="</div>"), None) for i in range(3)]  # without naming tags
    rows += [(200, "u", None, "t"), (201, "u", "", "t"), (None, "u", "<p>Only a text & no more", "t"), (203, "u", "<!-- x", "t"), (204, "u", "<a href='", "t"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    for i in range(20):
        assert got[i].text == TEXT.format(n=i) and got[i].n_chars == len(got[i].text) and got[i].url == f"u{i}"
    assert [got[100 + i].text for i in range(3)] == [TEXT.format(n=i) for i in range(3)]
    assert [got[i].text for i in (200, 201, 203, 204)] == [""] * 4 and got[None].text == "Only a text & no more"
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    unlabelled = html_extract.extract_pages(pages.where("page_id >= 100 and page_id < 200")).collect()  # the prior alone
    assert {r.text for r in unlabelled} == {TEXT.format(n=i) for i in range(3)}


@pytest.mark.parametrize("before, after", [("<div class='has-sidebar'>", "</div>"), ("<div class='wrap with-comments'>", "</div>"),
                                           ("<div class='page-header'>", "</div>"), ("<form id='aspnet'>", "</form>"), ("<header>", "</header>")])
def test_pages_keep_an_article_inside_wrappers(spark, before, after):
    article = "<article><h2>Title</h2><p>One two three four five six.</p><div class='ad'>Buy this</div><p>Last words of it.</p></article>"
    rows = [(i, "u", f"<html><head><title>T</title></head><body><nav><a href='/'>Home</a></nav>{before}{article}{after}<div id='comments'><article class='c'>"
             "<p>Great post</p></article></div><aside><article><p>Other story</p></article></aside></body></html>") for i in range(10)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"Title\nOne two three four five six.\nLast words of it."}


WIDE = ['<form id="f1">{}</form>', '<div class="social-layout">{}</div>', '<div class="legal">{}</div>', '<main><div class="alert-story">{}</div></main>',
        '<header>{}</header>', '<div class="search-page"><div class="widget-free notices">{}</div></div>', "<article>{}</article>"]


@pytest.mark.parametrize("wrapper", WIDE)
def test_pages_inside_one_wrapper(spark, wrapper):
    inner = ('<nav><a href="/">Home</a> <a href="/a">About us</a></nav><div class="article-header"><h1>Title</h1></div><p>One two three four five six.</p>'
             '<p>Last words of it, and some more of them.</p><div class="share">Share this</div><aside>Related things to read</aside>')
    page = f"<html><head><title>t</title></head><body>{wrapper.format(inner)}<footer>All rights reserved</footer></body></html>"
    row = html_extract.extract_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert row.text == "Title\nOne two three four five six.\nLast words of it, and some more of them."


@pytest.mark.parametrize("start", ["<body>", "<div>", ""])
def test_pages_without_the_end_of_the_head(spark, start):
    page = f"<html><head><title>T</title><meta charset=x><noscript><img src=x></noscript><script>a()</script>{start}<p>One two three four five six.</p>"
    row = html_extract.extract_pages(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert row.text == "One two three four five six."


# ---- tokens and packing ----------------------------------------------------------------------------------------------

def test_ranks_give_the_ids_of_the_vocabulary():
    rng = random.Random(9)
    texts = [r[1] or "" for r in nasty_rows()] + ["<|endoftext|> it's 12 345\r\n\t x", "日本 текст 🙂🙂", "a" * 30000, " " * 5000, "\n" * 50 + " x", "'ll 're I'M"]
    texts += ["".join(chr(rng.choice([32, 10, 97, 39, 48, 233, 0x4E00, 0x1F600, 0xA0, 0x2028, 0x85])) for _ in range(60)) for _ in range(200)]
    for t in texts:
        assert np.array_equal(tokens.token_ids(t), tokens.library_ids(t)), t[:50]


def test_added_tokens_have_their_own_ids():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokens.vocabulary_path(tokens.BYTE_BPE))
    for t in ("<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>\n y ", "  <|endoftext|>  ", "<|endoftext|", "<|<|endoftext|>|>"):
        assert tokens.token_ids(t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert tokens.token_ids("a<|endoftext|>b").tolist().count(50256) == 1


def plain_ids(text, end):
    return np.append(tokens.library_ids(text or ""), np.uint32(end))


def test_pack(nasty, empty):
    own = Counter(rows_of(nasty, "doc_id", "text"))
    got = packing.pack(nasty, packing.PackRules(capacity=128)).toPandas()
    want = Counter()
    for (doc, text), n in own.items():
        ids = plain_ids(text, 2).astype("<u4")
        cuts = [len(ids) % 128] * (len(ids) % 128 > 0) + [128] * (len(ids) // 128)
        starts = np.append(0, np.cumsum(cuts)[:-1])
        for piece, (at, size) in enumerate(zip(starts.tolist(), cuts)):
            want[-1 if doc is None else doc, piece, at, size, zlib.crc32(ids[at:at + size].tobytes())] += n
    found = got.fillna({"doc_id": -1})
    assert Counter(zip(found.doc_id.astype(int), found.piece, found.start, found.length, found.ids_crc32)) == want
    for _, group in got.groupby("sequence_id"):
        group = group.sort_values("offset")
        assert group.offset.tolist() == np.append(0, np.cumsum(group.length)[:-1]).tolist() and group.length.sum() <= 128
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 128) * 1.05 + 1
    assert packing.pack(empty).count() == 0


def fewest(counts, capacity):
    """Least number of sequences, by search."""
    items = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
    best = len(items)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - items[i]] + rooms[k + 1:])
        place(i + 1, rooms + [capacity - items[i]])

    place(0, [])
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(10)
    reduced = 0
    for _ in range(250):
        capacity = rng.randint(5, 30)
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 11)))
        fixed, rest = packing.reduce_lengths(counts, capacity)
        done = Counter()
        for pattern, n in fixed:
            assert sum(s * k for s, k in pattern) <= capacity
            for s, k in pattern:
                done[s] += k * n
        assert done + Counter(rest) == counts
        assert sum(n for _, n in fixed) + fewest(rest, capacity) == fewest(counts, capacity)
        reduced += sum(done.values()) > 0
        patterns = packing.plan(counts, capacity)
        assert sum((Counter({s: k * n for s, k in p}) for p, n in patterns), Counter()) == counts
    assert reduced > 150


def test_matrices(nasty, empty):
    rules = token_output.MatrixRules(length=64, rows=5, block_tokens=3000)
    found = token_output.packed_matrices(nasty, rules).collect()
    got = {}
    for row in found:
        ids, positions = token_output.matrix_ids(row, 64), token_output.position_ids(row, 64)
        assert ids.shape == positions.shape == (row.n_rows, 64) and row.n_rows <= 5
        assert np.flatnonzero(positions.reshape(-1) == 0).tolist() == list(row.position_resets) == list(row.cu_seqlens[:-1])
        assert row.cu_seqlens[-1] == ids.size and row.n_tokens == sum(len(i) for *_, i in token_output.unpack(row))
        for doc, piece, own in token_output.unpack(row):
            got.setdefault(doc, []).append((piece, own.tobytes()))
    want = {}
    for doc, text in rows_of(nasty, "doc_id", "text"):
        ids = plain_ids(text, 50256).astype("<u2")
        want.setdefault(doc, []).extend((i, ids[at:at + 64].tobytes()) for i, at in enumerate(range(0, len(ids), 64)))
    assert {d: Counter(x) for d, x in got.items()} == {d: Counter(x) for d, x in want.items()}
    assert all(r.n_rows == 0 for r in token_output.packed_matrices(empty, rules).collect())


def test_room_tree_finds_the_best_fit():
    rng = random.Random(11)
    tree, rooms = token_output.RoomTree(50), {}
    for n in range(2000):
        if rng.random() < 0.5:
            rooms[n] = rng.randint(0, 50)
            tree.put(rooms[n], n)
        else:
            size = rng.randint(1, 50)
            best = min((r for r in rooms.values() if r >= size), default=None)
            found = tree.best(size)
            assert (found and found[0]) == best
            if found:
                assert rooms.pop(found[1]) == found[0]


# ---- mixing ----------------------------------------------------------------------------------------------------------

def plain_targets(sizes, cap=3.0):
    """Sizes by source in order of place -> targets, by repeated sharing."""
    weights, total, fixed = {s: 1.0 + i % 3 for i, s in enumerate(sizes)}, sum(sizes.values()), {}
    while True:
        rest = total - sum(fixed.values())
        open_ = {s: w for s, w in weights.items() if s not in fixed}
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = {s: cap * sizes[s] for s in open_ if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return fixed | share
        fixed |= over


def test_mix(nasty, empty):
    own = rows_of(nasty, "doc_id", "text", "source")
    size = lambda t: len(re.findall(SPACE, t or ""))
    sizes = {s: sum(size(t) for _, t, x in own if x == s) for s in ["s1", "s10", "s2", None]}
    targets = plain_targets(sizes)
    got = mixing.mix(nasty).collect()
    assert Counter((r.doc_id, r["size"], r.source) for r in got) == Counter((d, size(t), s) for d, t, s in own)
    for source, target in targets.items():
        rows = [r for r in got if r.source == source]
        assert all(abs(r.target - target) < 1e-6 * max(1, target) and r.source_size == sizes[source] for r in rows)
        assert abs(sum(r.taken for r in rows) - target) <= max(r["size"] for r in rows) / 2 + 1
        assert all(0 <= r.taken <= 3 * r["size"] and (not r["size"] or r.taken % r["size"] == 0) for r in rows)
    again = mixing.mix(nasty.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).columns == empty.columns


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 10}, {"a": 0, "b": 0}, {"a": 5}, {str(i): 1 + i * i for i in range(9)}, {"a": 0, "b": 7, "c": 1}])
def test_water_fill(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(df, mixing.cycled_weights(1, 2, 3)).collect()}
    want = plain_targets(dict(sorted(sizes.items())))
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mixed_documents(nasty):
    taken = Counter({(r.doc_id, r.text_key): r.copies for r in mixing.mix(nasty).collect()})
    out = mixing.mixed_documents(nasty)
    assert out.columns == nasty.columns
    rows = nasty.withColumn("k", F.xxhash64(F.coalesce("text", F.lit("")))).groupBy("doc_id", "k").count().collect()
    want = {(r.doc_id, r.k): r["count"] for r in rows if r["count"] == 1}
    got = {(r.doc_id, r.k): r["count"] for r in out.withColumn("k", F.xxhash64(F.coalesce("text", F.lit("")))).groupBy("doc_id", "k").count().collect()}
    assert all(got.get(key, 0) == taken[key] for key in want)
