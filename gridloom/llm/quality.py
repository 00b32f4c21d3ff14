"""Quality rules by tokeniser fertility (operator 6).

One narrow pass over whole texts gives, per document, the base counts and three fertility measures of public
vocabularies: characters per token and the entropy of the tokens (byte-level BPE), and the share of bytes that a piece
vocabulary has to spell byte by byte. A document is rejected when a measure leaves the band of its language (its
script, where the language is null). Bands come from all documents that pass the base rules: the median and the median
absolute deviation, from exact histograms of rounded values in which exact copies count once. As a mean over n tokens spreads
like 1/sqrt(n), bands are kept per half octave of n and never narrower than that law, so a large group of near copies
cannot close a band on the others. Half octaves with fewer than ``least_docs`` documents take the spread of the language,
and languages with fewer that of their script, so that a document alone in its place does not set its own band.

Defined cases: a null or empty text has no words, fails the base rules and is not kept; a null language counts by
script; repeated rows get equal verdicts; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import ASCII_SPACE, as_text, raw_texts, stored, text_or_empty, vocabulary_path
from gridloom.llm.tokens import BYTE_BPE, BYTE_BPE_RANKS, token_ids
from gridloom.session import ship_package

SYMBOLS = b"#*$%&|<>"
MEASURES = ("struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, script: string, "
            "n_tokens: long, chars_per_token: double, byte_share: double, entropy: double>")
_ARROW_MEASURES = pa.struct([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [
    ("script", pa.string()), ("n_tokens", pa.int64())] + [(n, pa.float64()) for n in ("chars_per_token", "byte_share", "entropy")])

# First code point of each script block and its name.
_SCRIPTS = [(0x0, "other"), (0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
            (0x780, "other"), (0x900, "devanagari"), (0x980, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
            (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0xAC00, "hangul"),
            (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]
_STARTS = np.array([s for s, _ in _SCRIPTS], dtype=np.uint32)


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    repeat_window: int = 8
    max_repeat_percent: int = 30
    band_width: float = 5.0            # in robust standard deviations
    chars_spread: float = 0.8          # least deviation of characters per token, times sqrt(n)
    entropy_spread: float = 2.0        # least deviation of the entropy, times sqrt(n)
    byte_share_spread: float = 0.02    # least deviation of the byte-fallback share
    least_docs: int = 30               # documents that a band of its own needs
    vocabulary: str = BYTE_BPE
    ranks: str | None = BYTE_BPE_RANKS
    pieces: str = "piece_bpe_32k.model"


@lru_cache(maxsize=4)
def _spelled(path: str) -> np.ndarray:
    """True for every code point that the piece vocabulary holds no piece for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    missing = np.ones(0x110000, dtype=bool)
    singles = [p for p in (model.id_to_piece(i) for i in range(model.get_piece_size())) if len(p) == 1]
    missing[[ord(p) for p in singles]] = False
    missing[[*ASCII_SPACE]] = False
    return missing


def repeated_words(words: list[bytes], window: int) -> int:
    """Words inside windows of ``window`` words (a power of two) that occur at least twice."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ranks = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    step = 1
    while step < window:  # ranks of windows of doubled length, exact
        distinct, ranks, counts = np.unique(
            ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:], return_inverse=True, return_counts=True)
        if len(distinct) == len(ranks):
            return 0
        step *= 2
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(counts[ranks] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(edges)))


def _duplicate_lines(raw: bytes) -> int:
    lines = [line for line in raw.split(b"\n") if line.strip(ASCII_SPACE)]
    return len(lines) - len(set(lines))


def _entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    share = np.bincount(ids)
    share = share[share > 0] / len(ids)
    return float(-(share * np.log2(share)).sum()) + 0.0


def measure_text(raw: bytes, rules: QualityRules) -> dict:
    text = as_text(raw)
    words = raw.split()
    ids = token_ids(text, rules.vocabulary, rules.ranks)
    script, byte_share = "other", 0.0
    if text:
        if text.isascii():
            script = "latin" if text.lower() != text.upper() else "other"
        else:
            codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
            spelled = codes[_spelled(vocabulary_path(rules.pieces))[codes]]
            size = 1 + (spelled >= 0x80).astype(int) + (spelled >= 0x800) + (spelled >= 0x10000)
            byte_share = float(size.sum()) / len(raw)
            # Blanks, digits and signs below "A" are "other" and never win over a script.
            blocks = np.bincount(np.searchsorted(_STARTS, codes, side="right") - 1, minlength=len(_SCRIPTS))
            totals: dict[str, int] = {}
            for (_, name), n in zip(_SCRIPTS, blocks.tolist()):
                totals[name] = totals.get(name, 0) + (n if name != "other" else 0)
            script = max(sorted(totals), key=totals.get) if any(totals.values()) else "other"
    spaces = len(raw) - len(raw.translate(None, ASCII_SPACE))
    return {
        "n_words": len(words), "word_chars": len(text) - spaces, "n_symbols": len(raw) - len(raw.translate(None, SYMBOLS)),
        "n_dup_lines": _duplicate_lines(raw), "n_repeat_words": repeated_words(words, rules.repeat_window), "script": script,
        "n_tokens": len(ids), "chars_per_token": len(text) / max(1, len(ids)), "byte_share": byte_share, "entropy": _entropy(ids)}


def measure(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """All columns of ``docs`` (without the text on request) and one struct ``_quality`` of measures."""
    ship_package(docs.sparkSession)
    kept = [f for f in docs.schema.fields if not (drop_text and f.name == text_col)]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = part.schema.get_field_index(text_col)
            rows = pa.array([measure_text(raw, rules) for raw in raw_texts(part.column(at))], type=_ARROW_MEASURES)
            columns = [c for i, c in enumerate(part.columns) if not (drop_text and i == at)]
            names = [n for i, n in enumerate(part.schema.names) if not (drop_text and i == at)]
            yield pa.RecordBatch.from_arrays([*columns, rows], names=[*names, "_quality"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return docs.mapInArrow(batches, f"{schema}, _quality {MEASURES}")


def _median(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Exact lower median of ``v`` by key from (keys, v, n): windows over histograms, not over documents."""
    by = Window.partitionBy(*keys)
    counts = counts.groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    below = F.sum("n").over(by.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*keys, "v", (below * 2 >= F.sum("n").over(by)).alias("_upper"))
    return ranked.where("_upper").groupBy(*keys).agg(F.min("v").alias("med"))


def _base_failed(rules: QualityRules, q: str = "_quality"):
    return (F.col(f"{q}.n_words") < rules.min_words) | (
        F.col(f"{q}.n_repeat_words") * 100 > F.col(f"{q}.n_words") * rules.max_repeat_percent)


#: Values are rounded to these fractions in the histograms.
_GRAIN = 1000


def _grouped(measured: DataFrame, lang_col: str) -> DataFrame:
    q = F.col("_quality")
    return measured.withColumns({
        "_group": F.coalesce(F.col(lang_col), F.concat(F.lit("script:"), q["script"])),
        "_bin": F.floor(F.log2(F.greatest(q["n_tokens"], F.lit(1))) * 2).cast("int")})


def _least_of(df: DataFrame, keys: list[str], order: list, names: list[str]) -> DataFrame:
    """The first row by ``order`` of each key."""
    first = F.min(F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *names)).alias("x")
    return df.groupBy(*keys).agg(first).select(*keys, *[F.col(f"x.{n}") for n in names])


def bands(measured: DataFrame, rules: QualityRules = QualityRules(), lang_col: str = "lang") -> DataFrame:
    """(_group, _script, _bin) with the band of each measure: rows per language, script and half octave of token counts.

    A spread or middle comes from the narrowest of these with ``least_docs`` documents: the half octave of the language,
    the language (deviations times sqrt(n)), the populated languages of the script, whose bands are then joined. Where not
    even the script has them, its own values stand, as nothing says what is usual in it.
    """
    q = F.col("_quality")
    value = lambda name: F.round(q[name] * _GRAIN).cast("long")
    copies = ["_text_key"] if "_text_key" in measured.columns else []
    rows = _grouped(measured, lang_col).where(~_base_failed(rules)).select(
        "_group", "_bin", q["script"].alias("_script"), q["n_tokens"].alias("t"), value("chars_per_token").alias("c"), value("entropy").alias("h"),
        value("byte_share").alias("b"), *copies).distinct()
    # One histogram per measure: rounded values by language and half octave, whatever the number of documents.
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("kind"), F.col(m).alias("v")) for m in "chb"])).alias("x")
    by_script = stored(rows.select("_group", "_script", "_bin", each).groupBy(
        "_group", "_script", "_bin", F.col("x.kind").alias("kind"), F.col("x.v").alias("v")).agg(F.count(F.lit(1)).alias("n")), "quality-values")
    counts = by_script.groupBy("_group", "_bin", "kind", "v").agg(F.sum("n").alias("n"))
    least, scale = rules.least_docs, 1.4826 / _GRAIN  # of a normal distribution
    sizes = stored(counts.where("kind = 'c'").groupBy("_group", "_bin").agg(F.sum("n").alias("n_bin")), "quality-sizes")
    wide = sizes.groupBy("_group").agg(F.sum("n_bin").alias("n_group"))
    # The script with most documents of each language: thin languages are judged by the populated ones of their script.
    home = _least_of(by_script.where("kind = 'c'").groupBy("_group", "_script").agg(F.sum("n").alias("n")), ["_group"], [-F.col("n")], ["_script"])
    root = F.pow(F.lit(2.0), (F.col("_bin") + 0.5) / 4)  # of the tokens in the middle of a half octave
    out = sizes.join(wide, "_group").join(home, "_group")
    # Characters per token and the byte share keep their middle at all lengths; the entropy has one per half octave.
    middle = {"c": ["_group"], "h": ["_group", "_bin"], "b": ["_group"]}
    for m in "chb":
        own = counts.where(F.col("kind") == m).select("_group", "_bin", "v", "n")
        mid = stored(_median(own, middle[m]).withColumnRenamed("med", f"{m}_mid"), "quality-middles")
        away = own.join(mid, middle[m]).withColumn("v", F.abs(F.col("v") - F.col(f"{m}_mid")))
        scaled = away if m == "b" else away.withColumn("v", F.round(F.col("v") * root).cast("long"))
        out = out.join(mid, middle[m]).join(_median(scaled, ["_group"]).withColumnRenamed("med", f"{m}_wide"), "_group")
        if m != "b":
            out = out.join(_median(away, ["_group", "_bin"]).withColumnRenamed("med", f"{m}_mad"), ["_group", "_bin"])
    out = stored(out, "quality-levels")
    # The entropy of a thin half octave: the nearest populated one of the language or of the script, shorter ones first.
    # It grows with the length, by half a bit at most per half octave, so one from longer texts is lowered by that.
    full = out.where(F.col("n_bin") >= least).select(F.col("_group").alias("_g"), F.col("_script").alias("_s"), F.col("_bin").alias("_b"), F.col("h_mid").alias("_h"))
    thin = out.where(F.col("n_bin") < least).select("_group", "_bin", "_script", "n_group")
    same = F.when(F.col("n_group") >= least, F.col("_group") == F.col("_g")).otherwise(F.col("_script") == F.col("_s"))
    lower = F.greatest(F.col("_b") - F.col("_bin"), F.lit(0)) * (_GRAIN // 2)
    near = thin.join(F.broadcast(full), same).select("_group", "_bin", F.abs(F.col("_b") - F.col("_bin")).alias("_far"), (F.col("_b") > F.col("_bin")).alias("_up"),
                                                     (F.col("_h") - lower).alias("_near"))
    near = _least_of(near, ["_group", "_bin"], [F.col("_up"), F.col("_far"), F.col("_near")], ["_near"])
    # Joined bands of the populated languages of a script.
    known = out.where(F.col("n_group") >= least).groupBy("_script").agg(
        F.min("c_mid").alias("_low"), F.max("c_mid").alias("_high"), F.max("b_mid").alias("_b_mid"), *[F.max(f"{m}_wide").alias(f"_{m}_wide") for m in "chb"])
    out = out.join(near, ["_group", "_bin"], "left").join(known, "_script", "left")
    alone = (F.col("n_group") < least) & F.col("_low").isNotNull()
    wide_of = lambda m: F.when(alone, F.col(f"_{m}_wide")).otherwise(F.col(f"{m}_wide"))
    dev = lambda m: F.when(F.col("n_bin") >= least, F.col(f"{m}_mad")).otherwise(wide_of(m) / root) * scale
    return out.select(
        "_group", "_bin", (F.when(alone, (F.col("_low") + F.col("_high")) / 2).otherwise(F.col("c_mid")) / _GRAIN).alias("c_mid"),
        (F.when(alone, (F.col("_high") - F.col("_low")) / 2).otherwise(0.0) / _GRAIN).alias("c_half"),
        (F.when(F.col("n_bin") >= least, F.col("h_mid")).otherwise(F.coalesce("_near", "h_mid")) / _GRAIN).alias("h_mid"),
        (F.when(alone, F.col("_b_mid")).otherwise(F.col("b_mid")) / _GRAIN).alias("b_mid"),
        dev("c").alias("c_dev"), dev("h").alias("h_dev"), (wide_of("b") * scale).alias("b_dev"))


def judge(measured: DataFrame, rules: QualityRules = QualityRules(), lang_col: str = "lang") -> DataFrame:
    """Adds ``_base_failed`` and ``_kept`` to measured (stored) rows."""
    found = stored(bands(measured, rules, lang_col), "quality-bands")
    q, root = F.col("_quality"), F.sqrt(F.greatest(F.col("_quality")["n_tokens"], F.lit(1)).cast("double"))
    least = lambda name, floor: rules.band_width * F.greatest(F.col(f"{name}_dev"), floor)
    outside = (
        (F.abs(q["chars_per_token"] - F.col("c_mid")) - F.col("c_half") > least("c", rules.chars_spread / root))
        | (F.col("h_mid") - q["entropy"] > least("h", rules.entropy_spread / root))
        | (q["byte_share"] - F.col("b_mid") > least("b", F.lit(rules.byte_share_spread))))
    # Left to the planner: a few rows per language, broadcast by measured size only.
    rows = _grouped(measured, lang_col).join(found, ["_group", "_bin"], "left")
    failed = _base_failed(rules)
    return rows.withColumn("_base_failed", failed).withColumn("_kept", ~failed & ~F.coalesce(outside, F.lit(False)))


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang") -> DataFrame:
    """One row per document: base counts, fertility measures, ``base_failed`` and ``kept``."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("_text_key"), F.col(text_col).alias("text"),
                         F.col(lang_col).alias("lang"))
    measured = stored(measure(narrow, rules, drop_text=True), "quality-measures")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "chars_per_token", "byte_share", "entropy")
    return judge(measured, rules).select(
        "doc_id", *[F.col(f"_quality.{n}").alias(n) for n in names], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text",
              lang_col: str = "lang") -> DataFrame:
    """The documents that pass, with their own columns. Only narrow rows are stored; texts are joined to the verdicts."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("_text_key"), F.col(lang_col).alias("lang"),
                         F.col(text_col).alias("text"))
    measured = stored(measure(narrow, rules, drop_text=True), "quality-measures")
    good = judge(measured, rules).where("_kept").select(
        F.col("doc_id").alias("_good_id"), F.col("_text_key").alias("_good_key"), F.col("lang").alias("_good_lang")).distinct()
    same = docs[id_col].eqNullSafe(good["_good_id"]) & docs[lang_col].eqNullSafe(good["_good_lang"])
    return docs.join(good, same & (F.xxhash64(text_or_empty(text_col)) == good["_good_key"]), "left_semi")
