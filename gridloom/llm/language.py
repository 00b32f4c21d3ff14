"""Language identification with a string kernel (operator 10).

A text is the set of its n-grams of one to three letters of any script, by code point (runs of anything else are one
boundary sign). The blended
spectrum presence kernel of two texts is the number of n-grams they share over the root of the product of their numbers.
Landmarks are a few training texts per language; the Nystroem map turns kernel values against them into features, and
one-versus-rest kernel ridge regression is solved on those. All of that collapses into one matrix: texts are scored in
batches as (texts x n-grams) @ (n-grams x landmarks) @ (landmarks x languages).

The model is fitted on a bounded sample, ``sample_rows`` distinct texts per language in order of a text hash, as the
n-gram sets of its landmarks; everything else reads every row and whole texts. Prediction sees the text alone.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without training rows every text is;
documents with a null id or language are never trained on; equal texts get equal predictions; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import as_text, raw_texts, stored

UNKNOWN = "und"
#: A sign is the code point of a letter, or the boundary; a code point has 21 bits, so three signs are one number.
BOUNDARY = 1
SIGN_BITS = 21
#: Places of a batch of texts against the n-grams of the landmarks.
_PLACES_AT_ONCE = 1 << 25


@dataclass(frozen=True)
class LanguageRules:
    sample_rows: int = 400      # training texts per language, at most
    landmarks: int = 24         # of them per language
    ridge: float = 1e-2
    sharpness: float = 6.0      # of the scores' softmax
    batch: int = 128


@dataclass(frozen=True)
class Model:
    languages: list[str]
    grams: np.ndarray       # n-grams of the landmarks, sorted
    landmarks: np.ndarray   # n-grams x landmarks, float32, each column over the root of its number of n-grams
    weights: np.ndarray     # landmarks x languages


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str, alphabet: str = "") -> np.ndarray:
    """Sorted numbers of the n-grams present, exact for every script; empty without a letter. ``alphabet`` is not needed."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = np.append(False, _letters()[codes])
    if not letter.any():
        return np.empty(0, np.int64)
    sign = np.append(0, codes).astype(np.int64)
    sign[~letter] = BOUNDARY
    sign = np.append(sign[np.append(True, letter[1:] | letter[:-1])], BOUNDARY)
    two = (sign[:-1] << SIGN_BITS) | sign[1:]
    # Each length has its own range of numbers, as no sign is 0.
    return np.concatenate([np.unique(sign), np.unique(two), np.unique((two[:-1] << SIGN_BITS) | sign[2:])])


def _counts(sets: list[np.ndarray], model_grams: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Kernel values of texts against landmarks, as matrix products of bounded size."""
    step = max(1, _PLACES_AT_ONCE // max(1, len(model_grams)))
    if len(sets) > step:
        return np.concatenate([_counts(sets[i:i + step], model_grams, columns) for i in range(0, len(sets), step)])
    rows = np.zeros((len(sets), len(model_grams)), dtype=np.float32)
    for row, own in zip(rows, sets):
        at = np.searchsorted(model_grams, own)
        at[at == len(model_grams)] = 0
        row[at[model_grams[at] == own]] = 1.0
    sizes = np.array([max(1, len(s)) for s in sets], dtype=np.float32)
    return (rows @ columns) / np.sqrt(sizes)[:, None]


def landmark_columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the landmarks, and one column for each of them."""
    used = np.unique(np.concatenate(sets))
    columns = np.zeros((len(used), len(sets)), dtype=np.float32)
    for k, own in enumerate(sets):
        columns[np.searchsorted(used, own), k] = 1.0 / np.sqrt(len(own))
    return used, columns


def fit(kernel: np.ndarray, langs: list[str], chosen: list[int], used: np.ndarray, columns: np.ndarray, rules: LanguageRules) -> Model:
    """kernel: training texts x landmarks, in a fixed order; chosen: the rows of the landmarks."""
    languages = sorted(set(langs))
    values, vectors = np.linalg.eigh(kernel[chosen])
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = kernel @ whiten
    wanted = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    ridge = rules.ridge * len(langs) / max(1, features.shape[1])
    solved = np.linalg.solve(features.T @ features + ridge * np.eye(features.shape[1]), features.T @ wanted)
    return Model(languages, used, columns, (whiten @ solved).astype(np.float32))


def score(sets: list[np.ndarray], model: Model | None, rules: LanguageRules) -> tuple[list[str], list[float]]:
    if model is None:
        return [UNKNOWN] * len(sets), [0.0] * len(sets)
    values = _counts(sets, model.grams, model.landmarks).astype(np.float64) @ model.weights
    best = values.argmax(axis=1)
    odds = np.exp(rules.sharpness * (values - values.max(axis=1, keepdims=True)))
    sure = 1.0 / odds.sum(axis=1)
    known = [len(s) > 0 for s in sets]
    return ([model.languages[b] if k else UNKNOWN for b, k in zip(best, known)], [float(x) if k else 0.0 for x, k in zip(sure, known)])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """(lang, text, h): up to ``rows`` distinct texts per language, least hash first."""
    train = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    # Distinct texts per language, estimated from the share of hashes below a bound, give a bound that leaves few too many.
    # Stored, so that its few rows have a known size and the texts are not shuffled by language to meet them.
    sizes = stored(train.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")), "language-sizes")
    share = F.least(F.lit(1.0), F.lit(2.0 * rows + 50) / F.col("n"))
    near = train.join(sizes, "lang").where((F.col("h").cast("double") / 2.0**64 + 0.5) <= share).groupBy("lang", "h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return near.withColumn("place", place).where(F.col("place") <= rows).select("lang", "h", "text", "place")


def train(docs: DataFrame, rules: LanguageRules = LanguageRules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    sample = stored(training_sample(docs, id_col, text_col, lang_col, rules.sample_rows), "language-sample")

    def listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [grams(as_text(raw)) for raw in raw_texts(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["lang", "h", "grams"])

    # The n-grams of the landmarks only; of the other training texts their kernel values are enough.
    marks = sample.where(F.col("place") <= rules.landmarks).select("lang", "h", "text").mapInArrow(listed, "lang string, h long, grams array<long>")
    found = [(r["lang"], r["h"], np.array(r["grams"], dtype=np.int64)) for r in marks.orderBy("lang", "h").collect()]
    found = [f for f in found if len(f[2])]
    if not found:
        return None
    used, columns = landmark_columns([own for *_, own in found])

    def compared(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [grams(as_text(raw)) for raw in raw_texts(part.column(2))]
            values = _counts(sets, used, columns)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(values), pa.list_(pa.float32()))], names=["lang", "h", "k"])

    rows = sample.select("lang", "h", "text").mapInArrow(compared, "lang string, h long, k array<float>").orderBy("lang", "h").collect()
    place = {(r["lang"], r["h"]): i for i, r in enumerate(rows)}
    kernel = np.array([r["k"] for r in rows], dtype=np.float64)
    return fit(kernel, [r["lang"] for r in rows], [place[lang, h] for lang, h, _ in found], used, columns, rules)


def predict(docs: DataFrame, model: Model | None, rules: LanguageRules = LanguageRules(), text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with lang_pred and score."""
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            langs, sure, held = [], [], []

            def flush():
                found = score(held, model, rules)
                langs.extend(found[0]), sure.extend(found[1])
                held.clear()

            for raw in raw_texts(part.column(0)):
                held.append(grams(as_text(raw)))
                if len(held) == rules.batch:
                    flush()
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(langs, pa.string()), pa.array(sure, pa.float64())],
                                             names=[*part.schema.names[1:], "lang_pred", "score"])

    own = docs.select(F.col(text_col).alias("_text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[1:])
    return own.mapInArrow(batches, f"{fields}, lang_pred string, score double")


def identify(docs: DataFrame, rules: LanguageRules = LanguageRules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = train(docs, rules, id_col, text_col, lang_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predict(narrow, model, rules).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
