"""Line deduplication by a log-template tree (operator 8), DataFrame functions only.

A line is parsed to a fixed depth: its token count, then its three leading tokens, tokens with digits being wildcards. The
rest of the line is cut in up to eight parts, a token each while they suffice. Two lines of a leaf are instances of one
template if at least three quarters of their parts are equal in place; the others are its variable fields. A line that has
a template in common with a line of an earlier document is dropped; the first document of a template keeps its line.

Templates are met by equality, not by comparing lines: a line is generalised by leaving out every quarter of its parts in
turn (28 ways to leave out two of eight), and each generalised line is a number, the exclusive or of the hashes of the
parts it keeps. The least document of each number is one aggregation. So there are at most 28 rows for each distinct line,
whatever the size of a leaf.

Lines are stored once as hashes; the table of leaves tells which lines can recur at all. What follows works on distinct
lines: a line in a third of all documents is one row until the last join, to the few distinct lines that recur, which the
planner splits. Texts move once, to drop their lines.

Lines of one to three tokens have no parts: they go when an earlier document has the very same line. In scripts that are
written without blanks (Han, Kana, Thai, Lao, Khmer, Burmese, Tibetan) every character is a token.

Defined cases: blank lines are never dropped; repeats inside one document stay; a null text has one empty line and stays
null; a document with a null id keeps its lines; repeated rows are one document; documents that lose every line stay, with
an empty text; an empty table gives an empty result; other columns are passed through.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import stored

SPACE = r"\x20\x09-\x0D"
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
LEADING = 3
PARTS = 8


def _tokens(line: Column) -> Column:
    digits = line.rlike("[0-9]")
    masked = F.when(digits, F.regexp_replace(line, f"[^{SPACE}]*[0-9][^{SPACE}]*", "<*>")).otherwise(line)
    spaced = F.regexp_extract_all(masked, F.lit(f"[^{SPACE}]+"), F.lit(0))
    short = F.regexp_replace(line, "[0-9]+", "<*>")
    # Characters of these scripts have three bytes or more; other lines are spared a second pattern.
    return F.when(F.octet_length(line) > 2 * F.length(line), F.regexp_extract_all(short, F.lit(f"[{UNSPACED}]|[^{SPACE}{UNSPACED}]+"), F.lit(0))).otherwise(spaced)


def parsed_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, line_no, leaf, body, parts) of every line with a token; ``parts``: a hash for each place."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    rows = lines.select("doc_id", "text_key", "line_no", "line", _tokens(F.col("line")).alias("t")).withColumn("n", F.size("t")).where("n > 0")
    rest = F.col("n") - LEADING
    rows = rows.withColumn("m", F.least(rest, F.lit(PARTS)))
    edge = lambda g: F.floor(g * rest / F.col("m")).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda g: F.xxhash64(g, F.slice(F.col("t"), edge(g) + LEADING + 1, edge(g + 1) - edge(g))))
    long = rest > 0
    own = F.xxhash64(F.lit("line"), F.col("line"))
    return rows.select("doc_id", "text_key", "line_no", F.when(long, F.xxhash64("n", F.slice("t", 1, LEADING))).otherwise(own).alias("leaf"),
                       F.when(long, F.xxhash64("n", "t")).otherwise(own).alias("body"), F.when(long, parts).alias("parts"))


def _templates() -> tuple[Column, Column]:
    """(all parts in one number, the forms): the generalised forms of a line: a quarter of its parts left out, in every way."""
    at = lambda i: F.get("parts", F.lit(i))
    whole = F.aggregate("parts", F.col("leaf"), lambda acc, x: acc.bitwiseXOR(x))
    two = F.array(*[F.col("whole").bitwiseXOR(at(a)).bitwiseXOR(at(b)) for a, b in combinations(range(PARTS), 2)])
    one = F.transform("parts", lambda x: F.col("whole").bitwiseXOR(x))
    return whole, F.when(F.size("parts") == PARTS, two).when(F.size("parts") >= 4, one)


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, dropped): numbers of the lines to drop, for the documents that have such."""
    lines = stored(parsed_lines(docs, id_col, text_col), "line-hashes")
    leaves = stored(lines.groupBy("leaf").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("leaf"), "line-leaves")
    bodies = stored(lines.join(leaves, "leaf", "left_semi").groupBy("leaf", "body").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("parts").alias("parts")).where(F.col("first").isNotNull()), "line-bodies")
    whole, forms = _templates()
    general = bodies.where(F.size("parts") >= 4).withColumn("whole", whole).select("body", "first", F.explode(forms).alias("form"))
    # Forms of one line alone generalise nothing.
    shared = stored(general.groupBy("form").agg(F.min("first").alias("since"), F.max("first").alias("_last")).where("since < _last").select("form", "since"), "line-templates")
    earlier = general.join(shared, "form").where("since < first").groupBy(F.col("body").alias("_body")).agg(F.min("since").alias("since"))
    limits = bodies.join(earlier, F.col("body") == F.col("_body"), "left").select("body", "last", F.coalesce("since", "first").alias("since"))
    limits = stored(limits.where("since < last").select("body", "since"), "line-limits")
    return lines.join(limits, "body").where(F.col("doc_id") > F.col("since")).groupBy("doc_id", "text_key").agg(
        F.collect_set("line_no").alias("dropped"))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` without recurring lines. ``report``: rows (doc_id, n_lines, n_dropped, text) instead."""
    found = stored(recurring_lines(docs, id_col, text_col).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("dropped").alias("_dropped")), "line-dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    if report:
        docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        id_col, text_col, text = "doc_id", "text", F.coalesce(F.col("text"), F.lit(""))
    own = docs.withColumn("_own", F.xxhash64(text))
    joined = own.join(found, own[id_col].eqNullSafe(found["_id"]) & (own["_own"] == found["_key"]), "left")
    lines = F.split(text, "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_dropped"))
    shorter = F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
    left = F.when(F.col("_dropped").isNull(), F.col(text_col)).otherwise(shorter)
    if report:
        return joined.select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                             left.alias("text"))
    return joined.select(*[left.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
