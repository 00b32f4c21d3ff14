"""Main text of web pages by maximum-scoring subsequence (operator 4).

A page is a sequence of text runs and tags. Words score by where they stand (innermost block element, and the nearest
enclosing navigation, footer, form, advert and the like; a form, header or named wrapper that holds most of the page's words
is none), tags score negative by name. The weights are log odds counted on
labelled pages: those whose markup names the article (``article`` or ``main``) say which of their words are content; a
weak prior stands in for what they do not show. One linear scan finds the contiguous run with the greatest sum, the
content region. Its blocks are the text; runs inside that stand in a place of negative weight (an advert within the
article, say) are left out.

Weights are fitted on a bounded sample, ``sample_pages`` labelled pages in order of a hash. Without labelled pages the
prior alone decides. The scan does not use the naming tags themselves, so pages without them are treated alike.

Defined cases: a null or empty page has empty text and 0 characters; a page without a positive run too; unclosed tags end
with the element around them, an unclosed comment, script or tag at the end of the page runs to its end; repeated rows
get equal results; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_text, raw_texts, stored

# Fixed values of HTML: element kinds.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead
 title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
OPAQUE = frozenset("script style noscript template textarea select button svg math iframe object canvas audio video head".split())
PLACES = frozenset("nav footer aside form header dialog menu".split())
#: Words in a class or id that name what is not the article.
NOT_ARTICLE = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banners?|sponsor\w*|promo\w*|cookies?|consent|notices?|alerts?|popup|modal|overlay|menus?|nav\w*|breadcrumbs?|"
    r"side-?bars?|widgets?|footer|header|masthead|comments?|replies|disqus|respond|share|social|related|recommended|newsletter|subscribe|login|"
    r"signup|search|pagination|copyright|legal|disclaimer)(?:[^a-z]|$)")
#: Class or id words that say what a wrapper goes with, not what it is.
_BESIDE = re.compile(r"(?:^|(?<=\s))(?:has|have|with|without|no|show|hide)[-_]\S*")
#: Places that an article inside does not leave: elements, and whole words of a class or id.
_HARD_PLACES = PLACES - frozenset("form header".split())
#: The head of an article belongs to it.
_OF_ARTICLE = re.compile(r"(?:^|(?<=[\s_-]))(?:article|post|entry|story|content|main)[-_]{1,2}(?:header|head|title)(?=$|[\s_-])")
_HARD_NAMES = re.compile(r"(?:^|\s)(?:ads?|advert\w*|sponsor\w*|promo\w*|side-?bars?|widgets?|comments?|replies|disqus|respond|related|recommended)(?:\s|$)")
#: What a head can hold.
_IN_HEAD = frozenset("html head title base basefont bgsound link meta noframes noscript script style template".split())
_CLOSES_P = BLOCKS - frozenset("body head html title option optgroup".split())
_SAME = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|svg|iframe)\b(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:\"[^\"]*+\"|'[^']*+'|[^'\">])*+)>|</?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


@dataclass(frozen=True)
class ExtractRules:
    sample_pages: int = 2000
    prior: float = 20.0        # words that the prior counts for
    limit: float = 4.0         # of a weight
    least_word: float = -0.5   # so that an advert inside the article does not cut off its end
    least_tag: float = -0.05   # every tag costs at least this much


#: One token: kind (text, open, close), place or tag, text, whether it ends a block, whether inside the named article.
Token = tuple[str, str, str, bool, bool]


def tokens(page: str) -> list[Token]:
    out: list[Token] = []
    #: tag, the places around it (number, name, whether a hard one) from the outermost, inside the named article
    stack: list[tuple[str, tuple[tuple[int, str, bool], ...], bool]] = []
    texts: list[tuple[int, tuple]] = []
    words: Counter = Counter()  # by place; 0: of the page
    numbers = 0

    def leave(names: frozenset | set, stop: frozenset = frozenset()) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                del stack[at:]
                return
            if stack[at][0] in stop:
                return

    for m in _TOKEN.finditer(page):
        if (text := m["text"]) is not None and stack and stack[-1][0] == "head" and text.strip():
            leave({"head"})  # the end tag is optional
        places, named = stack[-1][1:] if stack else ((), False)
        if text is not None:
            if any(s[0] in OPAQUE for s in stack):
                continue
            inner = next((s[0] for s in reversed(stack) if s[0] in BLOCKS), "")
            linked = any(s[0] == "a" for s in stack)
            texts.append((len(out), places))
            out.append(("text", f"|{inner}{'>a' if linked else ''}", text, False, named))
            if n := len(text.split()):
                for number in (0, *(x[0] for x in places)):
                    words[number] += n
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            leave({tag}, frozenset() if tag in BLOCKS else BLOCKS)
            out.append(("close", tag, "", tag in BLOCKS, named))
            continue
        if tag == "body" or (tag not in _IN_HEAD and any(s[0] == "head" for s in stack) and not any(s[0] in OPAQUE and s[0] != "head" for s in stack)):
            leave({"head"})
        if tag in _CLOSES_P:
            leave({"p"}, frozenset(("td", "th", "table", "button", "article", "section", "div", "body", "aside", "main", "li")) if tag != "p" else frozenset(("td", "th", "div", "section", "article", "aside", "main", "li")))
        if tag in _SAME:
            leave(set(_SAME[tag].split()), frozenset(("ul", "ol", "menu", "dl", "table", "select")))
        places, named = stack[-1][1:] if stack else ((), False)
        hard = any(x[2] for x in places)
        names = _OF_ARTICLE.sub(" ", _BESIDE.sub(" ", " ".join(a or b or c for a, b, c in _NAMES.findall(m["rest"])).lower()))
        if tag == "main" or (tag == "article" and not named and not hard and not _HARD_NAMES.search(names)):
            places = ()  # what is around the article does not make it less of one
        elif found := NOT_ARTICLE.search(names) if names and tag not in ("html", "body", "article") else None:
            numbers += 1
            places = (*places, (numbers, f".{found[0].strip(' -_')}", bool(_HARD_NAMES.search(names)) or tag in _HARD_PLACES))
        elif tag in PLACES and not (tag == "header" and named):
            numbers += 1
            places = (*places, (numbers, tag, tag in _HARD_PLACES))
        out.append(("open", tag, "", tag in BLOCKS, named))
        if tag in ("br", "wbr", "hr"):
            if tag == "br":
                out.append(("text", "", " ", False, named))
        if tag not in VOID and not m["rest"].endswith("/"):
            stack.append((tag, places, named or tag in ("article", "main")))
    # A wrapper around most of the page is no place, unless it is one by its very kind: the next place inside it counts.
    for at, around in texts:
        name = next((x[1] for x in around if x[2] or 2 * words[x[0]] <= words[0]), "")
        if name:
            kind, where, text, block, named = out[at]
            out[at] = (kind, name + where, text, block, named)
    return out


def count_tokens(page: str) -> Counter:
    """(key, inside): words by place and tags by name, inside and outside the named article."""
    out: Counter = Counter()
    for kind, where, text, _, named in tokens(page):
        if kind == "text":
            if n := len(text.split()):
                out[f"w {where}", named and where[0] == "|"] += n  # an advert in an article is not content
        elif where not in ("article", "main"):
            out[f"t {where}", named] += 1
    return out


def _expected(where: str) -> float:
    """Prior share of content among words in a place."""
    place, _, inner = where.partition("|")
    if place or inner.startswith(("title", "head", "option")):
        return 0.05
    if inner.endswith(">a"):  # links in running text, and lists of links
        return 0.6 if inner[0] in "ph" else 0.3
    return 0.8 if inner.startswith(("p", "h", "blockquote", "pre", "li", "d", "t", "section", "article", "main", "fig")) else 0.6


@dataclass(frozen=True)
class Weights:
    counts: dict[str, tuple[int, int]]   # key -> (inside, outside)
    rules: ExtractRules

    def word(self, where: str) -> float:
        inside, outside = self.counts.get(f"w {where}", (0, 0))
        share = _expected(where)
        odds = (inside + self.rules.prior * share) / (outside + self.rules.prior * (1 - share))
        return max(self.rules.least_word, min(self.rules.limit, math.log(odds)))

    def tag(self, name: str) -> float:
        inside, outside = self.counts.get(f"t {name}", (0, 0))
        odds = (inside + self.rules.prior) / (outside + self.rules.prior)
        return max(-self.rules.limit, min(self.rules.least_tag, math.log(odds) / 4 + self.rules.least_tag))


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the greatest positive sum; the first one, empty if none is positive."""
    best, found, run, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += x
        if run > best:
            best, found = run, (start, i + 1)
    return found


def extract(page: str, weights: Weights, cache: dict[str, float] | None = None) -> str:
    """Blocks of the content region, one per line."""
    cache = {} if cache is None else cache
    parts = tokens(page)
    scores = []
    for kind, where, text, _, _ in parts:
        key = f"{kind[0]}{where}"
        if key not in cache:
            cache[key] = weights.word(where) if kind == "text" else weights.tag(where)
        scores.append(cache[key] * len(text.split()) if kind == "text" else cache[key])
    start, end = best_run(scores)
    blocks, own = [], []
    for (kind, where, text, block, _) in parts[start:end]:
        if block:
            blocks.append("".join(own))
            own = []
        elif kind == "text" and (not where or cache[f"t{where}"] > 0):
            own.append(html.unescape(text))
    blocks.append("".join(own))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def learn(pages: DataFrame, rules: ExtractRules = ExtractRules(), html_col: str = "html") -> Weights:
    labelled = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]")).select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h"))
    # A bound on the hash leaves about twice the sample, so few pages meet in the task that puts them in order.
    share = min(1.0, 2.0 * rules.sample_pages / max(1, labelled.count()))
    near = labelled.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= share)
    sample = stored(near.orderBy("h").limit(rules.sample_pages), "html-sample")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            total: Counter = Counter()
            for raw in raw_texts(part.column(0)):
                total.update(count_tokens(as_text(raw)))
            yield pa.RecordBatch.from_arrays([
                pa.array([k for k, _ in total], pa.string()), pa.array([i for _, i in total], pa.bool_()), pa.array(list(total.values()), pa.int64())],
                names=["key", "inside", "n"])

    counted = sample.select("html").mapInArrow(batches, "key string, inside boolean, n long")
    n = F.sum("n")
    # Bounded by the sample: the places and tags of its pages.
    rows = counted.groupBy("key").agg(F.coalesce(F.sum(F.when(F.col("inside"), F.col("n"))), F.lit(0)).alias("inside"), n.alias("n")).collect()
    return Weights({r["key"]: (r["inside"], r["n"] - r["inside"]) for r in rows}, rules)


def extract_pages(pages: DataFrame, rules: ExtractRules = ExtractRules(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  weights: Weights | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    weights = weights or learn(pages, rules, html_col)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for part in parts:
            texts = [extract(as_text(raw), weights, cache) for raw in raw_texts(part.column(0))]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*part.schema.names[1:], "text"])

    own = pages.select(F.col(html_col).alias("html"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    kinds = {f.name: f.dataType.simpleString() for f in own.schema.fields}
    found = own.mapInArrow(batches, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
