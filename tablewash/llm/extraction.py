"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags.  Words score positive and tags negative; the
scores are log ratios of how often each kind of token stands inside and outside the main
element of labelled pages, that is pages that mark it as ``article`` or ``main``.  One
linear scan finds the contiguous region with the largest sum.  Its text is put out block
by block, without the parts that are never content: scripts, forms, menus, notices,
adverts, comments and the like, known by element, class, id or role.

Weights are counted on at most ``max_labelled`` pages drawn by a hash of id and html; extraction
covers the whole html of every page and does not look at how the page marks its main element.  Defined cases: NULL html and pages without words
give an empty text; a region has no beginning that adds nothing, and of equal sums the earliest
region counts, the longer one if they begin alike; unclosed and stray tags are read as they stand; repeated rows give equal results.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import bounded_draw

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_MARKS = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
# Elements by their meaning in HTML.
MAIN = {"article", "main"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr"}
TAGS = INLINE | MAIN | NEVER | VOID | RAW | {
    "div", "p", "li", "ul", "ol", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "table", "tr", "td", "th", "section",
    "header", "body", "html", "blockquote", "pre", "figure", "figcaption", "center", "tbody", "thead"}
# Words of class names and roles that mark what is not content.
BOILERPLATE = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo",
               "promotion", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "cookie",
               "cookies", "consent", "notice", "notices", "popup", "modal", "comment", "comments", "disqus", "share", "sharing",
               "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search",
               "pagination", "pager", "skip", "toolbar", "masthead", "contentinfo", "complementary", "alert", "widget"}
LEAST, MOST = 0.05, 2.0
DEFAULT = {"word": 1.0, "tag": -2.0}


def _boilerplate(name: str, tag: str, in_main: bool) -> bool:
    if name in NEVER or (name == "header" and not in_main):
        return True
    if name in MAIN or name in ("html", "body"):
        return False
    for groups in _MARKS.findall(tag):
        if not BOILERPLATE.isdisjoint(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(groups)).lower())):
            return True
    return False


def page_tokens(page: str) -> list[tuple[str, str, bool]]:
    """(kind, text, inside a main element) for each run of content text (kind "") and each tag (its name).

    Text in elements that are never content does not appear; their tags do.
    """
    out, at, main = [], 0, 0
    skipped, depth = "", 0  # the element that is never content, and how often it is nested in itself
    while at < len(page):
        found = _TOKEN.search(page, at)
        end = found.start() if found else len(page)
        if end > at and not skipped:
            out.append(("", page[at:end], main > 0))
        if not found:
            break
        tag, at = found[0], found.end()
        named = _NAME.match(tag)
        if not named:
            if tag.startswith("<![CDATA[") and not skipped:
                out.append(("", tag[9:].removesuffix("]]>"), main > 0))
            continue
        name, closing = named[1].lower(), tag[1] == "/"
        if not closing and name in RAW and not tag.endswith("/>"):
            close = re.compile(f"</{re.escape(name)}\\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            out.append((name, "", main > 0))
            continue
        if skipped:
            if name == skipped:
                depth += -1 if closing else not tag.endswith("/>")
                if depth == 0:
                    skipped = ""
        elif not closing and name not in VOID and not tag.endswith("/>") and _boilerplate(name, tag, main > 0):
            skipped, depth = name, 1
        elif name in MAIN:
            main = max(0, main + (-1 if closing else 1))
        out.append((name if name in TAGS else "other", "", main > 0 or (closing and name in MAIN)))
    return out


def count_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each kind of token stands inside and outside the main element of marked pages."""
    counts: dict[tuple[str, bool], int] = {}
    for batch in batches:
        for page in batch.column("html").to_pylist():
            tokens = page_tokens(page or "")
            if not any(t[2] for t in tokens):
                continue
            for name, text, inside in tokens:
                key = (name or "word", inside)
                counts[key] = counts.get(key, 0) + (1 if name else len(text.split()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.bool_()), pa.array(list(counts.values()), pa.int64())],
        ["kind", "inside", "n"])


def learn_weights(
    pages: DataFrame, html_column: str = "html", max_labelled: int = 4_000, id_column: str = "page_id", max_bytes: int = 256 << 20,
) -> dict[str, float]:
    """Log ratios by kind: from ``LEAST`` to ``MOST`` for words, below ``-LEAST`` for tags.

    Learned from at most ``max_labelled`` pages of at most ``max_bytes``, drawn by id and html.
    """
    html = pages.select(F.col(id_column).alias("id"), F.col(html_column).cast("string").alias("html"))
    rows = bounded_draw(html, ["id", "html"], "html", max_labelled, max_bytes).select("html").mapInArrow(count_kinds, "kind string, inside boolean, n bigint")
    counts = {(r.kind, r.inside): r.n for r in rows.groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return {}
    total = {side: sum(n for (_, s), n in counts.items() if s == side) + 1 for side in (True, False)}
    weights = {}
    for kind in {k for k, _ in counts}:
        n_in, n_out = counts.get((kind, True), 0), counts.get((kind, False), 0)
        ratio = math.log((n_in + 0.5) / total[True]) - math.log((n_out + 0.5) / total[False])
        weights[kind] = min(MOST, max(LEAST, ratio)) if kind == "word" else min(-LEAST, ratio)
    return weights


def main_text(page: str, weights: dict[str, float]) -> str:
    tokens = page_tokens(page)
    best, best_range, total, begin = 0.0, (0, 0), 0.0, 0
    for i, (name, text, _) in enumerate(tokens):
        if name:
            total += weights.get(name, DEFAULT["tag"])
        else:
            total += weights.get("word", DEFAULT["word"]) * len(text.split())
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best or (total == best and best_range[0] == begin):
            best, best_range = total, (begin, i + 1)
    blocks, block = [], []
    for name, text, _ in tokens[best_range[0]:best_range[1]]:
        if not name:
            block.append(text)
        elif name not in INLINE:
            blocks.append("".join(block))
            block = []
    blocks.append("".join(block))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return " ".join(b for b in clean if b)


def extract_text(
    pages: DataFrame, weights: dict[str, float], id_column: str = "page_id", url_column: str = "url", html_column: str = "html",
) -> DataFrame:
    """Per page: id, url, text, n_chars (code points)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page or "", weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url"), F.col(html_column).cast("string").alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnRenamed("id", id_column)
