"""Main text of web pages (operator 10) by tag-path ratios.

A page is read as blocks of text, each under its root-to-leaf path of block-level tags. Per path, text length and
punctuation are summed and divided by the blocks there; the ratios are smoothed over neighbouring paths in page order,
fused with each other and with factors for what tags and names say of their content, and paths above the page's threshold are
content. Their blocks, in page order, are the text.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|$)"  # a quote that never closes is a letter
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)"
    r"|<[!?/][^>]*(?:>|$)",
    re.S,
)
_WORDS = re.compile(r"[a-z]+")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPACES = re.compile(r"\s+")
_MARKS = re.compile(r"[.,;:!?…。，、；：！？«»“”]")

# HTML's elements by how they are read.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address "
    "header footer nav aside form fieldset details summary hr center menu hgroup dialog search".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr"}, "tbody": {"thead", "tbody", "tr"}, "tfoot": {"tbody", "tr"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Tags whose text is never the article's.
ASIDE = frozenset("head nav footer aside form button select option datalist script style noscript template svg math canvas object audio video iframe map dialog menu title textarea search".split())
ARTICLE = frozenset("article main".split())
#: Blocks that belong to the text around them, however short.
PARTS = frozenset("h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption".split())
#: Words in class, id and role names that mark other things than the article.
ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation "
    "newsletter notice notices popup promo promoted recommended related reply replies respond sidebar share sharing social sponsor sponsored subscribe subscription widget complementary contentinfo".split()
)
ARTICLE_NAMES = frozenset("article content entry main post story".split())


#: Factors of the fusion: text that tags or names call the article's, text beside such, names with an aside word as a part.
IN, OUT, DOUBT = 4.0, 0.5, 0.25


def _factor(tag: str, attributes: str, around: float) -> float:
    """The factor of text within a tag, given that of the text around it; 0 for what is never the article's."""
    inside = around >= IN
    if around == 0 or tag in ASIDE or tag == "header" and not inside:
        return 0.0
    named = tag in ARTICLE
    if attributes:
        if _HIDDEN.search(attributes):
            return 0.0
        tokens = {t for m in _NAMES.finditer(attributes) for t in m[1].strip("\"'").lower().split()}
        parts = {w for t in tokens for w in _WORDS.findall(t)}
        if tag not in ("html", "body", "article", "main"):
            if tokens & ASIDE_NAMES:
                # beside a name of the article it says nothing: the text's own ratios decide
                return around if tokens & ARTICLE_NAMES else 0.0
            if parts & ASIDE_NAMES and not tokens & ARTICLE_NAMES:  # main-nav, but no-sidebar too
                return around * DOUBT
        named = named or bool(parts & ARTICLE_NAMES) and tag in ("div", "section", "td")
    return max(around, IN) if named else around


def blocks(page: str) -> list[tuple[tuple[str, ...], float, str, int]]:
    """A page's blocks of text in order: path of block-level tags, its factor, text, characters within links."""
    out: list[tuple[tuple[str, ...], float, str, int]] = []
    stack: list[tuple[str, float]] = []  # open tags, each with the factor of the text within
    path: list[str] = []
    held: list[str] = []
    linked = 0

    def end_block() -> None:
        nonlocal linked
        if held:
            text = _SPACES.sub(" ", "".join(held)).strip()
            if text:
                out.append((tuple(path), stack[-1][1] if stack else 1.0, text, linked))
            held.clear()
        linked = 0

    def close(i: int) -> None:
        """Close open tags from place i of the stack on; the text so far belongs to them."""
        if any(t in BLOCK for t, _ in stack[i:]):
            end_block()
            del path[len(path) - sum(t in BLOCK for t, _ in stack[i:]) :]
        del stack[i:]

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text and not (stack and stack[-1][1] == 0):
            text = unescape(text) if "&" in text else text
            held.append(text)
            if stack and any(t == "a" for t, _ in stack[-3:]):
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag in VOID:
                if tag == "hr":
                    end_block()
                elif tag == "br":
                    held.append("\n")
                continue
            if tag in BLOCK:
                if tag == "p" or tag not in CLOSES:  # an open paragraph ends where a block begins
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            close(i)
                            break
                        if stack[i][0] in BLOCK:
                            break
                if tag in CLOSES:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in WITHIN[tag]:
                            break
                        if stack[i][0] in CLOSES[tag]:
                            close(i)
                            break
                end_block()
            factor = _factor(tag, m[2], stack[-1][1] if stack else 1.0)
            if tag not in RAW and m[2].endswith("/") and tag not in BLOCK:
                continue
            if factor == 0:
                end_block()
            stack.append((tag, factor))
            if tag in BLOCK:
                path.append(tag)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else len(page)
                close(len(stack) - 1)
        elif m[3]:
            tag = m[3].lower()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
    end_block()
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    if len(x) < 3:
        return x
    padded = np.pad(x, 1, "edge")
    return 0.25 * padded[:-2] + 0.5 * padded[1:-1] + 0.25 * padded[2:]


def main_text(page: str) -> str:
    """The article's text of one page, blocks joined by line ends; empty if there is none."""
    found = blocks(page)
    if not found:
        return ""
    paths: dict[tuple, int] = {}
    for path, factor, _, _ in found:
        paths.setdefault((path, factor), len(paths))
    at = np.array([paths[path, factor] for path, factor, _, _ in found])
    chars = np.array([len(t) - min(k, len(t)) for _, _, t, k in found], float)  # links count for nothing
    marks = np.array([len(_MARKS.findall(t)) for _, _, t, _ in found], float)
    n = np.bincount(at, minlength=len(paths))
    length, punctuation = _smooth(np.bincount(at, chars) / n), _smooth(np.bincount(at, marks) / n)
    factors = np.array([f for _, f in paths])
    if (factors >= IN).any():
        factors = np.where(factors < IN, factors * OUT, factors)
    ratio = length * np.log2(2 + punctuation)
    fused = ratio * factors
    # names must not raise the bar for what they say nothing of, nor doubt keep it out of reach
    threshold = min(max(x.max() * 0.1, min(x.mean(), x.std())) for x in (ratio, fused))
    content = (fused > 0) & (fused >= threshold)
    beside = {path[:-1] for (path, _), k in paths.items() if content[k]}  # headings and lists of the content are short
    own = np.bincount(at, chars) / np.maximum(1, np.bincount(at, [len(t) for _, _, t, _ in found]))  # share outside links
    for (path, factor), k in paths.items():
        around = range(1, len(path)) if factor >= IN else (len(path) - 1, len(path) - 2)  # all of a named article
        if fused[k] > 0 and path and path[-1] in PARTS and (factor >= IN or own[k] >= 0.5) and any(path[: max(i, 0)] in beside for i in around):
            content[k] = True
    return "\n".join(t for (_, _, t, _), k in zip(found, at) if content[k])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) -> (page_id, url, text, n_chars): the article's whole text of every page.

    Null html is empty, and a page without an article, or without text, has an empty text. The paths' ratios decide
    on every page; what a page names as its article (article, main, a content class) weighs more. Repeated rows, of null
    ids too, give repeated results; other columns are not read; an empty table gives an empty one. One narrow pass."""
    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]

    def run(batches):
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
