"""Main text of web pages by two passes of block rules.

A page is split into blocks at block-level tags; a block knows its text, how much of it is in links, and the containers
around it. The first pass decides what it can: blocks of menus, headers, footers, sidebars, notices, adverts, forms and
comments (by element or by a word of their class or id) and blocks made of links are bad; long blocks with many stop words
are good, those with few are bad, and short ones or those in between stay ambiguous. In the second pass an ambiguous block
takes the label of its nearest decided neighbours: good if both agree on it or, for a nearly good block or a heading, if one
of them is good. An article or main element is a hint for both passes: a block in it needs fewer stop words to be good and is
not bad for having few, its neighbours are those in the same element, and it goes only if both of them are bad and some
block of the element is good.

Defined results: a null or empty page, or one without a good block, has the empty text. A very long page is read whole, in
time that grows with its length. Broken markup is read as far as it goes: an unclosed tag at the end is dropped, unknown tags
are ignored, stray closing tags close nothing. Neighbours that are equally near count alike. Repeated rows each get their
row, an empty table gives no rows, and extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import COMMON_WORDS

STOP_WORDS = frozenset(w for words in COMMON_WORDS.values() for w in words.split())
# fixed values: HTML elements by how they are read
UNREAD = "script style noscript template svg math iframe object canvas audio video select textarea title".split()
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article aside blockquote body center details dialog div dl fieldset figure footer form header main menu nav ol section table td tr ul".split())
BAD_ELEMENTS = frozenset("aside button dialog footer form header menu nav".split())
BAD_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer footer header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted recommended related reply replies respond share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(UNREAD) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[/!?a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LINK_DENSITY, SHORT, LONG, LOW_STOPS, HIGH_STOPS = 0.33, 70, 200, 0.2, 0.3


def named_bad(attributes: str) -> bool:
    for found in NAMED.findall(attributes) if attributes and "=" in attributes else ():
        if BAD_WORDS & set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(found)).lower())):
            return True
    return False


def blocks(page: str) -> Iterator[tuple[str, float, bool, int, bool]]:
    """(text, share in links, bad by its containers, number of its article or 0, is a heading) of each block with text."""
    stack: list[tuple[str, bool, int]] = []  # element, bad, article
    text, linked, at, in_link, own_bad, heading, articles = [], 0, 0, False, False, False, 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece.strip())

    def done() -> Iterator[tuple[str, float, str, bool]]:
        nonlocal linked
        whole = " ".join("".join(text).split())
        share = linked / max(1, len(whole))
        text.clear()
        linked = 0
        if whole:
            bad, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            bad = bad or own_bad  # a form or the comments in an article are no part of it
            yield whole, share, bad, 0 if bad else article, heading

    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        closing = bool(m[2])
        if name == "a":
            in_link = not closing
        elif name == "br":
            text.append(" ")
        elif name in BLOCKS:
            yield from done()
            in_link = False
            own_bad, heading = False, False
            if name in CONTAINERS:
                if not closing:
                    if not m[4].endswith("/"):
                        bad, article = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
                        if name in ("article", "main"):
                            # a menu or header that was never closed does not swallow the article
                            while stack and stack[-1][0] in ("nav", "header", "menu", "ul", "ol"):
                                stack.pop()
                            bad, articles = bool(stack) and stack[-1][1], articles + 1
                            article = articles
                        elif name != "body":
                            bad = bad or (name in BAD_ELEMENTS and not (name == "header" and article)) or named_bad(m[4])
                        stack.append((name, bad, article))
                elif any(x[0] == name for x in stack):
                    while stack.pop()[0] != name:
                        pass
            elif not closing:
                own_bad, heading = name in BAD_ELEMENTS or named_bad(m[4]), name[0] == "h" and name[1:].isdigit()
    add(page[at:])
    yield from done()


def first_pass(text: str, links: float, bad: bool, article: int) -> str:
    """bad, good, nearly (good), short or, in an article only, few (stop words)."""
    if bad or links > LINK_DENSITY:
        return "bad"
    if len(text) < SHORT:
        return "bad" if links > 0 and not article else "short"
    words = re.findall(r"\w+", text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if article:
        return "good" if stops >= LOW_STOPS else "few"
    if stops >= HIGH_STOPS:
        return "good" if len(text) > LONG else "nearly"
    return "nearly" if stops >= LOW_STOPS else "bad"


def nearest(labels: list[str], articles: list[int]) -> Iterator[tuple[str, str]]:
    """For each block: the nearest decided label before it, in its article and on the page ("" and "bad" if there is none)."""
    page, own = "bad", {}
    for label, article in zip(labels, articles, strict=True):
        yield own.get(article, ""), page
        if label in ("good", "bad"):
            page = own[article] = label


def second_pass(labels: list[str], articles: list[int], headings: list[bool]) -> list[bool]:
    """Which blocks are kept."""
    sides = zip(nearest(labels, articles), reversed([*nearest(labels[::-1], articles[::-1])]), strict=True)
    kept, some, told = [], "good" in labels, {a for x, a in zip(labels, articles, strict=True) if x == "good"}
    for label, article, heading, ((left, before), (right, after)) in zip(labels, articles, headings, sides, strict=True):
        if label in ("good", "bad"):
            kept.append(label == "good")
        elif article:
            kept.append((left, right) != ("bad", "bad") or article not in told)
        else:
            good = (before == "good") + (after == "good")
            kept.append(good == 2 or (label == "nearly" and (good or not some)) or (heading and after == "good"))
    return kept


def main_text(page: str) -> str:
    found = list(blocks(page))
    kept = second_pass([first_pass(*b[:4]) for b in found], [b[3] for b in found], [b[4] for b in found])
    return " ".join(b[0] for b, keep in zip(found, kept, strict=True) if keep)


def extract_main(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
