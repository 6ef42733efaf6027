"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block of the page. What stands in a menu, footer, form, advert or the like is taken out. A
line weighs its characters outside links; in the page's article it weighs at least a surge, unless text surges
``ELSEWHERE`` times as high outside it, because only teasers or readers' notes are marked so. If links outweigh all other text, they are what
the page is about and weigh too. Sums over windows of ``WINDOW`` lines locate the text: it surges where a window holds
``SHARE`` of the page's fullest one, or ``SURGE`` characters if that is less. It dives where ``LIST`` lines or more follow that no surge holds up: a
menu, a list of links, a footer or a header that nothing marks, of which nothing is kept. Between surge and dive every
line stays, however short. In front of a surge stay the lines of its window, and links behind the last text go.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.llm.shared import pieces, table

WINDOW = 3
ELSEWHERE = 4  # the page's article isn't the main text if text surges this many times as high outside it
SHARE, SURGE = 0.2, 150  # of the fullest window, and characters in a window, from which text surges: the lesser counts
LIST = 6  # lines without a surge that are something else

# Element and class names.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template svg math iframe object head title textarea select option canvas audio video map datalist".split())
RAW = set("script style noscript template iframe textarea title svg".split())
ASIDE = set("nav header footer aside form menu dialog button fieldset".split())
MARKS = set(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promotion sidebar cookie cookies consent gdpr notice nav navbar navigation menu "
    "breadcrumb breadcrumbs footer header masthead share sharing social related recommended comment comments disqus respond newsletter subscribe signup "
    "login popup modal overlay widget toolbar pagination pager hidden alert alerts announcement reaction reactions reply replies discussion feedback".split()
)
PARTS = set("a the of and all site page main top bottom left right inner outer mobile desktop box bar block list item items link links wrapper wrap container content section area group row col column unit slot button buttons icon icons form field posts post articles text js sticky fixed google reader readers user users visitor visitors small medium large big wide tall info warning success danger".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)[^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_ENDS = {name: re.compile(rf"</{name}\s*(?:>|\Z)", re.I) for name in RAW}


def _is_aside(name: str, attributes: str) -> bool:
    """Whether an element holds something other than the main text: a class names that, and nothing besides it but a place."""
    if name in ASIDE:
        return True
    if not attributes or name in ("html", "body", "main", "article"):
        return False
    for key, *values, bare in _ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if bare or key.lower() == "aria-hidden" and value == "true" or key.lower() == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key.lower() == "role" and value in ROLES:
            return True
        if key.lower() in ("class", "id"):
            for word in value.split():
                parts = {x.strip("0123456789") for x in re.split(r"[^a-z0-9]+", word)} - {""}
                if parts & MARKS and parts <= MARKS | PARTS:
                    return True
    return False


class _Open:
    """The elements that are open, with counts of their names and kinds, so that a line costs the same at any depth."""

    def __init__(self):
        self.stack: list[tuple[str, str]] = []  # (element, "aside", "article", "header" or "")
        self.names: Counter[str] = Counter()
        self.kinds: Counter[str] = Counter()
        self.inline: Counter[str] = Counter()  # names of inline elements that have a kind

    def push(self, name: str, kind: str) -> None:
        self.stack.append((name, kind))
        self.names[name] += 1
        self.kinds[kind] += 1
        self.kinds["heading"] += name in HEADINGS
        self.inline[name] += bool(kind) and name in INLINE

    def pop(self) -> str:
        name, kind = self.stack.pop()
        self.names[name] -= 1
        self.kinds[kind] -= 1
        self.kinds["heading"] -= name in HEADINGS
        self.inline[name] -= bool(kind) and name in INLINE
        return name

    def close(self, name: str) -> None:
        if self.names[name]:
            while self.pop() != name:
                pass


def _lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """``(text, characters outside links, counts, stands in an article)`` for each block."""
    out: list[tuple[str, int, bool, bool]] = []
    open_ = _Open()
    words: list[str] = []
    linked: list[int] = []  # places of words in links
    link, at = 0, 0

    def end_of_line() -> None:
        text = " ".join(html.unescape("".join(words)).split())
        if text:
            counts = not open_.kinds["aside"] and (open_.kinds["heading"] > 0 or not open_.kinds["header"])
            own = len(text)
            if linked:
                for i in linked:
                    words[i] = " "
                own = len(" ".join(html.unescape("".join(words)).split()))
            out.append((text, own, counts, open_.kinds["article"] > 0))
        words.clear()
        linked.clear()

    while at < len(page):
        found = _TOKEN.search(page, at)
        stop = found.start() if found else len(page)
        if stop > at:
            if link:
                linked.append(len(words))
            words.append(page[at:stop])
        if not found:
            break
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], "")
        if not name:
            continue
        name = name.lower()
        if name == "a":
            link = max(0, link + (-1 if closing else 1))
            continue
        if name == "br":
            words.append(" ")
        if name in RAW and not closing:
            end = _ENDS[name].search(page, at)
            if name != "title":
                words.append(" ")
            at = end.end() if end else len(page)
            continue
        if name in UNSEEN:
            end_of_line()
            if closing:
                open_.close(name)
            else:
                open_.push(name, "aside")
            continue
        inline = name in INLINE
        kind = ""
        if not closing and name not in VOID:
            if name in ("article", "main"):
                kind = "article"
            elif _is_aside(name, attributes or ""):
                within = open_.kinds["article"] > 0
                kind = "header" if within and (name == "header" or name == "div" and re.search(r"(class|id)\s*=\s*[\"']?[^\"'>]*\bheader\b", attributes or "", re.I)) else "aside"
        if inline and not kind and not (closing and open_.inline[name]):
            continue
        end_of_line()
        link = 0
        if closing:
            open_.close(name)
        elif name not in VOID:
            stack = open_.stack
            if kind == "article":
                while stack and stack[-1][1] == "aside" and stack[-1][0] in ("nav", "header", "footer", "form", "head"):
                    open_.pop()  # an element that was never closed
            if name in ("p", "li", "tr", "td", "th", "dt", "dd", *HEADINGS) and stack and stack[-1][0] == name and not stack[-1][1]:
                open_.pop()
            open_.push(name, kind)
    end_of_line()
    return out


def window_sums(weights: list[int], window: int = WINDOW) -> np.ndarray:
    """The sum over each ``window`` lines in a row; a shorter page is one window."""
    sums = np.concatenate([[0], np.cumsum(np.array(weights, np.int64))])
    return sums[window:] - sums[:-window] if len(weights) >= window else sums[-1:]


def _judged(page: str, window: int) -> tuple[list[tuple[str, int, bool]], bool]:
    found = _lines(page)
    inside = window_sums([n * (counts and within) for _, n, counts, within in found], window).max()
    outside = window_sums([n * (counts and not within) for _, n, counts, within in found], window).max()
    marked = any(counts and within for _, _, counts, within in found) and outside < max(1, ELSEWHERE * inside)
    judged = [(text, n, counts and (within or not marked)) for text, n, counts, within in found]
    return [(text, n if counts else 0, counts) for text, n, counts in judged], marked


def lines(page: str, window: int = WINDOW) -> list[tuple[str, int, bool]]:
    """``(text, weight, counts)`` for each block; ``counts`` is false for what isn't main text, which weighs nothing.

    Lines outside the page's article don't count, unless text surges ``ELSEWHERE`` times as high there as within it.
    """
    return _judged(page, window)[0]


def text_lines(weights: list[int], window: int = WINDOW, marked: bool = False) -> list[bool]:
    """Which of the lines with these weights lie between surge and dive; in a ``marked`` article each line holds up a surge."""
    n = len(weights)
    sums = window_sums(weights, window)
    level = min(SHARE * sums.max(), SURGE)
    if marked or not n:
        return [True] * n
    # A line holds up a surge if it is in a full window and no lighter than such a window's mean line.
    full = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(sums >= max(level, 1))
    np.add.at(full, at, 1)
    np.add.at(full, np.minimum(at + window, n), -1)
    holds = np.flatnonzero((np.cumsum(full[:-1]) > 0) & (np.array(weights) * window >= level))
    kept = np.zeros(n, bool)
    if not len(holds):
        return kept.tolist()
    kept[holds] = True
    for a, b in zip(holds[:-1].tolist(), holds[1:].tolist(), strict=True):
        if b - a - 1 < LIST:
            kept[a:b] = True
    first, last = int(holds[0]), int(holds[-1])
    if first < LIST:
        kept[max(0, first - window + 1) : first] = True
    if n - 1 - last < LIST:
        kept[last + 1 : n - next((i for i, w in enumerate(reversed(weights[last:])) if w))] = True
    return kept.tolist()


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The lines between surges and dives, joined by two line feeds."""
    if not page:
        return ""
    found, marked = _judged(page, window)
    found = [(text, n) for text, n, counts in found if counts]
    height = window_sums([n for _, n in found], window).max()
    linked = window_sums([0 if n else len(text) for text, n in found], window).max()
    weights = [n if height > linked else len(text) for text, n in found]
    return "\n\n".join(text for (text, _), kept in zip(found, text_lines(weights, window, marked), strict=True) if kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "html", 8 << 20):
        texts = [main_text(x) for x in piece.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html, ...)``; other columns are ignored.

    A null or empty page, or one without main text, gives an empty text. Each row stands alone, so repeated rows give
    repeated results and no rows give none. Whole pages are read, however long.
    """
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
