"""Main text of HTML pages by the distribution of text over lines.

Markup is stripped so that every block element becomes one line. Lines that belong to navigation,
headers, footers, side bars, notices, adverts, forms, comment sections or code are left out, by tag, or by
name where the named element does not hold most of the text (of article and main, if the page has one). Tags weigh the rest: if
the page has an ``article`` or ``main`` element with text, only lines inside such elements count.

The distribution of text over the lines that are left decides on every page. A line weighs its characters outside
links (headings: all; a page of links only: all). Weights are summed over a sliding window of ``WINDOW``
lines. Inside article and main any text is a surge, so a dive is a window without text outside links: its lines (a menu or
list of links within the article) are left out, whatever their names. On other pages
the threshold is where Otsu's method parts the page's sums, on a log scale, into low and high, and
``SURGE`` at most, so a long article does not raise it. A surge is where the sums reach the threshold, a dive
where they fall below it. Lines at the ends of a stretch that weigh less than their share of the threshold
are left out, unless they are paragraphs or headings beside its lines in the same parent. All stretches are kept.

Rules: null or empty html, and a page with no text line, give an empty text; unclosed elements end with
their parent; equal sums are treated alike; repeated pages are ordinary rows; other columns are not read. Pages of any length are
read whole, in time linear in their length: a tag ends at the first ``>`` outside quotes; where a page's quotes never
close, at the first ``>`` from there on; what follows the last ``>`` is text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate
from math import log
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.shared import ship

WINDOW = 3
#: The highest threshold: a window of lines of 80 characters.
SURGE = WINDOW * 80
#: Elements of the HTML standard, by what they do to the text.
CODE = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "textarea", "select", "title")
BOILERPLATE = ("nav", "header", "footer", "aside", "form", "dialog", "menu", "button", "head")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div",
          "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header",
          "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary",
          "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
#: Names in class, id or role of what is no article text; a name joined by - or _ counts if all its parts are listed.
NAMES = re.compile(r"(?:(?:^|[_-])(?:ads?|advert[^\W_]*|banner|sponsor[^\W_]*|promo[^\W_]*|cookies?|consent|notices?|popup|modal|newsletter|"
                   r"subscribe|comments?|replies|disqus|sidebar|side|widget|related|recommend[^\W_]*|share|social|breadcrumbs?|"
                   r"menu|nav[^\W_]*|pagination|pager|footer|header|masthead|toolbar|login|search|alert|disclaimer|complementary|"
                   r"contentinfo)(?=$|[_-]))+", re.I)
_OPEN = re.compile(r"<!--|<!\[CDATA\[|<[!?]|<(/?)([A-Za-z][A-Za-z0-9:-]*)")
_ATTRIBUTES = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_LABEL = re.compile(r"(?<![^\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_CODE_END = {t: re.compile(rf"</{t}(?![A-Za-z0-9:-])", re.I) for t in CODE}
_ROOTS = ("article", "main")
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PROSE = ("p", "blockquote", "pre", "li", *_HEADINGS)


def _named(attributes: str) -> bool:
    return any(NAMES.fullmatch(x) for a, b, c in _LABEL.findall(attributes) for x in (a or b or c).split())


class Tag(NamedTuple):
    start: int
    end: int
    closing: bool
    name: str           # lower case; empty for comments and declarations
    attributes: str


def tags(page: str) -> Iterator[Tag]:
    """The tags, comments and declarations of a page. Send the place to go on from, if it is not the end of the tag."""
    at, quoted = 0, True
    while (found := _OPEN.search(page, at)) is not None:
        start, body = found.span()
        mark = found[0]
        if found[2] is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(mark, ">")
            end = page.find(close, body)
            if end < 0 and close == ">":
                return
            end = len(page) if end < 0 else end + len(close)
            made = Tag(start, end, False, "", "")
        else:
            end = -1
            if quoted:
                end = _ATTRIBUTES.match(page, body).end()
                if end >= len(page) or page[end] != ">":
                    quoted, end = False, -1
            if end < 0:
                end = page.find(">", body)
                if end < 0:
                    return
            made = Tag(start, end + 1, bool(found[1]), found[2].lower(), page[body:end])
        resume = yield made
        at = made.end if resume is None else resume


class Line(NamedTuple):
    text: str
    bad: bool           # is boilerplate
    rooted: bool        # is inside article or main
    linked: int         # characters inside links
    tag: str            # the block element it is in, by name and number, and the number of the parent
    own: int
    parent: int


def lines(page: str) -> list[Line]:
    """Every block of the page in order."""
    out: list[Line] = []
    parts: list[str] = []
    links: list[str] = []
    stack: list[tuple[str, bool, int]] = []      # open block elements, whether they are boilerplate by tag, and their number
    opened: Counter = Counter()                  # their names
    named: list[tuple[int, int]] = []            # depth and number of the open elements that are boilerplate by name
    inside: dict[int, int] = {}                  # of each of these the number of the one around it
    held: list[int] = []                         # the number of the innermost of these around each line
    bad = roots = serial = 0
    link = -1           # how many blocks were open where the open link began

    def flat(texts: list[str]) -> str:
        text = " ".join(html.unescape("".join(texts)).split())
        texts.clear()
        return text

    def close() -> None:
        text, linked = flat(parts), len(flat(links)) if links else 0
        if text:
            held.append(named[-1][1] if named else 0)
            tag, _, own = stack[-1] if stack else ("", False, 0)
            out.append(Line(text, bad > 0, roots > 0, linked, tag, own, stack[-2][2] if len(stack) > 1 else 0))

    def pop() -> None:
        nonlocal bad, roots
        gone, was, _ = stack.pop()
        opened[gone] -= 1
        bad -= was
        roots -= gone in _ROOTS
        if named and named[-1][0] >= len(stack):
            named.pop()

    at, walk = 0, tags(page)
    found = next(walk, None)
    while found is not None:
        parts.append(page[at:found.start])
        if link >= 0:
            links.append(parts[-1])
        at, name, resume = found.end, found.name, None
        if name == "a":
            link = -1 if found.closing else len(stack)
        if name in CODE and not found.closing:
            if name == "title":
                close()
            ended = _CODE_END[name].search(page, at)
            at = page.find(">", ended.end()) + 1 if ended else 0
            at = resume = at or len(page)
        elif name in BLOCKS or name in BOILERPLATE:
            close()
            if found.closing:
                if opened[name] > 0:
                    while stack[-1][0] != name:
                        pop()
                    pop()
                    if link > len(stack):
                        link = -1
            elif name not in VOID and not found.attributes.rstrip().endswith("/"):
                if name == "p" or name == "li" or name in ("td", "th", "tr", "dd", "dt", "option"):
                    if stack and stack[-1][0] == name:
                        pop()
                # a header inside an article is part of it; the page's own is not
                plain = name == "header" and roots > 0
                is_bad = name in BOILERPLATE and not plain
                bad += is_bad
                roots += name in _ROOTS
                serial += 1
                if name not in ("html", "body", *_ROOTS) and not plain and _named(found.attributes):
                    inside[serial] = named[-1][1] if named else 0
                    named.append((len(stack), serial))
                stack.append((name, is_bad, serial))
                opened[name] += 1
        try:
            found = walk.send(resume)
        except StopIteration:
            found = None
    parts.append(page[at:])
    if link >= 0:
        links.append(parts[-1])
    close()
    return _judged(out, held, inside) if any(held) else out


def _judged(out: list[Line], held: list[int], inside: dict[int, int]) -> list[Line]:
    """Lines inside named elements are boilerplate, but for elements that hold most of the text in article and
    main, or of the page if it has none: these are wrappers. An element holds at least what those in it hold, so a line's
    innermost one tells."""
    rooted = any(b.rooted and not b.bad for b in out)
    total, own = 0, Counter()
    for line, number in zip(out, held):
        if not line.bad and (line.rooted or not rooted):
            total += len(line.text)
            own[number] += len(line.text)
    for x in sorted(inside, reverse=True):       # inner elements have higher numbers
        own[inside[x]] += own[x]
    return [b if b.bad or not x or 2 * own[x] > total else b._replace(bad=True) for b, x in zip(out, held)]


def _weights(blocks: list[Line]) -> list[int]:
    weigh = [len(b.text) if b.tag in _HEADINGS else max(0, len(b.text) - b.linked) for b in blocks]
    if not any(w for w, b in zip(weigh, blocks) if b.tag not in _HEADINGS):
        weigh = [len(b.text) for b in blocks]
    return weigh


def without_dives(blocks: list[Line], window: int = WINDOW) -> list[Line]:
    """The lines of article and main that are in no window without text."""
    weigh = _weights(blocks)
    total = [0, *accumulate(weigh)]
    kept, empty = [], 0          # up to where a window without text reaches
    for i, b in enumerate(blocks):
        if i + window <= len(blocks) and total[i + window] == total[i]:
            empty = i + window
        if i >= empty:
            kept.append(b)
    return kept


def threshold(sums: list[int], most: int = SURGE) -> int:
    """The smallest of the high sums where the variance between low and high logarithms is largest, at most ``most``."""
    some = sorted(x for x in sums if x > 0)
    if not some:
        return 1
    logs = [log(x) for x in some]
    total, below, best, at = sum(logs), 0.0, 0.0, 0
    for k in range(1, len(some)):
        below += logs[k - 1]
        apart = k * (len(some) - k) * ((total - below) / (len(some) - k) - below / k) ** 2
        if some[k] > some[k - 1] and apart > best:
            best, at = apart, k
    return min(some[at], most)


def stretches(blocks: list[Line], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """(first, last) of every stretch of text from a surge to a dive."""
    weigh = _weights(blocks)
    n = len(weigh)
    sums = [sum(weigh[i:i + window]) for i in range(max(1, n - window + 1))]
    least = threshold(sums, surge)
    if min(sums) >= least and least < surge:       # a short text without a dive
        return [(0, n - 1)]
    out: list[tuple[int, int]] = []
    i = 0
    while i < len(sums):
        j = i
        while j < len(sums) and sums[j] >= least:
            j += 1
        if j == i:
            i += 1
            continue
        a, b = i, min(n, j + window - 1) - 1
        while weigh[a] * window < least:
            a += 1
        while weigh[b] * window < least:
            b -= 1

        def beside(k: int, edge: int) -> bool:
            x, y = blocks[k], blocks[edge]
            return weigh[k] > 0 and (x.own == y.own or x.tag in _PROSE and y.tag in _PROSE and x.parent == y.parent)

        while a > 0 and beside(a - 1, a):
            a -= 1
        while b + 1 < n and beside(b + 1, b):
            b += 1
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
        i = j
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    blocks = [b for b in lines(page or "") if not b.bad]
    inside = [b for b in blocks if b.rooted]
    if inside or not blocks:
        return "\n".join(b.text for b in without_dives(inside, window))
    return "\n".join(blocks[k].text for a, b in stretches(blocks, window, surge) for k in range(a, b + 1))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    ship(pages.sparkSession)
    inner = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in inner.schema.fields}
    return inner.mapInArrow(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
