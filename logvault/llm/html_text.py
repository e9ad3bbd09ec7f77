"""Operator 11: main text of web pages from flat text blocks and a decision tree.

1. A page is cut into flat text blocks: the text between two block-level tags.
   Markup, comments, scripts, styles and other elements that show no text are
   dropped, character references decoded, white space in a block becomes one
   space. ``<br>`` is white space, inline tags are nothing.
2. A block is described by its word count and link density, by those of the
   block before and the one after, and by what encloses it: an element or class
   that names content, one that names furniture (menu, advert, form, reader
   comment, ...) or none, and whether the page names content elsewhere.
3. A decision tree says which blocks are main text. It is trained when first
   used, on the blocks of the small labelled pages below (``LABELLED``), by
   Gini impurity until its leaves are pure, and takes a millisecond.
4. The main blocks, in page order, joined by one space, are the text.

Every page is one row of an Arrow batch: no shuffle, nothing on the driver.
Scans are linear in the page, also where quotes, comments or elements are never
closed: an open comment, script or tag runs to the end of the page.

Defined cases: null, empty and blank pages and pages without main blocks give
an empty text; bare text without a tag is one block; repeated rows give a row
each; null page_id and url are carried through; extra columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvault.llm.common import pieces, read_table

# HTML element names by their role in the standard.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video title select textarea noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q s samp small span strike "
                   "strong sub sup time tt u var wbr img input ruby rt rp".split())
IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
LISTS = frozenset("ul ol dl table body article section div main".split())
# Names that say what an element holds.
CONTENT_TAGS, FURNITURE_TAGS = frozenset(("article", "main")), frozenset("nav footer aside form header menu dialog button".split())
ROLES = {"main": 1, "article": 1, **dict.fromkeys("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split(), -1)}
CONTENT_NAMES = frozenset("article content post entry story main text prose body".split())
FURNITURE_NAMES = frozenset(
    "nav navbar navigation menu submenu header masthead footer sidebar aside ad ads advert adverts advertisement adsense banner promo sponsor sponsored "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended "
    "recommendations breadcrumb breadcrumbs pagination pager widget toolbar search copyright legal disclaimer skip tags".split())
LAYOUT_NAMES = frozenset("has with without no is js".split())  # "has-sidebar" is no sidebar
COMMENT_NAMES = frozenset("comment comments reply replies respond disqus discussion".split())

_TAG = re.compile(
    r"<!--(?:(?!-->).)*+(?:-->)?|<([!?])[^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(>?)", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_NAME = re.compile(r"[a-z]+")
_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}

FEATURES = ("words", "link_density", "before_words", "before_density", "after_words", "after_density", "enclosed", "content_elsewhere")


def _hint(name: str, attributes: str) -> tuple[int, bool, bool]:
    """(1 content, -1 furniture, 0 neither; reader comments; shows nothing) of one element."""
    hint, comments, hidden = (name in CONTENT_TAGS) - (name in FURNITURE_TAGS), False, False
    if not attributes or name in ("html", "body"):
        return hint, comments, hidden
    named = 0
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role":
            hint = ROLES.get(value.strip(), hint)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            hidden = True
        elif key in ("class", "id"):
            for one in value.split():
                parts = _NAME.findall(one)
                if not parts or not LAYOUT_NAMES.isdisjoint(parts):
                    continue
                comments |= name not in INLINE and not COMMENT_NAMES.isdisjoint(parts)
                if not FURNITURE_NAMES.isdisjoint(parts):
                    named = -1
                elif not named and not CONTENT_NAMES.isdisjoint(parts):
                    named = 1
    if name != "main" and named and not (hint > 0 and CONTENT_NAMES.intersection(_NAME.findall(attributes.lower()))):
        hint = named if hint >= 0 else -1
    return (-1 if comments else hint), comments, hidden


def blocks(html: str) -> list[tuple[str, int, float, int]]:
    """(text, words, link density, enclosed: 1, 0 or -1) of the flat text blocks of a page that hold any text."""
    out: list[tuple[str, int, float, int]] = []
    text: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, state, inside comments, hidden
    open_now: dict[str, int] = {}
    state, comments, hidden, links, skip_head, at = 0, False, False, 0, False, 0

    def flush():
        if text:
            words = unescape("".join(text)).split()
            if words:
                inside = len(unescape("".join(linked)).split())
                out.append((" ".join(words), len(words), min(1.0, inside / len(words)), state))
            text.clear()
            linked.clear()

    def say(part):
        if part and not hidden and not skip_head:
            text.append(part)
            if links:
                linked.append(part)

    def restore():
        return stack[-1][1:] if stack else (0, False, False)

    def close(name):
        while stack:
            top = stack.pop()[0]
            open_now[top] -= 1
            if top == name:
                break

    n = len(html)
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            say(html[at:])
            break
        say(html[at:lt])
        m = _TAG.match(html, lt)
        if not m:
            say("<")
            at = lt + 1
            continue
        at = m.end()
        closing, name, attributes, closed = m.group(2), m.group(3), m.group(4), m.group(5)
        if name is None:  # a comment, a declaration
            continue
        if not closed:  # a tag without an end runs to the end of the page
            break
        name = name.lower()
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = _END[name].search(html, at)
                at = n if end is None else end.start()
                say(" ")
            continue
        if name == "br":
            say(" ")
            continue
        if name == "head":
            flush()
            skip_head = not closing
            continue
        if name == "body":
            skip_head = False
        if name == "a":
            links = 0 if closing else 1
            if links:
                linked.append(" ")
        block = name not in INLINE
        if block:
            flush()
            links = 0 if name not in VOID and closing else links
        if name in VOID or name == "a":
            continue
        if open_now.get("p") and block and not closing:
            close("p")
            state, comments, hidden = restore()
        if name == "p" and not closing and not attributes.strip():
            continue
        if closing:
            if open_now.get(name):
                close(name)
                was = state
                now, comments, hidden = restore()
                if now != was and not block:
                    flush()
                state = now
            continue
        for k in range(len(stack) - 1, -1, -1) if name in IMPLIED and any(open_now.get(x) for x in IMPLIED[name]) else ():
            top = stack[k][0]
            if top in IMPLIED[name]:
                for gone in stack[k:]:
                    open_now[gone[0]] -= 1
                del stack[k:]
                state, comments, hidden = restore()
                break
            if top in LISTS:
                break
        if attributes.endswith("/") and not block:
            continue
        hint, speaks, gone = _hint(name, attributes)
        if hint and not comments:
            nested_heading = name == "header" and state > 0
            if not nested_heading and hint != state:
                if not block:
                    flush()
                state = hint
        comments, hidden = comments or speaks, hidden or gone
        stack.append((name, state, comments, hidden))
        open_now[name] = open_now.get(name, 0) + 1
    flush()
    return out


def features(page: list[tuple[str, int, float, int]]) -> np.ndarray:
    """One row of ``FEATURES`` for each block."""
    n = len(page)
    out = np.zeros((n, len(FEATURES)))
    if n:
        out[:, 0], out[:, 1], out[:, 6] = [b[1] for b in page], [b[2] for b in page], [b[3] for b in page]
        out[1:, 2:4], out[:-1, 4:6] = out[:-1, 0:2], out[1:, 0:2]
        out[:, 7] = (out[:, 6] < 1) & (out[:, 6] > 0).any()
    return out


class Tree:
    """A binary decision tree: Gini impurity, splits halfway between values, pure leaves. Equal splits: the first feature, the lowest value."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.nodes: list[tuple] = []
        self._grow(x, y)

    def _grow(self, x, y) -> int:
        me, best = len(self.nodes), None
        self.nodes.append(())
        if 0 < y.sum() < len(y):
            for f in range(x.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, ones = x[order, f], np.cumsum(y[order])
                for k in np.flatnonzero(v[1:] > v[:-1]):
                    a, b = k + 1, len(y) - k - 1
                    p, q = ones[k] / a, (ones[-1] - ones[k]) / b
                    score = round(a * p * (1 - p) + b * q * (1 - q), 9)
                    if best is None or score < best[0]:
                        best = (score, f, (v[k] + v[k + 1]) / 2)
        if best is None:
            self.nodes[me] = (None, int(2 * y.sum() > len(y)))
        else:
            left = x[:, best[1]] <= best[2]
            self.nodes[me] = (best[1], best[2], self._grow(x[left], y[left]), self._grow(x[~left], y[~left]))
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        work = [(0, np.arange(len(x)))]
        while work:
            k, rows = work.pop()
            node = self.nodes[k]
            if node[0] is None:
                out[rows] = node[1]
            elif len(rows):
                left = x[rows, node[0]] <= node[1]
                work += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


def _w(n: int, linked: int = 0) -> str:
    """``n`` words, the first ``linked`` of them in a link."""
    return (f"<a>{'w ' * linked}</a> " if linked else "") + "w " * (n - linked)


#: The labelled table: pages as lists of (opening tags, words, linked words, closing tags, main text or not).
LABELLED = [
    # marked up pages: whatever the length, the article is main text and what surrounds or interrupts it is not
    [("<header><p>", 6, 0, "</p></header>", 0), ("<nav><li>", 1, 1, "</li>", 0), ("<li>", 2, 2, "</li></nav>", 0), ("<div class='ad'>", 14, 0, "</div>", 0),
     ("<article><h1>", 9, 0, "</h1>", 1), ("<p>", 80, 2, "</p>", 1), ("<p>", 1, 0, "</p>", 1), ("<p>", 4, 4, "</p>", 1), ("<ul><li>", 3, 3, "</li></ul>", 1),
     ("<aside><p>", 40, 3, "</p></aside>", 0), ("<p>", 25, 0, "</p></article>", 1), ("<footer>", 20, 1, "</footer>", 0)],
    [("<div class='cookie-notice'><p>", 45, 4, "</p></div>", 0), ("<div>", 30, 0, "</div>", 0), ("<main><p>", 3, 0, "</p>", 1), ("<p>", 55, 0, "</p>", 1),
     ("<form><p>", 8, 0, "</p></form>", 0), ("<p>", 12, 12, "</p>", 1), ("<section class='comments'><p>", 70, 0, "</p><p>", 0), ("", 30, 0, "</p></section></main>", 0),
     ("<div>", 12, 0, "</div>", 0), ("<p>", 60, 1, "</p>", 0)],
    [("<div id='sidebar'><p>", 50, 5, "</p>", 0), ("<p>", 2, 0, "</p></div>", 0), ("<div class='post-content'><p>", 40, 0, "</p>", 1), ("<p>", 2, 0, "</p>", 1),
     ("<div class='related'><li>", 7, 7, "</li></div>", 0), ("<p>", 18, 6, "</p></div>", 1), ("<div>", 5, 0, "</div>", 0), ("<div>", 4, 4, "</div>", 0)],
    # pages without names: word counts and link densities decide, also those of the neighbours
    [("<div>", 2, 2, "</div>", 0), ("<div>", 3, 3, "</div>", 0), ("<div>", 4, 0, "</div>", 0), ("<h1>", 8, 0, "</h1>", 1), ("<p>", 60, 0, "</p>", 1), ("<p>", 35, 3, "</p>", 1),
     ("<p>", 5, 0, "</p>", 1), ("<p>", 48, 1, "</p>", 1), ("<p>", 19, 0, "</p>", 1), ("<div>", 6, 6, "</div>", 0), ("<div>", 7, 2, "</div>", 0), ("<div>", 5, 0, "</div>", 0)],
    [("<td>", 1, 1, "</td>", 0), ("<td>", 1, 1, "</td>", 0), ("<td>", 12, 11, "</td>", 0), ("<p>", 28, 0, "</p>", 1), ("<p>", 22, 2, "</p>", 1), ("<p>", 90, 0, "</p>", 1),
     ("<p>", 14, 0, "</p>", 1), ("<div>", 15, 14, "</div>", 0), ("<div>", 3, 0, "</div>", 0), ("<div>", 9, 8, "</div>", 0)],
    [("<p>", 40, 0, "</p>", 1)],
    [("<p>", 7, 0, "</p>", 1), ("<p>", 30, 0, "</p>", 1), ("<p>", 45, 0, "</p>", 1), ("<div>", 8, 5, "</div>", 0), ("<div>", 2, 0, "</div>", 0), ("<div>", 20, 18, "</div>", 0)],
    [("<li>", 2, 2, "</li>", 0), ("<li>", 2, 2, "</li>", 0), ("<div>", 3, 0, "</div>", 0), ("<div>", 4, 0, "</div>", 0), ("<li>", 5, 4, "</li>", 0)],
]


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of ``LABELLED``."""
    xs, ys = [], []
    for page in LABELLED:
        found = blocks("".join(before + _w(n, linked) + after for before, n, linked, after, _ in page))
        xs.append(features(found))
        ys += [label for *_, label in page]
    return np.concatenate(xs), np.array(ys)


@cache
def trained_tree() -> Tree:
    return Tree(*labelled_table())


def main_text(html: str) -> str:
    """The main blocks of a page in page order, joined by one space."""
    page = blocks(html)
    return " ".join(b[0] for b, main in zip(page, trained_tree().predict(features(page))) if main)


def _extract(batches):
    for part, texts in pieces(batches, "html"):
        found = [main_text(t.decode("utf-8", "replace")) for t in texts]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], ["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url and the main text of each row."""
    src = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op11_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract_text(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


QUERIES = {"op11_html_blocks": op11_html_blocks}

#: The tables' pages mark their article; on them the tree's choice equals its text.
ORACLE_SQL = {"op11_html_blocks": r"""
WITH article AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS part FROM pages),
plain AS (
  SELECT page_id, url, regexp_replace(regexp_replace(part, '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS part FROM article),
decoded AS (
  SELECT page_id, url, replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(part,
         '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g'), chr(160), ' ') AS part FROM plain),
spaced AS (SELECT page_id, url, trim(regexp_replace(part, '\s+', ' ', 'g')) AS text FROM decoded)
SELECT page_id, url, text, length(text) AS n_chars FROM spaced
"""}
