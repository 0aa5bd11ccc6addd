"""Main text of web pages by tag-path ratios.

A page becomes a list of blocks in page order, each with the number of its path, the chain of block tags from the root to
it. Scripts, menus and the like are left out by tag, role or being hidden. Elements whose whole class or id says that they are no
content, and forms, are left out unless they wrap the page; reader comments never count as a wrapper. Over the rest, text
length and punctuation are summed for each path and divided by the path's blocks; the two series are smoothed along the page,
fused by multiplication and held against a share of their standard deviation.

Blocks of the paths that pass lead to the content nodes. Where most of their text lies in article or main elements, those
are the content, but for boxes of several texts without punctuation none of which passes. Else it is the smallest element that holds nearly all of it; of that element's parts, those
stay that have a block that passes, or hold a table, list, quotation, figure or code, or are headings. Lists and boxes of nothing but
links are menus wherever they stand.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import bounded, slices, texts_of

# Fixed values of HTML: elements by their role in a page.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style svg template textarea title".split())
LEFT_OUT = frozenset("aside datalist dialog footer head menu nav object optgroup option select".split())
#: Controls: left out, but for the words of a sentence they stand in.
CONTROLS = frozenset("button label".split())
SENTENCE = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p td th".split())
ARTICLE = frozenset({"article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a text that are no paragraphs, and the elements that rows and items of lists and tables belong to.
PARTS = frozenset("blockquote dl figure ol pre table ul".split())
ROWS, LISTS = frozenset("caption dd dt li tbody td tfoot th thead tr".split()), frozenset("dl ol table ul".split())
CLOSES_ITSELF = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An implied end does not reach past these.
SCOPE = frozenset("article aside blockquote body div dl figure footer form header main nav ol section table td th ul".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
COMMENTS = frozenset("comment commentlist comments disqus replies reply respond".split())
HINTS = COMMENTS | frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo related search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside a hint in one class name ("site-footer", "ad-box"), and hints that hold outside articles only.
BESIDE = frozenset("area bar block bottom box container form holder inner left link links list main mobile page right section site slot small top unit wrap wrapper zone".split())
#: Words that may stand beside a word for comments ("user-comments", "comment-body"), and beside "related".
BESIDE_COMMENTS = BESIDE | frozenset("all article author blog body content count entry facebook guest item meta post reader readers text thread user users visitor".split())
BESIDE_RELATED = BESIDE | frozenset("articles content items news pages posts products reading stories topics".split())
PAGE_HINTS = frozenset({"header", "topbar"})

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
WORDS = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PUNCTUATION = ".,;:!?…。，、！？；："
#: Share of the fused series' standard deviation that content must reach.
THRESHOLD = 0.8
#: Share of a page's text, and blocks, that a hinted element holds which wraps the page.
MOST, WRAPPED = 0.5, 3
#: Share of the text of passing paths that the content element holds where none is marked; of links in a menu, and their least number.
NEARLY_ALL, LINKED, LINKS = 0.8, 0.8, 3

HARD, FORM, HINT, COMMENT = 1, 2, 3, 4


def attributes_of(text: str) -> dict[str, str]:
    """Values by lower-case name; the first of a name counts."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), a or b or c)
    return out


def left_out(tag: str, text: str, in_article: bool, in_sentence: bool) -> int:
    """HARD where an element is no content by its tag, role or being hidden, else what its class, id or being a form hints at, else 0."""
    if tag in LEFT_OUT or tag == "header" and not in_article or tag in CONTROLS and not in_sentence:
        return HARD
    if tag in ("html", "body") or tag in ARTICLE:
        return 0
    hint = FORM if tag == "form" else 0
    if not text:
        return hint
    attributes = attributes_of(text)
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or HIDDEN_STYLE.search(html.unescape(attributes.get("style", ""))):
        return HARD
    if attributes.get("role", "").strip().lower() in ROLES:
        return HARD
    if tag not in HEADINGS:
        hints = HINTS if in_article else HINTS | PAGE_HINTS
        for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
            words = {w.lower() for w in WORDS.findall(CAMEL.sub(" ", token))}
            if words & COMMENTS and words <= hints | BESIDE_COMMENTS:
                return COMMENT
            if words & hints and words <= hints | (BESIDE_RELATED if "related" in words else BESIDE):
                hint = max(hint, HINT)
    return hint


class Block(NamedTuple):
    """A run of text: the number of its path, its text, its block element, that one's tag, the hinted element around it (0: none), whether it is in an article, its share of link text and its links."""

    path: int
    text: str
    element: int
    tag: str
    hinted: int
    in_article: bool
    linked: float
    links: int


class Page(NamedTuple):
    """Blocks; of each block element its parent and tag; of each hinted element the one around it, its kind and whether a title or article is in it."""

    blocks: list[Block]
    parents: list[int]
    tags: list[str]
    hints: dict[int, list]


class Element(NamedTuple):
    tag: str
    path: int
    number: int
    in_article: bool
    hard: bool
    hinted: int


class Stack:
    """Open elements, with the places of each tag, of blocks and of scopes, so that no closing tag searches the stack."""

    def __init__(self) -> None:
        self.open = [Element("", 0, 0, False, False, 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks, self.scopes = [0], [0]

    def push(self, e: Element) -> None:
        at = len(self.open)
        self.open.append(e)
        self.places.setdefault(e.tag, []).append(at)
        if e.tag in BLOCK:
            self.blocks.append(at)
        if e.tag in SCOPE:
            self.scopes.append(at)

    def cut(self, at: int) -> None:
        """Close the element at a place and all inside it."""
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()
        for places in (self.blocks, self.scopes):
            while places[-1] >= at:
                places.pop()

    def last(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)


def tag_end(page: str, at: int, missing: set[str]) -> int:
    """Where the tag that goes on at a place ends (its >), quotes observed; -1 if it does not. A quote that is never closed is a character."""
    while m := STOP.search(page, at):
        c = m[0]
        if c == ">":
            return m.start()
        close = -1 if c in missing else page.find(c, m.end())
        if close < 0:
            missing.add(c)
        at = m.end() if close < 0 else close + 1
    return -1


def parsed(page: str) -> Page:
    """The blocks of a page in order, in one pass: no tag, quote or open element is looked at again and again."""
    out: list[Block] = []
    parents, tags, hints = [0], [""], {}
    stack, paths, text, missing = Stack(), {}, [], set()
    at = linked = links = n_hints = 0

    def close_block() -> None:
        nonlocal linked, links
        if text:
            if (joined := " ".join(decoded("".join(text)).split())):
                own, last = stack.open[stack.blocks[-1]], stack.open[-1]
                out.append(Block(own.path, joined, own.number, own.tag, last.hinted, last.in_article, linked / len("".join(text).strip()), links))
            text.clear()
        linked = links = 0

    def add(piece: str) -> None:
        nonlocal linked
        if not stack.open[-1].hard:
            text.append(piece)
            if stack.places.get("a"):
                linked += len(piece.strip())

    size = len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            add(page[at:])
            break
        if start > at:
            add(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = size if end < 0 else end + 3
            continue
        closing = page.startswith("</", start)
        m = NAME.match(page, start + 1 + closing)
        if m is None:
            end = page.find(">", start) if page[start + 1 : start + 2] in ("!", "?", "/") else -1
            if end < 0:
                add("<")
            at = start + 1 if end < 0 else end + 1
            continue
        end = tag_end(page, m.end(), missing)
        if end < 0:  # no tag ends any more
            add(page[start:])
            break
        tag, attributes, at = m[0].lower(), page[m.end() : end], end + 1
        if not closing:
            if tag in RAW:
                if not attributes.endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                    at = page.find(">", close.end()) + 1 if close else 0
                    at = at or size
                continue
            if tag == "br":
                add(" ")
                continue
            if tag in BLOCK:
                close_block()
                ends = stack.last(CLOSES_ITSELF.get(tag) or ("p",))
                if ends > stack.scopes[-1] or ends and ends == stack.scopes[-1] and stack.open[ends].tag in CLOSES_ITSELF.get(tag, ()):
                    stack.cut(ends)
            if tag in VOID:
                continue
            parent = stack.open[-1]
            links += tag == "a"
            article = parent.in_article or tag in ARTICLE
            own = stack.open[stack.blocks[-1]].tag
            verdict = left_out(tag, attributes, article, own in SENTENCE)
            if verdict > HARD and not parent.hard:
                close_block()
            path = paths.setdefault((parent.path, tag), len(paths) + 1) if tag in BLOCK else parent.path
            hinted = parent.hinted
            if verdict > HARD:
                n_hints += 1
                hints[n_hints] = [hinted, verdict, False]
                hinted = n_hints
            if (tag == "h1" or tag in ARTICLE) and hinted:
                hints[hinted][2] = True
            if tag in BLOCK:
                parents.append(parent.number)
                tags.append(tag)
            stack.push(Element(tag, path, len(parents) - 1 if tag in BLOCK else parent.number, article, parent.hard or verdict == HARD, hinted))
        else:
            i = stack.last((tag,))
            if tag in BLOCK:
                close_block()
            elif stack.blocks[-1] > i:
                i = 0
            if i:
                e, outer = stack.open[i], stack.open[i - 1]
                if tag not in BLOCK and e.hinted != outer.hinted:
                    close_block()
                stack.cut(i)
    close_block()
    return Page(out, parents, tags, hints)


def decoded(text: str) -> str:
    """Character references decoded once; where &amp; is the only one, without the general search."""
    return text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else html.unescape(text)


def smooth(values: np.ndarray) -> np.ndarray:
    """Neighbours weigh half as much as a block itself."""
    padded = np.pad(values, 1, mode="edge")
    return (padded[:-2] + 2 * padded[1:-1] + padded[2:]) / 4


def judged(page: Page) -> list[Block]:
    """The blocks outside hinted elements, but for those that wrap most of the page: never comments, others only around a title or an article."""
    total = sum(len(b.text) for b in page.blocks)
    size, count = dict.fromkeys(page.hints, 0), dict.fromkeys(page.hints, 0)
    for b in page.blocks:
        if b.hinted:
            size[b.hinted] += len(b.text)
            count[b.hinted] += 1
    for h in reversed(page.hints):  # from the inner ones to those around them
        outer, _, titled = page.hints[h]
        if outer:
            size[outer] += size[h]
            count[outer] += count[h]
            page.hints[outer][2] |= titled
    kept = {0}
    for h, (outer, kind, titled) in page.hints.items():
        if outer in kept and (kind == FORM or kind == HINT and titled) and count[h] >= WRAPPED and size[h] > MOST * total:
            kept.add(h)
    return [b for b in page.blocks if b.hinted in kept]


def passing(found: list[Block]) -> set[int]:
    """The paths whose smoothed and fused ratios of text and punctuation reach the threshold."""
    totals: dict[int, list[float]] = {}
    for b in found:
        t = totals.setdefault(b.path, [0.0, 0.0, 0.0])
        t[0] += len(b.text)
        t[1] += sum(map(b.text.count, PUNCTUATION))
        t[2] += 1
    ratio = np.array([(totals[b.path][0] / totals[b.path][2], totals[b.path][1] / totals[b.path][2]) for b in found])
    fused = smooth(ratio[:, 0]) * (1 + smooth(ratio[:, 1]))
    least = THRESHOLD * fused.std()
    return {b.path for b, f in zip(found, fused.tolist()) if f >= least}


def menus(page: Page, found: list[Block]) -> set[int]:
    """The lists and boxes of nothing but links."""
    text, linked, links = {}, {}, {}
    for b in found:
        g = group_of(page, b.element)
        text[g] = text.get(g, 0) + len(b.text)
        linked[g] = linked.get(g, 0) + b.linked * len(b.text)
        links[g] = links.get(g, 0) + b.links
    return {g for g in text if links[g] >= LINKS and linked[g] >= LINKED * text[g]}


def group_of(page: Page, element: int) -> int:
    """The list or table that an item or cell belongs to, else the element itself."""
    at = element
    while page.tags[at] in ROWS:
        at = page.parents[at]
    return at if page.tags[at] in LISTS else element


def content(page: Page) -> list[str]:
    """The texts of the content blocks."""
    found = judged(page)
    if not found:
        return []
    passed, links = passing(found), menus(page, found)
    is_menu = [group_of(page, b.element) in links for b in found]
    good = [b.path in passed and not m for b, m in zip(found, is_menu)]
    weight = sum(len(b.text) for b, g in zip(found, good) if g)
    n = len(page.parents)
    sums, count, marks, has_good, has_part = [0] * n, [0] * n, [0] * n, [False] * n, [t in PARTS or t in HEADINGS for t in page.tags]
    for b, g in zip(found, good):
        sums[b.element] += len(b.text) * g
        count[b.element] += 1
        marks[b.element] += sum(map(b.text.count, PUNCTUATION))
        has_good[b.element] |= g
    for e in range(n - 1, 0, -1):  # an element comes after its parent
        up = page.parents[e]
        sums[up] += sums[e]
        count[up] += count[e]
        marks[up] += marks[e]
        has_good[up] |= has_good[e]
        has_part[up] |= has_part[e]
    inside = [False] * n
    if any(b.in_article for b in found) and 2 * sum(len(b.text) for b, g in zip(found, good) if g and b.in_article) >= weight:
        for e in range(1, n):
            bare = count[e] >= LINKS and not (marks[e] or has_good[e] or has_part[e])
            inside[e] = page.tags[e] in ARTICLE or inside[page.parents[e]] and not bare
        stays = [inside[b.element] for b in found]
    else:
        region = max((e for e in range(n) if sums[e] >= NEARLY_ALL * weight), default=0)
        inside[region] = True
        for e in range(region + 1, n):
            inside[e] = inside[page.parents[e]] and (page.parents[e] != region or has_good[e] or has_part[e])
        stays = [g or inside[b.element] and (b.element != region or b.path in passed) for b, g in zip(found, good)]
    kept, leads = [], False
    for b, m, s in reversed(list(zip(found, is_menu, stays))):  # a heading is kept with what follows it
        inside_it = s and not m
        if inside_it or leads and b.tag in HEADINGS:
            kept.append(b.text)
        leads = inside_it or leads and b.tag in HEADINGS
    return kept[::-1]


def main_text(page: str) -> str:
    return "\n\n".join(content(parsed(page)))


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row: the main text of the whole page and its code points.

    Character references are decoded, white space inside a block becomes one space, blocks are joined by an empty
    line. A null or empty page has an empty text; a very long page is read in one pass, in time and memory that grow with
    its length; blocks of equal scores are kept or left out alike; a null id or url stays null; repeated rows come back as often as
    they occur; an empty table gives no rows. Other columns are left out, whatever their names.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(page) for page in texts_of(part, "html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
                )

    pages = bounded(df).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return pages.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
