"""Main text of web pages by tag-path ratios.

A page is parted into blocks of text. Over all blocks with the same root-to-leaf tag path, the length of the text, its
punctuation and the text inside links are summed; text and punctuation for each block are two ratios of the path. Both
are smoothed over the page's order, fused, and paths over a threshold hold the content; outside an <article> or <main> the
threshold is higher if the page has one. The blocks kept are those of all content paths, and the headings, paragraphs, lists and tables
that stand beside them in the same box; blocks of links count only in an <article> or <main>, elsewhere they are menus. Parts that say what
they are by tag or name (menus, headers, footers, sidebars, notices, adverts, forms, comments) never are content.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, batch_of, column

#: Weights of a block's two neighbours in smoothing; share of the mean fused ratio that content paths reach; share of link text over which a path is a menu; factor of the threshold outside an article or main part.
SMOOTH, THRESHOLD, LINKS, OUTSIDE = 0.25, 0.5, 0.6, 2.0

#: Share of the page's text over which a part that is named as no content holds the article after all.
MOST = 0.5

# Elements that hold no main text, end tags that are implied, inline elements, names of parts that are not content.
SKIPPED = frozenset("nav header footer aside form script style noscript template svg iframe object select button textarea head title menu dialog canvas audio video map".split())
RAW = frozenset("script style textarea title noscript iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("ul ol dl table td th article section div body html".split())
NOT_CONTENT = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription "
    "sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer masthead header comment comments commentlist reply replies disqus respond share sharing social related recommended recommendations "
    "login signup register search toolbar pagination pager copyright disclaimer widget widgets skip sitemap discussion discussions gdpr".split()
)
# Of these the words that tell by any part of a token, as in user-comments; and those that never are the name of the article itself, whatever its share.
TELLING = frozenset("ads advert adverts advertisement advertising sponsored promo banner cookie cookies consent gdpr newsletter popup modal sidebar comment comments commentlist disqus discussion discussions".split())
NEVER = frozenset("ads advert adverts advertisement advertising banner cookie cookies consent gdpr popup comment comments commentlist disqus".split())

# Words that say nothing about a part beside one of NOT_CONTENT, as in site-footer; elements of running text inside a box.
NEUTRAL = frozenset("site page main global primary secondary top bottom left right bar box area list block section wrapper wrap container inner links link items item post entry article content".split())
# Names of boxes around several parts: what starts with one of the first and ends with one of the others holds the content too, as in content-sidebar-wrap.
HOLDS, WRAPS = frozenset("content main article primary".split()), frozenset("wrap wrapper container inner area".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption details summary address center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none")
_PARTS = re.compile(r"[^a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?¿¡。，、；：！？]")
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


class Block:
    """A block of text: the number of its tag path, of the innermost part around it that is named as no content (or -1), and its pieces."""

    __slots__ = ("path", "part", "skip", "parts", "links")

    def __init__(self, path: int, part: int, skip: bool):
        self.path, self.part, self.skip, self.parts, self.links = path, part, skip, [], 0


class Paths:
    """Root-to-leaf tag paths as numbers: a path is its parent's number and a step. 0 is the root."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, str], int] = {}
        self.parent, self.top, self.hinted, self.heading, self.box = [0], [True], [False], [False], [0]

    def child(self, parent: int, tag: str, step: str) -> int:
        """box: the path up to its last element that isn't running text. top: whether it ends at html or body."""
        found = self.number.get((parent, step))
        if found is None:
            found = self.number[parent, step] = len(self.parent)
            self.parent.append(parent)
            self.top.append(tag in ("html", "body"))
            self.hinted.append(self.hinted[parent] or tag in ("article", "main"))
            self.heading.append(self.heading[parent] or tag in HEADINGS)
            self.box.append(self.box[parent] if tag in TEXTUAL else found)
        return found


def names_of(attributes: str) -> tuple[set[str], bool, set[str]]:
    """The letters of each word in class, id and role; whether the element is hidden; the words that name it as no content."""
    names, hidden, gone = set(), False, set()
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "role"):
            for token in value.split():
                ordered = [p for p in _PARTS.split(token) if p]
                parts = set(ordered)
                names |= parts
                around = bool(ordered) and ordered[0] in HOLDS and ordered[-1] in WRAPS
                if not around and (parts <= NOT_CONTENT | NEUTRAL or not TELLING.isdisjoint(parts)):
                    gone |= parts & NOT_CONTENT
        elif key == "hidden" or (key == "aria-hidden" and value.strip() == "true") or (key == "style" and _NO_DISPLAY.search(value)):
            hidden = True
    return names, hidden, gone


class Scanner:
    """Markup of a page, one piece after the other; no character is looked at more than a few times."""

    def __init__(self, page: str) -> None:
        self.page, self.last, self.quotes, self.cdata = page, page.rfind(">"), True, True

    def end_of_tag(self, at: int) -> int:
        """The place of the > that ends a tag, quoted ones aside. From the first quote on that is never closed quotes count no more."""
        if self.quotes:
            k = at
            while m := _STOP.search(self.page, k):
                if m[0] == ">":
                    return m.start()
                k = self.page.find(m[0], m.end()) + 1
                if not k:
                    self.quotes = False
                    break
        return self.page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str]:
        """(start, end, tag, whether it closes, attributes) of the next markup; comments and declarations have no tag. start is the page's end if there is none."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, "", False, ""
            if start > self.last:
                # No tag ends any more; a comment still can begin.
                at = page.find("<!--", start)
                if at < 0:
                    break
                continue
            if self.cdata and page.startswith("<![CDATA[", start):
                end = page.find("]]>", start)
                if end >= 0:
                    return start, end + 3, "", False, ""
                self.cdata = False
            if page.startswith(("<!", "<?"), start):
                return start, page.find(">", start) + 1, "", False, ""
            if m := _TAG.match(page, start):
                end = self.end_of_tag(m.end())
                if end >= 0:
                    return start, end + 1, m[2].lower(), bool(m[1]), page[m.end() : end]
            at = start + 1
        return len(page), len(page), "", False, ""


class Page:
    """The blocks of a page in its order, their paths, and the parts that are named as no content."""

    def __init__(self, page: str) -> None:
        self.blocks: list[Block] = []
        self.paths = Paths()
        #: Of each part: the part around it, the words that name it, whether an article, main part or h1 begins in it.
        self.around: list[int] = []
        self.words: list[set[str]] = []
        self.core: list[bool] = []
        self.has_article = False  # or a main part
        self._current: Block | None = None
        self._stack: list[tuple[str, bool, int, int]] = []  # element, whether it is skipped, its path, its part
        self._open: Counter[str] = Counter()
        self._scopes: list[Counter[str]] = [Counter()]  # open elements of each scope
        self._read(page)

    def _text(self, piece: str) -> None:
        _, skip, path, part = self._stack[-1] if self._stack else ("", False, 0, -1)
        if self._current is not None and (self._current.skip, self._current.part) != (skip, part):
            if skip or part != self._current.part and part >= 0 and self._stack[-1][0] in INLINE:
                return  # an inline part of a block that isn't content, such as a share button
            self._current = None
        if not piece or (self._current is None and not piece.strip()):
            return
        if self._current is None:
            self._current = Block(path, part, skip)
            self.blocks.append(self._current)
        self._current.parts.append(piece)
        if self._open["a"]:
            self._current.links += len(piece.strip())

    def _push(self, tag: str, skip: bool, path: int, part: int) -> None:
        self._stack.append((tag, skip, path, part))
        self._open[tag] += 1
        if tag in SCOPES:
            self._scopes.append(Counter())
        self._scopes[-1][tag] += 1

    def _pop_to(self, tags: frozenset[str] | set[str]) -> None:
        """Closes elements up to the innermost of tags, of which one must be open."""
        while True:
            tag = self._stack.pop()[0]
            self._open[tag] -= 1
            self._scopes[-1][tag] -= 1
            if tag in SCOPES:
                self._scopes.pop()
            if tag not in INLINE:
                self._current = None
            if tag in tags:
                return

    def _read(self, page: str) -> None:
        scanner, at, end = Scanner(page), 0, len(page)
        while at < end:
            start, after, tag, closes, attributes = scanner.next(at)
            self._text(page[at:start])
            at = after
            if not tag:
                continue
            if closes:
                if self._open[tag]:
                    self._pop_to({tag})
            elif tag == "br":
                self._text(" ")
            else:
                at = self._begin(page, tag, attributes, at)

    def _begin(self, page: str, tag: str, attributes: str, at: int) -> int:
        if tag in ENDS_P:
            self._current = None
            if self._scopes[-1]["p"]:
                self._pop_to({"p"})
        if any(self._scopes[-1][t] for t in CLOSES.get(tag, ())):
            self._pop_to(CLOSES[tag])
        if tag in VOID:
            return at
        if tag in RAW:
            closed = _END[tag].search(page, at)
            return closed.end() if closed else len(page)
        names, hidden, words = names_of(attributes)
        _, skip, path, part = self._stack[-1] if self._stack else ("", False, 0, -1)
        whole = tag in ("html", "body", "article", "main")
        skip = skip or tag in SKIPPED or (hidden and not whole)
        if whole or tag == "h1":
            self.has_article = self.has_article or tag in ("article", "main")
            if not words and part >= 0 and not self.core[part]:
                self._mark(part)
        elif words:
            self.around.append(part)
            self.words.append(words)
            self.core.append(False)
            part = len(self.words) - 1
        if tag not in INLINE:
            self._current = None
            path = self.paths.child(path, tag, tag + "".join(f".{n}" for n in sorted(names)))
        if not attributes.rstrip().endswith("/") or tag not in INLINE:
            self._push(tag, skip, path, part)
        return at

    def _mark(self, part: int) -> None:
        while part >= 0 and not self.core[part]:
            self.core[part] = True
            part = self.around[part]

    def found(self) -> list[tuple[int, str, int]]:
        """(path, text, characters in links) of the blocks that can be content.

        A part that is named as no content goes, unless it holds most of the page's text: then the name tells of something else. If the page has an article or main
        part, or the name is one such as comments, there must be an article, main part or h1 in it for that. If nothing else is left, the share alone decides.
        """
        texts = [(b, " ".join(html.unescape("".join(b.parts)).split())) for b in self.blocks if not b.skip]
        texts = [(b, t) for b, t in texts if t]
        size = [0] * len(self.words)
        for b, t in texts:
            if b.part >= 0:
                size[b.part] += len(t)
        for k in range(len(size) - 1, -1, -1):
            if self.around[k] >= 0:
                size[self.around[k]] += size[k]
        total = sum(len(t) for _, t in texts)
        for strict in (True, False):
            gone: list[bool] = []
            for k, around in enumerate(self.around):
                kept = size[k] > MOST * total and (not strict or self.core[k] or (not self.has_article and NEVER.isdisjoint(self.words[k])))
                gone.append(not kept or (around >= 0 and gone[around]))
            left = [(b.path, t, b.links) for b, t in texts if b.part < 0 or not gone[b.part]]
            if left:
                break
        return left


def extract(page: str, threshold: float = THRESHOLD, smooth: float = SMOOTH) -> str:
    """The page's main text, its blocks joined by line breaks."""
    read = Page(page)
    found, paths = read.found(), read.paths
    if not found:
        return ""
    number = {p: k for k, p in enumerate(dict.fromkeys(f[0] for f in found))}
    of = np.array([number[f[0]] for f in found])
    count = np.bincount(of)
    total = lambda values: np.bincount(of, np.array(values, dtype=float))
    length = total([len(t) for _, t, _ in found])
    linked = total([n for *_, n in found]) / length
    ratios = []
    for sums in (length, total([len(_PUNCTUATION.findall(t)) for _, t, _ in found])):
        by_block = (sums / count)[of]
        ordered = np.r_[by_block[:1], by_block, by_block[-1:]]
        even = smooth * ordered[:-2] + (1 - 2 * smooth) * by_block + smooth * ordered[2:]
        ratios.append(even / max(even.mean(), 1e-9))
    fused = np.bincount(of, np.sqrt(ratios[0] * (ratios[1] + 0.1))) / count
    hinted = np.array([paths.hinted[p] for p in number])
    least = threshold * np.average(fused, weights=length) * np.where(hinted | (not hinted.any()), 1, OUTSIDE)
    content = (fused >= least) & (linked <= LINKS)
    if not content.any():
        return ""
    # A path's box ends with its last element that isn't running text; headings are also taken from the boxes around it.
    held = {paths.box[p] for p, k in number.items() if content[k]}
    around: set[int] = set()
    for box in held:
        while box and (box := paths.parent[box]) not in around:
            around.add(box)
    beside = lambda p: paths.box[p] in held or (paths.box[p] in around and not paths.top[paths.box[p]] and paths.heading[p])
    keep = {p: bool(content[k]) or (beside(p) and (linked[k] <= LINKS or bool(hinted[k]))) for p, k in number.items()}
    return "\n".join(t for p, t, _ in found if keep[p])


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(page_id, url, text, n_chars), a row for each of pages.

    Null or empty html, and pages without content, have an empty text. Null ids and urls and repeated rows are kept as they
    are; other columns are left out. Empty table: no rows.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(h) for h in column(batch, "html")]
        return batch_of(page_id=(batch.column(0), pa.int64()), url=(batch.column(1), pa.string()), text=(texts, pa.string()), n_chars=(list(map(len, texts)), pa.int64()))

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return arrow_map(rows, kernel, "page_id long, url string, text string, n_chars long")
