"""Main text of a web page by line-block distribution.

Markup becomes lines: every block element starts a line, inline markup leaves its text in the line. A line weighs its
characters outside links. Weights are summed over windows of WINDOW lines: a run of text reaches from the first line of
a window above nothing to the dive, where the windows fall to nothing again. Where a window of a run rises to RISE
(surge), the run is text of the page; if none does, the heaviest run is.

Runs too light for a surge are kept where they belong to the text: between two kept runs; opened by a heading that
text follows; or paragraphs inside the container (the innermost element around the heaviest run), or beside a heavy
paragraph. Short lines in plain elements before a run's first-level heading are left out. Where the page marks its text by
an article (or main) element, that element is the bound and all lines in it are text.

Left out before: elements that are never main text (menus, headers, footers, asides, forms, hidden ones), and elements
with a class, id or role that names such a part. A name counts as a whole: each of its words is a mark or says only
where or what box it is, so that "site-footer" is one and "form-of-government" isn't. A mark that also names subjects
("legal", "search") needs a second witness: less than MUCH characters outside links, or half of its text in links.
A marked element around the page's main element isn't left out. Each chunk left out becomes WINDOW empty lines.

Defined results: null, empty and text-free pages give the empty text; broken or unclosed markup is read as far as it
goes; repeated rows and ids are extracted row by row.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapscope.llm.common import bounded_batches

WINDOW = 3
RISE = 80
MUCH = 200

# Fixed values of HTML: elements whose content is never text, that are never main text, that don't break a line,
# and that have no content.
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button datalist".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = ("article", "main")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p blockquote pre dd dt figcaption".split())
# Words of class, id and role that name what isn't main text; those that name subjects too; those that only say where
# or what box it is; and those that mark a name whatever else is in it.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "footer sidebar aside widget related recommended share sharing cookie cookies consent gdpr notice notices popup modal overlay newsletter "
    "subscribe subscription signup comment comments commentlist respond disqus pagination pager complementary contentinfo".split()
)
SUBJECTS = frozenset(
    "promo promotion banner header masthead rail social alert login search form reply replies discussion tags toc skip copyright legal "
    "disclaimer hidden".split()
)
PLACES = frozenset(
    "site page main global top bottom left right inner outer list item items box block section area wrap wrapper container content slot bar "
    "unit link links button buttons post posts articles stories reader readers user users text group panel row col column body primary "
    "secondary mobile desktop sticky fixed".split()
)
ALWAYS = frozenset("comments commentlist disqus breadcrumb breadcrumbs advert adverts advertisement sponsored gdpr".split())
SAYS_WHETHER = frozenset("has no with without".split())
REMARKS = frozenset("comment comments reply related teaser advert".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_MARK = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}


def named(value: str, tag: str) -> int:
    """What the names in a class, id or role say: 2 not main text, 1 perhaps not, 0 nothing."""
    found = 0
    for name in value.strip("\"'").split():
        words = _MARK.findall(_CAMEL.sub(" ", name).lower())
        if not words or words[0] in SAYS_WHETHER:
            continue
        if tag in MAIN:
            found = max(found, 2 * (not REMARKS.isdisjoint(words)))
        elif not ALWAYS.isdisjoint(words):
            found = 2
        elif all(w in MARKS or w in SUBJECTS or w in PLACES for w in words):
            found = max(found, 2 if not MARKS.isdisjoint(words) else 1 if not SUBJECTS.isdisjoint(words) else 0)
    return found


def is_boilerplate(tag: str, attributes: str, in_main: bool) -> int:
    """3 by its element or because it is hidden, else by its names. A header inside the article belongs to the article."""
    if tag in BOILERPLATE and not (tag == "header" and in_main):
        return 3
    found = 0
    if attributes and tag not in ("html", "body"):
        for name, value in _ATTRIBUTE.findall(attributes):
            name = name.lower()
            if name == "hidden" or name == "aria-hidden" and "true" in value:
                return 3
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return 3
            if name in ("class", "id", "role"):
                found = max(found, named(value, tag))
    return found


class Line(NamedTuple):
    text: str
    weight: int
    inside: bool  # of the article
    block: int  # the innermost block element around it


EMPTY = Line("", 0, False, 0)


class Page:
    """Lines of a page, and its block elements by number with their tags and parents; 0 is the page itself."""

    def __init__(self, page: str) -> None:
        self.tags, self.parents = ["body"], [0]
        # Marked elements by number: sure or not, the marked one around, characters, those in links, around the main element.
        self._sure, self._outer, self._chars, self._linked, self._around = [False], [0], [0], [0], [False]
        self.lines = self._kept(self._read(page))

    def _read(self, page: str) -> list[tuple[Line, int]]:
        lines: list[tuple[Line, int]] = []
        buffer: list[str] = []
        linked, links, mains, mark, block = 0, 0, 0, 0, 0
        stack: list[tuple[str, int, int]] = []  # tag, and the block and mark around the element
        is_open: Counter = Counter()
        off: int | None = None  # depth of the element that is left out

        def end_line() -> None:
            nonlocal linked
            text = _SPACE.sub(" ", _html.unescape("".join(buffer))).strip()
            lines.append((Line(text, max(len(text) - linked, 0), mains > 0, block), mark))
            self._chars[mark] += len(text)
            self._linked[mark] += min(linked, len(text))
            buffer.clear()
            linked = 0

        at = 0
        while True:
            token = _TOKEN.search(page, at)
            text = page[at : token.start() if token else len(page)]
            if text and off is None:
                buffer.append(text)
                if links:
                    linked += len(_html.unescape(text))
            if token is None:
                break
            at = token.end()
            if token.group(2) is None:
                continue
            tag, closing = token.group(2).lower(), bool(token.group(1))
            if closing:
                if is_open[tag]:
                    while True:
                        top, around, outer = stack[-1]
                        if off is None and (top not in INLINE or outer != mark):
                            end_line()
                        stack.pop()
                        is_open[top] -= 1
                        links = max(links - (top == "a" and off is None), 0)
                        mains -= top in MAIN
                        block, mark = around, outer
                        if off is not None and len(stack) <= off:
                            off = None
                            lines.extend([(EMPTY, mark)] * WINDOW)
                        if top == tag:
                            break
                elif off is None and tag not in INLINE:
                    end_line()
                continue
            if tag in _RAW:
                end = _RAW[tag].search(page, at)
                at = end.end() if end else len(page)
                continue
            if off is None and tag not in INLINE:
                end_line()
            if tag in VOID or token.group(3).endswith("/") and tag in INLINE:
                continue
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                _, block, mark = stack.pop()  # these end where the next one begins
                is_open[tag] -= 1
            found = 3 if tag in SILENT else is_boilerplate(tag, token.group(3), mains > 0) if off is None else 0
            if found and off is None:
                end_line()
            if found == 3 and off is None:
                off = len(stack)
            stack.append((tag, block, mark))
            is_open[tag] += 1
            if off is None:
                if 0 < found < 3:
                    for values, value in ((self._sure, found == 2), (self._outer, mark), (self._chars, 0), (self._linked, 0), (self._around, False)):
                        values.append(value)
                    mark = len(self._sure) - 1
                if tag not in INLINE and tag not in ("html", "body"):
                    self.tags.append(tag)
                    self.parents.append(block)
                    block = len(self.tags) - 1
                if tag == "main":
                    self._around[mark] = True
            mains += tag in MAIN
            links += tag == "a" and off is None
        end_line()
        return lines

    def _kept(self, lines: list[tuple[Line, int]]) -> list[Line]:
        """The lines outside marked elements; each chunk of others as WINDOW empty ones."""
        for m in range(len(self._outer) - 1, 0, -1):  # inner ones have higher numbers
            self._chars[self._outer[m]] += self._chars[m]
            self._linked[self._outer[m]] += self._linked[m]
            self._around[self._outer[m]] |= self._around[m]
        left_out = [False]
        for m in range(1, len(self._outer)):
            light = self._chars[m] - self._linked[m] < MUCH or 2 * self._linked[m] >= self._chars[m]
            left_out.append(left_out[self._outer[m]] or not self._around[m] and (self._sure[m] or light))
        kept: list[Line] = []
        before = False
        for line, mark in lines:
            if not left_out[mark]:
                kept.append(line)
            elif not before:
                kept.extend([EMPTY] * WINDOW)
            before = left_out[mark]
        return kept

    def path(self, block: int) -> list[int]:
        """The element and those around it, up to the page."""
        path = [block]
        while path[-1]:
            path.append(self.parents[path[-1]])
        return path


def runs_of(weights: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(start, dive, heaviest window) of the runs: from a first line with weight until windows sum to nothing."""
    runs, start, top, total = [], None, 0, 0
    for at, w in enumerate(weights):
        total += w - (weights[at - window] if at >= window else 0)  # of the window that ends here
        if start is None and w:
            start, top = at, 0
        if start is not None:
            top = max(top, total)
            if total == 0:
                runs.append((start, at, top))
                start = None
    if start is not None:
        runs.append((start, len(weights), top))
    return runs


def _container(page: Page, run: list[Line]) -> int:
    """The innermost element around the lines of a run, a paragraph's parent at least; 0 if that is the page."""
    blocks = {line.block for line in run if line.weight}
    common: list[int] | None = None
    for b in blocks:
        path = page.path(page.parents[b] if page.tags[b] in PARAGRAPHS else b)
        known = set(path)
        common = path if common is None else [c for c in common if c in known]
    return common[0] if common else 0


def text_runs(page: Page) -> list[tuple[int, int]]:
    """The ranges of lines that are text, on a page without an article element."""
    lines, tags, parents = page.lines, page.tags, page.parents
    runs = runs_of([line.weight for line in lines])
    if not runs:
        return []
    heaviest = max(runs, key=lambda r: sum(line.weight for line in lines[r[0] : r[1]]))
    surged = [r[2] >= RISE for r in runs]
    surged[runs.index(heaviest)] = True
    container = _container(page, lines[heaviest[0] : heaviest[1]])
    within = {0: False, container: container > 0}
    for b in range(1, len(tags)):  # parents have lower numbers
        within[b] = b == container > 0 or within[parents[b]]
    beside = {parents[line.block] for line in lines if line.weight >= RISE and tags[line.block] in PARAGRAPHS}

    def belongs(start: int, end: int) -> bool:
        mine = [line for line in lines[start:end] if line.weight]
        if tags[mine[0].block] in HEADINGS and len(mine) > 1:
            return True
        return all(line.block == container > 0 or tags[line.block] in PARAGRAPHS and (within[line.block] or parents[line.block] in beside) for line in mine)

    kept = [s or belongs(r[0], r[1]) for s, r in zip(surged, runs)]
    first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
    out = []
    for start, end, _ in runs[first : last + 1]:
        head = next((at for at in range(start, end) if tags[lines[at].block] == "h1" and lines[at].weight), start)
        if all(line.weight < RISE and tags[line.block] not in PARAGRAPHS for line in lines[start:head]):
            start = head
        out.append((start, end))
    return out


def main_text(html: str) -> str:
    page = Page(html)
    inside = [line.text for line in page.lines if line.inside and line.text]
    return " ".join(inside or [line.text for a, b in text_runs(page) for line in page.lines[a:b] if line.text])


def _extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py() or "") for p in pages], pa.string())


def text_of(html: str) -> Column:
    return F.arrow_udf(_extract, "string")(html)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    bounded_batches(pages)
    out = pages.select("page_id", "url", text_of("html").alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
