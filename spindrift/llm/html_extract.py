"""Main text of web pages by tag-path ratios.

A page is cut into blocks: the text between two block-level tags. Each block has a tag path, the block-level elements
(with their classes) from the root to it. Text outside links and punctuation are summed for each tag path, divided by
its blocks and fused. A path is content if its ratio, smoothed with those of its neighbours in the same container,
reaches a share of the page's own level; what is below stays out, whether or not an element's name tells what it is.

Element names and roles that are no part of an article (menus, headers, footers, sidebars, adverts, forms, scripts) are
left out beforehand, and so are elements whose class or id says so; a class word drops no article or main, nor what holds
the article, its title or most of the page's text, and a form around the page is none. An article or main element is a prior: the one with the most scored text bounds
the blocks, unless the rest of the page outweighs it ``REGION`` times.

Pages are independent: there is no shuffle, and a task holds one Arrow batch of pages. A page costs time and memory in
proportion to its length, also if it is a hundred thousand elements deep.

Defined cases: null or empty html has an empty text; a page cut off in a tag, comment or script ends there; a page
without content has an empty text; repeated rows are each extracted; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import map_batches

#: A comment, an element whose content is no text, a tag, or what a cut page ends with.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|textarea|select|math|canvas|audio|video|title)\b[^>]*+>.*?(?:</\1\s*+[^>]*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("head nav footer aside button dialog menu fieldset".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
_CLASSES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars aside rail nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer header masthead topbar toolbar comment comments commentlist respond disqus reply replies share sharing social related recommended recommendations "
    "pagination pager widget widgets search skip".split()
)
#: Class words of what may hold an article's title, and those that may also name a paragraph of prose.
_HEADERS = frozenset("header masthead banner".split())
_WEAK = frozenset("share sharing social related recommended search skip header promo promotion".split())
#: Characters outside links from which a paragraph with a weak word is prose.
PROSE = 80
_REGIONS = frozenset(("article", "main"))
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li".split())
#: By element: those that its start closes, and those within which it does not.
_SIBLINGS = {
    "li": (("li",), frozenset(("ul", "ol", "menu"))),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "tr": (("tr",), frozenset(("table",))),
    "td": (("td", "th"), frozenset(("tr", "table"))),
    "th": (("td", "th"), frozenset(("tr", "table"))),
    "option": (("option",), frozenset(("select",))),
}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is text, and those that only group such.
_TEXTUAL = _HEADINGS | frozenset("p li dt dd td th blockquote pre caption figcaption address".split())
_GROUPS = frozenset("ul ol dl li table tbody thead tfoot tr td blockquote figure hgroup".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")
#: Share of linked text from which a path is a list of links.
LINKS = 0.6
#: Share of the page's level (the ratio of its median character) from which a path is content.
SHARE = 0.15
#: So many times an article's scored text must be outweighed by the rest of the page to bound nothing.
REGION = 4


class Page:
    """A page's elements, numbered as they open (so a parent's number is smaller), and its blocks in order.

    An element knows its parent and its tag path; a block knows the element that holds it. Nothing is copied down the
    tree, so a page costs time and memory in proportion to its length, however deep it is.
    """

    def __init__(self) -> None:
        self.names: list[str] = []
        self.parents: list[int] = []
        self.paths: list[int] = []
        self.dropped: list[bool] = []
        self.doubts: dict[int, frozenset[str]] = {}
        self.forms: list[int] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.above: list[int] = []
        self.leaves: list[str] = []
        self.blocks: list[Block] = []

    def open(self, name: str, attributes: str, parent: int, in_region: bool) -> int:
        words, classes, role = _attributes(attributes)
        number = len(self.names)
        self.names.append(name)
        self.parents.append(parent)
        key = (self.paths[parent] if parent >= 0 else -1, f"{name}.{classes}" if classes else name)
        path = self.steps.get(key)
        if path is None:
            path = self.steps[key] = len(self.above)
            self.above.append(key[0])
            self.leaves.append(name)
        self.paths.append(path)
        out = name in _DROPPED or (name == "header" and not in_region) or (role in _ROLES and name not in ("html", "body", "main"))
        self.dropped.append(out or (parent >= 0 and self.dropped[parent]))
        if name == "form" or role == "form":
            self.forms.append(number)
        if in_region:  # the head of an article is part of it, as for the element
            words -= {"header"}
        if words and name not in ("html", "body", *_REGIONS):
            self.doubts[number] = words
        return number

    def below(self, own: dict[int, float]) -> list[float]:
        """For each element the sum over it and all below it of values given by element."""
        total = [0.0] * len(self.names)
        for number, value in own.items():
            total[number] += value
        for number in range(len(total) - 1, 0, -1):
            if self.parents[number] >= 0:
                total[self.parents[number]] += total[number]
        return total

    def marked(self, which: Iterable[int]) -> list[bool]:
        """For each element whether it is one of which or lies in one."""
        out = [False] * len(self.names)
        for number in which:
            out[number] = True
        for number, parent in enumerate(self.parents):
            if parent >= 0 and out[parent]:
                out[number] = True
        return out


class Block:
    __slots__ = ("text", "at", "linked")

    def __init__(self, text: str, at: int, linked: int):
        self.text, self.at, self.linked = text, at, min(linked, len(text))


def _attributes(attributes: str) -> tuple[frozenset[str], str, str]:
    """Words of class and id that speak against an element, its classes as a step of a path has them, and its role."""
    if not attributes or "=" not in attributes:
        return frozenset(), "", ""
    words: set[str] = set()
    classes = role = ""
    for key, *values in _ATTRIBUTE.findall(attributes):
        value, key = "".join(values), key.lower()
        if key == "role":
            role = value.strip().lower()
            continue
        words |= _CLASSES.intersection(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()))
        if key == "class":
            classes = " ".join(sorted(re.sub(r"\d+", "", value).split()))
    return frozenset(words), classes, role


def parse(html: str) -> Page:
    """The elements and blocks of a page."""
    page = Page()
    stack: list[int] = []
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked = in_link = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            page.blocks.append(Block(text, stack[-1] if stack else page.open("body", "", -1, False), linked))
        pieces.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if in_link:
            linked += len(text.strip())

    def pop(to: int) -> None:
        nonlocal in_link
        in_link = 0
        opened.subtract(page.names[x] for x in stack[to:])
        del stack[to:]

    def close(own: tuple[str, ...], stop: frozenset[str]) -> None:
        """Close the innermost open element of own, unless one of stop comes first."""
        if any(opened[x] for x in own):
            for i in range(len(stack) - 1, -1, -1):
                name = page.names[stack[i]]
                if name in own:
                    pop(i)
                    break
                if name in stop:
                    break

    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        closing, name, attributes = (m[2], m[3], m[4]) if m[3] else (m[5], m[6], m[7])
        if not name:
            if m[1]:
                flush() if m[1].lower() not in ("svg", "math") else pieces.append(" ")
            continue
        name = name.lower()
        if name in _INLINE:
            if name == "br":
                pieces.append(" ")
            elif name == "a":
                in_link = 0 if closing else 1
            continue
        flush()
        if closing:
            close((name,), frozenset())
            continue
        if name in _VOID:
            continue
        if name in _CLOSES_P:
            close(("p",), _CLOSES_P)
        if name in _SIBLINGS:
            close(*_SIBLINGS[name])
        stack.append(page.open(name, attributes, stack[-1] if stack else -1, any(opened[x] for x in _REGIONS)))
        opened[name] += 1
    if at < len(html):
        add(html[at:])
    flush()
    return page


def _outside_forms(page: Page, found: list[Block]) -> list[Block]:
    """The blocks outside forms. A form around the page, as some page frameworks write it, is none: one that holds an
    article or main, the heading of the page, or most of the text of its paragraphs."""
    if not page.forms:
        return found
    paragraphs: dict[int, float] = {}
    for b in found:
        if page.names[b.at] == "p":
            paragraphs[b.at] = paragraphs.get(b.at, 0) + len(b.text) - b.linked
    prose = page.below(paragraphs)
    marks = {k: 1.0 for k, name in enumerate(page.names) if name in ("article", "main", "h1")}
    holds, every = page.below(marks), sum(paragraphs.values())
    gone = page.marked(k for k in page.forms if not holds[k] and not (prose[k] >= PROSE and 2 * prose[k] > every))
    return [b for b in found if not gone[b.at]]


def _undoubted(page: Page, found: list[Block]) -> list[Block]:
    """The blocks outside elements that class words speak against. Such words count against an element unless it holds the
    article, or those with its words hold most of the article's text, links left out. The article is the article or main
    with the most text, within a doubted element only if it has as much text as all that is not doubted; without one it
    is the page. Words of headers do not count against what holds the article's first h1, and weak words not against a
    paragraph of prose."""
    own: dict[int, float] = {}
    for b in found:
        own[b.at] = own.get(b.at, 0) + len(b.text) - b.linked
    mass = page.below(own)
    for number in [k for k, words in page.doubts.items() if words <= _WEAK and page.names[k] in _TEXTUAL and mass[k] >= PROSE]:
        del page.doubts[number]
    if not page.doubts:
        return found
    in_doubt = page.marked(page.doubts)
    clear = sum(n for at, n in own.items() if not in_doubt[at])
    regions = [k for k, name in enumerate(page.names) if name in _REGIONS and mass[k] and (mass[k] >= clear or not in_doubt[k])]
    article = max(regions, key=lambda k: (mass[k], -k), default=None)
    inside = page.marked([article]) if article is not None else [True] * len(page.names)
    total = mass[article] if article is not None else sum(own.values())
    # The text of those with the same words, each text once: of nested ones the outermost counts.
    same: dict[frozenset[str], list[int]] = {}
    for number, words in page.doubts.items():
        if inside[number]:
            same.setdefault(words, []).append(number)
    most = set()
    for words, numbers in same.items():
        if sum(mass[k] for k in numbers) * 2 > total:
            within = page.marked(numbers)
            if 2 * sum(n for at, n in own.items() if within[at]) > total:
                most.add(words)
    holders = set()
    if article is not None:
        title = next((k for k in range(article, len(page.names)) if page.names[k] == "h1" and inside[k]), -1)
        while title > article:
            title = page.parents[title]
            if title in page.doubts and page.doubts[title] <= _HEADERS:
                holders.add(title)
    while article is not None and article >= 0:
        holders.add(article)
        article = page.parents[article]
    gone = page.marked(k for k, words in page.doubts.items() if k not in holders and not (inside[k] and words in most))
    return [b for b in found if not gone[b.at]]


def path_scores(page: Page, found: list[Block]) -> tuple[dict[int, float], set[int]]:
    """Fused ratio of each tag path, and the paths that are lists of links.

    The ratios of a path are its text outside links and its punctuation, each for one block of the path.
    """
    sums: dict[int, list[int]] = {}
    for b in found:
        s = sums.setdefault(page.paths[b.at], [0, 0, 0, 0])
        s[0] += 1
        s[1] += len(b.text)
        s[2] += len(_PUNCTUATION.findall(b.text))
        s[3] += b.linked
    scores = {p: (size - linked) / n * (1 + math.log1p(marks / n)) for p, (n, size, marks, linked) in sums.items()}
    return scores, {p for p, s in sums.items() if s[3] >= LINKS * s[1]}


def _container(page: Page, at: int) -> int:
    """The element that an element's text belongs to: the one above it, above the whole list or table for their parts."""
    parent = page.parents[at]
    while parent >= 0 and page.names[parent] in _GROUPS:
        parent = page.parents[parent]
    return parent


def content_blocks(page: Page, found: list[Block], share: float = SHARE) -> list[Block]:
    """The blocks whose tag path is content.

    A path is strong if its own fused ratio reaches the threshold, a share of the ratio of the blocks' median character.
    Ratios are then smoothed: a path of headings, paragraphs, list items or the like takes half of the best ratio among the
    paths in the same container, so a heading or a short paragraph is judged with the text it stands in. What passes only
    so must also stand in a container that has a strong block of its own in this very place of the page (a title, first
    of the headings, somewhere below its container).
    """
    scores, links = path_scores(page, found)
    usable = [b for b in found if page.paths[b.at] not in links]
    if not usable:
        return []
    by_size = sorted((scores[page.paths[b.at]], len(b.text)) for b in usable)
    half, middle = sum(n for _, n in by_size) / 2, 0.0
    for value, n in by_size:
        half -= n
        middle = value
        if half <= 0:
            break
    threshold = share * middle
    strong = [b for b in usable if scores[page.paths[b.at]] >= threshold]
    held: dict[int, float] = {}
    best: dict[int, float] = {}
    for b in strong:
        box = _container(page, b.at)
        held[max(box, 0)] = 1.0
        path = page.paths[box] if box >= 0 else -1
        best[path] = max(best.get(path, 0.0), scores[page.paths[b.at]])
    below = page.below(held)
    at_best = max(best.values())
    keep: list[Block] = []
    for b in usable:
        own, leaf = scores[page.paths[b.at]], page.names[b.at]
        if own >= threshold:
            keep.append(b)
            continue
        if leaf not in _TEXTUAL:
            continue
        box = _container(page, b.at)
        near, here = best.get(page.paths[box] if box >= 0 else -1, 0.0), max(box, 0) in held
        if leaf in _HEADINGS and not here:
            # A heading may stand above the boxes that hold its text.
            while leaf == "h1" and box >= 0 and not below[box]:
                box = page.parents[box]
            if box >= 0 and below[box] and (leaf == "h1" or page.names[box] not in ("html", "body")):
                near, here = at_best, True
        if here and (own + near) / 2 >= threshold:
            keep.append(b)
    return keep


def main_text(html: str | None, share: float = SHARE) -> str:
    """The blocks of the article, joined by two newlines."""
    if not html:
        return ""
    page = parse(html)
    found = _undoubted(page, _outside_forms(page, [b for b in page.blocks if not page.dropped[b.at]]))
    scores, links = path_scores(page, found)
    mass: dict[int, float] = {}
    for b in found:
        if page.paths[b.at] not in links:
            mass[b.at] = mass.get(b.at, 0.0) + len(b.text) * scores[page.paths[b.at]]
    total, outer = page.below(mass), page.marked(k for k, name in enumerate(page.names) if name in _REGIONS)
    regions = [k for k, name in enumerate(page.names) if name in _REGIONS and total[k] and not (page.parents[k] >= 0 and outer[page.parents[k]])]
    region = max(regions, key=lambda k: (total[k], -k), default=None)
    if region is not None and REGION * total[region] >= sum(mass.values()) - total[region]:
        inside = page.marked([region])
        found = [b for b in found if inside[b.at]]
    return "\n\n".join(b.text for b in content_blocks(page, found, share))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, one row for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")
