"""Main text of web pages by scoring their element trees.

A page becomes a tree of its block elements, each with its own blocks of text. Every block earns points for its length
and commas, less the share of its text that is link; paragraphs hand them to their container, containers half of theirs
to the next one up. The container with the most points, and those of its siblings that look like more of the same,
are the article. Parts whose element, role or name says that they are something else are taken away before that.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

#: Fixed: how HTML groups its elements.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEAVES = frozenset("p pre li dd dt td th h1 h2 h3 h4 h5 h6 figcaption caption summary legend address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Fixed: elements whose content is no markup, those that have none, and others that hold no text of a page.
RAW = frozenset("script style noscript template title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTROLS = frozenset("button select option optgroup datalist svg math object canvas audio video applet map label".split())
#: Fixed: which open elements an element ends, and where that search ends.
ENDS = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tr": ("tr", "table"), "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table"),
    "body": ("head", ""),
}
ENDS = {tag: (frozenset(a.split()), frozenset(b.split())) for tag, (a, b) in ENDS.items()}

#: Elements, roles and parts of names that tell what is not the article.
OTHER_TAGS = frozenset("nav aside footer dialog menu head".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
COMMENT_NAMES = frozenset("comment comments commentlist commenter disqus reply replies respond responses".split())
OTHER_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login "
    "sidebar rail menu nav navbar navigation breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer "
    "share sharing social related recommended widget skip search".split()
)
#: A name that begins or ends so speaks about the page's state, not about what the element is.
STATE_BEGINS, STATE_ENDS = frozenset("has no with without is not".split()), frozenset("open closed enabled disabled count".split())
#: Parts of names under which a header belongs to the article.
OWN_NAMES = frozenset("article entry post story content main".split())

#: Share of points a container hands on, of the best score a sibling needs, and of link text from which a list is a menu.
PASSED, SIBLING, LINKS = 0.5, 0.15, 0.5
#: Of the points outside suspected elements and in the largest one, the first is less than this share if that one wraps the page.
WRAPPED = 0.05

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_COMMA = re.compile("[,，、،]")


class _Element:
    __slots__ = ("tag", "up", "below", "suspect", "gone", "own", "score", "chars", "linked")

    def __init__(self, tag: str, up: _Element | None):
        self.tag, self.up, self.below = tag, up, []
        self.suspect = self.gone = False
        self.own = self.score = 0.0
        self.chars = self.linked = 0
        if up is not None:
            up.below.append(self)


def _names(value: str) -> Iterator[frozenset[str]]:
    for token in value.split():
        parts = [p.lower() for p in _PARTS.findall(token)]
        if not parts or parts[0] in STATE_BEGINS or parts[-1] in STATE_ENDS:
            continue
        cut = next((i for i, p in enumerate(parts) if p in STATE_BEGINS), len(parts))
        yield frozenset(parts[:cut])


def _judge(element: _Element, attributes: str, in_article: bool) -> None:
    """Mark an element that is not the article: gone if that is sure, suspect if it might wrap the whole page."""
    tag = element.tag
    if tag in OTHER_TAGS:
        element.gone = True
    elif tag == "form" or (tag == "header" and not in_article):
        element.suspect = True
    if not attributes:
        return
    found = {name.lower(): (value or "").strip("\"'") for name, value in _ATTRIBUTE.findall(attributes)}
    style = found.get("style", "").replace(" ", "").lower()
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style:
        element.gone = True
    if tag in ("html", "body", "main"):
        return
    if found.get("role", "").lower() in OTHER_ROLES:
        element.suspect = True
    for parts in _names(f"{found.get('class', '')} {found.get('id', '')}"):
        other = parts & OTHER_NAMES
        if other == {"header"} and (in_article or parts & OWN_NAMES):
            continue
        if other & COMMENT_NAMES:
            element.gone = True
        elif other:
            element.suspect = True


def _tree(page: str) -> tuple[_Element, list[tuple[_Element, str, int]]]:
    """The root of a page's block elements, and its blocks in order: element, text, characters in links."""
    root = _Element("", None)
    stack, blocks, pieces = [root], [], []
    linked_from, articles, at, silent = 0, 0, 0, ""

    def flush() -> None:
        if pieces:
            text = " ".join("".join(p for p, _ in pieces).split())
            if text:
                linked = sum(len("".join(p.split())) for p, link in pieces if link)
                blocks.append((stack[-1], text, linked))
            pieces.clear()

    def close(depth: int) -> None:
        nonlocal linked_from, articles
        flush()
        for element in stack[depth:]:
            articles -= element.tag in ("article", "main")
        del stack[depth:]
        if len(stack) < linked_from:
            linked_from = 0

    while at < len(page):
        found = _TAG.search(page, at)
        end = found.start() if found else len(page)
        if end > at and not silent:
            pieces.append((entities.unescape(page[at:end]), linked_from > 0))
        if not found:
            break
        at, tag = found.end(), (found[2] or "").lower()
        if not tag:
            continue
        ending = bool(found[1])
        if silent:
            # Inside a control: only its end counts, or a block, in which no control goes on.
            if (ending and tag == silent) or tag in BLOCKS:
                silent = ""
            if tag not in BLOCKS:
                continue
        if ending:
            if tag == "a":
                linked_from = 0
            elif tag in BLOCKS:
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
                if depth:
                    close(depth)
                else:
                    flush()
            continue
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            at = stop.start() if stop else len(page)
        elif tag == "br":
            pieces.append((" ", False))
        elif tag == "hr":
            flush()
        elif tag in CONTROLS:
            silent = "" if found[3].endswith("/") else tag
            pieces.append((" ", False))
        elif tag == "a":
            linked_from = len(stack)
        elif tag in BLOCKS:
            flush()
            if stack[-1].tag == "p" or stack[-1].tag == "head" or (stack[-1].tag in HEADINGS and tag in HEADINGS):
                close(len(stack) - 1)
            if tag in ENDS:
                closed, fence = ENDS[tag]
                depth = len(stack) - 1
                while depth and stack[depth].tag not in fence:
                    if stack[depth].tag in closed:
                        close(depth)
                        break
                    depth -= 1
            element = _Element(tag, stack[-1])
            _judge(element, found[3], articles > 0)
            articles += tag in ("article", "main")
            stack.append(element)
    flush()
    return root, blocks


def _ordered(root: _Element) -> list[_Element]:
    """All elements, each before those below it."""
    out, todo = [], [root]
    while todo:
        element = todo.pop()
        out.append(element)
        todo.extend(reversed(element.below))
    return out


def _points(text: str, linked: int) -> float:
    return (1 + len(_COMMA.findall(text)) + len(text) / 100) * (1 - min(linked / len(text), 1))


def _drop_suspects(elements: list[_Element], blocks: list) -> None:
    """Suspects are gone, except one that wraps what looks like the page's whole text."""
    inside: dict[int, float] = {}
    suspects: dict[int, _Element] = {}
    nearest: dict[int, _Element | None] = {}
    depth: dict[int, int] = {}
    for element in elements:
        up = element.up
        element.gone = element.gone or (up is not None and up.gone)
        above = nearest.get(id(up))
        nearest[id(element)] = element if element.suspect else above
        depth[id(element)] = depth.get(id(up), 0) + element.suspect
        if element.suspect:
            suspects[id(element)] = element
    clean = 0.0
    for element, text, linked in blocks:
        if element.gone or element.tag in HEADINGS:
            continue
        if not depth[id(element)]:
            clean += _points(text, linked)
        elif depth[id(element)] == 1:
            key = id(nearest[id(element)])
            inside[key] = inside.get(key, 0.0) + _points(text, linked)
    if inside:
        wrapper = max(inside, key=inside.get)
        if clean < WRAPPED * inside[wrapper]:
            suspects[wrapper].suspect = False
    for element in elements:
        element.gone = element.gone or element.suspect or (element.up is not None and element.up.gone)


def main_text(page: str) -> str:
    """The blocks of a page's article, white space inside a block as one blank, blocks joined by two line feeds."""
    root, blocks = _tree(page)
    elements = _ordered(root)
    _drop_suspects(elements, blocks)
    blocks = [b for b in blocks if not b[0].gone]
    for element, text, linked in blocks:
        element.chars += len(text)
        element.linked += linked
        if element.tag not in HEADINGS:
            element.own += _points(text, linked)
    for element in reversed(elements):
        element.score += element.own
        if element.up is not None:
            element.up.score += element.score if element.tag in LEAVES else element.score * PASSED
            element.up.chars += element.chars
            element.up.linked += element.linked
    # A list or box that is mostly links is a menu wherever it stands.
    for element in elements:
        up_gone = element.up is not None and element.up.gone
        menu = element.tag not in LEAVES and element.tag not in ("", "html", "body", "main", "article") and element.linked > LINKS * element.chars
        element.gone = element.gone or up_gone or menu
    blocks = [b for b in blocks if not b[0].gone]
    if not blocks:
        return ""
    best = None
    for element in elements:
        if not element.gone and element.tag not in LEAVES and element.chars:
            worth = element.score * (1 - element.linked / element.chars)
            if best is None or worth > best[0]:
                best = (worth, element)
    chosen = _article(best[1], best[0]) if best else {id(root)}
    inside: set[int] = set()
    for element in elements:
        if id(element) in chosen or (element.up is not None and id(element.up) in inside):
            inside.add(id(element))
    return "\n\n".join(text for element, text, _ in blocks if id(element) in inside)


def _article(best: _Element, worth: float) -> set[int]:
    """The article or main element around the best container, or else this one and its siblings that go with it."""
    above, around = best, None
    while above is not None:
        if above.tag == "article" or (above.tag == "main" and (around is None or around.tag == "main")):
            around = above
        above = above.up
    if around is not None:
        return {id(around)}
    chosen = {id(best)}
    for other in best.up.below if best.up is not None else []:
        if other.gone or not other.chars:
            continue
        density = other.linked / other.chars
        if other.tag in HEADINGS or other.tag in LEAVES:
            keep = density < 0.25
        else:
            keep = other.score * (1 - density) >= SIBLING * worth
        if keep:
            chosen.add(id(other))
    return chosen


@F.pandas_udf(StringType())
def _main_texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(lambda page: main_text(page) if page else "")


def with_main_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``, and n_chars, its code points; columns of these names are replaced.

    A null or empty page, and one without text outside menus and the like, has an empty text. Nothing is cut off:
    pages are whole, however long, and so are articles. Each row stands for itself, so equal pages have equal texts.
    """
    return pages.withColumn(text, _main_texts(F.col(html))).withColumn("n_chars", F.length(text).cast("bigint"))
