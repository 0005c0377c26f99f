"""Blocks of text of a web page and the containers they stand in. A small helper without Spark."""

from __future__ import annotations

import hashlib
import html
import re
from dataclasses import dataclass

# Fixed values of HTML and of common page designs.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu "
    "nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style textarea title xmp noembed noframes".split())
DROPPED = frozenset(
    "aside audio button canvas dialog datalist footer form head iframe input label math menu nav "
    "noscript object script search select style svg template textarea title video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("article blockquote body div main section td".split())
CLOSED_BY_LIKE = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
LIMITS = frozenset("ul ol dl table article section div main body td th".split())
UNWANTED = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline comment "
    "comments consent cookie cookies copyright discussion disqus footer gdpr login masthead menu "
    "modal nav navbar navigation newsletter notice notices notification outbrain overlay pager "
    "pagination paywall popup promo promoted promotion recommended related reply replies respond "
    "share sharing sidebar sidenav signup skip social sponsor sponsored subscribe subscription "
    "taboola tags teaser toc toolbar widget widgets".split()
)
UNWANTED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation "
    "search".split()
)
WANTED = frozenset("article articlebody body content entry main post story text".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))|([^\s=\"'/]+)")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    tag: str
    parent: int
    path: str
    dropped: bool
    headings_only: bool
    in_article: bool
    weight: float
    link: bool


@dataclass
class Block:
    element: int
    words: list[str]
    linked: int
    dropped: bool


def parse(page: str | None) -> tuple[list[Element], list[Block]]:
    """Elements in order of opening, and blocks of text in page order."""
    page = page or ""
    elements = [Element("", -1, "", False, False, False, 0.5, False)]
    stack, blocks = [0], []
    parts: list[tuple[str, bool]] = []
    at = 0

    def close_block() -> None:
        if parts:
            holder = next(k for k in reversed(stack) if k == 0 or elements[k].tag in BLOCKS)
            _add_block(elements, blocks, holder, parts)
            parts.clear()

    def add_text(raw: str) -> None:
        if raw and not elements[stack[-1]].dropped:
            parts.append((html.unescape(raw), elements[stack[-1]].link))

    while True:
        found = _TAG.search(page, at)
        add_text(page[at : found.start()] if found else page[at:])
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            if tag == "p" and tag not in (elements[k].tag for k in stack):
                continue
            depth = _open_depth(elements, stack, tag)
            if depth:
                if any(elements[k].tag in BLOCKS for k in stack[depth:]):
                    close_block()
                del stack[depth:]
            continue
        if tag == "br":
            add_text(" ")
            continue
        if tag in BLOCKS:
            close_block()
        _close_implied(elements, stack, tag)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if not found[3].rstrip().endswith("/") or tag in BLOCKS:
            elements.append(_element(elements, stack[-1], tag, found[3]))
            stack.append(len(elements) - 1)
    close_block()
    return elements, blocks


def _open_depth(elements: list[Element], stack: list[int], tag: str) -> int:
    """Where in the stack an end tag closes; 0 if nowhere. Inline tags stay within their block."""
    for depth in range(len(stack) - 1, 0, -1):
        name = elements[stack[depth]].tag
        if name == tag:
            return depth
        if tag not in BLOCKS and name in BLOCKS or tag == "p" and name in LIMITS:
            return 0
    return 0


def _close_implied(elements: list[Element], stack: list[int], tag: str) -> None:
    closes = CLOSED_BY_LIKE.get(tag, {"p"} if tag in BLOCKS else set())
    for depth in range(len(stack) - 1, 0, -1):
        name = elements[stack[depth]].tag
        if name in closes or tag in BLOCKS and name == "p":
            del stack[depth:]
            if tag in CLOSED_BY_LIKE:
                continue
            return
        if name in LIMITS and not (tag in ("tr", "td", "th") and name in closes):
            return


def _element(elements: list[Element], parent: int, tag: str, attributes: str) -> Element:
    above = elements[parent]
    values = {}
    for name, double, single, bare, alone in _ATTRIBUTE.findall(attributes):
        values.setdefault((name or alone).lower(), html.unescape(double or single or bare))
    names = f"{values.get('class', '')} {values.get('id', '')}"
    tokens = {t.lower() for t in _NAME_PARTS.findall(names)}
    article = tag in ("article", "main") or values.get("role") == "main"
    body = tag in ("html", "body")
    unwanted = (
        not body
        and not (article and not tokens & {"comment", "comments", "reply", "teaser", "related"})
        and bool(tokens & UNWANTED or values.get("role") in UNWANTED_ROLES)
    )
    hidden = not body and (
        "hidden" in values
        or values.get("aria-hidden") == "true"
        or bool(_HIDDEN.search(values.get("style", "")))
    )
    title_part = tag == "header" or "header" in tokens and not article and not body
    generalised = ".".join([tag, *sorted({re.sub(r"\d+", "#", n.lower()) for n in names.split()})])
    weight = 1.5 if article else 0.5 if tag == "body" else 1.3 if tokens & WANTED else 1.0
    return Element(
        tag,
        parent,
        _path(above.path, generalised) if tag in BLOCKS or body else above.path,
        above.dropped
        or tag in DROPPED
        or unwanted
        or hidden
        or title_part
        and not above.in_article,
        above.headings_only or title_part,
        above.in_article or article,
        weight if tag in CONTAINERS or article else 0.0,
        above.link or tag == "a",
    )


def _path(above: str, own: str) -> str:
    """Inline elements add nothing to a path; very deep paths are shortened to a digest."""
    if len(above) > 1_000:
        above = hashlib.sha256(above.encode()).hexdigest()
    return f"{above}>{own}" if above else own


def _add_block(elements, blocks, holder: int, parts: list[tuple[str, bool]]) -> None:
    words = "".join(text for text, _ in parts).split()
    if words:
        element = elements[holder]
        linked = sum(len(text.strip()) for text, link in parts if link)
        dropped = element.dropped or element.headings_only and element.tag not in HEADINGS
        blocks.append(Block(holder, words, linked, dropped))


def best_path(elements: list[Element], blocks: list[Block]) -> tuple[str, float] | None:
    """Path and score of the container with most text that is not linked; None without text.

    What an article or a container named like one holds counts more, the page itself less; of
    containers that hold the same the innermost wins.
    """
    chars = [0.0] * len(elements)
    for block in blocks:
        if not block.dropped:
            size = sum(map(len, block.words)) + len(block.words) - 1
            k = block.element
            while k >= 0:
                chars[k] += max(size - block.linked, 0) + 0.1
                k = elements[k].parent
    scored = [(n * e.weight, k) for k, (n, e) in enumerate(zip(chars, elements, strict=True))]
    score, k = max(scored)
    return (elements[k].path, score) if score > 0 else None


def text_of(elements: list[Element], blocks: list[Block], path: str) -> str:
    """Blocks that stand in an element of this path, in page order."""
    inside = []
    for element in elements:
        inside.append(element.path == path or element.parent >= 0 and inside[element.parent])
    return "\n\n".join(" ".join(b.words) for b in blocks if inside[b.element] and not b.dropped)
