"""Leaf blocks of an HTML page: the text between block boundaries, with its ancestors."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

# Element names of the public HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav "
    "ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
RAW = frozenset("script style title textarea noscript template iframe svg math".split())
#: Elements of other languages, which may end themselves.
FOREIGN = frozenset({"svg", "math"})
#: An element of the key ends open elements of the value by its start.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: Where the search for an element to end stops.
SCOPES = frozenset("table ul ol dl select body html td th button".split())

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"'])*+)>"""
    r"|</?[a-z][^>]*(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}
_HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A block's text, its open elements from the outside in, and what stands in links."""

    text: str
    tags: tuple[str, ...]
    hints: frozenset[str]
    linked: int


def blocks_of(html: str) -> list[Block]:
    """The non-empty leaf blocks in page order.

    Comments, declarations and elements without readable text (scripts, styles, titles)
    are passed over. Where such an element has no end tag or ends itself (``<svg/>``), only
    its tag is passed over: what follows belongs to the page. Character references are decoded,
    white space becomes one space. Unbalanced tags are closed as browsers do it for
    paragraphs, list items and cells; an end tag without a start is ignored.
    """
    out: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            hints = frozenset().union(*(h for _, h in stack))
            out.append(Block(text, tuple(name for name, _ in stack), hints, linked))
        parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal links
        links -= sum(name == "a" for name, _ in stack[depth:])
        del stack[depth:]

    at = 0
    unended: set[str] = set()
    while (found := _MARKUP.search(html, at)) is not None:
        if found.start() > at:
            text = unescape(html[at : found.start()])
            parts.append(text)
            linked += len(text.strip()) if links else 0
        at = found.end()
        name = found["name"]
        if not name:
            continue
        name = name.lower()
        if name in RAW:
            closed = name in FOREIGN and found["rest"].endswith("/")
            if not found["end"] and not closed and name not in unended:
                # Without an end tag ahead there is none for a later element either.
                end = _RAW_ENDS[name].search(html, at)
                if end is None:
                    unended.add(name)
                else:
                    at = end.end()
            continue
        if found["end"]:
            if name in BLOCKS:
                flush()
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                pop_to(depth)
            continue
        if name in BLOCKS:
            flush()
            ends = ENDS.get(name, frozenset()) | {"p"}
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ends:
                    pop_to(depth)
                    break
                if stack[depth][0] in SCOPES:
                    break
        if name in VOID:
            parts.append(" " if name == "br" else "")
            continue
        given = _HINTS.findall(found["rest"])
        hints = frozenset(p for g in given for p in _PART.findall("".join(g).lower()))
        links += name == "a"
        stack.append((name, hints))
    if at < len(html):
        parts.append(unescape(html[at:]))
        linked += len(html) - at if links else 0
    flush()
    return out
