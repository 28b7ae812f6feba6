"""A forgiving reader of HTML: block elements and the runs of text between them."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

#: Elements that start a block, those whose text is never shown, and those without an end tag. Fixed values of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
UNSHOWN = frozenset("select button svg audio video canvas datalist".split())
#: Those of them that hold nothing but options, so that without an end tag they still hide text up to the next block boundary.
OPTIONS = frozenset("select datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements, up to the given bounds.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), **dict.fromkeys(("tbody", "thead", "tfoot"), (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",))),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/].*\Z", re.S
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME = re.compile(r"[a-z]+")


@dataclass
class Page:
    """Nodes in page order. ``end[i]`` is one past the last node below node i; text nodes carry their text."""

    tags: list[str] = field(default_factory=list)
    tokens: list[tuple[str, ...]] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)

    def add(self, tag: str, tokens: tuple[str, ...], parent: int, text: str = "", linked: int = 0) -> int:
        self.tags.append(tag)
        self.tokens.append(tokens)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1 if parent >= 0 else 0)
        self.end.append(len(self.tags))
        self.texts.append(text)
        self.linked.append(linked)
        return len(self.tags) - 1


def attribute_tokens(source: str) -> tuple[str, ...]:
    """Lower-case letter runs of the attributes that name a role."""
    return tuple(dict.fromkeys(t for m in ATTRIBUTE.finditer(source) for t in NAME.findall((m[2] or m[3] or m[4] or "").lower()))) if "=" in source else ()


def parse(source: str | None) -> Page:
    """Nodes of a whole page. Missing and surplus end tags, and markup cut off at the end, are borne with.

    An element whose text isn't shown hides it only if its own end tag comes
    before the end of the block around it and before another of its kind
    starts; else a list of options hides what comes before the next block
    boundary, and other elements hide nothing.

    A text node is the text of a block between block boundaries: references
    decoded, ``br`` as white space, white space turned into single spaces and
    trimmed; blank runs make no node. ``linked`` counts its characters in links.
    """
    if not source:
        return Page()
    page, unclosed = _read(source, frozenset())
    # Whether an end tag is missing is known only at the end; then the page is read once more.
    return _read(source, unclosed)[0] if unclosed else page


def _read(source: str, known: frozenset[int]) -> tuple[Page, frozenset[int]]:
    """The page, and the places of unshown elements without an end tag, some of which may be known."""
    page = Page()
    stack = [(page.add("#root", (), -1), "#root")]
    run: list[str] = []
    in_link = linked = 0
    # Unshown elements that are open: tag, place, size of the stack when they started.
    hidden: list[tuple[str, int, int]] = []
    unclosed: set[int] = set()
    # How many elements of a name are open: what isn't is never searched for.
    opened: Counter[str] = Counter()
    at, size = 0, len(source)

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                page.add("#text", (), stack[-1][0], text, min(linked, len(text)))
            run.clear()
        linked = 0

    def pop(to: int) -> None:
        while len(stack) > to:
            node, name = stack.pop()
            opened[name] -= 1
            page.end[node] = len(page.tags)
        while hidden and hidden[-1][2] > to:
            unclosed.add(hidden.pop()[1])

    def text(piece: str) -> None:
        nonlocal linked
        if not hidden:
            piece = html.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if in_link:
                linked += len(piece.strip())

    while at < size:
        m = TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            break
        if m.start() > at:
            text(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in RAW:
            if not closing and not rest.endswith("/"):
                shut = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I).search(source, at)
                at = shut.end() if shut else size
        elif tag in UNSHOWN:
            if rest.endswith("/"):
                continue
            same = [k for k, h in enumerate(hidden) if h[0] == tag]
            if closing:
                if same:
                    unclosed.update(h[1] for h in hidden[same[-1] + 1 :])
                    del hidden[same[-1] :]
                continue
            if same and tag != "svg":
                unclosed.update(h[1] for h in hidden[same[-1] :])
                del hidden[same[-1] :]
            if m.start() not in known or tag in OPTIONS:
                hidden.append((tag, m.start(), len(stack)))
        elif tag == "br":
            text(" ")
        elif tag == "a":
            in_link = 0 if closing else 1
        elif tag in BLOCKS:
            if tag == "body":
                unclosed.update(h[1] for h in hidden)
                hidden.clear()
            while not closing and hidden and hidden[-1][1] in known:
                hidden.pop()
            flush()
            in_link = 0
            if closing:
                if opened[tag]:
                    pop(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == tag))
                continue
            if stack[-1][1] == "p" and not (hidden and hidden[-1][2] == len(stack)):
                pop(len(stack) - 1)
            if tag in ENDS:
                ended, bounds = ENDS[tag]
                for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ended) else ():
                    if stack[k][1] in bounds:
                        break
                    if stack[k][1] in ended:
                        pop(k)
                        break
            elif tag[0] == "h" and tag[1:].isdigit() and stack[-1][1][0] == "h" and stack[-1][1][1:].isdigit():
                pop(len(stack) - 1)
            if tag in ("html", "body") and opened[tag]:
                continue
            node = page.add(tag, attribute_tokens(rest), stack[-1][0])
            if tag != "hr":
                stack.append((node, tag))
                opened[tag] += 1
    flush()
    pop(0)
    return page, frozenset(unclosed)
