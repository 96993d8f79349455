"""A small forgiving HTML reader, in linear time: text pieces under a tree of elements."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: An opening tag closes these, up to the nearest of the others.
SELF_CLOSING = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist"), "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table")}
SELF_CLOSING = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SELF_CLOSING.items()}

@dataclass
class Element:
    tag: str
    names: str  # class, id, role and the like, lower-cased
    parent: int


@dataclass
class Page:
    """elements[0] is the root. pieces: (element, text, whether a block begins before it)."""

    elements: list[Element] = field(default_factory=lambda: [Element("#root", "", -1)])
    pieces: list[tuple[int, str, bool]] = field(default_factory=list)


def label(tag: str, names: str) -> str:
    """Tag and up to two names without numbers of two digits or more, so that numbered names are alike."""
    words = [w for w in re.sub(r"\d{2,}", "", names).split() if w.strip("-_")][:2]
    return ".".join([tag, *[w[:24] for w in words]])


def read(html: str | None) -> Page:
    page, html = Page(), html or ""
    stack = [0]
    open_at: dict[str, list[int]] = {}  # places in the stack of the open elements of a tag
    at, fresh = 0, True
    last = html.rfind(">")  # no tag ends after it
    elements, pieces = page.elements, page.pieces

    def text(raw: str) -> None:
        nonlocal fresh
        if raw:
            pieces.append((stack[-1], unescape(raw) if "&" in raw else raw, fresh))
            fresh = False

    def push() -> None:
        open_at.setdefault(elements[-1].tag, []).append(len(stack))
        stack.append(len(elements) - 1)

    def cut(k: int) -> None:
        """Close all from place k on."""
        while len(stack) > k:
            open_at[elements[stack.pop()].tag].pop()

    def nearest(kinds) -> int:
        return max((places[-1] for t in kinds if (places := open_at.get(t))), default=0)

    def close(kinds: frozenset[str], until: frozenset[str] | tuple) -> None:
        """Close elements of these kinds, as far as none of the others lies between."""
        while (k := nearest(kinds)) and k > nearest(until):
            cut(k)

    while at < len(html):
        m = TOKEN.search(html, at) if at <= last else None
        if not m:
            text(re.sub(r"<[a-zA-Z/!][^<>]*\Z", "", html[at:]))  # a tag that was cut off
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), (m[1] or m[4]) == "/"
        if tag not in INLINE:
            fresh = True
        if closing:
            if k := nearest((tag,)):
                cut(k)
            continue
        if tag in P_CLOSERS:
            close(("p",), ("button", "table", "td", "th", "caption", "object"))
        if tag in SELF_CLOSING:
            close(*SELF_CLOSING[tag])
        names = ""
        if m[3] and not m[3].isspace():
            found = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(m[3])}
            names = " ".join(found[k] for k in ("class", "id", "role", "itemprop", "aria-label") if k in found).lower()
            if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
                names += " hidden"
        elements.append(Element(tag, names, stack[-1]))
        if tag in RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            stop = html.find(">", end.end()) if end else -1
            push()
            text(html[at : end.start()] if end else html[at:])
            cut(len(stack) - 1)
            at = stop + 1 if stop >= 0 else len(html)
            fresh = True
        elif tag not in VOID and (not (m[3] or "").endswith("/") or tag not in ("svg", "path", "use")):
            push()  # a stray slash closes nothing in HTML
    return page
