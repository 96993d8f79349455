"""Main text by wrapper induction.

Pages of a host are generated from a few templates. Each page becomes a tree of slots: block elements, where siblings
of one label and build that follow each other, or are many, share one (a list of records). The slot trees of a host
are aligned by simple tree matching: the greatest order-preserving matching of equal labels, computed top down over
the children of matched nodes, however many. Aligned trees are merged; a tree that matches no template of the host well begins a
new one. Each template node gathers, over all pages, how much text it has, how much of that is in links, and how many
pages have the same text there.

Nodes with the same text on nearly all pages are template. The main text is in the smallest node that holds most of a
page's varying text outside links, as the host's pages on the whole have it: so a page is judged by its host's template,
not by itself. Element and class names only break ties: a node that the template knows and whose name says navigation,
advert, comments and the like isn't the main text, and an article element around or right inside the main node sets its
edges. Nodes that the template doesn't know follow the node around them.

State is bounded. A host has at most 8 templates; a page like none of them is merged with the most alike one, side by
side with what is there. More than CHILDREN children of a node share slots by label, then by tag, then all; beyond NODES nodes, the
children of the rarest nodes are counted with their parents. Statistics are never dropped. Trees are merged per task
before they are shuffled, so that a host with a third of all pages sends a few trees from each task.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, short_batches, table
from .dom import INLINE, VOID, Page, label, read
from .url_filter import canonical

NEVER = frozenset("#root script style noscript template head title nav footer aside form menu dialog button select textarea iframe svg canvas object audio video map".split()) - {"#root"}
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "sidebar side rail widget widgets footer masthead topbar toolbar comment comments reply replies respond discussion disqus cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager skip hidden "
    "complementary contentinfo search dialog copyright legal disclaimer".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Never shown as text.
MARKUP = frozenset("script style noscript template head title iframe svg canvas object audio video map".split())
#: Deeper blocks share the slot of the block at this depth.
DEEPEST = 60
#: So many like siblings are a list of records, wherever they stand.
MANY = 4
#: Children of a node, and nodes of a template, that have slots of their own.
CHILDREN, NODES = 128, 4096
#: Share of the pages that have the same text in a constant node, and pages (copies counted once) that it takes.
SAME, LEAST = 0.8, 3
LINKED = 0.6
#: Share of a page's varying text that the main node holds.
MOST = 0.7
#: Least normalised matching with a template, and templates of a host.
ALIKE, TEMPLATES = 0.3, 8
#: Hosts that a task gathers at a time, and builds of pages whose alignment it keeps for each.
HOSTS, BUILDS = 2000, 1000
#: Total size of all templates up to which they are broadcast; beyond it the pages are joined by shuffle.
BROADCAST_BYTES = 32 << 20


#: Labels of the slots that more than CHILDREN children share: by label, by tag, one for all.
WIDER = (lambda label: label, lambda label: f"{label.split('.')[0]}.*", lambda label: "*")


def hinted(tag: str, names: str) -> bool:
    """Whether an element's names say that it isn't the article."""
    return bool(names) and not HINTS.isdisjoint(re.split(r"[^a-z]+", names))


# ---- slot trees ------------------------------------------------------------------------------


@dataclass
class Node:
    """tops: the most frequent texts (hashes) of this slot and their counts, which may be a little too low."""

    label: str
    pages: int = 0
    chars: int = 0
    links: int = 0
    tops: list[list[int]] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    def dump(self) -> list:
        return [self.label, self.pages, self.chars, self.links, self.tops, [c.dump() for c in self.children]]

    @classmethod
    def load(cls, x: list) -> Node:
        return cls(*x[:5], [cls.load(c) for c in x[5]])

    def walk(self) -> Iterator[Node]:
        """Parents first."""
        yield self
        for c in self.children:
            yield from c.walk()

    def size(self) -> int:
        return sum(1 for _ in self.walk())

    def build(self) -> str:
        """Labels and nesting."""
        return f"{self.label}({','.join(c.build() for c in self.children)})" if self.children else self.label

    def absorb(self, other: Node) -> None:
        """Add the statistics of another node, without its children."""
        self.pages += other.pages
        self.chars += other.chars
        self.links += other.links
        counts: dict[int, int] = {}
        for h, n in (*self.tops, *other.tops):
            counts[h] = counts.get(h, 0) + n
        tops = sorted(([h, n] for h, n in counts.items()), key=lambda t: (-t[1], t[0]))
        less = tops[2][1] if len(tops) > 2 else 0  # the third and later counts go off all (Misra and Gries)
        self.tops = [[h, n - less] for h, n in tops[:2] if n > less]


def same_slot(a: Node, b: Node) -> bool:
    if a.label == b.label:
        return True
    if not (a.label.endswith("*") or b.label.endswith("*")):
        return False
    x, y = a.label.split("."), b.label.split(".")
    return "*" in (x[-1], y[-1]) and (x[0] == y[0] or "*" in (x[0], y[0]))


def form(node: Node, memo: dict) -> int:
    """A number of a node's build in memo: nodes of one form match alike."""
    found = memo.get(id(node))
    if found is None:
        key = (node.label, *[form(c, memo) for c in node.children])
        found = memo[id(node)] = memo.setdefault(key, len(memo))
        memo[found, found] = (1 + sum(memo[c, c][0] for c in key[1:]), [(k, k) for k in range(len(key) - 1)])
    return found


def matched(a: Node, b: Node, memo: dict) -> int:
    """Nodes in the greatest matching of two trees whose roots are like slots, whatever their sizes."""
    if not (a.children and b.children):
        return 1
    key = form(a, memo), form(b, memo)
    if key not in memo:
        start, _, columns, shares = _like(a.children, b.children, memo)
        own = {id(x): x for x in shares}
        total = 1 + sum(memo[memo[id(x)], memo[id(x)]][0] for x in a.children[:start])
        if all(max(x) == 1 for x in own.values()):  # each bit a column, 0 where the row grows (Hyyro)
            bits = {k: sum(1 << n for n, y in enumerate(x) if y) for k, x in own.items()}
            full = rest = (1 << len(columns)) - 1
            for x in shares:
                u = rest & bits[id(x)]
                rest = ((rest + u) | (rest - u)) & full
            total += len(columns) - rest.bit_count()
        else:
            row = [0] * (len(columns) + 1)
            for x in shares:
                row = _row(row, x)
            total += row[-1]
        memo[key] = total, None
    return memo[key][0]


def tree_matching(a: Node, b: Node, memo: dict | None = None) -> tuple[int, list[tuple[int, int]]]:
    """Nodes in the greatest matching of two trees, and which of their children match; whatever their sizes.

    memo: the forms of nodes as they were when first met, and the matchings of forms.
    W[i][j] = max(W[i-1][j], W[i][j-1], W[i-1][j-1] + matching of the i-th and the j-th child).
    """
    if not same_slot(a, b):
        return 0, []
    if not (a.children and b.children):
        return 1, []
    memo = {} if memo is None else memo
    key = form(a, memo), form(b, memo)
    if memo.get(key, (0, None))[1] is None:
        start, rows, columns, shares = _like(a.children, b.children, memo)
        w = [[0] * (len(columns) + 1)]
        for x in shares:
            w.append(_row(w[-1], x))
        i, j, pairs = len(rows), len(columns), []
        while i and j:
            if w[i][j] == w[i - 1][j]:
                i -= 1
            elif w[i][j] == w[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((rows[i], columns[j]))
        memo[key] = matched(a, b, memo), [(k, k) for k in range(start)] + pairs[::-1]
    return memo[key]


def _row(last: list[int], share: list[int]) -> list[int]:
    row, most = [0], 0
    for k, own in enumerate(share):
        here = last[k] + own if own else 0
        if last[k + 1] > most:
            most = last[k + 1]
        if here > most:
            most = here
        row.append(most)
    return row


def _like(xs: list[Node], ys: list[Node], memo: dict) -> tuple[int, list[int], list[int], list[list[int]]]:
    """How many children at the start have equal forms, so that they match each other; of the others those that are like
    one on the other side: their places in xs and in ys, and their matchings, a list for each of xs."""
    start = 0
    while start < min(len(xs), len(ys)) and memo[id(xs[start])] == memo[id(ys[start])]:
        start += 1
    places: dict[str, list[int]] = {}
    for j in range(start, len(ys)):
        places.setdefault(ys[j].label, []).append(j)
    first = {x.label: x for x in reversed(xs[start:])}
    like = {name: [j for own in places.values() if same_slot(x, ys[own[0]]) for j in own] for name, x in first.items()}
    rows = [i for i in range(start, len(xs)) if like[xs[i].label]]
    columns = sorted({j for own in like.values() for j in own})
    column = {j: k for k, j in enumerate(columns)}
    shares: dict[int, list[int]] = {}  # by form
    for i in rows:
        if memo[id(xs[i])] not in shares:
            own = shares[memo[id(xs[i])]] = [0] * len(columns)
            for j in like[xs[i].label]:
                own[column[j]] = matched(xs[i], ys[j], memo)
    return start, rows, columns, [shares[memo[id(xs[i])]] for i in rows]


def _greedy(a: Node, b: Node, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """A matching in which each child of b takes the next child of a with its label: a bound that tests compare with, no step of the operator."""
    places: dict[str, list[int]] = {}
    for i in reversed(range(len(a.children))):
        places.setdefault(a.children[i].label, []).append(i)
    total, pairs, last = 1, [], -1
    for j, y in enumerate(b.children):
        own = places.get(y.label, [])
        while own and own[-1] <= last:
            own.pop()
        if own:
            last = own.pop()
            pairs.append((last, j))
            total += tree_matching(a.children[last], y, memo)[0]
    return total, pairs


def align(template: Node, tree: Node, memo: dict, grow: bool) -> list[Node | None]:
    """The template node of each node of a tree, parents first; their roots match.

    grow: nodes without one get a new one, in their place and without statistics; else they get None.
    """
    out: list[Node | None] = []

    def go(a: Node | None, b: Node) -> None:
        out.append(a)
        own: dict[int, Node | None] = {}
        if a is not None:
            own = {j: a.children[i] for i, j in tree_matching(a, b, memo)[1]}
            taken = {id(x) for x in own.values()}
            where = 0
            for j, child in enumerate(b.children):
                if j not in own:  # a slot that stands elsewhere is the same slot
                    free = [x for x in a.children if x.label == child.label and id(x) not in taken]
                    if len(free) == 1:
                        own[j] = free[0]
                        taken.add(id(free[0]))
            for j, child in enumerate(b.children):
                if j in own:
                    where = next(i for i, x in enumerate(a.children) if x is own[j]) + 1
                elif grow:
                    own[j] = Node(child.label)
                    a.children.insert(where, own[j])
                    where += 1
        for j, child in enumerate(b.children):
            go(own.get(j), child)

    go(template, tree)
    return out


def narrow(node: Node) -> bool:
    """Let children beyond CHILDREN share slots by label, then by tag, then all; whether anything changed."""
    changed = False
    for name in WIDER:
        if len(node.children) > CHILDREN:
            changed, slots = True, {}
            for c in node.children:
                own = slots.setdefault(name(c.label), Node(name(c.label)))
                own.absorb(c)
                own.children += c.children
            node.children = list(slots.values())
    for c in node.children:
        changed |= narrow(c)
    return changed


def shorten(template: Node) -> bool:
    """Beyond NODES nodes, count the children of the rarest nodes with their parents."""
    n = template.size()
    if n <= NODES:
        return False
    for node in sorted((x for x in template.walk() if x.children and x is not template), key=lambda x: x.pages):
        if n <= NODES // 2:
            break
        below = list(node.walk())[1:]
        for x in below:
            node.chars += x.chars
            node.links += x.links
        if any(x.chars for x in below):
            node.tops = []  # not known to be the same
        node.children, n = [], template.size()
    return True


class Host:
    """Templates of a host: each tree joins the one it matches best, or begins a new one."""

    def __init__(self) -> None:
        self.templates: list[Node] = []
        self.known: dict[str, list[Node]] = {}

    def add(self, tree: Node) -> None:
        build = tree.build()
        own = self.known.get(build)
        if own is None:
            own = self._place(tree)
            if len(self.known) < BUILDS:
                self.known[build] = own
        for a, b in zip(own, tree.walk(), strict=True):
            a.absorb(b)
        template = own[0]
        if len(template.children) > CHILDREN or len(own) > CHILDREN or template.pages & 63 == 0:
            if narrow(template) | shorten(template):
                self.known.clear()

    def _place(self, tree: Node) -> list[Node]:
        found = best(self.templates, tree)
        if found and (found[2] >= ALIKE or len(self.templates) >= TEMPLATES):
            return align(found[0], tree, found[1], grow=True)
        self.templates.append(Node(tree.label))
        return align(self.templates[-1], tree, {}, grow=True)

    def dump(self) -> str:
        for t in self.templates:
            narrow(t)
            shorten(t)
        return json.dumps([t.dump() for t in self.templates])


def best(templates: list[Node], tree: Node) -> tuple[Node, dict, float] | None:
    """The template that matches a tree best, the matchings, and its share of both."""
    out, size = None, tree.size()
    for t in templates:
        memo: dict = {}
        share = 2 * (matched(t, tree, memo) if same_slot(t, tree) else 0) / (t.size() + size)
        if out is None or share > out[2]:
            out = (t, memo, share)
    return out


def page_tree(page: Page) -> tuple[Node, list[int]]:
    """The slot tree of one page, and the slot (place in the tree, parents first) of each element."""
    e, n = page.elements, len(page.elements)
    block, children = [0] * n, [[] for _ in range(n)]  # the nearest block, and the blocks right below a block
    for k in range(1, n):
        up = block[e[k].parent]
        if e[k].tag in INLINE or e[k].tag in VOID or e[k].tag in MARKUP:
            block[k] = up
        else:
            block[k] = k
            children[up].append(k)
    names = [label(x.tag, x.names) for x in e]
    kind = [(names[k], frozenset(names[c] for c in children[k])) for k in range(n)]
    slot_of, nodes = [0] * n, []

    def make(name: str, members: list[int], depth: int) -> Node:
        node = Node(name, 1)
        place = len(nodes)
        nodes.append(node)
        for k in members:
            slot_of[k] = place
        below = [c for k in members for c in children[k]]
        if depth >= DEEPEST:
            while below:
                k = below.pop()
                slot_of[k] = place
                below += children[k]
        many = {k for k, x in Counter(kind[c] for c in below).items() if x >= MANY}
        groups: list[tuple[str, list[int]]] = []
        lists: dict[tuple, list[int]] = {}
        for c in below:
            if kind[c] in lists:
                lists[kind[c]].append(c)
            elif groups and kind[groups[-1][1][-1]] == kind[c]:
                groups[-1][1].append(c)
            else:
                groups.append((names[c], [c]))
                if kind[c] in many:
                    lists[kind[c]] = groups[-1][1]
        for wide in WIDER:
            if len(groups) > CHILDREN:
                merged: dict[str, list[int]] = {}
                for x, own in groups:
                    merged.setdefault(wide(x), []).extend(own)
                groups = [(x, sorted(own)) for x, own in merged.items()]
        node.children = [make(x, own, depth + 1) for x, own in groups]
        return node

    root = make("#root", [0], 0)
    slot_of = [slot_of[block[k]] for k in range(n)]
    linked, markup = [False] * n, [False] * n
    for k in range(1, n):
        linked[k] = e[k].tag == "a" or linked[e[k].parent]
        markup[k] = e[k].tag in MARKUP or markup[e[k].parent]
    texts: list[list[str]] = [[] for _ in nodes]
    for k, text, _ in page.pieces:
        flat = "" if markup[k] else "".join(text.split())
        if flat:
            slot = slot_of[k]
            texts[slot].append(flat)
            nodes[slot].chars += len(flat)
            nodes[slot].links += len(flat) if linked[k] else 0
    for node, own in zip(nodes, texts, strict=True):
        node.tops = [[xxhash.xxh64_intdigest("\n".join(own).encode("utf-8", "surrogatepass")), 1]]
    root.tops = [[xxhash.xxh64_intdigest("\n".join(x for own in texts for x in own).encode("utf-8", "surrogatepass")), 1]]  # of the whole page
    return root, slot_of


# ---- wrappers --------------------------------------------------------------------------------


class Wrapper:
    """What a template says of its nodes: constant text, mostly links, and varying text outside links on a page."""

    def __init__(self, template: Node):
        self.template = template
        self.copies = max([n for _, n in template.tops[:1]], default=1) - 1  # more pages that are the same as a whole
        self.same: dict[int, bool] = {}
        self.linked: dict[int, bool] = {}
        self.weight: dict[int, float] = {}
        self._judge(template)
        self.builds: dict[str, list[Node | None]] = {}

    @classmethod
    def alone(cls, tree: Node) -> Wrapper:
        """Of a single page."""
        return cls(tree)

    def _judge(self, node: Node) -> tuple[int, int, bool]:
        pages = node.pages - self.copies
        alike = node.tops[0][1] - self.copies if node.tops else 0
        own = node is not self.template and pages >= LEAST and alike >= SAME * pages
        chars, links, same = node.chars, node.links, own or not node.chars
        for c in node.children:
            x, y, z = self._judge(c)
            chars, links, same = chars + x, links + y, same and z
        self.same[id(node)] = same and chars > 0
        self.linked[id(node)] = node.pages >= LEAST and links > LINKED * chars
        self.weight[id(node)] = 0.0 if own else (node.chars - node.links) / max(1, node.pages)
        return chars, links, same

    def align(self, tree: Node) -> list[Node | None]:
        build = tree.build()
        got = self.builds.get(build)
        if got is None:
            got = list(tree.walk()) if tree is self.template else align(self.template, tree, {}, grow=False)
            if len(self.builds) < BUILDS:
                self.builds[build] = got
        return got


def extract(page: Page, wrapper: Wrapper | None, tree: Node | None = None, slot_of: list[int] | None = None) -> str:
    """The main text of a page: blocks in page order, joined by one space. Without a wrapper the page is a host of its own."""
    if tree is None or slot_of is None:
        tree, slot_of = page_tree(page)
    wrapper = wrapper or Wrapper.alone(tree)
    known = wrapper.align(tree)
    slots = list(tree.walk())
    e, n = page.elements, len(page.elements)
    markup, hint = [False] * n, [False] * n
    for k in range(1, n):
        x = e[k]
        markup[k] = x.tag in MARKUP or markup[x.parent]
        hint[k] = known[slot_of[k]] is not None and (x.tag in NEVER or (x.tag not in ("html", "body") and hinted(x.tag, x.names)))
    # an element that holds an article is no advert, whatever it is called
    holds = [False] * n
    for k in range(n - 1, 0, -1):
        if holds[k] or (e[k].tag in ("article", "main") and not hint[k] and known[slot_of[k]] is not None):
            holds[e[k].parent] = True
    out = [False] * n
    for k in range(1, n):
        out[k] = markup[k] or out[e[k].parent] or (hint[k] and not (holds[k] and e[k].tag not in NEVER))
    main = _main_slot(tree, slots, known, wrapper, {slot_of[k] for k in range(1, n) if out[k] and e[k].tag not in INLINE | VOID | MARKUP})
    first = {slot: k for k, slot in reversed(list(enumerate(slot_of)))}
    stray = [out[k] or known[slot_of[k]] is None for k in range(n)]
    roots = _edges(e, slot_of, main, stray, slots, first)
    flat = all(e[k].tag in ("#root", "html", "body") for k in roots)
    inside = [False] * n
    inside[0] = 0 in roots
    for k in range(1, n):
        x, node = e[k], known[slot_of[k]]
        inside[k] = inside[x.parent] or k in roots
        if out[x.parent]:
            out[k] = True
        elif not out[k] and inside[k] and node is not None and k not in roots and x.tag not in INLINE | HEADINGS and not holds[k]:
            own_slot = x.tag not in VOID and x.tag not in ("html", "body")
            out[k] = own_slot and (x.tag == "header" or wrapper.same[id(node)] or (flat and wrapper.linked[id(node)] and x.tag != "p"))
    articles = any(e[k].tag in ("article", "main") for k in roots)
    title, barred = [False] * n, [False] * n  # a heading of the first order belongs to the article, even in its header or before its box
    for k in range(1, n):
        barred[k] = hint[k] or barred[e[k].parent]
        title[k] = title[e[k].parent] or (e[k].tag == "h1" and not barred[k] and (inside[k] or not articles))
    parts: list[str] = []
    for k, text, block in page.pieces:
        if block:
            parts.append(" ")
        if not markup[k] and ((inside[k] and not out[k]) or title[k]):
            parts.append(text)
    return " ".join("".join(parts).split())


def _main_slot(tree: Node, slots: list[Node], known: list[Node | None], wrapper: Wrapper, out: set[int]) -> tuple[int, int]:
    """The smallest slot (its place, and the first place after it) with most of the varying text, as the host's pages have it."""
    own = [0.0 if s in out else 0.0 if known[s] is None else wrapper.weight[id(known[s])] for s in range(len(slots))]
    if not any(own):
        own = [0.0 if s in out or known[s] is None else float(x.chars) for s, x in enumerate(slots)]
    place = {id(x): s for s, x in enumerate(slots)}
    size, total = [1] * len(slots), own[:]
    for s in range(len(slots) - 1, -1, -1):
        for c in slots[s].children:
            size[s] += size[place[id(c)]]
            total[s] += 0.0 if place[id(c)] in out else total[place[id(c)]]
    at = 0
    while slots[at].children:
        c = max((place[id(x)] for x in slots[at].children), key=lambda s: (0.0 if s in out else total[s], -s))
        if c in out or not total[c] or total[c] < MOST * total[0] or own[c] * 2 >= total[c]:
            break
        at = c
    return at, at + size[at]


def _edges(e, slot_of: list[int], main: tuple[int, int], out: list[bool], slots: list[Node], first: dict[int, int]) -> set[int]:
    """The elements whose text is the main text: an article around the main slot, or those inside it that hold most of it, or the slot's."""
    n = len(e)
    members = {k for k in range(n) if slot_of[k] == main[0] and (k == 0 or e[k].tag not in INLINE | VOID | MARKUP)}
    for tag in ("article", "main"):
        outermost = [-1] * n
        for k in range(1, n):
            up = outermost[e[k].parent]
            outermost[k] = up if up >= 0 else k if e[k].tag == tag and not out[k] else -1
        if around := {outermost[k] for k in members} - {-1}:
            return around
    chars = [slots[s].chars for s in range(len(slots))]
    for tag in ("article", "main"):
        found = {k for k in range(n) if e[k].tag == tag and not out[k] and main[0] < slot_of[k] < main[1]}
        if found:
            below = [False] * n
            for k in range(1, n):
                below[k] = k in found or below[e[k].parent]
            held = sum(chars[s] for s in range(*main) if below[first[s]])
            if held * 2 >= sum(chars[s] for s in range(*main) if not out[first[s]]):
                return found
    return members


# ---- in Spark --------------------------------------------------------------------------------


def templates(pages: DataFrame) -> DataFrame:
    """host, templates (JSON) over all pages (host, html)."""
    names = ["host", "tree"]

    def flush(hosts: dict[str, Host]) -> pa.RecordBatch:
        rows = [(h, json.dumps([t])) for h, own in sorted(hosts.items()) for t in json.loads(own.dump())]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=names)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[str, Host] = {}
        for b in batches:
            for host, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                hosts.setdefault(host, Host()).add(page_tree(read(html))[0])
            if len(hosts) > HOSTS:
                yield flush(hosts)
                hosts = {}
        yield flush(hosts)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, own = None, Host()
        for b in batches:
            done = []
            for name, tree in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != host:
                    if host is not None:
                        done.append((host, own.dump()))
                    host, own = name, Host()
                for t in json.loads(tree):
                    own.add(Node.load(t))
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=names)
        if host is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (host, own.dump())], names=names)

    rows = pages.select("host", "html").mapInArrow(gather, "host string, tree string")
    return rows.repartition("host").sortWithinPartitions("host", "tree").mapInArrow(fold, "host string, tree string").withColumnRenamed("tree", "templates")


def extract_text(df: DataFrame, key: str = "page_id") -> DataFrame:
    """key, url, text, n_chars of every row.

    Null html is empty, as is a page without content. Pages without a host are a host of their own.
    Rows with equal keys give a row each; other columns are not read; an empty table gives an empty
    result. Nothing is cut off: the text has all content blocks of the page.
    """
    spark = df.sparkSession
    short_batches(spark)
    scratch = Scratch(spark)
    pages = df.select(F.col(key), "url", canonical(F.col("url"))[0].alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    wrappers = scratch.save(templates(pages))
    size = wrappers.agg(F.coalesce(F.sum(F.length("templates") + F.length("host")), F.lit(0))).first()[0]
    sent = spark.sparkContext.broadcast({r.host: r.templates for r in wrappers.collect()}) if size <= BROADCAST_BYTES else None
    joined = pages.select(key, "url", "host", "html") if sent else pages.join(wrappers, "host", "left").select(key, "url", "host", "html", "templates")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, list[Wrapper]] = {}
        for b in batches:
            texts = []
            found = b.column(4) if sent is None else None
            for k, (host, html) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if host not in cache:
                    if len(cache) > 500:
                        cache.clear()
                    cache[host] = [Wrapper(Node.load(t)) for t in json.loads((sent.value.get(host) if sent else found[k].as_py()) or "[]")]
                page, own = read(html), cache[host]
                tree, slot_of = page_tree(page)
                if len(own) > 1:
                    build = tree.build()
                    got = next((w for w in own if build in w.builds), None)
                    if got is None:
                        like = best([w.template for w in own], tree)[0]
                        got = next(w for w in own if w.template is like)
                    own = [got]
                texts.append(extract(page, own[0] if own else None, tree, slot_of))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
