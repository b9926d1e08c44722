"""Pages as trees of blocks, and what can be measured of each block.

Only what starts a new line on a page is a node: blocks, and runs of text that stand beside blocks. Inline markup belongs to the text around it. Trees are lists in page
order, so that a subtree is a range, and sums over subtrees are differences of running sums.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np

#: Tags that are alike; a node's first features say which of these it is. Names of HTML.
TAGS = {
    "text": "#text",
    "paragraph": "p",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "item": "li dt dd",
    "list": "ul ol dl menu",
    "division": "div center",
    "section": "section",
    "article": "article main",
    "nav": "nav search",
    "header": "header",
    "footer": "footer",
    "aside": "aside",
    "form": "form fieldset legend",
    "table": "table thead tbody tfoot tr td th caption",
    "quote": "blockquote pre",
    "figure": "figure figcaption details summary",
    "address": "address",
    "dialog": "dialog",
}
#: Words in the values of class, id and role that say what a block is for.
HINTS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toolbar pagination pager tabs topnav",
    "top": "header masthead topbar logo branding banner",
    "bottom": "footer foot colophon copyright legal contentinfo",
    "side": "sidebar side aside widget widgets complementary rail related recommended trending popular teaser",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog toast paywall subscribe newsletter signup",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion",
    "form": "form search login contact",
    "comment": "comment comments commentlist reply replies respond discussion",
    "share": "share sharing social follow",
    "content": "article content main post entry story body text page hentry prose",
    "about": "author byline date meta tags caption",
}
_TAG_BIT = {tag: 1 << k for k, tags in enumerate(TAGS.values()) for tag in tags.split()}
_HINT_BIT = {word: 1 << (len(TAGS) + k) for k, words in enumerate(HINTS.values()) for word in words.split()}
BITS = len(TAGS) + len(HINTS)

#: Their contents are no text of the page.
_HIDDEN = frozenset("head template svg math canvas audio video object select button datalist".split())
#: Of these, what stands inside a line.
_INSIDE = frozenset("svg math canvas audio video object select button datalist".split())
_BLOCKS = frozenset(_TAG_BIT) | _HIDDEN
#: Opening one of these ends an open one of the second kind, unless one of the third lies between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: A comment, an element whose content is no markup, a declaration, or a tag. A "<" starts a new match at the latest, so the time is linear.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(script|style|textarea|title|iframe|noscript|noembed|noframes|xmp)\b(?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+>.*?(?:</\1\b[^>]*(?:>|\Z)|\Z)
    |<[!?][^>]*(?:>|\Z)
    |<(/?)([a-z][^\s/<>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+'|["'])*+)>""",
    re.I | re.S | re.X,
)
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))""", re.I)
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@lru_cache(maxsize=4096)
def _hints(attributes: str) -> int:
    bits = 0
    for values in _ATTRIBUTE.findall(attributes):
        for word in _HINT.findall("".join(values)):
            bits |= _HINT_BIT.get(word.lower(), 0)
    return bits


@dataclass
class Tree:
    """Nodes in page order; the first is the body. text: of leaves, white space as one blank; links: characters of it in links."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    own: list[int] = field(default_factory=lambda: [0])
    above: list[int] = field(default_factory=lambda: [0])
    text: list[str] = field(default_factory=lambda: [""])
    links: list[int] = field(default_factory=lambda: [0])

    def add(self, parent: int, own: int) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.own.append(own)
        self.above.append(self.above[parent] | own)
        self.text.append("")
        self.links.append(0)
        return len(self.parent) - 1


def parse(html: str) -> Tree:
    """The tree of a page. Nothing is required of the markup: what is not closed ends with what it stands in, what was never opened is not closed."""
    tree = Tree()
    stack, names, open_tags, hidden = [0], ["body"], {}, 0
    run, linked, in_link, at = [], 0, 0, 0

    def end_run(closing: bool) -> None:
        """The text so far becomes that of the node, if that is all it has, else a node beside its blocks."""
        nonlocal run, linked
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                node = stack[-1] if closing and len(tree.parent) - 1 == stack[-1] and len(stack) > 1 else tree.add(stack[-1], _TAG_BIT["#text"])
                tree.text[node], tree.links[node] = text, min(linked, len(text))
            run, linked = [], 0

    def close() -> None:
        nonlocal hidden
        name = names.pop()
        if name not in _INSIDE:
            end_run(True)
        stack.pop()
        open_tags[name] -= 1
        hidden -= name in _HIDDEN

    for token in _TOKEN.finditer(html):
        begin = token.start()
        if begin > at and not hidden:
            run.append(html[at:begin])
            linked += (begin - at) if in_link else 0
        at = token.end()
        name = token[3]
        if name is None:
            continue
        name = name.lower()
        if name not in _BLOCKS:
            if name == "a":
                in_link = 0 if token[2] else 1
            elif name == "br" and not hidden:
                run.append(" ")
            elif name == "body" and names[-1] == "head":
                close()
            elif name == "hr":
                end_run(False)
            continue
        if token[2]:
            if open_tags.get(name):
                while names[-1] != name:
                    close()
                close()
            continue
        if hidden and names[-1] == "head" and name not in _HIDDEN:
            close()  # a block ends a head that was not closed
        if name not in _INSIDE:
            if names[-1] == "p":
                close()
            elif name in _ENDS:
                ended, bounds = _ENDS[name]
                if any(open_tags.get(x) for x in ended):
                    k = len(names) - 1
                    while k > 0 and names[k] not in ended and names[k] not in bounds:
                        k -= 1
                    if k > 0 and names[k] in ended:
                        while len(names) > k:
                            close()
            end_run(False)
            attributes = token[4]
            bits = _TAG_BIT.get(name, 0) | (_hints(attributes) if len(attributes) < 200 else _hints.__wrapped__(attributes))
            stack.append(tree.add(stack[-1], bits))
        else:
            stack.append(stack[-1])
        names.append(name)
        open_tags[name] = open_tags.get(name, 0) + 1
        hidden += name in _HIDDEN
    if at < len(html) and not hidden:
        run.append(html[at:])
    while len(stack) > 1:
        close()
    end_run(False)
    return tree


_STOPS = re.compile(r"[.,;:!?]")
NUMBERS = """chars words stops leaves nodes children linked depth share before after siblings place of_siblings previous next
    per_leaf per_node per_word link_share parent_share parent_links""".split()
FEATURES = [*NUMBERS, *(f"own_{name}" for name in (*TAGS, *HINTS)), *(f"above_{name}" for name in (*TAGS, *HINTS))]


@dataclass
class Forest:
    """The nodes of several trees behind each other. begins: of each tree its first node (one more at the end)."""

    parent: np.ndarray
    depth: np.ndarray
    begins: np.ndarray
    text: list[str]
    features: np.ndarray


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """Nodes of each depth, the deepest first."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)[::-1] if len(depth) else []


def measured(trees: list[Tree]) -> Forest:
    """What is known of each node: sizes of its subtree, densities, its place among siblings and in the page, tags and attribute words of it and above it."""
    sizes = np.array([len(t.parent) for t in trees], np.int64)
    begins = np.append(0, np.cumsum(sizes))
    n, tree_of = int(begins[-1]), np.repeat(np.arange(len(trees)), sizes)
    first = begins[tree_of]
    join = lambda name, kind: np.array([v for t in trees for v in getattr(t, name)], kind)
    parent, depth = join("parent", np.int64), join("depth", np.int64)
    root = parent < 0
    parent = np.where(root, np.arange(n), parent + first)
    text = [s for t in trees for s in t.text]

    children = np.bincount(parent[~root], minlength=n) if n else np.zeros(0, np.int64)
    end = np.arange(1, n + 1)
    for at in levels(depth):  # from the deepest up: a subtree ends where that of the last child does
        np.maximum.at(end, parent[at], end[at])

    def below(values: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(values))
        return (sums[end] - sums[np.arange(n)]).astype(np.float64)

    own_chars = np.array([len(s) for s in text], np.int64)
    chars, linked = below(own_chars), below(join("links", np.int64))
    words, stops = below(np.array([s.count(" ") + 1 if s else 0 for s in text])), below(np.array([len(_STOPS.findall(s)) for s in text]))
    leaves, nodes = below(own_chars > 0), below(np.ones(n, np.int64))
    running = np.append(0, np.cumsum(own_chars))
    total = np.maximum(1, running[begins[1:]] - running[begins[:-1]])[tree_of] if n else chars
    before = (running[:-1] - running[first]) / total

    # Siblings in page order: nodes by parent; the body is its own only sibling.
    by_parent = np.argsort(np.where(root, -1 - np.arange(n), parent), kind="stable")
    rank, previous, following = np.zeros(n), np.zeros(n), np.zeros(n)
    if n:
        group = np.where(root, -1 - np.arange(n), parent)[by_parent]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        rank[by_parent] = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        same = np.append(group[1:] == group[:-1], False)
        following[by_parent[same]] = chars[by_parent[np.flatnonzero(same) + 1]]
        previous[by_parent[np.flatnonzero(same) + 1]] = chars[by_parent[same]]
    siblings = np.where(root, 1, children[parent]) if n else chars
    of_siblings = np.where(siblings > 1, (chars[parent] - chars) / np.maximum(1, siblings - 1), 0) if n else chars
    ratio = lambda a, b: a / np.maximum(1, b)
    numbers = [chars, words, stops, leaves, nodes, children, linked, depth, chars / total, before, 1 - before - chars / total, siblings, rank, of_siblings, previous, following]
    numbers += [ratio(chars, leaves), ratio(chars, nodes), ratio(chars, words), ratio(linked, chars), ratio(chars, chars[parent]), ratio(linked[parent], chars[parent])]
    features = np.empty((n, len(FEATURES)), np.float32)
    features[:, : len(numbers)] = np.stack(numbers, axis=1) if n else 0
    for k, name in enumerate(("own", "above")):
        bits = join(name, np.int64)
        features[:, len(numbers) + k * BITS : len(numbers) + (k + 1) * BITS] = bits[:, None] >> np.arange(BITS) & 1
    return Forest(parent, depth, begins, text, features)
