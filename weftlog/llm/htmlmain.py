"""Main text of web pages by a graphical model on the document tree.

Every block element and every run of text is a binary variable (content or not). A node has a
potential from its features (tag, words of class and id, length, share of link text), an edge
one from the pair of labels. Sum-product messages go from the leaves to the root and back
and give each node's probability of being content; on a tree they are exact. The weights are
fitted by maximum likelihood on labelled pages, with the same messages for the expectations.
"""

from __future__ import annotations

import functools
import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlog.llm import labelled
from weftlog.llm.base import map_batches

# Quoted attribute values may hold ">"; the unrolled form reads every character once.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>?|<[!?][^>]*>?""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg head select".split())
# Those that hold markup: without an end tag only the tag itself is dropped.
READ_ON = frozenset("noscript template svg head select".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
# A start tag of the first closes an open element of the second, up to the nearest of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

# Words of class, id and role that say what an element is for.
PURPOSES = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager tabs toc",
    "head": "header masthead logo topbar banner",
    "foot": "footer copyright legal colophon contentinfo bottom",
    "side": "sidebar side aside widget related recommended recommend share sharing social tags tag links more complementary teaser popular trending",
    "ad": "ad ads adv advert advertisement advertisements sponsor sponsored promo promotion banner dfp",
    "notice": "cookie cookies notice consent alert popup modal newsletter subscribe subscription signup login gdpr overlay warning message disclaimer paywall",
    "talk": "comment comments commentlist reply replies discussion respond responses feedback review reviews disqus reader readers",
    "form": "form search contact register",
    "main": "article content main post entry story body text page prose",
}
PURPOSE_OF: dict[str, list[str]] = {}
for _kind, _words in PURPOSES.items():
    for _word in _words.split():
        PURPOSE_OF.setdefault(_word, []).append(_kind)

EPOCHS, RATE, DECAY = 60, 0.5, 1e-3


class Node:
    __slots__ = ("parent", "tag", "features", "text", "size", "linked", "label")

    def __init__(self, parent: int, tag: str, features: tuple[str, ...], label: int):
        self.parent, self.tag, self.features, self.label = parent, tag, features, label
        self.text: str | None = None
        self.size = self.linked = 0


@functools.lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> tuple[tuple[str, ...], int | None]:
    """Features of an element and its label, if it has one."""
    found, label = {f"tag={tag}"}, None
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = a or b or c
        if name.lower() == "data-label":
            label = int(value)
            continue
        for part in NAME_PART.findall(value):
            found.update(f"for={p}" for p in PURPOSE_OF.get(part.lower(), ()))
    return tuple(sorted(found)), label


def tree(page: str) -> list[Node]:
    """Nodes in page order, parents before children; node 0 is the root. Text runs are leaves."""
    nodes = [Node(-1, "#root", ("tag=#root",), 0)]
    stack, open_links = [0], 0
    run: list[str] = []
    run_linked = pos = 0

    def flush() -> None:
        nonlocal run_linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                top = stack[-1]
                leaf = Node(top, "#text", (), nodes[top].label)
                leaf.text, leaf.size, leaf.linked = text, len(text), min(len(text), run_linked)
                nodes.append(leaf)
            run.clear()
        run_linked = 0

    def add(piece: str) -> None:
        nonlocal run_linked
        run.append(piece)
        if open_links:
            run_linked += len(piece)

    def close(names, stops=frozenset()) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[k]].tag
            if tag in names:
                flush()
                del stack[k:]
                return
            if tag in stops:
                return

    while True:
        m = TAG.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos:m.start()])
        pos = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                open_links = 0
            elif tag not in INLINE:
                close({tag})
        elif tag in RAW:
            if tag == "svg" and m[3].endswith("/"):
                continue
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, pos)
            if end:
                pos = end.end()
            elif tag in READ_ON:
                continue
            else:
                break
        elif tag == "a":
            open_links = 1
        elif tag in VOID:
            if tag in ("br", "hr", "wbr"):
                add(" " if tag != "wbr" else "")
        elif tag not in INLINE:
            flush()
            if tag in CLOSES_P:
                close({"p"}, {"table", "td", "th", "li", "div", "article", "section"} if tag != "p" else {"table", "td", "th"})
            if tag in CLOSES:
                close(*CLOSES[tag])
            features, label = _element(tag, m[3])
            nodes.append(Node(stack[-1], tag, features, nodes[stack[-1]].label if label is None else label))
            stack.append(len(nodes) - 1)
    flush()
    for node in reversed(nodes[1:]):
        up = nodes[node.parent]
        up.size += node.size
        up.linked += node.linked
    return nodes


def describe(nodes: list[Node]) -> list[tuple[str, ...]]:
    """Features of every node, with those that depend on the text below it."""
    out = []
    for node in nodes:
        long = min(5, int(math.log(node.size + 1, 6)))
        links = "none" if not node.linked else "some" if node.linked * 2 < node.size else "most"
        kind = "leaf" if node.text is not None else "element"
        found = [f"{kind}:size={long}", f"{kind}:links={links}", f"{kind}:any"]
        if node.text is not None:
            found += [f"in={nodes[node.parent].tag}", f"ends={node.text[-1] in '.!?…'}", f"mark={'©' in node.text}"]
        out.append((*node.features, *found))
    return out


class Model:
    """Unary weights of the label "content" and pair weights by edge kind and pair of labels."""

    def __init__(self):
        self.unary: dict[str, float] = {}
        self.pair = {kind: [[0.0, 0.0], [0.0, 0.0]] for kind in ("leaf", "element")}
        self.factors: dict[str, list[list[float]]] = {}
        self.cache: dict[tuple[str, ...], float] = {}

    def freeze(self) -> "Model":
        self.factors = {k: [[math.exp(x) for x in row] for row in t] for k, t in self.pair.items()}
        self.cache = {}
        return self

    def odds(self, features: tuple[str, ...]) -> float:
        """Potential of "content" against "not", for one node alone."""
        got = self.cache.get(features)
        if got is None:
            if len(self.cache) > 50_000:
                self.cache.clear()
            got = math.exp(max(-30.0, min(30.0, sum(self.unary.get(f, 0.0) for f in features))))
            self.cache[features] = got
        return got

    def marginals(self, nodes: list[Node], described: list[tuple[str, ...]]) -> tuple[list[float], list[float], list[float]]:
        """(probability of content, upward message, message-free odds towards the parent) by node.

        Messages are ratios of "content" to "not". `below[i]` is a node's odds from itself and all
        below it, `up[i]` what it tells its parent; the way back divides its own part out.
        """
        n = len(nodes)
        own = [self.odds(d) for d in described]
        below, up = own[:], [1.0] * n
        for i in range(n - 1, 0, -1):
            f = self.factors["leaf" if nodes[i].text is not None else "element"]
            b = below[i]
            up[i] = (f[1][0] + f[1][1] * b) / (f[0][0] + f[0][1] * b)
            j = nodes[i].parent
            below[j] = min(1e30, max(1e-30, below[j] * up[i]))
        total, rest = below[:], [1.0] * n
        for i in range(1, n):
            f = self.factors["leaf" if nodes[i].text is not None else "element"]
            rest[i] = total[nodes[i].parent] / up[i]
            down = (f[0][1] + f[1][1] * rest[i]) / (f[0][0] + f[1][0] * rest[i])
            total[i] = min(1e30, max(1e-30, below[i] * down))
        return [t / (1 + t) for t in total], below, rest


def fit(pages: list[str], epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Maximum likelihood with a small ridge: observed minus expected counts, over all pages."""
    data = []
    for page in pages:
        nodes = tree(page)
        data.append((nodes, describe(nodes)))
    model = Model().freeze()
    total = sum(len(nodes) for nodes, _ in data)
    weight: dict[str, float] = {}
    for nodes, described in data:
        for d in described:
            for f in d:
                weight[f] = weight.get(f, 0.0) + 1
    for _ in range(epochs):
        unary: dict[str, float] = {}
        pair = {k: [[0.0, 0.0], [0.0, 0.0]] for k in model.pair}
        seen = {k: 1e-9 for k in model.pair}
        for nodes, described in data:
            p, below, rest = model.marginals(nodes, described)
            for i, (node, d) in enumerate(zip(nodes, described)):
                gap = node.label - p[i]
                for f in d:
                    unary[f] = unary.get(f, 0.0) + gap
                if i:
                    kind = "leaf" if node.text is not None else "element"
                    f = model.factors[kind]
                    joint = [[f[a][b] * (rest[i] if a else 1.0) * (below[i] if b else 1.0) for b in (0, 1)] for a in (0, 1)]
                    z = sum(map(sum, joint))
                    seen[kind] += 1
                    for a in (0, 1):
                        for b in (0, 1):
                            pair[kind][a][b] += ((nodes[node.parent].label, node.label) == (a, b)) - joint[a][b] / z
        for f, g in unary.items():
            w = model.unary.get(f, 0.0)
            model.unary[f] = w + rate * (g / math.sqrt(weight[f] * 20) - decay * w)
        for k, t in pair.items():
            for a in (0, 1):
                for b in (0, 1):
                    model.pair[k][a][b] += rate * (t[a][b] / math.sqrt(seen[k] * 20) - decay * model.pair[k][a][b])
        model.freeze()
    return model


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    return fit(labelled.pages())


def main_text(page: str | None, model: Model) -> str:
    """Content runs of `page` in page order, joined by one space."""
    if not page:
        return ""
    nodes = tree(page)
    p, _, _ = model.marginals(nodes, describe(nodes))
    return " ".join(n.text for n, x in zip(nodes, p) if n.text is not None and x > 0.5)


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars per row of `pages` (page_id, url, html).

    Null or empty html, and pages without content, give an empty text. Repeated rows stay. The
    weights are a few kB and go to the tasks with the function; rows do not move.
    """
    fitted = model or default_model()

    def run(ids, urls, htmls):
        texts = [main_text(h, fitted) for h in htmls]
        return {"page_id": ids, "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.select("page_id", "url", F.col("html")), run, "page_id bigint, url string, text string, n_chars bigint")
