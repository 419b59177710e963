"""Main text of web pages: gradient-boosted trees over DOM nodes, then a hierarchical decoding.

A page is parsed in one linear pass into a tree of block elements and, as leaves, runs of inline text. A node is
*kept* if article text lies in its subtree. Boosted oblivious trees (binned features, logistic loss, numpy) give
each node a probability from its subtree's text, link and tag density, the tag and attribute tokens of its own and
above, depth, and its place and size among its siblings. Decoding maximises the likelihood of a labelling
in which no kept node lies in a dropped one, by dynamic programming over the tree; the kept runs are the text.

Attribute tokens are hashed, and no list of them says what they mean: each bucket has a weight, the smoothed log-odds
that nodes with it are kept, learnt from the training pages. For training itself the weights of a page come from the
other folds, so that the trees also learn to do without a token that nothing is known of.

There are no labels, so the trees are trained on (a) at most ``sample`` hash-chosen pages that have an ``article`` or
``main`` element, where the text in it is kept and that outside is not (what lies in it under an element with
attributes or a sectioning tag of another purpose is left open and not learnt from), and (b) generated pages, whose
layouts vary, whose class names are common ones or made up, and whose sentences come from (a). There, what belongs
to the article is known from where it was put.

Defined results: null, empty and text-free pages give an empty text. Unclosed or cut-off markup closes at the end
of the page; character references are decoded; white space in a block (``br`` too) becomes one space; blocks are
joined by one line feed, none is left out for its length. Equal pages give equal texts.
"""

from __future__ import annotations

import html
import itertools
import math
import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, col

TOKEN = re.compile(
    r"""<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S
)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
LETTERS = re.compile(r"[a-z]+")
# Element names.
RAW = frozenset("script style template noscript iframe object svg math canvas audio video select textarea button title".split())
# Of those, the ones that take the rest of the page if they have no end; others without one are ignored.
TO_END = frozenset("script style title textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = frozenset("ul ol dl table article section div body nav aside main form".split())
MARKS = {"article": 0, "main": 0, "nav": 1, "menu": 1, "header": 2, "footer": 3, "aside": 4, "form": 5, "h1": 6, "h2": 6, "h3": 6, "h4": 6, "h5": 6, "h6": 6, "p": 7, "pre": 7, "blockquote": 7, "li": 8, "dd": 8, "dt": 8, "ul": 9, "ol": 9, "dl": 9, "table": 10, "td": 10, "th": 10, "figure": 11, "figcaption": 11}
#: Buckets of hashed attribute tokens.
TOKENS = 1 << 13


@dataclass
class Page:
    parent: list[int]
    names: list[str]
    flags: list[int]  # bit k: MARKS value k
    tokens: dict[int, tuple[int, ...]]  # node -> buckets of its attribute tokens
    runs: dict[int, str]  # leaf -> its text
    links: dict[int, int]  # leaf -> characters in links
    places: dict[int, int]  # leaf -> where it begins in the source


def bucket(token: str) -> int:
    return zlib.crc32(token.encode()) % TOKENS


class Open:
    """The open elements, and how many of each name: over all, and since the last wall, so that no search is in vain."""

    def __init__(self):
        self.stack, self.all, self.near = [(0, "#page")], {}, [{}]

    def push(self, node: int, name: str) -> None:
        self.stack.append((node, name))
        self.all[name] = self.all.get(name, 0) + 1
        self.near[-1][name] = self.near[-1].get(name, 0) + 1
        if name in WALLS:
            self.near.append({})

    def pop(self) -> str:
        _, name = self.stack.pop()
        if name in WALLS:
            self.near.pop()
        self.all[name] -= 1
        self.near[-1][name] -= 1
        return name

    def close(self, name: str) -> bool:
        """Close the innermost element of this name and all in it."""
        if not self.all.get(name):
            return False
        while self.pop() != name:
            pass
        return True

    def close_near(self, names: tuple[str, ...], every: bool) -> None:
        """Close the innermost element of these names that no wall hides, or every one."""
        while any(self.near[-1].get(n) for n in names):
            while self.pop() not in names:
                pass
            if not every:
                return


def parse(source: str) -> Page:
    parent, names, flags, tokens, runs, links, places = [-1], ["#page"], [0], {}, {}, {}, {}
    inside, opened = 0, Open()
    pending: list[str] = []
    linked, began = 0, -1
    endless: set[str] = set()

    def close_run():
        nonlocal linked, began
        if pending:
            text = " ".join(html.unescape("".join(pending)).split())
            pending.clear()
            if text:
                parent.append(opened.stack[-1][0])
                names.append("#run")
                flags.append(0)
                runs[len(parent) - 1], links[len(parent) - 1], places[len(parent) - 1] = text, min(linked, len(text)), began
            linked = 0
        began = -1

    at, n = 0, len(source)
    find = TOKEN.search
    while at < n:
        m = find(source, at)
        a, b = m.span() if m else (n, n)
        if a > at:
            piece = source[at:a]
            if began < 0 and not piece.isspace():
                began = at
            pending.append(piece)
            if inside:
                linked += a - at
        at = b
        name = m.group(2) if m else None
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            if name == "a":
                inside = max(0, inside - 1)
            elif name not in INLINE and name not in VOID and opened.all.get(name):
                close_run()
                opened.close(name)
                inside = 0
            continue
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
            if not end:
                endless.add(name)
            pending.append(" ")
            at = end.end() if end else n if name in TO_END else at
            continue
        if name == "head":  # its texts are raw elements; the rest belongs to the page whether or not it is closed
            continue
        if name in INLINE:
            inside += name == "a"
            continue
        if name == "br":
            pending.append(" ")
            continue
        close_run()
        inside = 0
        if name in VOID:
            continue
        if name in CLOSES_P:
            opened.close_near(("p",), False)
        elif name in ENDS:
            opened.close_near(ENDS[name], name == "tr")
        parent.append(opened.stack[-1][0])
        names.append(name)
        flags.append(1 << MARKS[name] if name in MARKS else 0)
        attrs = m.group(3)
        if attrs:
            words = {w for v in ATTRIBUTE.findall(attrs) for w in LETTERS.findall(v.lower())}
            if words:
                tokens[len(parent) - 1] = tuple(sorted(map(bucket, words)))
        opened.push(len(parent) - 1, name)
    close_run()
    return Page(parent, names, flags, tokens, runs, links, places)


FEATURES = 44


def features(page: Page, weight: np.ndarray) -> np.ndarray:
    """One row for each node; ``weight``: of each bucket of attribute tokens, 0 for one that nothing is known of."""
    parent, flags, names = page.parent, page.flags, page.names
    n = len(parent)
    depth, text, link, leaves, nodes, kids, stops, place = ([0] * n for _ in range(8))
    above, title, alike, named, best, marked, seen = ([0] * n for _ in range(7))
    own_low, own_high, low, high, beside = ([0.0] * n for _ in range(5))
    nodes[:] = [1] * n
    scores = {i: weight[list(t)] for i, t in page.tokens.items()}
    heads, same = 0, {}
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | flags[p]
        place[i] = kids[p]
        kids[p] += 1
        same[p, names[i]] = same.get((p, names[i]), 0) + 1
        low[i], high[i] = min(low[p], own_low[p]), max(high[p], own_high[p])
        if i in scores:
            own_low[i], own_high[i] = float(min(scores[i].min(), 0)), float(max(scores[i].max(), 0))
            beside[p] += own_low[i] + own_high[i]
            named[i], marked[p] = 1, marked[p] + 1
        title[i] = names[i] == "h1"
        seen[i] = heads
        heads += title[i]
    for i, t in page.runs.items():
        text[i], link[i], leaves[i] = len(t), page.links[i], 1
        stops[i] = t.count(". ") + t.count(", ") + (t[-1] in ".!?")
    for i in range(n - 1, 0, -1):
        p = parent[i]
        text[p] += text[i]
        link[p] += link[i]
        leaves[p] += leaves[i]
        nodes[p] += nodes[i]
        stops[p] += stops[i]
        title[p] |= title[i]
        best[p] = max(best[p], text[i])
        alike[i] = same[p, names[i]]
    up = np.array(parent)
    up[0] = 0
    depth, text, link, leaves, nodes, kids, stops, place, title, alike, named, best, marked, seen = (np.array(c, np.float64) for c in (depth, text, link, leaves, nodes, kids, stops, place, title, alike, named, best, marked, seen))
    own_low, own_high, low, high, beside = (np.array(c) for c in (own_low, own_high, low, high, beside))
    own, above = np.array(flags, np.int64), np.array(above, np.int64)
    others = np.maximum(kids[up] - 1, 1)
    x = np.zeros((n, FEATURES), np.float32)
    x[:, 0] = depth
    x[:, 1] = np.log1p(text)
    x[:, 2] = link / np.maximum(text, 1)
    x[:, 3] = nodes / np.maximum(text, 1) * 100
    x[:, 4] = stops / np.maximum(text, 1) * 100
    x[:, 5] = np.log1p(text / np.maximum(leaves, 1))
    x[:, 6] = text / max(text[0], 1)
    x[:, 7] = np.log1p(kids)
    x[:, 8] = np.log1p(place)
    x[:, 9] = place / others
    x[:, 10] = np.log1p(np.maximum(text[up] - text, 0) / others)
    x[:, 11] = link[up] / np.maximum(text[up], 1)
    x[:, 12] = np.log1p(kids[up])
    x[:, 13] = np.log1p(text[up] / np.maximum(leaves[up], 1))
    both = own | above
    for k in range(6):
        x[:, 14 + k] = both >> k & 1
    for k in range(6, 10):
        x[:, 14 + k] = (own | own[up]) >> k & 1
    x[:, 24] = np.minimum(low, own_low)
    x[:, 25] = np.maximum(high, own_high)
    x[:, 26] = own_low
    x[:, 27] = own_high
    x[:, 28] = own & 1
    x[:, 29] = own_low[up]
    x[:, 30] = text[up] / max(text[0], 1)
    x[:, 31] = stops[up] / np.maximum(text[up], 1) * 100
    x[:, 32] = (beside[up] - own_low - own_high) / others
    x[:, 33] = title
    x[:, 34] = title[up]
    x[:, 35] = np.sign(seen) + title  # before, after or around the first title
    x[:, 36] = alike / np.maximum(kids[up], 1)
    x[:, 37] = named
    x[:, 38] = (marked[up] - named) / others
    x[:, 39] = text / np.maximum(best[up], 1)
    x[:, 40] = best / np.maximum(text, 1)
    x[:, 41] = named[up]
    x[:, 42] = title[up[up]]
    x[:, 43] = text[up[up]] / max(text[0], 1)
    return x


@dataclass
class Trees:
    """Oblivious trees: at each level of a tree one question for all its nodes."""

    bias: float
    asked: np.ndarray  # (trees, depth) features
    bounds: np.ndarray  # (trees, depth) thresholds
    leaf: np.ndarray  # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        columns = np.ascontiguousarray(x.T)
        for f, b, leaf in zip(self.asked, self.bounds, self.leaf):
            at = np.zeros(len(x), np.int64)
            for k in range(len(f)):
                at = at * 2 + (columns[f[k]] > b[k])
            out += leaf[at]
        return out


def context(page: Page, margin: np.ndarray) -> np.ndarray:
    """What a first round of trees says around each node: above, beside and below it, the runs by their lengths."""
    parent, n = page.parent, len(page.parent)
    own = np.clip(margin, -8, 8).tolist()
    least, beside, kids, told, mass = own[:], [0.0] * n, [0] * n, [0.0] * n, [0.0] * n
    for i in range(1, n):
        least[i] = min(least[parent[i]], own[i])
        beside[parent[i]] += own[i]
        kids[parent[i]] += 1
    for i, t in page.runs.items():
        mass[i] = 1 + math.log1p(len(t))
        told[i] = own[i] * mass[i]
    for i in range(n - 1, 0, -1):
        told[parent[i]] += told[i]
        mass[parent[i]] += mass[i]
    up = np.array(parent)
    up[0] = 0
    own, least, beside, kids, told, mass = (np.array(c, float) for c in (own, least, beside, kids, told, mass))
    mean = told / np.maximum(mass, 1)
    return np.stack([own, own[up], own[up[up]], least[up], (beside[up] - own) / np.maximum(kids[up] - 1, 1), mean, mean[up], mean[up[up]]], 1).astype(np.float32)


@dataclass
class Model:
    weight: np.ndarray  # of each bucket of attribute tokens
    first: Trees
    second: Trees  # asks what the first say around a node, too

    def margins(self, pages: list[Page]) -> list[np.ndarray]:
        if not pages:
            return []
        x = np.concatenate([features(p, self.weight) for p in pages])
        ends = np.cumsum([len(p.parent) for p in pages])[:-1]
        said = np.split(self.first.margin(x), ends)
        return np.split(self.second.margin(np.concatenate([x, np.concatenate([context(p, m) for p, m in zip(pages, said)])], 1)), ends)


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 80, depth: int = 5, rate: float = 0.25, bins: int = 32, ridge: float = 2.0, share: float = 0.5, seed: int = 7) -> Trees:
    """Newton boosting; each tree is chosen on a random ``share`` of the rows, each question from one of the features."""
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]).astype(np.int32)
    useful = [f for f, c in enumerate(cuts) if len(c)]
    mean = np.average(y, weights=w) if len(y) else 0.5
    margin = np.full(len(y), math.log(max(mean, 1e-3) / max(1 - mean, 1e-3)))
    trees = Trees(float(margin[0]) if len(y) else 0.0, np.zeros((rounds, depth), np.int64), np.full((rounds, depth), np.inf), np.zeros((rounds, 1 << depth)))
    for r in range(rounds if useful else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (y - p), w * p * (1 - p)
        some = np.flatnonzero(rng.random(len(y)) < share)
        gs, hs, at = g[some], h[some], np.zeros(len(some), np.int64)
        whole = np.zeros(len(y), np.int64)
        for k in range(depth):
            best = (-np.inf, 0, 0)
            for f in rng.choice(useful, max(1, int(share * len(useful))), replace=False).tolist():
                m = len(cuts[f]) + 1
                key = at * m + binned[f][some]
                gl = np.bincount(key, gs, (1 << k) * m).reshape(-1, m).cumsum(1)
                hl = np.bincount(key, hs, (1 << k) * m).reshape(-1, m).cumsum(1)
                gl, hl, gt, ht = gl[:, :-1], hl[:, :-1], gl[:, -1:], hl[:, -1:]
                gain = (gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge)).sum(0)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (gain[j], f, j)
            _, f, j = best
            trees.asked[r, k], trees.bounds[r, k] = f, cuts[f][j]
            at = at * 2 + (binned[f][some] > j)
            whole = whole * 2 + (binned[f] > j)
        trees.leaf[r] = rate * np.bincount(whole, g, 1 << depth) / (np.bincount(whole, h, 1 << depth) + ridge)
        margin += trees.leaf[r][whole]
    return trees


def decode(page: Page, margin: np.ndarray) -> list[int]:
    """The kept runs: best labelling in which a dropped node drops all below it; in it, a run counts by its length."""
    parent, n = page.parent, len(page.parent)
    weight = np.ones(n)
    for i, t in page.runs.items():
        weight[i] = 1 + math.log1p(len(t))
    yes = (-np.logaddexp(0, -margin) * weight).tolist()
    no = (-np.logaddexp(0, margin) * weight).tolist()
    some = [i in page.runs for i in range(n)]  # a node may be kept only for a kept run
    keep, drop = yes[:], no[:]
    regret, hope = [-math.inf] * n, [False] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        if not some[i] and not hope[i]:
            keep[i] = -math.inf
        elif not some[i] and regret[i] < 0:
            keep[i] += regret[i]  # no child gains by being kept: keep the one that costs least
        drop[p] += drop[i]
        keep[p] += max(keep[i], drop[i])
        if keep[i] > -math.inf:
            hope[p] = True
            regret[p] = max(regret[p], min(0.0, keep[i] - drop[i]))
    kept = [False] * n
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[parent[i]] and keep[i] > drop[i]
    return [i for i in page.runs if kept[i]]


def texts(model: Model, sources: list[str]) -> list[str]:
    pages = [parse(s) for s in sources]
    return ["\n".join(p.runs[i] for i in decode(p, m)) for p, m in zip(pages, model.margins(pages))]


def up_from(page: Page, leaf: int, y: np.ndarray) -> None:
    """Mark a leaf and all above it."""
    while leaf >= 0 and not y[leaf]:
        y[leaf] = 1
        leaf = page.parent[leaf]


#: Tags (bits of MARKS) under which text is no part of the article: nav and menu, footer, aside, form; header outside of it.
ASIDE, HEADER = 1 << 1 | 1 << 3 | 1 << 4 | 1 << 5, 1 << 2


def weak(page: Page) -> tuple[np.ndarray, np.ndarray] | None:
    """Labels of a page that marks its article, and which of them to learn from.

    Kept: runs under article or main, and not under a tag of another purpose. Left open: what lies in the article
    under an element that has attributes or is a box of its own, as its purpose is unknown.
    """
    n, inside, other, unsure = len(page.parent), [False] * len(page.parent), [False] * len(page.parent), [False] * len(page.parent)
    y = np.zeros(n)
    for i in range(1, n):
        p, f = page.parent[i], page.flags[i]
        inside[i] = inside[p] or bool(f & 1)
        other[i] = other[p] or bool(f & ASIDE) or bool(f & HEADER) and not inside[i]
        unsure[i] = unsure[p] or inside[p] and (i in page.tokens or page.names[i] in ("div", "section"))
        if i in page.runs and inside[i] and not other[i] and not unsure[i]:
            up_from(page, i, y)
    return (y, ~np.array(unsure)) if y.any() else None


MARK = "\x00"
# Names that sites give to parts of a page, for generated pages; what they mean is learnt, and others are made up.
NAMES = {
    "ad": "ad ads advert advertisement sponsored sponsor banner promo promotion adsense",
    "nav": "menu nav navbar navigation",
    "header": "masthead topbar header",
    "crumbs": "breadcrumb breadcrumbs",
    "notice": "cookie cookies consent notice alert gdpr popup modal",
    "aside": "sidebar rail widget related recommended more",
    "form": "newsletter subscribe signup search login",
    "share": "share social tags sharing",
    "comments": "comments replies disqus discussion respond",
    "comment": "comment reply",
    "footer": "footer copyright legal",
    "article": "article content post entry story main text body",
    "part": "section chapter part block intro",
}


def generated(rng: random.Random, sentences: list[str], known: float = 0.5) -> tuple[str, set[int]]:
    """A page, and the places in its source where blocks of its article begin.

    A share ``known`` of the pages uses common names for its classes, the others make them up.
    """
    common = rng.random() < known
    made: dict[str, str] = {}

    def say(low: int, high: int) -> str:
        return " ".join(rng.choice(sentences) for _ in range(rng.randint(low, high)))

    def word() -> str:
        return rng.choice(sentences).split()[0].strip(".,")

    def name(kind: str) -> str:
        """Of one page, a made-up name always means the same."""
        if common:
            return rng.choice(["", "site-", "page ", "c-"]) + rng.choice(NAMES[kind].split())
        if kind not in made:
            made[kind] = "".join(rng.choice("bcdfghklmnprstvwxz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "-box", "_1", "-x"])
        return made[kind]

    def box(tag: str, kind: str, inner: str) -> str:
        """Named by its tag, by a class or id, or both."""
        how = rng.random()
        if how < 0.35 and tag not in ("div", "section"):
            return f"<{tag}>{inner}</{tag}>"
        tag = tag if how < 0.6 else "div"
        return f'<{tag} {rng.choice(["class", "id"])}="{name(kind)}">{inner}</{tag}>'

    def title() -> str:
        text = rng.choice(sentences)
        return text if rng.random() < 0.3 else " ".join(text.rstrip(".").split()[: rng.randint(2, 9)])

    def links(low: int, high: int) -> str:
        items = [f'<a href="/x">{word()}{" " + word() if rng.random() < 0.4 else ""}</a>' for _ in range(rng.randint(low, high))]
        return "<ul><li>" + "</li><li>".join(items) + "</li></ul>" if rng.random() < 0.7 else rng.choice([" ", " | "]).join(items)

    def own(tag: str, text: str, attrs: str = "") -> str:
        return f"<{tag}{attrs}>{MARK}{html.escape(' '.join(text.split()), quote=False)}</{tag}>"

    def comments() -> str:
        each = name("comment")
        return box("section", "comments", f"<h3>{word()}</h3>" + "".join(f'<div class="{each}"><p>{say(1, 4)}</p></div>' for _ in range(rng.randint(1, 4))))

    noise = {
        "nav": lambda: box("nav", "nav", links(3, 10)),
        "header": lambda: box("header", "header", rng.choice([f"<h1>{word()}</h1>", f"<p>{word()} {word()}</p>", f"<h2>{word()}</h2>{links(2, 5)}"])),
        "crumbs": lambda: box("div", "crumbs", links(2, 4)),
        "notice": lambda: box("div", "notice", f"<p>{say(1, 3)}</p><button>OK</button>"),
        "ad": lambda: box("div", "ad", f"<p>{say(1, 2)}</p>" if rng.random() < 0.5 else say(1, 2)),
        "aside": lambda: box("aside", "aside", f"<h3>{word()}</h3>" + rng.choice([links(3, 8), f"<p>{say(1, 3)}</p>"])),
        "form": lambda: box("form", "form", f"<p>{say(1, 1)}</p><label>{word()}</label><input name=q>"),
        "share": lambda: box("div", "share", links(2, 6)),
        "comments": comments,
        "footer": lambda: box("footer", "footer", f"&copy; {word()} &middot; {say(1, 2)}" if rng.random() < 0.6 else f"<p>{say(1, 2)}</p>" + links(2, 6)),
    }
    pick = lambda kinds, p: "".join(noise[k]() for k in kinds.split() if rng.random() < p)
    before = pick("notice header nav crumbs ad", 0.55)
    parts = [own("h1", title())] if rng.random() < 0.85 else []
    if parts and rng.random() < 0.2:
        parts = [f"<header>{parts[0]}</header>"]
    wrapped = rng.random() < 0.15  # its blocks in boxes of their own
    for _ in range(rng.randint(1, 9)):
        kind = rng.random()
        if wrapped:
            parts.append(f'<{"section" if common else "div"} class="{name("part")}">' + "".join(own("p", say(1, 7)) for _ in range(rng.randint(2, 4))) + f'</{"section" if common else "div"}>')
        elif kind < 0.78:
            parts.append(own("p", say(1, 7)))
        elif kind < 0.86:
            parts.append(own(rng.choice(["h2", "h3"]), title()))
        elif kind < 0.92:
            parts.append("<ul>" + "".join(own("li", say(1, 2)) for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.96:
            parts.append(f"<blockquote>{own('p', say(1, 3))}</blockquote>")
        else:
            parts.append(own("p", word()))
        if rng.random() < 0.12:
            parts.append(noise[rng.choice(["ad", "share", "form", "aside"])]())
    if rng.random() < 0.25:
        parts.append(noise["comments"]())
    how, inner = rng.random(), "".join(parts)
    article = f"<article>{inner}</article>" if how < 0.4 else f"<main>{inner}</main>" if how < 0.55 else f'<div class="{name("article")}">{inner}</div>' if how < 0.9 else f"<section>{inner}</section>"
    if rng.random() < 0.3:
        article = f"<div>{article}</div>"
    pieces = f"<html><head><title>{word()}</title></head><body>{before}{article}{pick('ad aside share comments form footer', 0.5)}</body></html>".split(MARK)
    return "".join(pieces), set(itertools.accumulate(map(len, pieces[:-1])))


def truth(page: Page, places: set[int]) -> np.ndarray:
    """Labels of a generated page: the runs that begin at the places of its article's blocks, and all above them."""
    y = np.zeros(len(page.parent))
    for i, at in page.places.items():
        if at in places:
            up_from(page, i, y)
    return y


def token_weights(pages: list[Page], ys: list[np.ndarray], sure: list[np.ndarray], doubt: float = 3.0) -> np.ndarray:
    """Smoothed log-odds of each bucket's nodes to be kept, against all nodes with attributes; 0 for a bucket not met."""
    there, kept = np.zeros(TOKENS), np.zeros(TOKENS)
    for page, y, ok in zip(pages, ys, sure):
        for i, tokens in page.tokens.items():
            if ok[i]:
                there[list(tokens)] += 1
                kept[list(tokens)] += y[i]
    p = (kept.sum() + 1) / (there.sum() + 2)
    odds = np.log((kept + doubt * p) / (there - kept + doubt * (1 - p))) - math.log(p / (1 - p))
    return np.where(there > 0, odds, 0.0)


def fit(sources: list[str], pages: int = 1000, folds: int = 6, seed: int = 3) -> Model:
    rng = random.Random(seed)
    found, ys, sure = [], [], []
    sentences: list[str] = []
    for source in sources:
        page = parse(source)
        labels = weak(page)
        if labels is not None:
            found.append(page), ys.append(labels[0]), sure.append(labels[1])
            for i, t in page.runs.items():
                if labels[0][i]:
                    sentences += [s.strip() + "." for s in t.split(". ") if 3 < len(s) < 400][:20]
    alphabet = "eeetaoinshrdlu"
    while len(sentences) < 200:
        sentences.append(" ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(3, 18))).capitalize() + ".")
    sentences = sorted(set(sentences))
    for _ in range(pages):
        source, places = generated(rng, sentences)
        page = parse(source)
        found.append(page), ys.append(truth(page, places)), sure.append(np.ones(len(page.parent), bool))
    # a page's features use weights learnt without its fold
    fold = [k % folds for k in range(len(found))]
    without = [token_weights(*zip(*[(p, y, ok) for p, y, ok, f in zip(found, ys, sure, fold) if f != k])) for k in range(folds)]
    x, y, ok, fold = np.concatenate([features(p, without[f]) for p, f in zip(found, fold)]), np.concatenate(ys), np.concatenate(sure), np.repeat(fold, [len(p.parent) for p in found])
    weigh = 1 + 3.0 * x[:, 20]  # headings are few and short, and lost most easily
    # the second trees learn from what first trees of the other half say
    half, said = fold % 2 == 1, np.zeros(len(y))
    for part in (half, ~half):
        use = ok & ~part
        said[part] = boost(x[use], y[use], weigh[use]).margin(x[part])
    ends = np.cumsum([len(p.parent) for p in found])[:-1]
    wide = np.concatenate([x, np.concatenate([context(p, m) for p, m in zip(found, np.split(said, ends))])], 1)
    return Model(token_weights(found, ys, sure), boost(x[ok], y[ok], weigh[ok]), boost(wide[ok], y[ok], weigh[ok]))


def train(df: DataFrame, source: str = "html", order: str = "page_id", sample: int = 150) -> Model:
    """Fit on at most ``sample`` pages, those of the least hash of ``order`` and page, and on generated pages.

    A bound on the hash, from the count of pages, lets about a quarter more than that pass; equal pages of one id
    count once, and the least of the rest are cut off on the executors, so that repeated ids send no more.
    """
    rows = df.where(col(source).isNotNull()).select(col(source).alias("s"), F.pmod(F.xxhash64(col(order), col(source)), F.lit(1 << 30)).alias("h"))
    bound = int((1 << 30) * min(1.0, 1.25 * sample / max(1, rows.count())))
    chosen = rows.where(F.col("h") <= bound).groupBy("h").agg(F.min("s").alias("s")).orderBy("h").limit(sample)
    return fit([r["s"] for r in chosen.toLocalIterator()])


def extract(df: DataFrame, model: Model, source: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The rows with ``text string``; one pass over whole pages, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory():
        t = shared.value
        return lambda rows: [pa.array(texts(t, [s or "" for s in rows.to_pylist()]), pa.string())]

    return arrow_map(df, [source], "text string", factory, keep, budget=500_000)
