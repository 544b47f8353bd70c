"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

A page is parsed leniently into a tree.  Structural elements are described by subtree size and
density, link density, attribute tokens, depth, position and sibling statistics.  Boosted regression
trees give each the log-odds of holding main text.  The labels kept and cut are then chosen for the
whole tree at once: a kept node's ancestors must be kept, and the assignment of the highest total
log-likelihood is found from the leaves up.  Text of kept nodes becomes the blocks.

The trees are trained here on ``TRAINING_PAGES`` generated layouts whose labels are known by
construction: many combinations of wrappers, menus, sidebars, notices, adverts, forms, comments.

Null and empty html give an empty text.  Repeated rows give equal rows; an empty table gives none.
Parsing takes time in proportion to the page, however long or broken.  Nodes whose labels tie (log-odds
of zero) are cut.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES, TREES, DEPTH, BINS, RATE = 900, 60, 4, 32, 0.25

# Element classes of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title select option button textarea svg iframe object math canvas".split())
RAW = frozenset("script style textarea title noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input br".split())
TAGS = tuple("body div section article main header footer nav aside form ul ol li p h1 h2 h3 h4 h5 h6 table tr td blockquote pre figure figcaption dl details fieldset".split())
_TAG_CODE = {t: i for i, t in enumerate(TAGS)}
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SAME_STOP = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_EMPTY_COMMENT, _COMMENT_END = re.compile(r"-?>"), re.compile(r"--!?>")
_BEFORE_QUOTE = re.compile(r"[^>\"']*")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])([^\s=/\"'>]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "parent", "block", "code")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        # The element itself or, for an inline one, the nearest ancestor that is not inline.
        self.block: Node = parent.block if parent is not None and tag in INLINE else self
        self.code = -1

    def tokens(self) -> list[str]:
        out = []
        for name, *values in _ATTRIBUTE.findall(self.attributes):
            if name.lower() in ("class", "id", "role", "aria-label", "itemprop"):
                out += [t.lower() for t in _TOKEN.findall("".join(values))]
        return out


class Markup:
    """Tags and texts of a page in order: (end tag, name, attributes) or a text.

    Every position is passed a bounded number of times, however broken the page: a quote that is
    never closed is searched for once, and its tag then ends at the first ``>``.  An unfinished tag
    at the end of the page is dropped.
    """

    def __init__(self, page: str) -> None:
        self.page, self.at = page, 0
        self.unclosed: set[str] = set()

    def _tag_end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag at ``at``, or -1."""
        now = at
        while True:
            now = _BEFORE_QUOTE.match(self.page, now).end()
            if now == len(self.page):
                break
            quote = self.page[now]
            if quote == ">":
                return now
            closing = -1 if quote in self.unclosed else self.page.find(quote, now + 1)
            if closing < 0:
                self.unclosed.add(quote)
                break
            now = closing + 1
        return self.page.find(">", at)

    def __iter__(self) -> Iterator[tuple[bool, str, str] | str]:
        page, size = self.page, len(self.page)
        begin = 0
        while (at := page.find("<", self.at)) >= 0:
            name = _NAME.match(page, at + 1)
            declared = page[at + 1 : at + 2] in ("!", "?")
            if not name and not declared:
                self.at = at + 1
                continue
            if at > begin:
                yield page[begin:at]
            if declared:
                if page.startswith("<!--", at):
                    end = _EMPTY_COMMENT.match(page, at + 4) or _COMMENT_END.search(page, at + 4)
                    self.at = end.end() if end else size
                else:
                    cdata = page.startswith("<![CDATA[", at)
                    end = page.find("]]>" if cdata else ">", at)
                    self.at = size if end < 0 else end + (3 if cdata else 1)
            else:
                end = self._tag_end(name.end())
                if end < 0:
                    self.at = begin = size
                    break
                self.at = end + 1
                tag = name[0].lower()
                yield tag[0] == "/", tag.lstrip("/"), page[name.end() : end]
            begin = self.at
        if begin < size:
            yield page[begin:]

    def raw(self, tag: str) -> str:
        """The content of a raw element, in which nothing but its own end tag counts."""
        end = _RAW_END[tag].search(self.page, self.at)
        inner = self.page[self.at : end.start() if end else len(self.page)]
        self.at = end.end() if end else len(self.page)
        return inner


def parse(page: str) -> Node:
    """The page's tree; missing end tags are implied as browsers do for common cases."""
    root = Node("#root", "", None)
    now = root
    # Open elements by tag, and those that matter for the elements of a list or table: the last is the nearest.
    opened: dict[str, list[Node]] = {}
    near: dict[str, list[Node]] = {tag: [] for tag in _SAME}
    watched = {t: [tag for tag in _SAME if t in _SAME[tag] or t in _SAME_STOP[tag]] for tag in _SAME for t in (*_SAME[tag], *_SAME_STOP[tag])}

    def close(upto: Node) -> Node:
        """Closes the open elements down to one; what contains it is then the innermost."""
        node = now
        while True:
            opened[node.tag].pop()
            for tag in watched.get(node.tag, ()):
                near[tag].pop()
            if node is upto:
                return node.parent
            node = node.parent

    markup = Markup(page)
    for item in markup:
        if isinstance(item, str):
            if now.tag == "head" and not item.isspace():
                now = close(now)
            now.children.append(item)
            continue
        ends, tag, attributes = item
        if ends:
            same = opened.get(tag)
            # The end of an inline element doesn't end the blocks inside it.
            if same and (tag not in INLINE or same[-1].block is now.block):
                now = close(same[-1])
            continue
        if now.tag == "head" and tag not in _HEAD:
            now = close(now)
        if tag in _CLOSES_P and now.block.tag == "p":
            now = close(now.block)
        elif tag in _SAME and near[tag] and near[tag][-1].tag in _SAME[tag]:
            now = close(near[tag][-1])
        node = Node(tag, attributes, now)
        now.children.append(node)
        if tag in RAW:
            if not attributes.rstrip().endswith("/") or tag in ("script", "style", "textarea", "title"):
                node.children.append(markup.raw(tag))
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            now = node
            opened.setdefault(tag, []).append(node)
            for watch in watched.get(tag, ()):
                near[watch].append(node)
    return root


class Tree:
    """Structural nodes of a page in page order, with their features."""

    def __init__(self, page: str) -> None:
        self.root = parse(page)
        self.nodes: list[Node] = []
        self.parents: list[int] = []
        self.rows: list[list[float]] = []
        self._stats: list[list[float]] = []
        self._visit()
        self._describe()

    def _visit(self) -> None:
        # characters, words, link characters, tags, paragraphs, list items, controls, headings, stops
        stack: list[tuple[Node, int, int, bool]] = [(self.root, -1, 0, False)]
        self.depth: list[int] = []
        while stack:
            node, above, depth, linked = stack.pop()
            if node.tag in HIDDEN:
                continue
            own = above
            if node.tag not in INLINE:
                own = node.code = len(self.nodes)
                self.nodes.append(node)
                self.parents.append(above)
                self.depth.append(depth)
                self._stats.append([0.0] * 9)
                stats = self._stats[own]
                stats[4] += node.tag == "p"
                stats[5] += node.tag == "li"
                stats[7] += node.tag in ("h1", "h2", "h3", "h4")
            else:
                stats = self._stats[above]
                stats[6] += node.tag in ("input", "label")
            stats[3] += 1
            linked = linked or node.tag == "a"
            for child in node.children:
                if isinstance(child, str):
                    n = len(child) - child.count(" ") if not child.isspace() else 0
                    stats[0] += n
                    if n:
                        stats[1] += child.count(" ") + 1
                        stats[2] += n if linked else 0
                        stats[8] += child.count(".") + child.count(",")
            for child in reversed(node.children):
                if not isinstance(child, str):
                    stack.append((child, own, depth + 1, linked))
        self.own = np.array(self._stats).reshape(-1, 9)
        total = self.own.copy()
        for i in range(len(self.nodes) - 1, 0, -1):
            total[self.parents[i]] += total[i]
        self.total = total

    def _describe(self) -> None:
        n, t, parents = len(self.nodes), self.total, np.array(self.parents)
        page = np.maximum(t[0], 1)
        up = np.maximum(parents, 0)
        size = np.log1p(t)
        link = t[:, 2] / np.maximum(t[:, 0], 1)
        order = np.arange(n)
        # Statistics of the siblings: how many, how many of the tag, their mean size, place among them.
        count = np.bincount(up, minlength=n).astype(float)
        sibling_text = np.bincount(up, t[:, 0], n)
        place = np.zeros(n)
        same = np.zeros(n)
        seen: Counter = Counter()
        tags: Counter = Counter()
        for i in range(n):
            place[i] = seen[up[i]]
            seen[up[i]] += 1
            tags[up[i], self.nodes[i].tag] += 1
        for i in range(n):
            same[i] = tags[up[i], self.nodes[i].tag]
        mean = sibling_text[up] / np.maximum(count[up], 1)
        code = np.array([_TAG_CODE.get(x.tag, -1) for x in self.nodes])
        before = np.cumsum(self.own[:, 0]) - self.own[:, 0]
        columns = [
            size[:, 0], size[:, 1], size[:, 2], size[:, 3], size[:, 4], size[:, 5], size[:, 6], size[:, 7],
            link, t[:, 0] / np.maximum(t[:, 3], 1), t[:, 0] / np.maximum(t[:, 1], 1), t[:, 8] / np.maximum(t[:, 1], 1),
            t[:, 0] / page[0], t[:, 0] / np.maximum(t[up, 0], 1), np.log1p(self.own[:, 0]),
            np.array(self.depth, float), order / max(n, 1), before / page[0], place, count[up], same, np.log1p(mean), t[:, 0] / np.maximum(mean, 1),
            link[up], size[up, 0], code, code[up],
            *[(code == k).astype(float) for k in range(len(TAGS))],
            *[(code[up] == _TAG_CODE[k]).astype(float) for k in ("body", "div", "article", "main", "ul", "aside", "footer", "nav", "header", "form", "section")],
        ]
        self.features = np.stack(columns, 1)
        self.names = [x.tokens() for x in self.nodes]

    def with_tokens(self, weight: dict[str, float]) -> np.ndarray:
        """The features, with the sum, least and greatest weight of the node's and its parent's attribute tokens."""
        own = [[weight.get(t, 0.0) for t in names] or [0.0] for names in self.names]
        base = np.array([[sum(w), min(w), max(w)] for w in own]).reshape(-1, 3)
        known = np.array([[float(any(t in weight for t in names))] for names in self.names]).reshape(-1, 1)
        up = np.maximum(np.array(self.parents), 0)
        return np.concatenate([self.features, base, base[up], known], 1)

    def kept(self, log_odds: np.ndarray) -> np.ndarray:
        """The best labels of which no kept node has a cut ancestor."""
        n = len(self.nodes)
        yes = -np.logaddexp(0, -log_odds)
        no = -np.logaddexp(0, log_odds)
        cut, keep = no.copy(), yes.copy()
        for i in range(n - 1, 0, -1):
            p = self.parents[i]
            cut[p] += cut[i]
            keep[p] += max(cut[i], keep[i])
        out = np.zeros(n, bool)
        for i in range(n):
            out[i] = (i == 0 or out[self.parents[i]]) and keep[i] > cut[i]
        return out

    def text(self, kept: np.ndarray) -> str:
        blocks: list[str] = []
        line: list[str] = []

        def end() -> None:
            block = " ".join("".join(line).split())
            if block:
                blocks.append(block)
            line.clear()

        # (node, None) enters a node, (None, tag) leaves one.
        stack: list[tuple[Node | str | None, bool]] = [(self.root, True)]
        while stack:
            node, entering = stack.pop()
            if node is None:
                end()
                continue
            if isinstance(node, str):
                line.append(html.unescape(node))
                continue
            if node.tag in HIDDEN:
                continue
            if node.tag in ("br", "hr", "img", "wbr"):
                line.append(" " if node.tag != "wbr" else "")
                continue
            if node.code >= 0:
                end()
                if not kept[node.code]:
                    continue
                stack.append((None, False))
            stack += [(c, True) for c in reversed(node.children)]
        end()
        return "\n\n".join(blocks)


class Boosted:
    """Complete regression trees on binned features, boosted for the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)
        rate = y.mean()
        self.base = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
        f = np.full(len(y), self.base)
        inner = 2**DEPTH - 1
        self.feature = np.zeros((TREES, inner), np.int64)
        self.limit = np.full((TREES, inner), np.inf)
        self.leaf = np.zeros((TREES, inner + 1))
        for t in range(TREES):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                best, choice = np.full(width, 1e-6), np.full((width, 2), -1)
                for j in range(x.shape[1]):
                    n_bins = len(self.edges[j]) + 1
                    if n_bins == 1:
                        continue
                    key = (node - first) * n_bins + binned[:, j]
                    sg = np.bincount(key, g, width * n_bins).reshape(width, n_bins).cumsum(1)
                    sh = np.bincount(key, h, width * n_bins).reshape(width, n_bins).cumsum(1)
                    lg, lh, ag, ah = sg[:, :-1], sh[:, :-1], sg[:, -1:], sh[:, -1:]
                    gain = lg**2 / (lh + 1) + (ag - lg) ** 2 / (ah - lh + 1) - ag**2 / (ah + 1)
                    gain[(lh < 1) | (ah - lh < 1)] = 0
                    k = gain.argmax(1)
                    top = gain[np.arange(width), k]
                    better = top > best
                    best[better], choice[better, 0], choice[better, 1] = top[better], j, k[better]
                for w in range(width):
                    if choice[w, 0] >= 0:
                        self.feature[t, first + w] = choice[w, 0]
                        self.limit[t, first + w] = self.edges[choice[w, 0]][choice[w, 1]]
                node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[t, node]] > self.limit[t, node])
            slot = node - inner
            self.leaf[t] = RATE * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + 1)
            f += self.leaf[t, slot]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, row = np.full(len(x), self.base), np.arange(len(x))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[row, feature[node]] > limit[node])
            out += leaf[node - len(feature)]
        return out


# ---------------------------------------------------------------- generated layouts

# Attribute tokens of layouts (word lists).
MAIN_NAMES = "content article post entry story body main text page-content post-content entry-content article-body story-text node blog-post articleBody main-content prose rich-text copy".split()
MENU_NAMES = "menu nav navbar navigation topnav main-menu breadcrumb breadcrumbs tabs toolbar site-nav links pager pagination toc".split()
HEAD_NAMES = "header masthead top site-header banner branding logo page-header topbar".split()
FOOT_NAMES = "footer site-footer bottom copyright legal colophon foot footer-links".split()
SIDE_NAMES = "sidebar side aside widget widgets related recommended popular trending rail secondary more-stories tags share social social-share author-box bio promo".split()
AD_NAMES = "ad ads advert advertisement sponsor sponsored banner-ad adslot ad-box promo-box dfp adsense".split()
NOTICE_NAMES = "cookie cookies consent notice alert gdpr popup modal overlay cookie-banner newsletter subscribe paywall announcement message privacy".split()
FORM_NAMES = "form search login signup contact-form subscribe-form searchbox register".split()
COMMENT_NAMES = "comments comment comment-list replies reply responses discussion disqus thread reader-comments feedback".split()
NEUTRAL_NAMES = "wrap wrapper container row col box inner block section grid panel clearfix module layout outer page site x1 c2".split()


class Layouts:
    """Random pages; main blocks carry the mark that tells the labels."""

    MARK = "\x02"

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        letters = "aeioubcdlmnprst"
        self.vocabulary = ["".join(self.r.choices(letters, k=self.r.randint(2, 9))) for _ in range(400)]

    def words(self, low: int, high: int) -> str:
        text = " ".join(self.r.choices(self.vocabulary, k=self.r.randint(low, high)))
        return text[0].upper() + re.sub(r"(\w{8}) ", r"\1, ", text[1:]) + self.r.choice([".", ".", ".", "", "!", "?"])

    def element(self, tag: str, inner: str, names: list[str] | None = None, chance: float = 0.9) -> str:
        if names and self.r.random() < chance:
            value = " ".join(self.r.sample(names, 1) + ([self.r.choice(NEUTRAL_NAMES)] if self.r.random() < 0.3 else []))
            return f'<{tag} {self.r.choice(["class", "class", "class", "id"])}="{value}">{inner}</{tag}>'
        return f"<{tag}>{inner}</{tag}>"

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.r.choice(self.vocabulary)}">{self.words(low, high)}</a>'

    def links(self, low: int, high: int) -> str:
        n = self.r.randint(low, high)
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return self.r.choice([" | ", " ", " &middot; "]).join(self.link() for _ in range(n))

    def plain(self) -> str:
        k = self.r.random()
        if k < 0.5:
            return self.words(3, 30)
        if k < 0.75:
            return f"<p>{self.words(3, 30)}</p>"
        return f"<h3>{self.words(1, 4)}</h3><p>{self.words(5, 25)}</p>"

    def boilerplate(self) -> str:
        r = self.r
        k = r.randrange(9)
        if k == 0:
            return self.element(r.choice(["nav", "nav", "div", "div", "ul"]), self.links(3, 12), MENU_NAMES)
        if k == 1:
            inner = r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<h2>{self.words(1, 3)}</h2>", self.words(1, 4), ""]) + r.choice(["", f"<p>{self.words(2, 8)}</p>", self.element("nav", self.links(3, 8), MENU_NAMES)])
            return self.element(r.choice(["header", "div"]), inner or "x", HEAD_NAMES)
        if k == 2:
            inner = r.choice(["&copy; 2020 ", "", ""]) + r.choice([self.words(2, 12), f"<p>{self.words(3, 20)}</p>", self.links(2, 10)])
            return self.element(r.choice(["footer", "footer", "div"]), inner, FOOT_NAMES)
        if k == 3:
            parts = "".join(r.choice([self.plain(), f"<h3>{self.words(1, 3)}</h3>" + self.links(3, 8), self.links(2, 6)]) for _ in range(r.randint(1, 4)))
            return self.element(r.choice(["aside", "aside", "div", "section"]), parts, SIDE_NAMES)
        if k == 4:
            return self.element(r.choice(["div", "div", "aside", "section"]), r.choice([self.plain(), self.link(2, 8), self.words(3, 20)]), AD_NAMES, 1)
        if k == 5:
            return self.element(r.choice(["div", "div", "section", "aside"]), self.plain() + r.choice(["", "<button>OK</button>", self.link(1, 2)]), NOTICE_NAMES, 1)
        if k == 6:
            fields = "".join(f"<label>{self.words(1, 3)}</label><input name=q>" for _ in range(r.randint(1, 4)))
            return self.element("form", r.choice(["", f"<p>{self.words(3, 12)}</p>"]) + fields + "<button>Go</button>", FORM_NAMES, 0.6)
        if k == 7:
            return self.comments()
        return self.element(r.choice(["div", "section"]), f"<h3>{self.words(1, 3)}</h3>" + self.links(3, 8), SIDE_NAMES + MENU_NAMES, 1)

    def comments(self) -> str:
        r = self.r
        tag = r.choice(["div", "li", "article", "p"])
        each = [self.element(tag, r.choice([self.link(1, 2), f"<b>{self.words(1, 2)}</b>", ""]) + r.choice([self.words(4, 40), f"<p>{self.words(4, 60)}</p>" if tag != "p" else self.words(4, 60)]), ["comment", "reply", "comment-body", "response"], 0.7) for _ in range(r.randint(1, 8))]
        inner = "".join(each)
        if tag == "li":
            inner = f"<ol>{inner}</ol>"
        return self.element(r.choice(["div", "section", "aside"]), r.choice(["", f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 2)}</h2>"]) + inner, COMMENT_NAMES, 1)

    def block(self) -> str:
        r, m = self.r, self.MARK
        k = r.random()
        if k < 0.62:
            text = self.words(*r.choice([(1, 4), (2, 12), (10, 50), (20, 150)]))
            if r.random() < 0.2:
                text = f"<b>{text}" + r.choice(["</b>", "</b>", "<br>"])
            if r.random() < 0.2:
                text += f" {self.link(1, 3)} {self.words(2, 20)}"
            return f"<p>{m}{text}" + r.choice(["</p>", "</p>", "</p>", ""])
        if k < 0.72:
            return self._heading(r.randint(2, 4))
        if k < 0.8:
            tag = r.choice(["ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{m}{self.words(2, 20)}</li>" for _ in range(r.randint(2, 6))) + f"</{tag}>"
        if k < 0.86:
            return f"<blockquote>{m}{self.words(5, 40)}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{m}{self.words(5, 40)}</p></blockquote>"
        if k < 0.9:
            return f"<pre>{m}{self.words(3, 20)}</pre>"
        if k < 0.94:
            rows = "".join(f"<tr><td>{m}{self.words(1, 4)}</td><td>{m}{self.words(1, 6)}</td></tr>" for _ in range(r.randint(1, 4)))
            return f"<table>{rows}</table>"
        if k < 0.97:
            return f"<figure><img src=x><figcaption>{m}{self.words(3, 12)}</figcaption></figure>"
        return f"<div>{m}{self.words(5, 80)}</div>"

    def _heading(self, level: int) -> str:
        return f"<h{level}>{self.MARK}{self.words(1, 6)}</h{level}>"

    def main(self) -> str:
        r = self.r
        blocks = [self.block() for _ in range(r.choice([1, 1, 1, 2, 2, 3, 5, 8, 13, 20]))]
        if r.random() < 0.75:
            blocks.insert(0, f"<h1>{self.MARK}{self.words(2, 12)}</h1>")
        for _ in range(r.choice([0, 0, 1, 2])):
            blocks.insert(r.randint(1, len(blocks)), r.choice([self.boilerplate, self.comments])())
        inner = "".join(blocks)
        if r.random() < 0.3:
            inner = self.element("div", inner, NEUTRAL_NAMES + MAIN_NAMES, 0.8)
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        return self.element(tag, inner, MAIN_NAMES, 0.5 if tag in ("article", "main") else 0.85)

    def page(self) -> str:
        r = self.r
        before = [self.boilerplate() for _ in range(r.choice([0, 1, 2, 3]))]
        after = [self.boilerplate() for _ in range(r.choice([0, 1, 2, 4]))]
        middle = self.main()
        if r.random() < 0.4:
            side = [self.boilerplate() for _ in range(r.choice([0, 1, 2]))]
            side.insert(r.randint(0, len(side)), middle)
            middle = self.element(r.choice(["div", "main"]), "".join(side), NEUTRAL_NAMES, 0.8)
        return f"<html><head><title>t</title><style>x</style></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


class Model:
    def __init__(self, boosted: Boosted, weight: dict[str, float]) -> None:
        self.boosted, self.weight = boosted, weight

    def texts(self, pages: list[str]) -> list[str]:
        trees = [Tree(p) if p else None for p in pages]
        some = [t for t in trees if t is not None]
        if not some:
            return [""] * len(pages)
        odds = self.boosted.log_odds(np.concatenate([t.with_tokens(self.weight) for t in some]))
        out, at = [], 0
        for t in trees:
            if t is None:
                out.append("")
                continue
            own = odds[at : at + len(t.nodes)].copy()
            at += len(t.nodes)
            own[0] = 20.0  # the document itself
            out.append(t.text(t.kept(own)))
        return out


def train(seed: int = 5, n_pages: int = TRAINING_PAGES) -> Model:
    """Fit token weights and trees on generated layouts."""
    layouts = Layouts(seed)
    trees, labels = [], []
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for _ in range(n_pages):
        tree = Tree(layouts.page())
        holds = np.zeros(len(tree.nodes), bool)
        for i in range(len(tree.nodes) - 1, -1, -1):
            holds[i] |= any(isinstance(c, str) and Layouts.MARK in c for c in _inline(tree.nodes[i]))
            if holds[i] and i:
                holds[tree.parents[i]] = True
        for names, y in zip(tree.names, holds.tolist(), strict=True):
            seen[y].update(set(names))
        trees.append(tree)
        labels.append(holds)
    weight = {t: float(np.log((seen[1][t] + 0.5) / (seen[0][t] + 0.5))) for t in {*seen[0], *seen[1]} if seen[0][t] + seen[1][t] >= 3}
    x = np.concatenate([t.with_tokens(weight) for t in trees])
    return Model(Boosted(x, np.concatenate(labels).astype(float)), weight)


def _inline(node: Node) -> Iterator[str]:
    for child in node.children:
        if isinstance(child, str):
            yield child
        elif child.tag in INLINE:
            yield from _inline(child)


def _batches(model: Model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = model.texts(part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    model = train() if model is None else model
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(_batches(model), "page_id long, url string, text string, n_chars long")
