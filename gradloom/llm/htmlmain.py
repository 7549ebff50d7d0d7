"""Main text of web pages: gradient-boosted trees over DOM nodes with hierarchical decoding.

A tolerant parser makes a tree of block-level elements whose leaves are blocks of running text. Each node and block has
features: subtree density (text, links, punctuation, descendants), attribute tokens (of its own and of its ancestors), tag, depth, and
sibling statistics. Boosted trees give the log-odds that a node holds main text. A node can only hold main text if its parent does, so
decoding picks, among all choices without a kept child below a dropped parent, the one of largest total log-odds: a sum up the tree,
dropping each subtree whose best total is negative.

The trees are learnt in numpy from pages that `training_page` makes up: layouts with and without semantic elements, class names,
asides, notices, adverts, forms and comments around and inside the article. They depend on no table, so that any page gets
the same text wherever it is extracted.

Text: character references are decoded; white space inside a block, line breaks included, becomes one space; blocks are trimmed and joined in page order by
two line feeds. The contents of head, template, datalist, script, style, title, textarea and frames are never text; what else may hold text (formulas, fallbacks of media, noscript) is for the trees to judge.

Defined results: a null or empty page, or one without main text, gives an empty text of 0 characters. Malformed markup is
parsed as far as it goes: unclosed elements end with their parents, a tag that never ends is text. Repeated rows get
equal texts. Other columns are never read.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names by how they nest.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes".split())
HIDDEN = frozenset("head template datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "label legend li main menu nav noscript object audio video canvas ol option p pre search section select summary table tbody td tfoot th thead tr ul xmp".split()
) | HIDDEN
NO_P = BLOCK - frozenset("html body button label option select td th tr tbody thead tfoot caption head template noscript object audio video canvas".split())
SCOPE = frozenset("table td th caption button object template html".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
LIMIT = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",), "body": (), "tbody": ("table",), "tfoot": ("table",)}
TAGS = [
    ("article main", "main"), ("nav menu", "nav"), ("aside", "aside"), ("header", "header"), ("footer", "footer"), ("form button select label legend fieldset option dialog search", "form"),
    ("p blockquote pre", "para"), ("h1 h2 h3 h4 h5 h6", "heading"), ("ul ol dl dir", "list"), ("li dt dd", "item"), ("table tbody thead tfoot tr td th caption", "table"), ("div section center details", "div"),
]
TAG = {name: k for k, (names, _) in enumerate(TAGS) for name in names.split()}
WORDS = {
    "content": "article articlebody content post entry story main body text blog news copy prose",
    "nav": "nav navbar navigation menu submenu breadcrumb breadcrumbs tabs pagination pager toc skip links topics",
    "side": "sidebar aside side rail widget widgets complementary related recommended recommendations trending popular more also teaser teasers",
    "head": "header masthead topbar logo brand hero site",
    "foot": "footer colophon copyright contentinfo legal bottom imprint",
    "comment": "comment comments disqus reply replies respond discussion thread reader readers feedback reviews",
    "ad": "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner dfp",
    "notice": "cookie cookies consent notice notices alert gdpr popup modal overlay privacy newsletter subscribe subscription signup paywall toast warning disclaimer",
    "form": "form search login signin register contact input",
    "social": "share sharing social follow facebook twitter like byline author meta date tags tag rating",
}
GROUP = {w: k for k, ws in enumerate(WORDS.values()) for w in ws.split()}
_G, _T = len(WORDS), len(TAGS)
#: In place of an inline element's node, where it has ended before those in it.
GONE = -2

_TOKEN = re.compile(
    r"<(?:!--(?P<comment>.*?(?:-->|\Z))|(?P<decl>[!?][^>]*+>)|/(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>|(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>))", re.S
)
_OPEN = re.compile(r"<!--(?P<comment>.*\Z)(?P<start>(?!))?(?P<end>(?!))?", re.S)
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_CLOSE = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>|</{n}\Z", re.I) for n in RAW}
_PUNCT = re.compile(r"[.,;:!?]")


@dataclass
class Page:
    """Nodes in page order: parents before children. A leaf has a text; groups are bit sets of WORDS."""

    tag: list[str]
    parent: list[int]
    groups: list[int]
    text: list[str | None]
    links: list[int]


def attribute_groups(attrs: str) -> int:
    found = 0
    if "=" in attrs:
        for m in _NAMES.finditer(attrs):
            for w in _PART.findall(unescape(m[1] or m[2] or m[3] or "")):
                if (k := GROUP.get(w.lower())) is not None:
                    found |= 1 << k
    return found


def parse(html: str) -> Page:
    page = Page(["#page"], [-1], [0], [None], [0])
    stack: list[tuple[str, int]] = [("#page", 0)]  # inline elements have node -1
    here, hidden, anchors = 0, 0, 0
    buffer: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                page.tag.append(page.tag[here])
                page.parent.append(here)
                page.groups.append(page.groups[here])
                page.text.append(text)
                page.links.append(min(linked, len(text)))
            linked = 0

    places: dict[str, list[int]] = defaultdict(list)  # the depths of the open elements of each name
    blocks: list[int] = [0]  # the depths of the open blocks

    def push(name: str, node: int) -> None:
        places[name].append(len(stack))
        if node >= 0:
            blocks.append(len(stack))
        stack.append((name, node))

    def pop_to(depth: int) -> None:
        nonlocal here, hidden, anchors
        flush()
        while len(stack) > depth:
            name, node = stack.pop()
            if node == GONE:
                continue
            places[name].pop()
            if node >= 0:
                blocks.pop()
                here = page.parent[node]
                hidden -= name in HIDDEN
            elif name == "a":
                anchors -= 1

    def end_inline(name: str) -> None:
        """The innermost open inline element of this name is closed, those in it stay open: its place on the stack stays, too."""
        nonlocal anchors
        stack[places[name].pop()] = ("", GONE)
        anchors -= name == "a"

    def find(names: tuple[str, ...], stop: frozenset | tuple) -> int:
        """The depth of the innermost open element of these names, outside of which none of stop is looked behind; 0 if none."""
        d = max((places[n][-1] for n in names if places[n]), default=0)
        return d if d and all(not places[n] or places[n][-1] <= d for n in stop) else 0

    def words(part: str) -> None:
        nonlocal linked
        if part and not hidden:
            if "&" in part:
                part = unescape(part)
            buffer.append(part)
            if anchors:
                linked += len(part)

    at, last = 0, html.rfind(">")
    while True:
        # behind the last > there is no tag, but there may be an open comment
        m = _TOKEN.search(html, at) if at <= last else _OPEN.search(html, at)
        if m is None:
            words(html[at:])
            break
        words(html[at : m.start()])
        at = m.end()
        if m["start"]:
            name = m["start"].lower()
            if name in RAW:
                close = _CLOSE[name].search(html, at, last + 1) if at <= last else None
                at = close.end() if close else len(html)
            elif name in VOID:
                if name == "br":
                    words(" ")
                elif name == "hr":
                    flush()
            elif name in BLOCK:
                flush()
                if name in NO_P and (d := find(("p",), SCOPE)):
                    pop_to(d)
                if name in ENDS:
                    while d := find(ENDS[name], LIMIT[name]):
                        pop_to(d)
                page.tag.append(name)
                page.parent.append(here)
                page.groups.append(attribute_groups(m["attrs"]))
                page.text.append(None)
                page.links.append(0)
                here = len(page.tag) - 1
                hidden += name in HIDDEN
                push(name, here)
            else:
                if name == "a" and anchors and find(("a",), SCOPE):
                    end_inline("a")
                push(name, -1)
                anchors += name == "a"
        elif m["end"]:
            name = m["end"].lower()
            if name in BLOCK:
                if d := find((name,) if name[0] != "h" or name[1:] not in "123456" or len(name) != 2 else ("h1", "h2", "h3", "h4", "h5", "h6"), ("table",) if name in ("p", "li") else ()):
                    pop_to(d)
                else:
                    flush()
            elif name == "br":
                words(" ")
            else:
                if places[name] and places[name][-1] > blocks[-1]:
                    end_inline(name)
    pop_to(1)
    return page


FEATURES = ["leaf", "depth", "ln_chars", "link_share", "punctuation", "ln_nodes", "ln_density", "sibling_place", "ln_siblings", "page_share", "parent_share", "place", "ln_before", "ln_after", "mean_leaf"]
_F = len(FEATURES) + 3 * _T + 3 * _G  # tags and words: its own, its container's, all its ancestors'


def features(page: Page) -> np.ndarray:
    """A row for each node of the page."""
    n = len(page.tag)
    chars, links, punct, nodes, leaves = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    first, depth, above, under = [0] * n, [0] * n, [0] * n, [0] * n
    kids: list[list[int]] = [[] for _ in range(n)]
    seen = 0
    parent, text = page.parent, page.text
    for i in range(n):
        p = parent[i]
        first[i] = seen
        if p >= 0:
            kids[p].append(i)
            depth[i] = depth[p] + 1
            above[i] = above[p] | page.groups[p]
            under[i] = under[p] | (1 << k if (k := TAG.get(page.tag[p])) is not None else 0)
        if (t := text[i]) is not None:
            chars[i], links[i], leaves[i] = len(t), page.links[i], 1
            punct[i] = len(_PUNCT.findall(t))
            seen += len(t)
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        punct[p] += punct[i]
        nodes[p] += nodes[i] + 1
        leaves[p] += leaves[i]
    place, siblings, before, after = [0] * n, [1] * n, [0] * n, [0] * n
    for own in kids:
        for k, i in enumerate(own):
            place[i], siblings[i] = k, len(own)
            if k:
                before[i] = chars[own[k - 1]]
                after[own[k - 1]] = chars[i]
    x = np.zeros((n, _F), np.float32)
    c, total = np.array(chars, float), max(1, chars[0])
    one = np.maximum(c, 1)
    x[:, 0] = [t is not None for t in text]
    x[:, 1] = depth
    x[:, 2] = np.log1p(c)
    x[:, 3] = links / one
    x[:, 4] = punct / one
    x[:, 5] = np.log1p(nodes)
    x[:, 6] = np.log1p(c / (1 + np.array(nodes)))
    x[:, 7] = np.array(place) / np.maximum(1, np.array(siblings) - 1)
    x[:, 8] = np.log1p(siblings)
    x[:, 9] = c / total
    x[:, 10] = c / np.maximum(1, np.array([chars[p] if p >= 0 else total for p in parent]))
    x[:, 11] = np.array(first) / total
    x[:, 12] = np.log1p(before)
    x[:, 13] = np.log1p(after)
    x[:, 14] = np.log1p(c / np.maximum(1, leaves))
    base = len(FEATURES)
    outer = [parent[parent[i]] if text[i] is not None and parent[i] > 0 else parent[i] for i in range(n)]
    tags = [1 << k if (k := TAG.get(t)) is not None else 0 for t in page.tag]
    at = len(FEATURES)
    for bits, own, width in ((tags, under, _T), (page.groups, above, _G)):
        for part in (bits, [bits[o] if o >= 0 else 0 for o in outer], own):
            x[:, at : at + width] = (np.array(part)[:, None] >> np.arange(width)) & 1
            at += width
    return x


@dataclass
class Forest:
    """Complete trees of one depth: feature and threshold of each inner node (x < threshold goes left), values of the leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1]))
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] >= t[at])
            out += v[at - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 150, depth: int = 5, eta: float = 0.3, reg: float = 1.0, bins: int = 48) -> Forest:
    """Boosted trees for logistic loss, split by histograms of gradients over quantile bins.

    Rows of equal bins and label are one row of their weights' sum. Of two sister leaves the one of fewer rows is summed, the other is the rest of their parent.
    """
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "right") for f, c in enumerate(cuts)], 1)
    same = np.unique(np.hstack([binned, y[:, None].astype(binned.dtype)]), axis=0, return_index=True, return_inverse=True)
    binned, y, weight = binned[same[1]], y[same[1]], np.bincount(same[2].ravel(), weight)
    p = float((weight * y).sum() / weight.sum())
    base = np.log(p / (1 - p))
    z = np.full(len(y), base)
    inner, width = 2**depth - 1, x.shape[1]
    fs, ts, vs = [], [], []
    flat = binned + np.arange(width) * bins

    def sums(rows: np.ndarray, slot: np.ndarray, count: int, values: tuple[np.ndarray, ...]) -> np.ndarray:
        key = (slot[:, None] * (width * bins) + flat[rows]).ravel()
        return np.stack([np.bincount(key, np.repeat(v[rows], width), minlength=count * width * bins).reshape(count, width, bins) for v in values])

    for _ in range(rounds):
        q = 1 / (1 + np.exp(-z))
        g, h = weight * (q - y), np.maximum(weight * q * (1 - q), 1e-12)
        f_, t_, b_, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins), np.zeros(len(y), np.int64)
        for level in range(depth):
            start, count = 2**level - 1, 2**level
            if level == 0:
                hist = sums(np.arange(len(y)), at, 1, (g, h))
            else:
                few = np.bincount(at - start, minlength=count).reshape(-1, 2).argmin(1) + 2 * np.arange(count // 2)
                light = np.zeros(count, bool)
                light[few] = True
                rows = np.flatnonzero(light[at - start])
                part, above = sums(rows, (at[rows] - start) // 2, count // 2, (g, h)), hist
                hist = np.empty((2, count, width, bins))
                hist[:, few], hist[:, few ^ 1] = part, above - part
            left = [np.cumsum(v, 2)[:, :, :-1] for v in hist]
            whole = [v.sum(2, keepdims=True) for v in hist]
            score = lambda a, b: a * a / (b + reg)
            gain = score(left[0], left[1]) + score(whole[0] - left[0], whole[1] - left[1]) - score(whole[0], whole[1])
            gain[(left[1] < 1) | (whole[1] - left[1] < 1)] = 0
            for f in range(width):
                gain[:, f, len(cuts[f]) :] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins - 1)
                if gain[k, f, b] > 1e-6:
                    f_[start + k], t_[start + k], b_[start + k] = f, cuts[f][b], b
            at = 2 * at + 1 + (binned[np.arange(len(y)), f_[at]] > b_[at])
        leaf = at - inner
        value = -eta * np.bincount(leaf, g, minlength=inner + 1) / (np.bincount(leaf, h, minlength=inner + 1) + reg)
        z = z + value[leaf]
        fs.append(f_), ts.append(t_), vs.append(value)
    return Forest(np.array(fs), np.array(ts), np.array(vs), float(base))


def decode(page: Page, margin: np.ndarray) -> str:
    """The texts of the kept leaves, where the kept nodes are the closed set of largest total margin."""
    n, parent = len(page.tag), page.parent
    best = margin.astype(float).tolist()
    best[0] = max(best[0], 0.0)
    kept_text = [t is not None for t in page.text]
    for i in range(n - 1, 0, -1):
        if not kept_text[i]:  # without a leaf below there is nothing to keep
            best[i] = 0.0
        if best[i] > 0:
            best[parent[i]] += best[i]
        if kept_text[i]:
            kept_text[parent[i]] = True
    keep, out = [True] * n, []
    for i in range(1, n):
        keep[i] = keep[parent[i]] and best[i] > 0
        if keep[i] and page.text[i] is not None:
            out.append(page.text[i])
    return "\n\n".join(out)


def training_page(rng: random.Random) -> tuple[str, set[str]]:
    """(a made-up page, the texts of its main blocks)."""
    syllables = ["".join(rng.choice(s) for s in ("bcdfghklmnprstvw", "aeiouäéó", "nrstlm")) for _ in range(40)]
    main: set[str] = set()
    w = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    title = lambda n: " ".join(w() for _ in range(n)).capitalize()

    def sentences(n: int) -> str:
        out, left = [], n
        while left > 0:
            k = min(left, rng.randint(3, 18))
            s = [w() + ("," if rng.random() < 0.1 else "") for _ in range(k)]
            out.append(" ".join(s).capitalize().rstrip(",") + rng.choice("....?!"))
            left -= k
        return " ".join(out)

    def mark(text: str) -> str:
        main.add(" ".join(text.split()))
        return text

    label = lambda n: rng.choice([title(rng.randint(1, n)), w(), w() + rng.choice(".,:!"), sentences(rng.randint(1, n + 2))])
    link = lambda n=2: f'<a href="/{w()}">{label(n)}</a>'
    hint = rng.random()  # how far names tell what things are
    semantic = rng.random() < 0.7

    def box(tag: str, names: str, inner: str) -> str:
        tag = tag if semantic and rng.random() < 0.9 else "div"
        name = rng.choice(names.split()) if rng.random() < (0.6 + 0.4 * hint if tag == "div" else 0.4) else w()
        attr = rng.choice(['class="%s"', 'id="%s"', 'class="%s ' + w() + '"', 'class="' + w() + '-%s"']) % name if tag == "div" or rng.random() < 0.5 else ""
        return f"<{tag}{' ' + attr if attr else ''}>{inner}</{tag}>\n"

    def items(n: int) -> str:
        if rng.random() < 0.8:
            return "<ul>" + "".join(f"<li>{link(3)}</li>" for _ in range(n)) + "</ul>"
        return rng.choice([" | ", " ", "<br>"]).join(link(3) for _ in range(n))

    def extra(inside: bool) -> str:
        kind = rng.randrange(8)
        p = lambda a, b: f"<p>{sentences(rng.randint(a, b))}</p>"
        plain = sentences(rng.randint(4, 25))
        if kind == 0:
            return box("div", "ad ads advert sponsored promo banner advertisement", rng.choice([plain, p(4, 25), link(6)]))
        if kind == 1:
            return box("aside", "sidebar related widget rail recommended trending popular", f"<h3>{title(2)}</h3>" + rng.choice([items(rng.randint(2, 8)), p(6, 40), p(6, 40) + p(6, 40)]))
        if kind == 2:
            return box("div", "cookie notice consent alert gdpr popup disclaimer", rng.choice([plain, p(5, 40)]) + rng.choice(["", "<button>OK</button>", link(2)]))
        if kind == 3:
            return box("form", "newsletter signup search login subscribe form contact", f"<label>{title(2)}</label><input name=q><button>{title(1)}</button>" + rng.choice(["", p(4, 20)]))
        if kind == 4:
            return box("div", "share social tags meta byline author date", rng.choice([items(rng.randint(2, 5)), title(4), f"<p>{title(3)}</p>", f"<span>{title(2)}</span> {link(2)}"]))
        if kind == 5 and not inside:
            one = lambda: box("div", "comment reply", f"<b>{w()}</b>" + p(3, 70) + rng.choice(["", link(1)]))
            return box("section", "comments discussion respond disqus reader", f"<h3>{title(2)}</h3>" + "".join(one() for _ in range(rng.randint(1, 8))))
        if kind == 6:
            return box("nav", "nav menu breadcrumb pagination toc", items(rng.randint(2, 6)))
        return box("aside", "related more teaser recommended", p(4, 30) + link(5))

    def block() -> str:
        r = rng.random()
        text = mark(sentences(rng.choice([1, rng.randint(1, 8), rng.randint(8, 60), rng.randint(20, 160)])))
        if r < 0.08:
            cut = text.find(" ")
            return f"<p>{text[: cut + 1]}<{(t := rng.choice(['b', 'em', 'a']))}>{text[cut + 1 :]}</{t}></p>" if cut > 0 and rng.random() < 0.7 else f"<p>{text}</p>"
        if r < 0.72:
            return f"<p>{text}</p>" if rng.random() < 0.9 else f"<p>{text}"
        main.discard(" ".join(text.split()))
        if r < 0.80:
            return f"<h{(k := rng.randint(2, 4))}>{mark(title(rng.randint(1, 8)))}</h{k}>"
        if r < 0.87:
            t = rng.choice(["ul", "ol"])
            return f"<{t}>" + "".join(f"<li>{mark(sentences(rng.randint(2, 25)))}</li>" for _ in range(rng.randint(2, 6))) + f"</{t}>"
        if r < 0.92:
            return f"<blockquote><p>{mark(sentences(rng.randint(5, 50)))}</p></blockquote>" if rng.random() < 0.5 else f"<blockquote>{mark(sentences(rng.randint(5, 50)))}</blockquote>"
        if r < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{mark(title(rng.randint(1, 3)) + w())}</td>" for _ in range(3)) + "</tr>" for _ in range(rng.randint(1, 4))) + "</table>"
        return f"<figure><img src=x.png><figcaption>{mark(sentences(rng.randint(3, 15)))}</figcaption></figure>" if rng.random() < 0.5 else f"<div><p>{mark(sentences(rng.randint(10, 60)))}</p></div>"

    body = [f"<h1>{mark(title(rng.randint(2, 10)))}</h1>\n"] if rng.random() < 0.8 else []
    if rng.random() < 0.25:
        body.append(box("header", "byline meta author date", title(3)))
    for _ in range(rng.choice([1, 2, rng.randint(2, 8), rng.randint(5, 25)])):
        body.append(block() + "\n")
        if rng.random() < 0.05:
            body.append(extra(True))
    if rng.random() < 0.3:
        body.insert(0, f"<p><b>{mark(sentences(rng.randint(3, 30)))}<br><p>{mark(sentences(rng.randint(3, 50)))}</p>")
    article = box("article", "article content post entry story text body main", "".join(body))
    if rng.random() < 0.5:
        article = box("main", "main content page wrapper container", (extra(True) if rng.random() < 0.2 else "") + article + (extra(False) if rng.random() < 0.5 else ""))
    top = [box("header", "header masthead topbar site", rng.choice([link(3), f"<h2>{title(2)}</h2>", title(3)]) + (items(rng.randint(2, 7)) if rng.random() < 0.4 else ""))] if rng.random() < 0.6 else []
    if rng.random() < 0.8:
        top.append(box("nav", "nav menu navbar navigation", items(rng.randint(2, 12))))
    around = [extra(False) for _ in range(rng.choice([0, 0, 1, 1, 2, 4]))]
    k = rng.randint(0, len(around))
    bottom = [box("footer", "footer colophon copyright legal bottom", rng.choice(["&copy; " + w() + ". " + sentences(rng.randint(3, 40)), items(rng.randint(2, 8)), f"<p>&copy; {title(3)}</p>" + items(3)]))] if rng.random() < 0.85 else []
    inner = "".join([*top, *around[:k], article, *around[k:], *bottom])
    if rng.random() < 0.3:
        inner = box("div", "page wrapper container site", inner)
    return f"<html><head><title>{title(4)}</title></head><body>{inner}</body></html>", main


def train(pages: int = 800, seed: int = 5) -> Forest:
    """Trees learnt from made-up pages; each page weighs the same, leaves by the root of their length."""
    rng = random.Random(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        html, main = training_page(rng)
        page = parse(html)
        y = np.array([t is not None and t in main for t in page.text])
        some = np.array([t is not None for t in page.text])
        for i in range(len(page.tag) - 1, 0, -1):
            y[page.parent[i]] |= y[i]
            some[page.parent[i]] |= some[i]
        xs.append(features(page)[some])
        ys.append(y[some])
        ws.append(np.full(int(some.sum()), 30.0 / some.sum()) ** 0.5)
    return boost(np.vstack(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def extract_many(pages: list[str], forest: Forest) -> list[str]:
    trees = [parse(h) for h in pages]
    if not trees:
        return []
    margin = forest.margin(np.vstack([features(t) for t in trees]))
    off = np.append(0, np.cumsum([len(t.tag) for t in trees]))
    return [decode(t, margin[a:b]) for t, a, b in zip(trees, off[:-1], off[1:], strict=True)]


def main_text(pages: DataFrame, forest: Forest, keep: list[str], html: str = "html") -> DataFrame:
    """The columns `keep` of pages, with the main text and n_chars, its number of code points."""
    held = pages.sparkSession.sparkContext.broadcast(forest)
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 128):
                part = batch.slice(a, 128)
                texts = extract_many([h or "" for h in part.column(len(keep)).to_pylist()], held.value)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html).alias("_html")).mapInArrow(run, schema)
