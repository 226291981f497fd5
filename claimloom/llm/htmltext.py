"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Each element gets a probability that all its text is main text. The decoding chooses for each element to keep its whole
subtree, drop its whole subtree, or leave the choice to its children, so that no kept element lies in a dropped one. The
trees are fitted on generated pages, whose main text is known.
"""

from __future__ import annotations

import hashlib
import html
import inspect
import json
import math
import random
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import put, shared_dir
from .gbt import BoostedTrees

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
NO_TEXT = frozenset("head script style noscript template iframe noembed noframes textarea title select option button svg canvas object audio video input datalist".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "thead": {"thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}

# a quote counts as one only after an equals sign; <!--> and <!---> are comments of their own
TAG = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|$))|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"?+|'[^']*+'?+)?+)*+)(?:>|$))", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: What an end tag of an inline element or paragraph doesn't reach out of.
P_STOPS = frozenset("td th table article main section div body".split())
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("attrs", "children", "depth", "in_link", "parent", "tag")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.depth = parent.depth + 1 if parent else 0
        self.in_link = tag == "a" or (parent is not None and parent.in_link)


class OpenElements:
    """The elements that are open, and where those of each tag stand, so that a look for a tag costs no walk."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags; 0, the root's, if there is none."""
        return max((p[-1] for t in tags if (p := self.at.get(t))), default=0)

    def close(self, tags, stop) -> bool:
        """Closes the innermost element of these tags and all within it, unless one to stop at lies within it."""
        place = self.last(tags)
        if not place or place < self.last(stop):
            return False
        for n in self.stack[place:]:
            self.at[n.tag].pop()
        del self.stack[place:]
        return True


def parse(page: str) -> Node:
    """A tree of the page: end tags left out are implied, unmatched ones are ignored. Time is linear in the page."""
    root = Node("#root", "", None)
    open_ = OpenElements(root)
    pos, end = 0, len(page)
    while pos < end:
        m = TAG.search(page, pos)
        at = open_.stack[-1]
        if not m:
            at.children.append(html.unescape(page[pos:]))
            break
        if m.start() > pos:
            at.children.append(html.unescape(page[pos : m.start()]))
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            open_.close({tag}, P_STOPS if tag in INLINE or tag == "p" else {"table"} if tag in ("div", "section") else ())
            continue
        if tag in CLOSES_P:
            open_.close({"p"}, {"td", "th", "table", "button", "object"})
        if tag in SAME:
            while open_.close(SAME[tag], SCOPE[tag] if tag not in ("tr", "tbody", "tfoot") else {"table"}):
                pass
        node = Node(tag, m[3] or "", open_.stack[-1])
        open_.stack[-1].children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, pos)
            pos = stop.end() if stop else end
        elif tag not in VOID and not node.attrs.endswith("/"):
            open_.push(node)
    return root


def attribute_tokens(node: Node) -> list[str]:
    """Lower-case pieces of class, id and role, and the tag itself in angle brackets."""
    out = [f"<{node.tag}>"]
    if "=" in node.attrs:
        for name, a, b, c in ATTRIBUTE.findall(node.attrs):
            if name.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                out += [t.lower() for t in TOKEN.findall(a or b or c)]
    return out


FEATURES = ("parent_tag", "parent_own", "near_above", "grand_above", "tag_score", "own_score", "least_above", "best_above", "log_chars", "log_words", "link_share", "tags_per_char", "punctuation", "depth", "place", "siblings", "same_siblings", "sibling_chars", "share_of_parent", "child_elements", "inputs", "own_text", "paragraphs", "capital_start")


class Page:
    """The elements of a page in document order, with the sums over their subtrees."""

    def __init__(self, text: str):
        self.root = parse(text)
        self.nodes: list[Node] = []
        todo = [self.root]
        while todo:
            n = todo.pop()
            self.nodes.append(n)
            todo += [c for c in reversed(n.children) if isinstance(c, Node) and c.tag not in NO_TEXT]
        index = {id(n): i for i, n in enumerate(self.nodes)}
        self.parent = [index[id(n.parent)] if n.parent else -1 for n in self.nodes]
        k = len(self.nodes)
        self.sums = np.zeros((k, 7))  # chars, words, chars in links, elements, sentence marks, form fields, paragraphs
        self.own = np.zeros(k)
        self.starts_upper = np.zeros(k)
        for i, n in enumerate(self.nodes):
            pieces = [" ".join(c.split()) for c in n.children if isinstance(c, str)]
            chars = sum(map(len, pieces))
            self.own[i] = chars
            if chars:
                joined = " ".join(pieces)
                link = n.in_link
                self.sums[i, :5] = chars, joined.count(" ") + 1, chars * link, 0, sum(map(joined.count, ".,;:!?"))
                self.starts_upper[i] = joined.lstrip()[:1].isupper()
            self.sums[i, 3] = 1
            self.sums[i, 5] = sum(isinstance(c, Node) and c.tag in ("input", "button", "select", "textarea") for c in n.children)
            self.sums[i, 6] = n.tag == "p"
        for i in range(k - 1, 0, -1):
            self.sums[self.parent[i]] += self.sums[i]

    def features(self, weights: dict[str, float]) -> np.ndarray:
        k, s = len(self.nodes), self.sums
        kids: list[list[int]] = [[] for _ in range(k)]
        for i in range(1, k):
            kids[self.parent[i]].append(i)
        out = np.zeros((k, len(FEATURES)))
        own, low, high, tag_of, near, far = (np.zeros(k) for _ in range(6))
        tags = [Counter(self.nodes[j].tag for j in ks) for ks in kids]
        place = [0] * k
        for ks in kids:
            for at, j in enumerate(ks):
                place[j] = at
        for i, n in enumerate(self.nodes):
            tokens = attribute_tokens(n)
            tag = weights.get(tokens[0], 0.0)
            own[i] = sum(weights.get(t, 0.0) for t in tokens[1:])
            p = self.parent[i]
            both = tag + own[i]
            tag_of[i] = tag
            # the closest and the next element, itself or above, whose tag or names say something
            tells = abs(both) >= 1 and n.tag not in INLINE and n.tag not in ("p", "li", "ul", "ol", "h1", "h2", "h3", "td", "tr", "table")
            near[i], far[i] = (both, near[p] if p >= 0 else 0) if tells else (near[p], far[p]) if p >= 0 else (0, 0)
            low[i], high[i] = (min(low[p], both), max(high[p], both)) if p >= 0 else (0, 0)
            chars, words, link, elements, marks, inputs, paragraphs = s[i]
            same = tags[p][n.tag] if p >= 0 else 1
            others = kids[p] if p >= 0 else [i]
            out[i] = (
                tag_of[p] if p >= 0 else 0, own[p] if p >= 0 else 0, near[i], far[i], tag, own[i], low[p] if p >= 0 else 0, high[p] if p >= 0 else 0, math.log1p(chars), math.log1p(words), link / max(1, chars), elements / max(1, chars), marks / max(1, words), n.depth,
                place[i] / len(others), math.log1p(len(others)), same / len(others), math.log1p((s[p, 0] - chars) / max(1, len(others) - 1)) if p >= 0 else 0,
                chars / max(1, s[p, 0]) if p >= 0 else 1, math.log1p(len(kids[i])), inputs / max(1, elements), self.own[i] / max(1, chars), math.log1p(paragraphs), self.starts_upper[i],
            )
        self.kids = kids
        return out

    def decode(self, p: np.ndarray, switch: float = 1.0) -> np.ndarray:
        """Which elements' own text is kept: the likeliest labelling in which a child may differ only below a mixed element."""
        p = np.clip(p, 1e-4, 1 - 1e-4)
        has = self.sums[:, 0] > 0
        keep, drop = np.where(has, np.log(p), 0), np.where(has, np.log(1 - p), 0)
        k = len(p)
        all_keep, all_drop, best, mixed = keep.copy(), drop.copy(), np.zeros(k), np.zeros(k, bool)
        below = np.zeros(k)
        for i in range(k - 1, -1, -1):
            mine = max(keep[i], drop[i]) if self.own[i] else 0.0
            split = below[i] + mine - switch
            best[i] = max(all_keep[i], all_drop[i], split)
            mixed[i] = bool(self.kids[i]) and split > max(all_keep[i], all_drop[i])
            if not mixed[i]:
                best[i] = max(all_keep[i], all_drop[i])
            if i:
                q = self.parent[i]
                all_keep[q] += all_keep[i]
                all_drop[q] += all_drop[i]
                below[q] += best[i]
        out, fixed = np.zeros(k, bool), np.zeros(k, bool)
        for i in range(k):
            q = self.parent[i]
            if i and fixed[q]:
                out[i], fixed[i] = out[q], True
            elif mixed[i]:
                out[i] = keep[i] > drop[i]
            else:
                out[i], fixed[i] = all_keep[i] > all_drop[i], True
        return out

    def text(self, kept: np.ndarray) -> str:
        """Kept text: white space in a block is one space, blocks are joined by a blank line."""
        index = {id(n): i for i, n in enumerate(self.nodes)}
        blocks: list[list[str]] = [[]]
        todo: list[tuple[Node | str, bool, bool]] = [(self.root, False, False)]
        while todo:
            n, keep, leave = todo.pop()
            if isinstance(n, str):
                if keep:
                    blocks[-1].append(n)
                continue
            if n.tag in NO_TEXT:
                continue
            block = n.tag not in INLINE
            if block or leave:
                blocks.append([])
            if leave:
                continue
            if n.tag == "br":
                blocks[-1].append(" ")
                continue
            i = index[id(n)]
            if block:
                todo.append((n, False, True))
            todo += [(c, bool(kept[i]), False) for c in reversed(n.children)]
        joined = (" ".join("".join(b).split()) for b in blocks)
        return "\n\n".join(b for b in joined if b)


class Extractor:
    def __init__(self, weights: dict[str, float], trees: BoostedTrees):
        self.weights, self.trees = weights, trees

    def dump(self) -> str:
        """JSON that ``load`` takes, with a digest in front."""
        t = self.trees
        body = json.dumps({"weights": self.weights, "base": t.base, "depth": t.depth, "bins": t.bins, "edges": [e.tolist() for e in t.edges], "feature": t.feature.tolist(), "cut": t.cut.tolist(), "leaf": t.leaf.tolist()}, sort_keys=True)
        return f"{hashlib.sha256(body.encode()).hexdigest()} {body}"

    @staticmethod
    def load(text: str) -> Extractor:
        digest, _, body = text.partition(" ")
        if hashlib.sha256(body.encode()).hexdigest() != digest:
            raise ValueError("a stored model was changed")
        d = json.loads(body)
        t = BoostedTrees(trees=len(d["leaf"]), depth=d["depth"], bins=d["bins"])
        t.base, t.edges = d["base"], [np.array(e) for e in d["edges"]]
        t.feature, t.cut, t.leaf = np.array(d["feature"]), np.array(d["cut"]), np.array(d["leaf"])
        return Extractor(d["weights"], t)

    def texts(self, pages: list[str | None], at_once: int = 64) -> list[str]:
        out = []
        for i in range(0, len(pages), at_once):
            made = [Page(p or "") for p in pages[i : i + at_once]]
            p = self.trees.predict(np.concatenate([m.features(self.weights) for m in made]))
            ends = np.cumsum([len(m.nodes) for m in made])
            out += [m.text(m.decode(x)) for m, x in zip(made, np.split(p, ends[:-1]), strict=True)]
        return out


@lru_cache(1)
def word_pool(size: int = 6000) -> list[str]:
    """Made-up words of one to four syllables."""
    r = random.Random(size)
    return ["".join(r.choice("bcdfglmnprstvwzhkéñß") + r.choice("aeiou") for _ in range(r.randint(1, 4))) + r.choice(["", "", "n", "s", "r"]) for _ in range(size)]


class PageMaker:
    """Generates pages of many layouts; main text is marked in the tree by an attribute that is removed before fitting."""

    #: Names that sites give to their parts (fixed values).
    NAMES = {
        "main": "content main article post entry story body text page-content post-body article-body main-content entry-content post-content articleBody story-body blog-post".split(),
        "menu": "nav menu navbar navigation topnav main-menu breadcrumb breadcrumbs site-nav links pager pagination toc tabs".split(),
        "head": "header site-header masthead top banner topbar logo branding page-header".split(),
        "foot": "footer site-footer bottom copyright legal colophon page-footer credits".split(),
        "side": "sidebar aside related widget rail right-column secondary recommended trending popular more-stories tags categories archive".split(),
        "note": "notice cookie cookies consent cookie-banner gdpr alert popup modal overlay newsletter subscribe paywall promo message".split(),
        "ad": "ad ads advert advertisement sponsored sponsor banner-ad ad-slot adsbox promo-box dfp google-ads".split(),
        "form": "search search-form login signup subscribe-form contact newsletter-form comment-form".split(),
        "talk": "comments comment comment-list discussion replies disqus responses reader-comments comment-thread".split(),
        "share": "share social social-share sharing share-buttons tools meta-links".split(),
    }

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int, capital: bool = True) -> str:
        r = self.r
        n = r.randint(low, high)
        ws = r.choices(word_pool(), k=n)
        for i in range(n - 1):
            u = r.random()
            if u < 0.08:
                ws[i] += ",;:"[int(u * 1e4) % 3]
            elif u < 0.18:
                ws[i] += "..?!"[int(u * 1e4) % 4]
                ws[i + 1] = ws[i + 1].capitalize()
        if self.junk:
            ws = [w + r.choice(["***", "%%%", "###", "$$$"]) for w in ws]
        s = " ".join(ws)
        return (s[:1].upper() + s[1:] + r.choice([".", ".", ".", "", "!"])) if capital else s

    def named(self, kind: str) -> str:
        r = self.r
        name = r.choice(self.NAMES[kind])
        if r.random() < 0.2:
            name = r.choice(["site-", "c-", "block-", "my", "js-"]) + name
        how = r.random()
        return f' class="{name}"' if how < 0.6 else f' id="{name}"' if how < 0.85 else f' class="{r.choice(["box", "row", "wrap", "col-md-8", "inner"])} {name}"'

    def links(self, tag: bool = True) -> str:
        r = self.r
        items = [f'<a href="/{r.randint(1, 99)}">{self.words(1, r.choice([1, 1, 3, 7]), r.random() < 0.5)}</a>' for _ in range(r.randint(1, 12))]
        if tag and r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{i}</li>" if r.random() < 0.9 else f"<li>{i}" for i in items) + "</ul>"
        return r.choice([" ", " | ", "<br>"]).join(items)

    def box(self, kind: str, tags: list[str], inner: str) -> str:
        r = self.r
        tag = r.choice(tags)
        plain = tag in ("nav", "footer", "header", "aside", "form") and r.random() < 0.5
        return f"<{tag}{'' if plain else self.named(kind)}>{inner}</{tag}>"

    def clutter(self, kind: str) -> str:
        r = self.r
        say = lambda a, b: self.words(a, b)
        p = lambda a, b: r.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<span>{}</span>"]).format(say(a, b))
        if kind == "menu":
            return self.box(kind, ["nav", "nav", "div", "div"], self.links())
        if kind == "head":
            return self.box(kind, ["header", "header", "div"], r.choice(["", f"<h1>{say(1, 4)}</h1>", f"<h2>{say(1, 3)}</h2>"]) + p(1, 8) + r.choice(["", self.links()]))
        if kind == "foot":
            return self.box(kind, ["footer", "footer", "div"], r.choice([f"&copy; {r.choice(['blog', 'www'])}.{say(1, 1)[:-1]}.example &middot; {say(2, 9)}", p(3, 20), self.links() + p(2, 9)]))
        if kind == "side":
            return self.box(kind, ["aside", "aside", "div", "section"], r.choice(["", f"<h3>{say(1, 3)}</h3>"]) + r.choice([self.links(), self.links() + p(4, 25), "".join(p(5, 20) for _ in range(r.randint(1, 3)))]))
        if kind == "note":
            return self.box(kind, ["div", "div", "section", "p"], p(5, 35) + r.choice(["", "<button>OK</button>", '<a href="/x">' + say(1, 2) + "</a>"]))
        if kind == "ad":
            return self.box(kind, ["div", "div", "aside", "section", "p"], r.choice([say(3, 15), p(3, 25), f'<a href="/ad">{say(3, 9)}</a>', f"<b>{say(2, 6)}</b> {say(3, 9)}"]))
        if kind == "form":
            return f"<form{r.choice(['', self.named('form')])}>{r.choice(['', f'<label>{say(1, 4)}</label>', p(2, 15)])}<input name=q>{r.choice(['', '<textarea>' + say(1, 5) + '</textarea>'])}<button>{say(1, 2)}</button></form>"
        if kind == "talk":
            one = lambda: f"<{(t := r.choice(['div', 'li', 'article', 'section']))}{r.choice(['', self.named('talk')])}>{r.choice(['', f'<b>{say(1, 2)}</b>', f'<cite>{say(1, 2)}</cite>'])}<p>{say(4, 60)}</p></{t}>"
            return self.box(kind, ["div", "section", "ol", "aside"], r.choice(["", f"<h3>{say(1, 3)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 6))) + (self.clutter("form") if r.random() < 0.3 else ""))
        return self.box("share", ["div", "ul", "p", "section"], self.links())

    def main(self) -> str:
        r = self.r
        k = " data-main=1"
        out, n = [], r.choice([1, 1, 1, 2, 3, 5, 8, 14])
        size = r.choice([(1, 4), (1, 8), (5, 20), (10, 60), (30, 120), (80, 250)])
        if r.random() < 0.8:
            title = f"<h1{k}>{self.words(2, 12)}</h1>"
            out.append(title if r.random() < 0.85 else f"<header{k}>{title}<p{k}>{self.words(2, 10)}</p></header>")
        for _ in range(n):
            h = r.random()
            low, high = size if r.random() < 0.85 else (1, 5)
            body = self.words(low, high)
            if r.random() < 0.2:
                body += f' <a{k} href="/{r.randint(1, 9)}">{self.words(1, 6, False)}</a> {self.words(3, 30)}'
            if h < 0.62:
                out.append(r.choice([f"<p{k}>{body}</p>", f"<p{k}>{body}</p>", f"<p{k}><b{k}>{body}<br>", f"<p{k}>{body} <em{k}>{self.words(1, 5, False)}</em> {self.words(2, 20)}</p>", f"<div{k}>{body}</div>", f"<p{k}>{body}"]))
            elif h < 0.7:
                out.append(f"<h2{k}>{self.words(1, 8)}</h2>")
            elif h < 0.78:
                out.append(f"<ul{k}>" + "".join(f"<li{k}>{self.words(1, 25)}</li>" for _ in range(r.randint(2, 7))) + "</ul>")
            elif h < 0.83:
                out.append(f"<blockquote{k}><p{k}>{body}</p></blockquote>")
            elif h < 0.88:
                row = lambda t: f"<tr{k}>" + "".join(f"<{t}{k}>{self.words(1, 5, False)}</{t}>" for _ in range(3)) + "</tr>"
                out.append(f"<table{k}>{row('th')}" + "".join(row("td") for _ in range(r.randint(1, 5))) + "</table>")
            elif h < 0.92:
                out.append(f'<figure{k}><img src="/i.png"><figcaption{k}>{self.words(3, 15)}</figcaption></figure>')
            elif h < 0.95:
                out.append(f"<pre{k}><code{k}>{self.words(3, 40, False)}</code></pre>")
            else:
                out.append(f"{body}<br><br>" if r.random() < 0.3 else f"<section{k}><h3{k}>{self.words(1, 6)}</h3><p{k}>{body}</p></section>")
        for kind, share in (("ad", 0.15), ("share", 0.12), ("side", 0.1), ("form", 0.06), ("note", 0.08)):
            if r.random() < share:
                out.insert(r.randint(1, len(out)), self.clutter(kind))
        if r.random() < 0.1:
            out.append(self.clutter("talk"))
        if r.random() < 0.03:
            out = []
        tag = r.choice(["article", "article", "article", "main", "div", "section", "td"])
        name = self.named("main") if tag in ("div", "section", "td") or r.random() < 0.3 else ""
        whole = f"<{tag}{name} data-top=1>{''.join(out)}</{tag}>"
        if tag == "td":
            whole = f"<table><tr><td>{self.links()}</td>{whole}</tr></table>"
        if r.random() < 0.25:
            whole = f"<main{r.choice(['', self.named('main')])}>{whole}{self.clutter('side') if r.random() < 0.4 else ''}</main>"
        return whole

    def page(self) -> str:
        r = self.r
        self.junk = r.random() < 0.06
        before = [self.clutter(k) for k in ("head", "menu", "note", "ad", "form") if r.random() < 0.45]
        after = [self.clutter(k) for k in ("talk", "side", "ad", "share", "foot", "note", "form", "menu") if r.random() < 0.35]
        r.shuffle(before)
        body = "".join(before) + self.main() + "".join(after)
        if r.random() < 0.35:
            body = f"<div{r.choice(['', ' id=\"wrapper\"', ' class=\"container\"', ' class=\"page\"'])}>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style><script>var a='<p>';</script></head><body>{body}{'</body></html>' if r.random() < 0.8 else ''}"


def truth(p: Page) -> np.ndarray:
    """Of a generated page: 1 if all text of the element is main text, 0 if none is, -1 if mixed or without text."""
    k = len(p.nodes)
    main, rest = np.zeros(k), np.zeros(k)
    for i, n in enumerate(p.nodes):
        marked = "data-main" in n.attrs or "data-top" in n.attrs
        main[i], rest[i] = (p.own[i], 0) if marked else (0, p.own[i])
    for i in range(k - 1, 0, -1):
        main[p.parent[i]] += main[i]
        rest[p.parent[i]] += rest[i]
    return np.where(main + rest == 0, -1, np.where(rest == 0, 1, np.where(main == 0, 0, -1)))


def true_text(page: str) -> str:
    p = Page(page)
    return p.text(np.array(["data-main" in n.attrs or "data-top" in n.attrs for n in p.nodes]))


@lru_cache(2)
def fitted(pages: int = 2200, seed: int = 7) -> Extractor:
    """The extractor fitted on generated pages; the same on every machine."""
    made = [Page(PageMaker(seed * 100_003 + i).page()) for i in range(pages)]
    labels = [truth(p) for p in made]
    seen: dict[str, list[float]] = {}
    for p, y in zip(made, labels, strict=True):
        for n, v in zip(p.nodes, y, strict=True):
            if v >= 0:
                for t in set(attribute_tokens(n)):
                    seen.setdefault(t, [0.5, 0.5])[int(v)] += 1
    weights = {t: max(-4.0, min(4.0, math.log(b / a))) for t, (a, b) in seen.items() if a + b >= 6 and not t.isdigit()}
    weights = {t: w for t, w in weights.items() if t not in ("data", "top")}
    x = np.concatenate([p.features(weights) for p in made])
    y = np.concatenate(labels)
    return Extractor(weights, BoostedTrees(trees=120, depth=5, rate=0.12).fit(x[y >= 0], y[y >= 0]))


@lru_cache(4)
def stored(spark: SparkSession, where: str, pages: int = 2200, seed: int = 7) -> Extractor:
    """The fitted extractor, from the shared folder ``where`` if an earlier session has left it there, else fitted and left.

    The file's name has a digest of this code, so another version of it fits anew.
    """
    code = hashlib.sha256("".join(map(inspect.getsource, (sys.modules[__name__], sys.modules[BoostedTrees.__module__]))).encode()).hexdigest()
    path = f"{where}/main-text-{pages}-{seed}-{code[:16]}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return Extractor.load(spark.read.text(path, wholetext=True).first()[0].strip())
    tool = fitted(pages, seed)
    spark.createDataFrame([(tool.dump(),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return tool


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` with ``main_text``, from the whole ``html``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by a
    blank line. A null or empty page, and one without main text, gives the empty text. A column named main_text is
    replaced.
    """
    spark = pages.sparkSession
    held = spark.sparkContext.broadcast(stored(spark, shared_dir(spark)))  # some hundred token weights and 120 small trees

    @F.pandas_udf(StringType())
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tool = held.value
        for texts in batches:
            yield pd.Series(tool.texts(texts.tolist()), dtype=object)

    return put(pages, {"main_text": extract(F.col("html"))})
