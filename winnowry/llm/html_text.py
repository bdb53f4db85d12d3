"""Operator 4, HTML extraction: gradient-boosted trees over DOM nodes.

A page becomes a tree of elements.  Trees of depth 3, boosted on logistic loss in
numpy, give each element the probability that it holds main text, from its tag,
attribute tokens, depth, siblings, text and link density of its subtree and the
same of its parent.  Decoding is hierarchical: a page's choice maximizes the sum of log
probabilities under the rule that what lies in a dropped element is dropped, so
ancestors and descendants never contradict each other.

There are no labelled pages, so the model is trained on pages it makes itself, in many
layouts, in which it is known what is main text (``synthetic_pages``, a fixed number and seed).

Elements inside lines are judged like blocks where they have attributes that tell
something (class, id, role, hidden, style); leaving one out does not break the line.

Defined results: null and empty html give an empty text; broken markup (open
ends, stray end tags) is repaired as browsers do in simple cases, and a quote
that is never closed counts as part of a value that ends at white space or >;
nothing is truncated; rows are kept one for one, repeated ones too; other columns
are returned as they are, but for one named ``text``, which gives way to the result.
"""

from __future__ import annotations

import functools
import html as html_lib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import release
from .common import table

#: Fixed values of HTML: elements without content, of raw text, inside lines, and those that an opening block ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
NEVER = RAW | frozenset("head template svg object select canvas audio video datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("table", "tr")), "th": ("td th", ("table", "tr")), "option": ("option", ("select",))}

# attributes as browsers read them: quotes count right after = only; all repetitions are possessive, so no page takes more than linear time
_VALUE = r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]++|(?=>)))?+"""
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?+|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+{_VALUE})*+)>", re.S)
# tags of pages in which some quote is never closed
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?+|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)|(?=>)))?+""")
_NONE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?+", re.S)  # no > follows any more
_TOKEN = re.compile(r"[a-z]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

GOOD = frozenset("article content main post entry story body text blog news page prose richtext articlebody".split())
BAD = {
    "nav": frozenset("nav menu navbar navigation breadcrumb breadcrumbs toc tabs pagination pager".split()),
    "frame": frozenset("header footer masthead banner topbar foot copyright legal bottom".split()),
    "side": frozenset("sidebar aside side related widget recommended more trending popular rail".split()),
    "ad": frozenset("ad ads advert advertisement sponsor sponsored promo promotion outbrain taboola dfp".split()),
    "note": frozenset("cookie cookies consent notice gdpr popup modal overlay alert subscribe newsletter signup paywall".split()),
    "talk": frozenset("comment comments reply replies discussion disqus respond reader readers feedback".split()),
    "tool": frozenset("share sharing social tools toolbar buttons search login form".split()),
}
ALL_BAD = frozenset().union(*BAD.values())
TAGS = {t: k for k, group in enumerate(("html body", "article main", "section div", "p blockquote pre figure figcaption", "h1", "h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "nav menu", "header", "footer", "aside", "form fieldset dialog button", "table tbody tr td th thead tfoot caption", "address details summary")) for t in group.split()}
N_FEATURES = 41


class Node:
    __slots__ = ("tag", "tokens", "parent", "parts", "kids", "depth", "index", "chars", "links", "words", "marks", "tags", "paras", "hidden", "id", "good", "bad", "inline")

    def __init__(self, tag, tokens, parent, hidden=False, inline=False):
        self.tag, self.tokens, self.parent, self.hidden, self.inline = tag, tokens, parent, hidden, inline
        self.parts: list = []
        self.kids: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.index = len(parent.kids) if parent else 0
        # good and bad ancestors or self, by tag and attribute tokens
        self.good = (parent.good if parent else 0) + (tag in ("article", "main") or not GOOD.isdisjoint(tokens))
        self.bad = (parent.bad if parent else 0) + (tag in ("nav", "header", "footer", "aside", "form") or not ALL_BAD.isdisjoint(tokens))
        self.chars = self.links = self.words = self.marks = self.tags = self.paras = 0
        if parent:
            parent.kids.append(self)
            parent.parts.append(self)


class _Open:
    """The stack of open elements, with the places of each tag in it."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks = [root], {}, [0]

    def push(self, x: Node) -> None:
        self.at.setdefault(x.tag, []).append(len(self.stack))
        if not x.inline:
            self.blocks.append(len(self.stack))
        self.stack.append(x)

    def last(self, names) -> int:
        return max((self.at[t][-1] for t in names if self.at.get(t)), default=0)

    def close(self, names, barrier=()) -> bool:
        """Close the last open element of these names and all in it, unless one of the barrier is in between."""
        k = self.last(names)
        if not k or self.last(barrier) > k:
            return False
        while len(self.stack) > k:
            x = self.stack.pop()
            self.at[x.tag].pop()
            if not x.inline:
                self.blocks.pop()
        return True


def parse(page: str) -> Node:
    """The tree of judged elements; parts are strings, None for a break, and nodes in page order."""
    root = Node("#root", frozenset(), None)
    tree = _Open(root)
    stack = tree.stack
    links = 0
    at, n, markup = 0, len(page), _MARKUP
    endless: set[str] = set()  # raw elements known to have no end further on

    def text(s: str) -> None:
        if s:
            top = stack[-1]
            top.parts.append(s)
            if links:
                top.links += len(s)

    while at < n:
        lt = page.find("<", at)
        m = markup.match(page, lt) if lt >= 0 else None
        if not m and markup is _MARKUP and lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
            markup = _PLAIN if page.find(">", lt) >= 0 else _NONE
            continue
        if not m:  # a lone < is text
            stop = lt + 1 if lt >= 0 else n
            text(page[at:stop])
            at = stop
            continue
        text(page[at:lt])
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(html_lib.escape(m[0][9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if m[1]:
            if name in INLINE:
                if name == "a":
                    links = max(0, links - 1)
                # ends of elements inside lines reach no further than the block they stand in
                if tree.last((name,)) > tree.blocks[-1]:
                    tree.close((name,))
            elif name == "p" and not tree.at.get("p"):
                stack[-1].parts.append(None)
            elif name not in VOID and tree.close((name,)):
                links = 0
            continue
        if name in RAW:
            end = None if name in endless else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            if end is None:
                endless.add(name)
            at = end.end() if end else n if name in ("script", "style", "textarea", "title") else at
            if name != "noscript":
                stack[-1].parts.append(None)
            continue
        if name in VOID:
            if name in ("br", "hr"):
                stack[-1].parts.append(None)
            continue
        attrs: dict[str, str] = {}
        for k, a, b, c in _ATTR.findall(m[3]) if m[3].strip(" /") else ():
            attrs.setdefault(k.lower(), html_lib.unescape(a or b or c))
        words = " ".join(attrs.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label")).lower() if attrs else ""
        hidden = name in NEVER or "hidden" in attrs or bool(_UNSEEN.search(attrs.get("style", "").lower()))
        tokens = frozenset(_TOKEN.findall(words))
        if name in INLINE:
            links += name == "a"
            if tokens or hidden:
                tree.push(Node(name, tokens, stack[-1], hidden, True))
            continue
        if name in ENDS_P:
            tree.close(("p",), ("td", "th", "li", "div", "section", "article", "aside", "main", "body", "blockquote", "form", "button", "table", "caption", *NEVER))
            if name in HEADINGS and stack[-1].tag in HEADINGS:
                tree.close((stack[-1].tag,))
        if name in SCOPE:
            tree.close(SCOPE[name][0].split(), SCOPE[name][1])
        if name in ("html", "body") and tree.at.get(name):
            continue
        if name == "body":
            tree.close(("head",))
        tree.push(Node(name, tokens, stack[-1], hidden, name == "button"))
        links = 0
    return root


def measured(root: Node) -> list[Node]:
    """All nodes in page order, with the sums of their subtrees."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        x.id = len(out)
        out.append(x)
        todo.extend(reversed(x.kids))
    for x in reversed(out):
        own = [p for p in x.parts if isinstance(p, str)]
        for p in own:
            x.chars += len(p)
            x.words += p.count(" ") + 1
            x.marks += p.count(",") + p.count(".")
        x.tags += 1
        x.paras += x.tag == "p"
        if x.parent is not None:
            q = x.parent
            q.chars += x.chars
            q.links += x.links
            q.words += x.words
            q.marks += x.marks
            q.tags += x.tags
            q.paras += x.paras
    return out


def features(nodes: list[Node]) -> np.ndarray:
    out = np.zeros((len(nodes), N_FEATURES), np.float32)
    total = max(1, nodes[0].chars)
    for x, row in zip(nodes, out, strict=True):
        k = TAGS.get(x.tag)
        if k is not None:
            row[k] = 1
        if x.tokens:
            row[15] = bool(x.tokens & GOOD)
            for i, bad in enumerate(BAD.values()):
                row[16 + i] = bool(x.tokens & bad)
        p = x.parent
        row[23:31] = (x.depth, x.index, len(p.kids) if p else 1, len(x.kids), np.log1p(x.chars), x.links / max(1, x.chars), x.chars / x.tags, x.paras)
        row[31:38] = (x.marks / max(1, x.words), x.chars / total, p.chars / total if p else 1, p.links / max(1, p.chars) if p else 0, (x.chars - sum(k.chars for k in x.kids)) / max(1, x.chars), x.good, x.bad)
        row[38:41] = (x.inline, x.chars / max(1, p.chars) if p else 1, x.tag in ("article", "main"))
    return out


class Boosted:
    """Depth-3 regression trees on the gradients of the logistic loss, over 16-bin histograms."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.3):
        self.rounds, self.depth, self.rate = rounds, depth, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 17)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        f, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            at, tree = np.zeros(len(y), int), {}
            for d in range(self.depth):
                for leaf in range(2**d - 1, 2 ** (d + 1) - 1):
                    own = np.flatnonzero(at == leaf)
                    best = (1e-6, None, None)
                    for j in range(x.shape[1]) if len(own) >= 20 else ():
                        n = len(self.edges[j]) + 1
                        gs, hs = np.bincount(bins[own, j], g[own], n).cumsum(), np.bincount(bins[own, j], h[own], n).cumsum()
                        gain = gs**2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                        if n > 1 and gain[:-1].max() > best[0]:
                            best = (gain[:-1].max(), j, int(gain[:-1].argmax()))
                    _, j, b = best
                    tree[leaf] = (0, np.inf) if j is None else (j, float(self.edges[j][b]))
                    j, cut = tree[leaf]
                    at[own] = 2 * leaf + 1 + (x[own, j] > cut)
            first = 2**self.depth - 1
            k = at - first
            value = np.bincount(k, g, 2**self.depth) / (np.bincount(k, h, 2**self.depth) + 1) * self.rate
            f += value[k]
            self.trees.append((np.array([tree[i][0] for i in range(first)]), np.array([tree[i][1] for i in range(first)], np.float32), value))
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        f, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            f += value[at - len(feature)]
        return f


def decode(nodes: list[Node], logit: np.ndarray) -> list[bool]:
    """Which elements are kept: the likeliest choice in which no dropped element has a kept one inside."""
    lp = -np.logaddexp(0, -logit)
    lq = -np.logaddexp(0, logit)
    drop, keep = lq.copy(), lp.copy()  # of whole subtrees
    for x in reversed(nodes):
        if x.parent is not None:
            i, p = x.id, x.parent.id
            drop[p] += drop[i]
            keep[p] += drop[i] if x.hidden else max(drop[i], keep[i])
    out = [False] * len(nodes)
    for x in nodes:
        i = x.id
        out[i] = not x.hidden and (x.parent is None or (out[x.parent.id] and keep[i] > drop[i]))
    return out


def main_text(root: Node, kept: list[bool]) -> str:
    """Blocks of kept elements in page order."""
    blocks, line, todo = [], [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            line.append(x)
        elif isinstance(x, Node) and x.inline:
            if kept[x.id]:
                todo.extend(reversed(x.parts))
        else:
            if line:
                blocks.append("".join(line))
                line = []
            if isinstance(x, Node) and kept[x.id]:
                todo.append(None)
                todo.extend(reversed(x.parts))
    blocks.append("".join(line))
    return " ".join(t for b in blocks if (t := " ".join(html_lib.unescape(b).split())))


_WORDS = "ra ti on the er in an de ge lo mu ta ke si vor el as pu".split()


def synthetic_pages(n: int = 400, seed: int = 4) -> list[tuple[str, str]]:
    """(html, mark) pages in many layouts; main text is inside words that begin with the mark."""
    r = random.Random(seed)
    mark = "qz"

    def words(a, z, m=""):
        return " ".join(m + "".join(r.choices(_WORDS, k=r.randint(1, 4))) + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(a, z)))

    def cls(*names):
        c = r.choice([*names, ""])
        return f' {r.choice(["class", "id"])}="{c}"' if c else ""

    def menu():
        items = "".join(f'<li><a href="/{k}">{words(1, 2)}</a></li>' for k in range(r.randint(3, 9)))
        return r.choice([f"<nav><ul>{items}</ul></nav>", f'<div class="{r.choice(["menu", "nav", "navbar", "breadcrumbs"])}"><ul>{items}</ul></div>', f'<ul role="navigation">{items}</ul>'])

    def links():
        return "".join(f'<p><a href="/{k}">{words(3, 9)}</a></p>' for k in range(r.randint(2, 6)))

    def inside(m):
        """Elements inside a line: plain ones, and now and then an advert, a control or something unseen."""
        t = r.choice(["span", "span", "em", "small", "a", "b"])
        if r.random() < 0.5:
            return f'<{t} class="{r.choice(["highlight", "term", "x1", "caps", "quote", "lead", "note-ref"])}">{words(1, 12, m)}</{t}>'
        return r.choice([
            f'<{t} class="{r.choice(["ad", "advert sponsored", "sponsored", "promo", "share", "social", "newsletter", "popup"])}">{words(1, 9)}</{t}>',
            f'<button class="{r.choice(["share", "subscribe", "btn"])}">{words(1, 2)}</button>',
            f'<span style="display:none">{words(1, 6)}</span>',
        ])

    def paragraph(m):
        own = words(1, r.choice([1, 4, 12, 60, 60]), m)
        if r.random() < 0.2:
            own += f" {inside(m)} {words(0, 12, m)}"
        return f"<p>{r.choice(['', '', '<b>'])}{own}{r.choice(['</p>', '</p>', '<br>'])}"

    def comments():
        def one():
            t = r.choice(["div", "li", "article"])
            return f'<{t} class="{r.choice(["comment", "reply", "comment body"])}"><p>{words(3, 50)}</p></{t}>'

        return f'<{(t := r.choice(["section", "div"]))} {r.choice(["id", "class"])}="{r.choice(["comments", "discussion", "reader-comments", "replies"])}"><h{(h := r.randint(2, 4))}>{words(1, 3)}</h{h}>{"".join(one() for _ in range(r.randint(1, 6)))}</{t}>'

    extras = [
        lambda: f'<div class="{r.choice(["ad", "ads", "advert", "sponsored", "promo"])}">{words(3, 40)}</div>',
        lambda: f'<div class="{r.choice(["cookie-notice", "consent", "notice", "newsletter", "popup"])}"><p>{words(5, 40)}</p></div>',
        lambda: f'<aside{cls("sidebar", "related", "widget")}><h3>{words(1, 3)}</h3>{r.choice([links(), "<p>" + words(5, 40) + "</p>"])}</aside>',
        lambda: f'<div class="{r.choice(["sidebar", "related", "widget", "trending"])}">{links()}</div>',
        lambda: f'<form action="/s"><p>{words(2, 12)}</p><label>{words(1, 3)}</label><input name="q"></form>',
        lambda: f'<div class="{r.choice(["share", "social"])}"><a href="#">{words(1, 2)}</a> <a href="#">{words(1, 2)}</a></div>',
        comments,
    ]
    out = []
    for _ in range(n):
        body = [f"<h1>{words(2, 10, mark)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 1, 2, 5, 20])):
            body.append(r.choice([paragraph] * 8 + [lambda m: f"<h2>{words(1, 6, m)}</h2>", lambda m: f"<blockquote><p>{words(5, 30, m)}</p></blockquote>", lambda m: "<ul>" + "".join(f"<li>{words(2, 15, m)}</li>" for _ in range(r.randint(2, 6))) + "</ul>", lambda m: f"<div>{words(10, 60, m)}</div>", lambda m: f"<table><tr><td>{words(1, 4, m)}</td><td>{words(1, 4, m)}</td></tr></table>"])(mark))
            if r.random() < 0.06:
                body.append(r.choice(extras)())
        inner = "".join(body) or paragraph(mark)
        shell = r.choice(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<div class="content">{}</div>', '<div id="main"><div class="post">{}</div></div>', '<div class="entry-content">{}</div>'])
        before = "".join(r.choice(extras)() for _ in range(r.choice([0, 1, 1, 2])))
        after = "".join(r.choice(extras)() for _ in range(r.choice([0, 0, 1, 2])))
        top = r.choice([menu(), f"<header>{words(1, 8)}{menu()}</header>", f'<div class="header"><h1>{words(1, 4)}</h1></div>' + menu(), ""])
        foot = r.choice([f"<footer>&copy; {words(2, 20)}</footer>", f'<div class="footer">{words(2, 15)}</div>', ""])
        out.append((f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body>{top}{before}{shell.format(inner)}{after}{foot}</body></html>", mark))
    return out


@functools.lru_cache(1)
def trained() -> Boosted:
    xs, ys = [], []
    for page, mark in synthetic_pages():
        nodes = measured(parse(page))
        holds = [False] * len(nodes)
        for x in reversed(nodes):
            if any(isinstance(p, str) and mark in p for p in x.parts):
                holds[x.id] = True
            if holds[x.id] and x.parent is not None:
                holds[x.parent.id] = True
        xs.append(features(nodes))
        ys += holds
    return Boosted().fit(np.concatenate(xs), np.array(ys, float))


#: Pages are worked on together up to so many, and so many characters.
BATCH_PAGES = 128
BATCH_CHARS = 2 << 20


def texts_of(pages: list[str | None], model: Boosted) -> list[str]:
    trees = [measured(parse(p or "")) for p in pages]
    logit = model.logit(np.concatenate([features(t) for t in trees]))
    cuts = np.cumsum([0, *map(len, trees)])
    return [main_text(t[0], decode(t, logit[a:z])) for t, a, z in zip(trees, cuts, cuts[1:], strict=False)]


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """The other columns and text, the main text of ``html_col``."""
    import pickle

    from pyspark.sql.pandas.types import to_arrow_type

    shared = df.sparkSession.sparkContext.broadcast(pickle.dumps(trained()))  # of fixed size
    others = [f for f in df.schema if f.name not in (html_col, "text")]
    src = df.select(*[F.col(f"`{f.name}`").alias(f"c{k}") for k, f in enumerate(others)], F.col(f"`{html_col}`").alias("html"))
    schema = "".join(f"c{k} {f.dataType.simpleString()}, " for k, f in enumerate(others)) + "text string"
    kinds = [(f"c{k}", to_arrow_type(f.dataType)) for k, f in enumerate(others)]

    def run(batches):
        model = pickle.loads(shared.value)
        for batch in batches:
            cols = [batch.column(f).cast(k) if batch.column(f).type != k else batch.column(f) for f, k in kinds]
            html, at = batch.column("html"), 0
            while at < batch.num_rows:
                pages, held = [], 0
                while at + len(pages) < batch.num_rows and len(pages) < BATCH_PAGES and held < BATCH_CHARS:
                    pages.append(html[at + len(pages)].as_py())
                    held += len(pages[-1] or "")
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(pages)) for c in cols), pa.array(texts_of(pages, model), pa.string())], names=[*(f for f, _ in kinds), "text"])
                at += len(pages)
        release()

    return src.mapInArrow(run, schema).select(*[F.col(f"c{k}").alias(f.name) for k, f in enumerate(others)], "text")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
