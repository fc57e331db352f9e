"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text between the tags that break lines. Each block has
features of its ancestors (tag names, words of class, id and role), of the tags inside it, and of
its text (length, links, punctuation, signs of notices). A chain of two labels, text and other, joins
neighbouring blocks. It is trained on labelled pages by the gradient of the log-likelihood (forward
and backward sums), and the best labelling of a page is found by Viterbi.

The labelled pages are drawn by a seeded generator of page layouts, a parameter: articles inside
varied wrappers, with menus, banners, sidebars, cookie notices, adverts, forms, comments and footers
around and inside them. ``train`` takes any other labelled pages as well.

Defined results: null or empty html gives the empty text; unclosed tags end with the page; an element
that closes more than was opened is ignored; repeated pages have repeated results. A head ends at the
first tag or text that cannot stand in one. A hidden element that its own end tag does not close
hides no more than what comes before the next tag that breaks lines, or the end of what it is in. A
tag or comment that the end of the page cuts short is dropped; ``<!-->``, ``<![ ... >`` and other
declarations are comments. Neither broken nor hostile markup stops a job: reading takes time in
proportion to the page, however deep its elements lie. ``data-y`` attributes are labels in training
pages only, and nothing elsewhere. Ties between labels go to *other*. Empty tables and extra columns,
whatever their names, pass; a column named like the result is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, slices

#: Fixed values of HTML: elements that break lines, that hold no text, and that have no end.
BLOCKS = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
HIDDEN = frozenset("script style noscript template head iframe object svg canvas textarea".split())
EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What can stand in a head; hidden elements that are looked at for an end tag.
IN_HEAD = frozenset("html head title base basefont bgsound link meta style script noscript noframes template".split())
CLOSABLE = HIDDEN - {"head", "script", "style"}
_CLOSABLE = re.compile(f"<(?:{'|'.join(sorted(CLOSABLE))})", re.IGNORECASE)
#: An open one of these is closed by the next one.
CLOSES_ITSELF = {"p": BLOCKS - {"br", "button", "option", "tr", "td", "th", "tbody", "thead", "tfoot", "html", "body"}, "li": frozenset({"li"}), "option": frozenset({"option"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"})}
#: What begins a tag, if a ``>`` is to come.
_CUT_SHORT = re.compile("<[A-Za-z/!?]")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    """A leaf block: with its features where it is to be learnt from, else with the sum of their weights."""

    text: str
    features: tuple[str, ...] = ()
    label: int | None = None
    score: float | None = None


class _Parser(HTMLParser):
    """Reads a page of any kind; markup that the library has no reading of is a comment."""

    def read(self, page: str) -> None:
        self.feed(page)
        if self.rawdata.startswith("<!"):  # a comment that never ends
            self.rawdata = ""
        self.close()

    def parse_comment(self, i: int, report: bool = True) -> int:
        for empty in ("<!-->", "<!--->"):
            if self.rawdata.startswith(empty, i):
                return i + len(empty)
        return super().parse_comment(i, report)

    def parse_html_declaration(self, i: int) -> int:
        return self.parse_bogus_comment(i) if self.rawdata.startswith("<![", i) else super().parse_html_declaration(i)


class _Unclosed(_Parser):
    """Numbers the closable elements from 0; ``open`` gets those that their own end tag does not close."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.depth: Counter[str] = Counter()
        self.seen = 0
        self.open: set[int] = set()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in EMPTY:
            self.stack.append((tag, self.seen))
            self.depth[tag] += 1
            self.seen += tag in CLOSABLE

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        pass

    def pop(self) -> tuple[str, int]:
        tag, number = self.stack.pop()
        self.depth[tag] -= 1
        return tag, number

    def handle_endtag(self, tag: str) -> None:
        if self.depth[tag]:
            while (top := self.pop())[0] != tag:
                self.left(*top)

    def left(self, tag: str, number: int) -> None:
        if tag in CLOSABLE:
            self.open.add(number)

    def finish(self) -> set[int]:
        for top in self.stack:
            self.left(*top)
        return self.open


class _Leaves(_Parser):
    """Collects leaf blocks: with scores by ``weights``, or else with features and, from ``data-y``, labels."""

    def __init__(self, unclosed: frozenset[int] | set[int] = frozenset(), weights: dict[str, float] | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.unclosed, self.seen, self.weights = unclosed, 0, weights
        #: How many open elements give each feature, and how many have each tag.
        self.around: Counter[str] = Counter()
        self.depth: Counter[str] = Counter()
        #: Places on the stack of an open head and of unclosed hidden elements.
        self.heads: list[int] = []
        self.loose: list[int] = []
        #: Tag, features, label and, of all features that are open then, the sum of their weights.
        self.stack: list[tuple[str, list[str], int | None, float]] = []
        self.hidden = 0
        self.blocks: list[Block] = []
        self.parts: list[str] = []
        self.inside: set[str] = set()
        self.linked = 0

    def end_hidden(self, tag: str) -> None:
        """End what a start tag shows to be over: unclosed hidden elements, and the head."""
        if self.loose and tag in BLOCKS:
            self.pop_to(self.loose[0])
        if self.heads and (tag in ("body", "frameset") or tag not in IN_HEAD and self.stack[-1][0] in ("head", "title")):
            self.flush()
            self.pop_to(self.heads[0])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.end_hidden(tag)
        if tag in BLOCKS:
            self.flush()
            while self.stack and tag in CLOSES_ITSELF.get(self.stack[-1][0], ()):
                self.pop()
        elif not self.hidden:
            self.inside.add(tag)
        if tag in EMPTY:
            return
        names, label = [], self.stack[-1][2] if self.stack else None
        for k, v in attrs:
            if k in ("class", "id", "role", "aria-label"):
                names += _WORD.findall((v or "").lower())
            elif k == "data-y" and self.weights is None:
                label = int(v)
            elif k == "hidden" or k == "style" and "display:none" in (v or "").replace(" ", ""):
                names.append("hidden")
        if tag == "head":
            self.heads.append(len(self.stack))
        elif tag in CLOSABLE:
            if self.seen in self.unclosed:
                self.loose.append(len(self.stack))
            self.seen += 1
        own = list(dict.fromkeys((f"in={tag}", *(f"name={n}" for n in names))))
        total = self.stack[-1][3] if self.stack else 0.0
        if self.weights is not None:
            own = [f for f in own if f in self.weights]
            total += sum(self.weights[f] for f in own if not self.around[f])
        self.around.update(own)
        self.depth[tag] += 1
        self.stack.append((tag, own, label, total))
        self.hidden += tag in HIDDEN

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.end_hidden(tag)
        if tag in BLOCKS:
            self.flush()

    def pop(self) -> None:
        tag, own, *_ = self.stack.pop()
        self.hidden -= tag in HIDDEN
        self.depth[tag] -= 1
        for f in own:
            self.around[f] -= 1
            if not self.around[f]:
                del self.around[f]
        for places in (self.heads, self.loose):
            if places and places[-1] == len(self.stack):
                places.pop()

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        if self.depth[tag]:
            while self.stack[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if self.heads and self.stack[-1][0] == "head" and not data.isspace():
            self.flush()
            self.pop_to(self.heads[0])
        if not self.hidden:
            self.parts.append(data)
            if any(t == "a" for t, *_ in self.stack[-3:]):
                self.linked += len(data)

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                tag, _, label, total = self.stack[-1] if self.stack else ("", [], None, 0.0)
                own = self.features(tag, text)
                if self.weights is None:
                    self.blocks.append(Block(text, (*self.around, *own), label))
                else:
                    self.blocks.append(Block(text, score=total + sum(self.weights.get(f, 0.0) for f in own)))
            self.parts = []
        self.inside, self.linked = set(), 0

    def features(self, tag: str, text: str) -> list[str]:
        """A block's own features."""
        out, n = [f"near={tag}", *(f"has={t}" for t in sorted(self.inside))], len(text)
        out.append(f"len={min(n.bit_length(), 9)}")
        out.append(f"links={min(3, 4 * self.linked // max(n, 1))}")
        out.append("stop" if text[-1] in ".!?\"'”»" else "open")
        if "©" in text:
            out.append("copyright")
        return out


def leaf_blocks(html: str | None, model: Crf | None = None) -> list[Block]:
    """The blocks of a page, scored by the model; without one, they have features and labels to learn from."""
    page, unclosed = (html or "").replace("\x00", ""), set()
    if cut_short := _CUT_SHORT.search(page, page.rfind(">") + 1):
        page = page[: cut_short.start()]
    if _CLOSABLE.search(page):
        u = _Unclosed()
        u.read(page)
        unclosed = u.finish()
    p = _Leaves(unclosed, model.weights if model else None)
    p.read(page)
    p.flush()
    return p.blocks


@dataclass
class Crf:
    """Weights of features for the label *text*, and of neighbouring labels."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def scores(self, blocks: list[Block]) -> np.ndarray:
        w = self.weights
        return np.array([sum(w.get(f, 0.0) for f in b.features) if b.score is None else b.score for b in blocks])

    def decode(self, blocks: list[Block]) -> list[int]:
        """The best labels, by Viterbi."""
        if not blocks:
            return []
        (a, b), (c, d) = self.moves.tolist()
        s, back, x, y = self.scores(blocks).tolist(), [], 0.0, 0.0
        y = s[0]
        for v in s[1:]:
            px, py = int(y + c > x + a), int(y + d > x + b)
            x, y = (y + c if px else x + a), (y + d if py else x + b) + v
            back.append((px, py))
        label = int(y > x)
        out = [label]
        for px, py in reversed(back):
            label = py if label else px
            out.append(label)
        return out[::-1]


def _logadd(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(pages: list[list[Block]], epochs: int = 12, rate: float = 0.25, decay: float = 1e-4) -> Crf:
    """Fit on pages whose blocks have labels, by stochastic gradient on the chain's log-likelihood."""
    names = sorted({f for p in pages for b in p for f in b.features})
    index = {f: i for i, f in enumerate(names)}
    data = [([np.array([index[f] for f in b.features]) for b in p], np.array([b.label for b in p])) for p in pages if p]
    w, moves, rng = np.zeros(len(names)), np.zeros((2, 2)), np.random.default_rng(5)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for k in rng.permutation(len(data)):
            feats, y = data[k]
            n = len(y)
            s = np.zeros((n, 2))
            s[:, 1] = [w[f].sum() for f in feats]
            fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
            fore[0] = s[0]
            for i in range(1, n):
                fore[i] = _logadd(fore[i - 1][:, None] + moves, 0) + s[i]
            for i in range(n - 2, -1, -1):
                aft[i] = _logadd(moves + s[i + 1] + aft[i + 1], 1)
            z = _logadd(fore[-1], 0)
            p = np.exp(fore + aft - z)[:, 1]
            for f, g in zip(feats, y - p):
                w[f] += step * (g - decay * w[f])
            for i in range(1, n):
                moves -= step * np.exp(fore[i - 1][:, None] + moves + s[i] + aft[i] - z) / n
                moves[y[i - 1], y[i]] += step / n
    return Crf({f: float(w[i]) for f, i in index.items() if w[i]}, moves)


def drawn_pages(count: int = 500, seed: int = 11) -> list[list[Block]]:
    """Labelled pages of a seeded generator of layouts."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]

    def words(lo: int, hi: int, stop: bool = True) -> str:
        mark = pick("", "", "", "!!", "***", ";")
        out = ["".join(chr(97 + int(z)) for z in rng.integers(0, 26, rng.integers(1, 10))) + mark for _ in range(rng.integers(lo, hi))]
        text = " ".join(out)
        return text.capitalize() + ("." if stop and rng.random() < 0.8 else "")

    def links(n: int) -> str:
        return "".join(f'<li><a href="/">{words(1, 3, False)}</a></li>' for _ in range(n))

    def cells(n: int) -> str:
        """A menu in the cells of a table, in one row or many."""
        apart = pick("", "</tr><tr>")
        return f"<tr>{apart.join(f'<td><a href="/">{words(1, 3, False)}</a></td>' for _ in range(n))}</tr>"

    def other(kind: str) -> str:
        if kind == "nav":
            return pick(f"<nav><ul>{links(rng.integers(2, 9))}</ul></nav>", f'<div class="{pick("menu", "navbar", "navigation main", "breadcrumb", "breadcrumbs")}"><ul>{links(4)}</ul></div>', f'<ul role="navigation" class="{pick("nav", "menu")}">{links(5)}</ul>', f'<div id="{pick("menu", "nav", "topnav")}"><a href="/">{words(1, 3)}</a> <a href="/b">{words(1, 3)}</a></div>', f"<table>{cells(rng.integers(3, 9))}</table>", f'<table class="{pick("menu", "nav", "links", "topbar")}">{cells(4)}</table>')
        if kind == "header":
            return pick(f"<header><h1>{words(1, 5, False)}</h1><p>{words(3, 12)}</p></header>", f'<div class="{pick("header", "site-header", "masthead", "banner", "topbar")}"><p>{words(2, 9)}</p></div>')
        if kind == "footer":
            return pick(f"<footer>&copy; {words(1, 3, False)} &middot; {words(3, 20)}</footer>", f'<footer><p>{words(3, 30)}</p></footer>', f'<div class="{pick("footer", "site-footer", "copyright")}">{words(3, 20)}</div>', f'<div id="footer">{words(3, 20)}</div>')
        if kind == "ad":
            return pick(f'<div class="{pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad")}">{words(3, 25)}</div>', f'<div class="ad"><p>{words(3, 40)}</p></div>', f'<aside class="{pick("promo", "sponsor", "ad")}"><a href="/x">{words(2, 8)}</a></aside>')
        if kind == "aside":
            return pick(f"<aside><h3>{words(1, 4, False)}</h3><p>{words(5, 50)}</p></aside>", f'<div class="{pick("sidebar", "related", "widget", "share", "social", "popular", "recommended", "tags")}"><h3>{words(1, 4, False)}</h3><ul>{links(3)}</ul></div>', f'<div id="sidebar"><p>{words(5, 50)}</p></div>')
        if kind == "notice":
            return pick(f'<div class="{pick("cookie", "cookies", "cookie-banner", "consent", "notice", "gdpr", "alert", "popup", "modal", "newsletter", "subscribe", "disclaimer")}"><p>{words(4, 40)}</p><button>{words(1, 3, False)}</button></div>', f'<div role="{pick("alert", "dialog", "alertdialog")}">{words(5, 30)}</div>', f'<div id="cookie-notice">{words(5, 30)}</div>', f"<dialog open><p>{words(5, 30)}</p></dialog>")
        if kind == "form":
            return f'<form><label>{words(1, 4, False)}</label><input type="text"><select><option>{words(1, 2)}</option><option>{words(1, 2)}</option></select><button>{words(1, 2, False)}</button><p>{words(3, 20)}</p></form>'
        body = "".join(f'<{t} class="comment"><p>{words(3, 60)}</p></{t}>' for t in [pick("div", "li", "article", "section")] * int(rng.integers(1, 4)))
        return pick(f'<section class="{pick("comments", "comment-list", "responses", "discussion", "replies")}"><h2>{words(1, 3, False)}</h2>{body}</section>', f'<div id="{pick("comments", "disqus", "respond")}">{body}</div>', f'<ol class="{pick("commentlist", "comments")}">{body}</ol>')

    def article() -> str:
        out = [f"<h1>{words(1, 10, False)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.integers(1, 9)):
            long = words(3, 120) if rng.random() < 0.7 else words(1, 4)
            out.append(pick(f"<p>{long}</p>", f"<p>{long}</p>", f"<p><b>{words(2, 9)}</b>{long}<br><p>{words(2, 20)}</p>", f"<p>{long}<br>{words(2, 50)}</p>", f"<p><b>{long}<br>", f"<h2>{words(1, 6, False)}</h2><p>{long}</p>", f"<ul><li>{words(2, 15)}</li><li>{words(2, 9)}</li></ul>", f"<blockquote>{long}</blockquote>", f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 9)}</td></tr></table>", f'<p>{words(4, 30)} <a href="/z">{words(1, 4, False)}</a> {words(4, 30)}</p>', f"<pre>{words(3, 30)}</pre>", f"<figure><figcaption>{words(3, 12)}</figcaption></figure>", f"<div>{long}</div>", f"<section><p>{long}</p></section>"))
            if rng.random() < 0.25:
                # Adverts and menus stand between the paragraphs of many articles.
                out.append(_marked(other(pick("ad", "ad", "nav"))))
            if rng.random() < 0.12:
                out.append(f'<div data-y="0">{other(pick("ad", "aside", "notice", "form", "nav"))}</div>' if rng.random() < 0.5 else _marked(other(pick("ad", "aside", "notice", "form", "comments", "footer", "header"))))
        return "".join(out)

    pages = []
    for _ in range(count):
        kinds = ["nav", "header", "ad", "aside", "notice", "form", "comments"]
        before = [_marked(other(k)) for k in rng.permutation(kinds)[: rng.integers(0, 4)]]
        after = [_marked(other(k)) for k in rng.permutation([*kinds, "footer"])[: rng.integers(0, 4)]] + ([_marked(other("footer"))] if rng.random() < 0.7 else [])
        left, right = pick(("<article data-y='1'>", "</article>"), ("<article data-y='1'>", "</article>"), ("<main data-y='1'>", "</main>"), ("<main><article data-y='1'>", "</article></main>"), (f"<div data-y='1' class='{pick('content', 'post', 'entry', 'article body', 'story', 'post-content', 'entry-content')}'>", "</div>"), ("<div data-y='1' id='content'>", "</div>"), ("<div data-y='1' role='main'>", "</div>"), ("<div data-y='1'>", "</div>"))
        pages.append(leaf_blocks(f"<!DOCTYPE html><html><head><title>{words(1, 6)}</title><style>p{{}}</style></head><body data-y='0'>{''.join(before)}{left}{article()}{right}{''.join(after)}</body></html>"))
    return pages


def _marked(html: str) -> str:
    return re.sub(r"^<(\w+)", r"<\1 data-y='0'", html)


@lru_cache(1)
def default_model() -> Crf:
    return train(drawn_pages())


def main_text(html: str | None, model: Crf) -> str:
    blocks = leaf_blocks(html, model)
    return " ".join(b.text for b, y in zip(blocks, model.decode(blocks)) if y)


def extract(df: DataFrame, model: Crf | None = None, html: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The rows with the main text of ``html`` in ``out``; ``keep`` names the other columns of the result."""
    model = model or default_model()
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = df.select(keep).schema.add(out, "string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, html):
                made = pa.array([main_text(h, model) for h in part.column(html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), made], [*keep, out])

    return map_rows(df.select(list(dict.fromkeys([*keep, html]))), run, schema)
