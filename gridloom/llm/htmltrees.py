"""HTML extraction: boosted trees over DOM-node features, decoded from the root down.

A page is parsed into a tree as browsers would roughly do (void elements, implied end tags, raw
text of scripts and styles, missing end tags, cut-off pages). Every element gets features: its tag
and class of tag, words of its id, class and role, depth, place among its siblings, the share of
the page's text below it, link and punctuation density, text per tag, and the same of its parent.
Gradient-boosted trees (logistic loss, quantile bins) give the probability that the element belongs
to the article.

Decoding chooses keep or drop for all elements at once: below a dropped element everything is
dropped, so no descendant contradicts its ancestor; of all such choices the one of greatest
likelihood is found from the leaves up. Text of kept elements is joined into blocks.

The trees are fitted on pages made from templates of this module with a fixed seed; nothing is
read from the corpus. Nulls count as empty pages, whose text is empty. Repeated rows keep their own
output rows.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._common import table
from gridloom.llm._units import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
#: Scripts, styles, form controls, the head and raw fallbacks are never text of the page, whatever the trees say.
NEVER = frozenset("script style noscript template head title textarea select option button iframe xmp noembed noframes datalist".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "figcaption", "summary"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""\b(id|class|role|style|hidden|aria-hidden|itemprop|aria-label)\b\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_BLANK = re.compile(r"[\s ]+")


class Page:
    """Elements in document order: tag, parent, attribute text; content: (element, text) in order."""

    __slots__ = ("tag", "parent", "attr", "pieces")

    def __init__(self, source: str):
        self.tag, self.parent, self.attr = ["#root"], [-1], [""]
        self.pieces: list[tuple[int, str | None]] = []
        open_, at, n = [0], 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self._text(open_[-1], source[at:])
                break
            nxt = source[lt + 1 : lt + 2]
            if nxt.isalpha() and nxt.isascii():
                if lt > at:
                    self._text(open_[-1], source[at:lt])
                at = self._start(source, lt, open_)
            elif nxt == "/" and source[lt + 2 : lt + 3].isalpha():
                if lt > at:
                    self._text(open_[-1], source[at:lt])
                gt = source.find(">", lt)
                name = _NAME.match(source, lt + 2)[0].lower()
                if name in ("p",) and name not in (self.tag[x] for x in open_):
                    pass
                else:
                    for k in range(len(open_) - 1, 0, -1):
                        if self.tag[open_[k]] == name:
                            del open_[k:]
                            break
                        if name not in BLOCK and self.tag[open_[k]] in BLOCK:
                            break
                if name in BLOCK:
                    self.pieces.append((open_[-1], None))
                at = n if gt < 0 else gt + 1
            elif nxt in ("!", "?", "/"):
                if lt > at:
                    self._text(open_[-1], source[at:lt])
                if source.startswith("<!--", lt):
                    end = source.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = source.find(">", lt)
                    at = n if end < 0 else end + 1
            else:
                self._text(open_[-1], source[at : lt + 1])
                at = lt + 1

    def _text(self, node: int, raw: str) -> None:
        self.pieces.append((node, html.unescape(raw)))

    def _start(self, source: str, lt: int, open_: list[int]) -> int:
        name = _NAME.match(source, lt + 1)[0]
        at, n = lt + 1 + len(name), len(source)
        name = name.lower()
        gt = source.find(">", at)
        # a quoted attribute value may hold the bracket
        while gt >= 0:
            body = source[at:gt]
            if body.count('"') % 2 and (q := source.find('"', gt)) >= 0:
                gt = source.find(">", q)
            elif not body.count('"') and body.count("'") % 2 and "='" in body and (q := source.find("'", gt)) >= 0:
                gt = source.find(">", q)
            else:
                break
        if gt < 0:
            return n  # cut off inside a tag
        body = source[at:gt]
        if name in _CLOSES_P:
            for k in range(len(open_) - 1, 0, -1):
                t = self.tag[open_[k]]
                if t == "p":
                    del open_[k:]
                    break
                if t in BLOCK:
                    break
        if name in _CLOSED_BY:
            for k in range(len(open_) - 1, 0, -1):
                t = self.tag[open_[k]]
                if t in _SCOPE[name]:
                    break
                if t in _CLOSED_BY[name]:
                    del open_[k:]
        if name in BLOCK:
            self.pieces.append((open_[-1], None))
        elif name == "br":
            self._text(open_[-1], " ")
        node = len(self.tag)
        self.tag.append(name)
        self.parent.append(open_[-1])
        attr = " ".join(f"{k.lower()} {a or b or c or ''}" for k, a, b, c in _ATTR.findall(body)) if body and ("=" in body or "hidden" in body.lower()) else ""
        self.attr.append(attr.lower())
        if name in VOID or body.endswith("/") and name not in BLOCK and name not in RAW:
            return gt + 1
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(source, gt + 1)
            if end is None:
                return n
            close = source.find(">", end.start())
            return n if close < 0 else close + 1
        open_.append(node)
        return gt + 1


_GOOD = frozenset("article content main story post entry body text blog news page paragraph prose read longform articlebody".split())
_BAD = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer foot copyright legal sidebar side aside widget rail related recommended trending popular more teaser ad ads advert adverts advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login share sharing social comment comments reply replies respond disqus discussion feedback form search pagination pager tags tagcloud toolbar byline meta hidden none contentinfo complementary dialog banner".split()
)
_KINDS = ("nav", "ads", "comments", "notice", "side", "foot", "head", "share", "form")
_KIND_WORDS = [
    frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar".split()),
    frozenset("ad ads advert adverts advertisement sponsor sponsored promo promotion dfp banner".split()),
    frozenset("comment comments reply replies respond disqus discussion feedback".split()),
    frozenset("cookie cookies consent gdpr notice alert popup modal overlay warning dialog".split()),
    frozenset("sidebar side aside rail widget related recommended trending popular more complementary teaser".split()),
    frozenset("footer foot copyright legal contentinfo colophon".split()),
    frozenset("header masthead topbar site-header top".split()),
    frozenset("share sharing social tags tagcloud newsletter subscribe signup login".split()),
    frozenset("form search input hidden none".split()),
]
_TAGS = ("html", "body", "div", "section", "article", "main", "p", "h1", "h2", "h3", "ul", "ol", "li", "a", "span", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "b", "em", "strong", "i", "label", "dl", "details")
_TAG_NO = {t: k for k, t in enumerate(_TAGS)}
_PARAGRAPHS = frozenset("p h1 h2 h3 blockquote pre".split())
_DROPPED_TAGS = frozenset("nav footer aside form dialog menu".split())


def features(pages: list[Page]) -> np.ndarray:
    """A row for each element of the pages, one page after another."""
    tags = [t for p in pages for t in p.tag]
    n = len(tags)
    starts = np.cumsum([0, *(len(p.tag) for p in pages)])
    above = [x + o if x >= 0 else o for p, o in zip(pages, starts.tolist()) for x in p.parent]  # a root is its own parent
    roots = set(starts.tolist())
    chars, ends, words = [0] * n, [0] * n, [0] * n
    for p, o in zip(pages, starts.tolist()):
        for node, text in p.pieces:
            if text and not text.isspace():
                i = node + o
                chars[i] += len(text)
                ends[i] += text.count(".") + text.count(". ") + text.count("!") + text.count("?") + text.count(",")
                words[i] += text.count(" ") + 1
    kids, depth, place, in_link = [0] * n, [0] * n, [0] * n, [False] * n
    kind = np.zeros((n, len(_KINDS) + 2), np.float32)
    above_bad, above_tag, above_good = [0] * n, [0] * n, [0] * n
    i = 0
    for p in pages:
        for a in p.attr:
            t, up = tags[i], above[i]
            bad = good = False
            if a:
                found = set(_TOKEN.findall(a))
                kind[i, :-2] = [not found.isdisjoint(w) for w in _KIND_WORDS]
                good, bad = len(found & _GOOD), len(found & _BAD)
                kind[i, -2], kind[i, -1] = good, bad
            if i != up:
                depth[i], place[i] = depth[up] + 1, kids[up]
                kids[up] += 1
                in_link[i] = in_link[up] or t == "a"
                above_bad[i] = above_bad[up] + (bad > 0)
                above_tag[i] = above_tag[up] + (t in _DROPPED_TAGS)
                above_good[i] = above_good[up] + (good > 0 or t == "article" or t == "main")
                if t in NEVER:
                    chars[i] = 0
            i += 1
    own = np.array(chars, float)
    links = [c if x else 0 for c, x in zip(chars, in_link)]
    below, in_para, in_list = [1] * n, [1 if t in _PARAGRAPHS else 0 for t in tags], [1 if t == "li" else 0 for t in tags]
    for i in range(n - 1, 0, -1):
        if i not in roots:
            up = above[i]
            chars[up] += chars[i]
            links[up] += links[i]
            ends[up] += ends[i]
            words[up] += words[i]
            below[up] += below[i]
            in_para[up] += in_para[i]
            in_list[up] += in_list[i]
    up = np.array(above)
    chars, links, ends, words, kids, place, below, in_para, in_list = (np.array(x, float) for x in (chars, links, ends, words, kids, place, below, in_para, in_list))
    total = np.maximum(np.repeat(chars[starts[:-1]], np.diff(starts)), 1.0)
    base = np.column_stack([
        [_TAG_NO.get(t, -1) for t in tags], depth, kids, place, place / np.maximum(kids[up], 1), np.log1p(chars), chars / total, links / np.maximum(chars, 1), ends / np.maximum(words, 1),
        chars / below, np.log1p(own), in_para, in_list, in_para / below, np.log1p(words), [t in _DROPPED_TAGS for t in tags], [t == "header" for t in tags], [t in ("article", "main") for t in tags], above_bad, above_tag, above_good,
    ])
    mix = np.column_stack([base, kind])
    return np.column_stack([mix, base[up][:, [0, 1, 6, 7, 8, 13]], kind[up]]).astype(np.float32)


@dataclass
class Forest:
    """Trees of equal depth; node k's children are 2k + 1 and 2k + 2."""

    start: float
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray
    leaf: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            while True:
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
                if at[0] >= inner:
                    break
            out += v[at - inner]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Forest:
    """Gradient-boosted trees, second order, on quantile bins."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(m)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)])
    mean = (y * weight).sum() / weight.sum()
    start = float(np.log(mean / (1 - mean)))
    z, inner = np.full(n, start), 2**depth - 1
    out_f, out_c, out_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(n, np.int64)
        f, c, v = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32), np.zeros(inner + 1)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            local = at - first
            top = np.full(wide, 1e-6)
            for j in range(m):
                if not len(cuts[j]):
                    continue
                k = local * (bins + 1) + binned[:, j]
                gs = np.bincount(k, g, wide * (bins + 1)).reshape(wide, -1).cumsum(1)
                hs = np.bincount(k, h, wide * (bins + 1)).reshape(wide, -1).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = (gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge))[:, : len(cuts[j])]
                gain[(hs[:, : len(cuts[j])] < 1) | ((ht - hs)[:, : len(cuts[j])] < 1)] = -1
                b = gain.argmax(1)
                for node in np.flatnonzero(gain[np.arange(wide), b] > top):
                    top[node] = gain[node, b[node]]
                    f[first + node], c[first + node] = j, cuts[j][b[node]]
            at = 2 * at + 1 + (x[np.arange(n), f[at]] > c[at])
        gl, hl = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        v = rate * gl / (hl + ridge)
        z += v[at - inner]
        out_f.append(f)
        out_c.append(c)
        out_v.append(v)
    return Forest(start, np.array(out_f), np.array(out_c), np.array(out_v))


def keep(page: Page, odds: np.ndarray) -> list[bool]:
    """The choice of greatest likelihood in which nothing is kept below a dropped element."""
    n = len(page.tag)
    p = np.clip(odds, -12, 12)
    stay, go = -np.logaddexp(0, -p), -np.logaddexp(0, p)  # log-likelihood of keeping, of dropping
    for i, t in enumerate(page.tag):
        if t in NEVER:
            stay[i] = -1e9
    stay[0] = 0.0
    stay, go, parent = stay.tolist(), go.tolist(), page.parent
    best = [0.0] * n  # of the children's better choices, then of keeping the element
    gone = go[:]  # of dropping it with all below
    for i in range(n - 1, 0, -1):
        best[i] += stay[i]
        best[parent[i]] += max(best[i], gone[i])
        gone[parent[i]] += gone[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parent[i]] and best[i] > gone[i]
    return kept


def text_of(page: Page, kept: list[bool]) -> str:
    blocks, run = [], []
    for node, text in page.pieces:
        if text is None:
            if run:
                blocks.append("".join(run))
                run = []
        elif kept[node] and page.tag[node] not in NEVER:
            run.append(text)
        elif not kept[node] and page.tag[node] in BLOCK and run:
            blocks.append("".join(run))
            run = []
    blocks.append("".join(run))
    return "\n".join(b for x in blocks if (b := _BLANK.sub(" ", x).strip()))


# Template pages: content is wrapped in elements marked as such, everything else is to be dropped.
_SYLLABLES = "ba de ti lo ru me sa ko in er an on re st th ou qu ver che sch tion ent al is".split()


class _Maker:
    def __init__(self, rnd: random.Random):
        self.r = rnd

    def words(self, lo: int, hi: int) -> str:
        return " ".join("".join(self.r.choices(_SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3)))) for _ in range(self.r.randint(lo, hi)))

    def sentence(self, lo=4, hi=18) -> str:
        return self.words(lo, hi).capitalize() + self.r.choice(". . . , ? !".split())

    def para(self) -> str:
        t = " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8))))
        if self.r.random() < 0.2:
            w = t.split(" ")
            k = self.r.randrange(len(w))
            tag = self.r.choice(("b", "em", "strong", "i", 'a href="/x"', "span"))
            w[k] = f"<{tag}>{w[k]}</{tag.split()[0]}>"
            t = " ".join(w)
        return t

    def links(self, lo=2, hi=8) -> str:
        wrap = self.r.choice((("<ul>", "<li>", "</li>", "</ul>"), ("", "", " | ", ""), ("<div>", "<span>", "</span>", "</div>")))
        return wrap[0] + "".join(f'{wrap[1]}<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>{wrap[2]}' for _ in range(self.r.randint(lo, hi))) + wrap[3]

    def named(self, names: str) -> str:
        name = self.r.choice(names.split())
        kind = self.r.choice(("class", "class", "id"))
        extra = self.r.choice(("", "", " box", "-wrap", "-container", "_1"))
        return f'{kind}="{name}{extra}"'

    def junk(self) -> str:
        k, r = self.r.randrange(11), self.r
        if k == 0:
            t = r.choice(("nav", "nav", f"div {self.named('nav menu navbar navigation breadcrumbs')}", f"ul {self.named('menu nav pagination')}"))
            return f"<{t}>{self.links()}</{t.split()[0]}>"
        if k == 1:
            t = r.choice(("div", "aside", "section", "p"))
            return f"<{t} {self.named('ad ads advert advertisement sponsored promo banner')}>{self.para()}</{t}>"
        if k == 2:
            t = r.choice(("footer", f"div {self.named('footer foot copyright legal')}"))
            return f"<{t}>&copy; {self.words(1, 3)} &middot; {self.sentence()}{self.links(0, 4) if r.random() < .5 else ''}</{t.split()[0]}>"
        if k == 3:
            t = r.choice(("aside", f"aside {self.named('sidebar related')}", f"div {self.named('sidebar side related widget rail recommended trending')}"))
            return f"<{t}><h3>{self.words(1, 3)}</h3>{r.choice((self.links(), '<p>' + self.para() + '</p>'))}</{t.split()[0]}>"
        if k == 4:
            inner = "".join(f'<div class="comment"><b>{self.words(1, 1)}</b><p>{self.para()}</p></div>' for _ in range(r.randint(1, 4)))
            t = r.choice((f"section {self.named('comments comment-list discussion')}", f"div {self.named('comments replies respond disqus')}", f"ol {self.named('comments commentlist')}"))
            return f"<{t}><h3>{self.words(1, 2)}</h3>{inner}</{t.split()[0]}>"
        if k == 5:
            t = r.choice((f"div {self.named('cookie cookie-notice consent gdpr notice alert popup modal')}", 'div role="alert"', 'div role="dialog"'))
            return f"<{t}><p>{self.para()}</p><button>OK</button></{t.split()[0]}>"
        if k == 6:
            return f'<form {self.named("search newsletter signup login subscribe")}><label>{self.words(1, 3)}</label><input type="text"><p>{self.sentence()}</p><button>{self.words(1, 1)}</button></form>'
        if k == 7:
            t = r.choice(("header", f"div {self.named('header masthead topbar')}"))
            return f"<{t}><a href='/'>{self.words(1, 3)}</a>{'<p>' + self.sentence() + '</p>' if r.random() < .5 else ''}{self.links() if r.random() < .5 else ''}</{t.split()[0]}>"
        if k == 8:
            return f"<div {self.named('share social sharing tags newsletter')}>{self.links(2, 5)}</div>"
        if k == 9:
            return r.choice((f"<script>var t=\"</p>\";x('{self.words(1, 4)}')</script>", "<style>p{margin:0}</style>", f"<noscript>{self.sentence()}</noscript>", f"<!-- {self.words(1, 3)} -->"))
        return f"<div {self.named('related recommended teaser more popular')}>" + "".join(f"<div><a href='/{i}'>{self.words(3, 8)}</a><p>{self.sentence()}</p></div>" for i in range(r.randint(1, 4))) + "</div>"

    def body(self) -> str:
        r, out = self.r, []
        title = self.words(2, 10).capitalize()
        if r.random() < 0.8:
            out.append(r.choice((f"<h1 data-k>{title}</h1>", f"<h2 data-k>{title}</h2>", f"<header data-k><h1 data-k>{title}</h1></header>" if r.random() < 0.3 else f"<h1 data-k>{title}</h1>")))
        for _ in range(r.choice((1, 2, 3, 5, 8, 12))):
            k = r.random()
            if k < 0.62:
                out.append(f"<p data-k>{self.para()}" + r.choice(("</p>", "</p>", "")))
            elif k < 0.70:
                out.append(f"<h2 data-k>{self.words(1, 6)}</h2>")
            elif k < 0.78:
                out.append(f"<p data-k><b data-k>{self.sentence()}<br>" if r.random() < 0.6 else f"<p data-k>{self.sentence()}<br>{self.sentence()}</p>")
            elif k < 0.84:
                out.append("<ul data-k>" + "".join(f"<li data-k>{self.sentence()}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.88:
                out.append(f"<blockquote data-k><p data-k>{self.para()}</p></blockquote>")
            elif k < 0.91:
                out.append(f"<pre data-k>{self.words(3, 20)}</pre>")
            elif k < 0.94:
                out.append("<table data-k><tr data-k>" + "".join(f"<td data-k>{self.words(1, 4)}</td>" for _ in range(r.randint(1, 4))) + "</tr></table>")
            else:
                out.append(self.junk())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        t = r.choice(("article",) * 4 + ("main", "div class=\"content\"", "div id=\"main-content\"", "div class=\"post-body\"", "div class=\"entry\"", "section class=\"story\"", "div", "td", "div class=\"article-text\""))
        article = f"<{t} data-k>{self.body()}</{t.split()[0]}>"
        if r.random() < 0.4:
            w = r.choice(("main", "div", "div class=\"wrapper\"", "div id=\"page\"", "div class=\"row\"", "section"))
            inside = [self.junk() for _ in range(r.randint(0, 2))]
            inside.insert(r.randint(0, len(inside)), article)
            article = f"<{w} data-k>{''.join(inside)}</{w.split()[0]}>"
        before, after = [self.junk() for _ in range(r.randint(0, 4))], [self.junk() for _ in range(r.randint(0, 4))]
        source = f"<!DOCTYPE html><html data-k><head><title>{self.words(1, 5)}</title></head><body data-k>{''.join(before)}{article}{''.join(after)}</body></html>"
        return source[: r.randint(len(source) // 3, len(source))] if r.random() < 0.1 else source


class _Marked(Page):
    """A template page whose elements know whether they are content."""

    def __init__(self, source: str):
        marks = [bool(re.search(r"\bdata-k\b", m[0])) for m in re.finditer(r"<[a-zA-Z](?:\"[^\"]*\"|'[^']*'|[^>\"'])*>", re.sub(r"(?s)(<script>).*?(</script>)", r"\1\2", source))]
        super().__init__(source)
        self.content = [True, *marks][: len(self.tag)]
        self.content += [False] * (len(self.tag) - len(self.content))
        for i in range(1, len(self.tag)):
            p = self.parent[i]
            if self.tag[i] in ("b", "em", "strong", "i", "a", "span", "br", "label", "tbody") and self.content[p] and self.tag[p] not in ("div", "section", "body", "main", "article", "td"):
                self.content[i] = True
            self.content[i] = self.content[i] and self.content[p]


@lru_cache(1)
def forest(seed: int = 11, pages: int = 800) -> Forest:
    """Fitted on template pages, the same each time."""
    maker = _Maker(random.Random(seed))
    made = [_Marked(maker.page()) for _ in range(pages)]
    x = features(made)
    y = np.array([c for p in made for c in p.content], float)
    weight = 1 + np.minimum(x[:, 5], 6)  # elements with text below them matter more
    return boost(x, y, weight)


def extract(source: str, trees: Forest) -> str:
    page = Page(source)
    return text_of(page, keep(page, trees.log_odds(features([page])))) if len(page.tag) > 1 else text_of(page, [True])


def extracted(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages with the html column replaced by the main text."""
    keep_cols = [c for c in pages.columns if c not in (html_col, out_col)]
    schema = pages.select(*(f"`{c}`" for c in keep_cols)).schema.add(out_col, T.StringType())
    trees = forest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (x for y in slices(batch, 0, 4 << 20) for x in (y.slice(at, 64) for at in range(0, y.num_rows, 64))):
                made = [Page(s) for s in part.column(0).to_pylist()]
                sizes = [len(p.tag) for p in made]
                odds = np.split(trees.log_odds(features(made)), np.cumsum(sizes)[:-1])
                texts = [text_of(p, keep(p, o)) for p, o in zip(made, odds)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*keep_cols, out_col])

    return pages.select(F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias(html_col), *(f"`{c}`" for c in keep_cols)).mapInArrow(run, schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
