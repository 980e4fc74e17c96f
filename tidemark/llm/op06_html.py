"""HTML extraction (operator 6): a tree-structured graphical model over the DOM.

Every element and every block of text of a page is a node that is content or not. A node's
own potential comes from its tag, its class, id and role words and, for text, its length,
links and punctuation; a potential on each edge ties a node to its parent. Sum-product
messages pass from the leaves to the root and back, which gives every node's exact
marginal, and the blocks whose marginal is above a half are the text. All potentials are
estimated by counting on the labelled pages below, on the driver; they are some kilobytes.

Null html is empty and gives an empty text, as does a page without content. Broken markup
is read as far as it goes, in linear time: unclosed elements end with their parents, a new
paragraph ends an open one, a ``<`` that starts no tag is text, an unclosed script or style
runs to the end. Formulas are text; buttons, choices and embedded objects are not. Text of any length is kept whole. Repeated
rows are extracted each on its own (a marginal of exactly a half is not content) and an
empty table gives an empty result. Only the id, url and html columns are read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+|[0-9]+")
#: Elements without an end tag; those whose text runs to their end tag, whatever stands in it; those whose
#: text isn't shown as text; those that don't start a new block.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_SILENT = frozenset("template svg select datalist option optgroup button object canvas audio video annotation".split())
_INLINE = _SILENT | frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot munder mover munderover mstyle mpadded".split()
)
#: What an opening tag ends, up to the nearest of the elements after it.
_ENDS = {
    "p": ({"p"}, {"div", "article", "section", "td", "li", "body", "blockquote", "main", "aside"}),
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
} | {t: ({"p"}, {"div", "article", "section", "td", "li", "body", "blockquote", "main", "aside"}) for t in "h1 h2 h3 h4 h5 h6 div ul ol dl table section article aside header footer nav form pre blockquote main figure hr address".split()}


@dataclass
class Page:
    """A page's nodes in document order: elements, and the blocks of text as leaves."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    attributes: list[dict[str, str]] = field(default_factory=list)
    text: list[str] = field(default_factory=list)  # of blocks
    linked: list[int] = field(default_factory=list)  # characters of a block in links

    def add(self, tag: str, parent: int, attributes: dict[str, str], text: str = "", linked: int = 0) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.attributes.append(attributes)
        self.text.append(text)
        self.linked.append(linked)
        return len(self.tag) - 1


class Scanner:
    """Finds tags from left to right; every look-ahead that finds nothing is done once, so any text takes linear time."""

    def __init__(self, source: str) -> None:
        self.source = source
        self.last = {c: source.rfind(c) for c in ">\"'"}
        self.quotes = True  # until a tag's quotes run past the end of the text: from there on, a tag ends at the next >

    def tag_end(self, at: int) -> int:
        """Where the tag whose name ends before ``at`` ends, or -1; a > in quotes ends no tag."""
        if at > self.last[">"]:
            return -1
        to = at
        while self.quotes:
            mark = _TAG_MARK.search(self.source, to)
            if mark and mark[0] == ">":
                return mark.end()
            if not mark or self.last[mark[0]] == mark.start():
                self.quotes = False
                break
            to = self.source.find(mark[0], mark.end()) + 1
        return self.source.find(">", at) + 1

    def marks(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, tag, closing, attributes) of tags; of comments and declarations the tag is empty."""
        source, at = self.source, self.source.find("<")
        while at >= 0:
            name = _NAME.match(source, at)
            end = -1
            if name:
                end = self.tag_end(name.end())
                if end > 0:
                    tag, closing = name[2].lower(), bool(name[1])
                    yield at, end, tag, closing, source[name.end() : end]
                    if tag in _RAW and not closing and source[end - 2] != "/":
                        close = _RAW_END[tag].search(source, end)
                        yield end, close.start() if close else len(source), "", False, ""
                        end = close.start() if close else len(source)
            elif source.startswith("<!--", at):
                close = source.find("-->", at + 4)
                end = close + 3 if close >= 0 else len(source)
                yield at, end, "", False, ""
            elif source.startswith(("<!", "<?"), at) and at < self.last[">"]:
                end = source.find(">", at) + 1
                yield at, end, "", False, ""
            at = source.find("<", end if end > 0 else at + 1)


_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_TAG_MARK = re.compile("[>\"']")
_RAW_END = {tag: re.compile("</" + tag, re.IGNORECASE) for tag in _RAW}


class Open:
    """The open elements: each one's node, the innermost block, and where each tag stands."""

    def __init__(self, root: int) -> None:
        self.nodes, self.tags, self.block = [root], ["#root"], [0]
        self.places: dict[str, list[int]] = {}
        self.links = self.silent = 0

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.block.append(self.block[-1] if tag in _INLINE else len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)
        self.links += tag == "a"
        self.silent += tag in _SILENT

    def nearest(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, at: int) -> None:
        while len(self.nodes) > at:
            tag = self.tags.pop()
            self.nodes.pop()
            self.block.pop()
            self.places[tag].pop()
            self.links -= tag == "a"
            self.silent -= tag in _SILENT


def parse(source: str) -> Page:
    page = Page()
    open_ = Open(page.add("#root", -1, {}))
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                page.add("#text", open_.nodes[open_.block[-1]], {}, text, linked)
            parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not open_.silent:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if open_.links:
                linked += len(text)

    at = 0
    for start, end, tag, closing, attributes in Scanner(source).marks():
        say(source[at:start])
        at = end
        if not tag:
            continue
        if closing:
            where = open_.nearest((tag,))
            if where and (tag not in _INLINE or where > open_.block[-1]):  # a stray inline end doesn't end the blocks within
                if open_.block[-1] >= where:
                    flush()
                open_.close(where)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _INLINE:
            flush()
        if tag in _ENDS:
            ended, within = _ENDS[tag]
            if (own := open_.nearest(ended)) > open_.nearest(within):
                open_.close(own)
        if tag in _VOID or tag in _RAW:
            continue
        found = {}
        if attributes != ">":
            for a in _ATTRIBUTE.finditer(attributes.rstrip("/>")):
                found.setdefault(a[1].lower(), html.unescape(a[2] or a[3] or a[4] or ""))
        parent = open_.nodes[-1] if tag in _INLINE else open_.nodes[open_.block[-1]]
        node = page.add(tag, parent, found)
        if not (tag in _SILENT and attributes.endswith("/>")):
            open_.push(node, tag)
    say(source[at:])
    flush()
    return page


def features(page: Page, i: int) -> list[str]:
    if page.tag[i] == "#text":
        text = page.text[i]
        n = len(text)
        return [
            f"n{min(n.bit_length() // 2, 5)}", f"a{min(3, 4 * page.linked[i] // max(n, 1))}",
            f"e{text[-1] in '.!?…\"”»:;'}", "in=" + page.tag[page.parent[i]],
        ]
    a = page.attributes[i]
    out = ["t=" + page.tag[i]]
    out += {"w=" + w for key in ("class", "id", "role", "itemprop", "aria-label") if key in a for w in _WORDS.findall(a[key].lower())}
    if a.get("hidden") is not None and "hidden" in a or "display:none" in a.get("style", "").replace(" ", ""):
        out.append("hidden")
    return out


# ---- the labelled pages: content is what stands in an element marked data-main, and not in one marked data-not

#: Words of classes and ids, by what they stand on.
_OTHER_WORDS = {
    "nav": ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "pagination", "pager", "skip"),
    "header": ("header", "masthead", "banner", "logo", "branding", "site"),
    "footer": ("footer", "copyright", "legal", "colophon", "bottom"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "trending", "popular", "rail", "side", "more", "teaser"),
    "div": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "cookie", "cookies", "consent", "gdpr", "notice",
            "alert", "popup", "modal", "overlay", "subscribe", "newsletter", "signup", "login", "paywall", "share", "sharing", "social", "tags", "toolbar"),
    "form": ("form", "search", "login", "subscribe", "newsletter", "contact", "signup"),
    "section": ("comments", "comment", "discussion", "reply", "replies", "respond", "disqus", "feedback", "reviews", "thread"),
}
_MAIN_WORDS = ("article", "content", "main", "post", "entry", "story", "body", "text", "page", "prose", "markdown")
_PROSE = (
    "The river had risen over night and by morning the lower road was closed to all but carts and people on foot.",
    "Nobody in the village could say when the old bridge was built, but the stones were cut by hand.",
    "A short answer.",
    "In the second year the harvest failed, and those who could leave went south before the first snow fell on the pass.",
    "It rained.",
)


def _labelled_pages() -> Iterator[str]:
    """Pages built from the word tables by rule: every word stands on a few pages."""
    others = [(tag, w) for tag, all_words in _OTHER_WORDS.items() for w in all_words]
    for k in range(4 * len(others)):
        tag, word = others[k % len(others)]
        turn = k // len(others)
        prose = [_PROSE[(k + j) % len(_PROSE)] for j in range(2 + k % 4)]
        good, bad = _PROSE[k % len(_PROSE)], _PROSE[(k + 1) % len(_PROSE)]
        level = f"h{2 + k % 4}"
        title = f"<h1>{prose[0][:40]}</h1>" if k % 4 else f"<{level}>{prose[0][:40]}</{level}>"

        inner = "".join(f"<p>{p}</p>" for p in prose)
        inner = {
            0: inner,
            1: f"<{level}>{_PROSE[2]}</{level}>{inner}<ul><li>{_PROSE[4]}</li><li>{good}</li></ul>",
            2: f"{inner}<blockquote><p>{good}</p></blockquote><pre>x = 1</pre><figure><figcaption>{_PROSE[4]}</figcaption></figure>",
            3: f"<div>{inner}</div><table><tr><td>{_PROSE[4]}</td><td>12</td></tr></table>",
            4: f"{prose[0]}<div>{prose[1]}</div>{prose[0]}<ol><li>{good}</li></ol>",
            5: f"<p>{good} <a href=#>link</a></p><ul><li><a href=#>source</a></li><li>{good}</li></ul><dl><dt>Item</dt><dd>{good}</dd></dl>{inner}",
        }[k % 6]
        other = {
            0: f"<p>{bad}</p>",
            1: bad,
            2: f"<{level}>{word}</{level}><ul><li><a href=#>{bad}</a></li><li><a href=#>Next</a></li></ul>",
            3: f"<{level}>{word}</{level}><p>{bad}</p><div>{bad}</div>",
            4: f"<div><{level}>{bad[:30]}</{level}><p>{bad}</p><p>{good}</p></div>",
            5: f"<h1>{word}</h1><p>{bad}</p><ol><li>{bad}</li></ol><blockquote>{good}</blockquote><table><tr><td>{bad}</td></tr></table>",
        }[(k + turn) % 6]
        holder = tag if turn % 2 else "div"
        attribute = "id" if k % 3 == 0 else "class"
        extra = f'<{holder} {attribute}="{word}" data-not>{other}</{holder}>'

        shown = ("article", "main", "div", "section")[(k + turn) % 4]
        main = _MAIN_WORDS[k % len(_MAIN_WORDS)]
        named = f' {"id" if k % 5 == 0 else "class"}="{main}"' if k % 3 or shown in ("div", "section") else ""
        inside = k % 6 == 0
        body = f"<{shown}{named} data-main>{title}{inner}{extra if inside else ''}</{shown}>"
        if k % 4 == 3:
            body = f'<div class="wrapper container">{body}</div>'
        if k % 12 == 11:  # no container at all
            body = f"<h1 data-main>{prose[0][:40]}</h1>" + "".join(f"<p data-main>{p}</p>" for p in prose)
        nav = '<nav data-not><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>' if k % 7 else ""
        head = f'<header data-not><h1>Site</h1><a href="/">Site</a><p>{_PROSE[4]}</p></header>' if k % 2 else ""
        note = f'<section class="comments" data-not><h2>Comments</h2><div class="comment"><p>{good}</p></div></section>' if k % 3 == 0 else ""
        side = f"<aside data-not><{level}>More</{level}><p>{bad}</p><div>{good}</div></aside>" if k % 5 else ""
        yield (
            f"<html><body>{head}{nav}{'' if inside else extra}{body}{note}{side}"
            f"<footer data-not><p>&copy; {_PROSE[2]}</p><div>{bad}</div><a href=#>Terms</a></footer></body></html>"
        )


@dataclass(frozen=True)
class Model:
    root: tuple[float, float]  # log-potentials of the root being other or content
    edge: dict[str, tuple[tuple[float, float], tuple[float, float]]]  # potentials [parent][child] for each kind of child
    own: dict[str, float]  # log-potential of content over other, by feature


_CONTAINERS = frozenset("html body div section article main aside header footer nav form figure center td span".split())


def _kind(tag: str, parent: str) -> str:
    """Edges of texts, of containers and of other elements (at the top or not) have potentials of their own."""
    if tag == "#text":
        return "text"
    return "container" if tag in _CONTAINERS else "top" if parent in ("#root", "html", "body") else "element"


@cache
def trained(smooth: float = 0.1) -> Model:
    """Potentials from counts on the labelled pages."""
    edge = {kind: [[1.0, smooth], [smooth, 1.0]] for kind in ("text", "container", "top", "element")}
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    n = [0, 0]
    for source in _labelled_pages():
        page = parse(source)
        label = [0] * len(page.tag)
        for i in range(1, len(page.tag)):
            a = page.attributes[i]
            label[i] = 1 if "data-main" in a else 0 if "data-not" in a else label[page.parent[i]]
            edge[_kind(page.tag[i], page.tag[page.parent[i]])][label[page.parent[i]]][label[i]] += 1
            n[label[i]] += 1
            seen[label[i]].update(features(page, i))
    rate = {kind: tuple(tuple(c / sum(row) for c in row) for row in rows) for kind, rows in edge.items()}
    own = {f: math.log((seen[1][f] + smooth) / (n[1] + 2 * smooth)) - math.log((seen[0][f] + smooth) / (n[0] + 2 * smooth)) for f in {*seen[0], *seen[1]}}
    return Model((0.0, -8.0), rate, own)


def marginals(page: Page, model: Model) -> list[float]:
    """P(content) of every node, by one pass of messages to the root and one back."""
    n = len(page.tag)
    get, parent = model.own.get, page.parent
    edges = [model.edge[_kind(t, page.tag[p])] for t, p in zip(page.tag, parent, strict=True)]
    # Two-state messages are kept as ratios content : other, so one number each.
    own = []
    for i in range(n):
        if page.tag[i] != "#text" and not page.attributes[i]:  # most elements: one number for a tag
            own.append(math.exp(get("t=" + page.tag[i], 0.0)))
        else:
            own.append(math.exp(max(-30.0, min(30.0, sum([get(f, 0.0) for f in features(page, i)])))))
    up = [1.0] * n  # product of the children's messages
    to_parent = [1.0] * n
    for i in range(n - 1, 0, -1):
        (e00, e01), (e10, e11) = edges[i]
        b = own[i] * up[i]
        to_parent[i] = m = (e10 + e11 * b) / (e00 + e01 * b)
        up[parent[i]] = max(1e-100, min(1e100, up[parent[i]] * m))
    down = [math.exp(model.root[1] - model.root[0])] * n
    out = [0.0] * n
    for i in range(n):
        if i:
            (e00, e01), (e10, e11) = edges[i]
            p = parent[i]
            b = down[p] * own[p] * (up[p] / to_parent[i])  # the parent without this child
            down[i] = (e01 + e11 * b) / (e00 + e10 * b)
        belief = down[i] * own[i] * up[i]
        out[i] = belief / (1 + belief) if belief < 1e200 else 1.0
    return out


def main_text(source: str | None, model: Model) -> str:
    if not source:
        return ""
    page = parse(source)
    p = marginals(page, model)
    return "\n".join(t for t, x, tag in zip(page.text, p, page.tag, strict=True) if tag == "#text" and x > 0.5)


SCHEMA = "page_id long, url string, text string, n_chars long"


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page; one pass, no shuffle."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h, model) for h in part.column(2).to_pylist()]
                found = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), found, pc.utf8_length(found).cast(pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    columns = [F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")]
    return map_arrow(pages.select(*columns), run, SCHEMA)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
