"""Main-text extraction from web pages by scoring the element tree.

A tolerant tokenizer builds the tree (implied end tags, void elements, raw-text elements, unclosed tags). Elements that are
never article text (navigation, asides, forms, scripts, anything hidden, and boxes whose class, id or role says advert,
sidebar, notice, comments and the like) are cut off. Every remaining block of text passes points for its length and its
commas to the elements around it (all to the parent, half to the grandparent, a third to the next), discounted by the
share of its text that is link text. The container of most points wins, moved up to an enclosing ``article`` or ``main``, or
past elements that hold nothing else; siblings that score a fifth as much, read like prose or are headings stay with it,
whatever their tag (next to an ``article`` or ``main``: only others of the kind). All text of what was kept is returned: white space
inside a block becomes one space, blocks are joined in page order by two newlines, character references are decoded.

Cases: null, empty and text-free pages give an empty text; html without any tag is one block; an unclosed comment or
script swallows the rest, as browsers do; ties of points go to the earlier element; nesting is unlimited (no recursion) and
time is in proportion to the page, however it is nested;
repeated rows are extracted row by row and extra columns are never read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, text string, n_chars long"
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>]*)>?|!--|[!?/])")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"'>]|$)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul xmp".split()
)
#: Opening one of these closes an open one of the set, up to the given barriers.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
DROPPED = frozenset("head script style noscript template nav aside footer form button select option textarea input label fieldset dialog menu iframe object embed applet svg math canvas audio video map search title datalist noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status note".split())
BAD = frozenset(
    "ad ads adv advert advertisement adverts adbox adslot adsense sponsor sponsored sponsors promo promoted promotion banner banners sidebar aside rail comment comments commentlist disqus respond reply replies reader cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe subscription signup login paywall nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager footer foot masthead topbar toolbar share sharing social related recommended recommendations trending widget widgets skip legal copyright outbrain taboola".split()
)
GOOD = frozenset("article articlebody body content entry main post story text".split())
KEPT_TAGS = frozenset("html body article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of which a short sentence is text of the page.
TEXT_TAGS = frozenset("p blockquote pre ul ol dl table figure".split())


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "score", "link", "length")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        self.score, self.link, self.length = 0.0, 0, 0


def _unwanted(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is cut off; ``inside``: an article or main element is around it."""
    if tag in DROPPED or tag == "header" and not inside:
        return True
    if not attributes or attributes.isspace():
        return False
    words: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif name in ("class", "id"):
            words.update(w.lower() for w in _WORD.findall(value))
        elif name == "itemprop" and value.lower() == "comment":
            return True
    return tag not in KEPT_TAGS and bool(words & BAD) and not words & GOOD or tag == "article" and bool(words & {"comment", "comments", "related", "promo", "ad", "ads", "sponsored"})


class _Open:
    """The open elements, outermost first, and the places of each tag among them, so that no end tag climbs in vain."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = [root]
        self.places: dict[str, list[int]] = {}
        self.headings: list[int] = []
        self.boxes: list[int] = []  # block elements that are neither headings nor paragraphs
        self.gone = self.inside = 0  # how many open elements are dropped, and are article or main

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in HEADINGS:
            self.headings.append(at)
        elif node.tag in BLOCK and node.tag != "p":
            self.boxes.append(at)
        self.gone += node.dropped
        self.inside += node.tag in ("article", "main")

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these tags, -1 without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    def outermost(self, tags: Iterable[str], after: int) -> int:
        """Place of the outermost open element of these tags beyond a place, -1 without one."""
        found = [p[i] for t in tags if (p := self.places.get(t)) and (i := bisect_right(p, after)) < len(p)]
        return min(found, default=-1)

    def close(self, at: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.nodes) > at:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in HEADINGS:
                self.headings.pop()
            elif node.tag in BLOCK and node.tag != "p":
                self.boxes.pop()
            self.gone -= node.dropped
            self.inside -= node.tag in ("article", "main")


def parse(html: str) -> tuple[Node, list[Node]]:
    """The element tree, and its nodes, parents before children; texts are decoded, dropped elements keep no children."""
    root = Node("#root", None, False)
    made, open_ = [root], _Open(root)
    lower, at, size = "", 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        node = open_.nodes[-1]
        if m is None:
            if not open_.gone:
                node.children.append(unescape(html[at:]))
            break
        if m.start() > at and not open_.gone:
            node.children.append(unescape(html[at : m.start()]))
        end, tag = m.end(), m[2]
        if tag is None:
            if m[0] == "<!--":
                close = html.find("-->", end - 2 if html.startswith(">", end) or html.startswith("->", end) else end)
                at = size if close < 0 else close + 3
            else:
                close = html.find(">", end)
                at = size if close < 0 else close + 1
            continue
        tag, attributes = tag.lower(), m[3]
        for quote in "\"'":  # a > inside a quoted value does not end the tag
            if attributes.count(quote) % 2 and re.search(rf"=\s*{quote}[^{quote}]*$", attributes):
                close = html.find(quote, end)
                stop = html.find(">", close) if close >= 0 else -1
                if stop >= 0:
                    attributes, end = html[m.start(3) : stop], stop + 1
                break
        at = end
        if m[1]:
            held = open_.last(tag)
            if held > 0 and (tag != "p" or held > open_.last("td", "th", "table")):
                open_.close(held)
            continue
        if tag in BLOCK:
            held = open_.last("p")
            if held > max(open_.boxes[-1] if open_.boxes else -1, open_.headings[-1] if open_.headings and tag[0] != "h" else -1):
                open_.close(held)
        if tag in CLOSES:
            ends, barriers = CLOSES[tag]
            held = open_.outermost(ends, open_.last(*barriers))
            if held > 0:
                open_.close(held)
        node = open_.nodes[-1]
        if tag in VOID:
            if not open_.gone:
                node.children.append(Node(tag, node, tag == "input"))
                made.append(node.children[-1])
            continue
        if tag in RAW:
            lower = lower or html.lower()
            close = lower.find(f"</{tag}", at) if len(lower) == size else html.find(f"</{tag}", at)
            if close < 0:
                break
            stop = html.find(">", close)
            at = size if stop < 0 else stop + 1
            continue
        child = Node(tag, node, _unwanted(tag, attributes, open_.inside > 0))
        if not open_.gone:
            node.children.append(child)
            made.append(child)
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        open_.push(child)
    return root, made


def _walk(root: Node) -> Iterator[tuple[Node | str, bool]]:
    """Every node and text in page order; nodes once on entry (True) and once on leaving (False)."""
    stack: list[tuple[Node | str, bool]] = [(root, True)]
    while stack:
        x, entering = stack.pop()
        yield x, entering
        if entering and isinstance(x, Node):
            stack.append((x, False))
            if not x.dropped:
                stack.extend((c, True) for c in reversed(x.children))


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(block element, text, length of its link text) of each run of text between block boundaries, in page order."""
    out: list[tuple[Node, str, int]] = []
    parts: list[str] = []
    owner = [root]
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if text := " ".join("".join(parts).split()):
            out.append((owner[-1], text, min(linked, len(text))))
        parts.clear()
        linked = 0

    for x, entering in _walk(root):
        if isinstance(x, str):
            parts.append(x)
            if links:
                linked += len(" ".join(x.split()))
        elif x.tag == "br":
            if entering:
                parts.append(" ")
        elif x.tag in BLOCK or x is root:
            flush()
            if entering:
                owner.append(x)
            else:
                owner.pop()
        elif x.tag == "a" and not x.dropped:
            links += 1 if entering else -1
    return out


def _prose(text: str, link: int, short: bool) -> bool:
    """Whether a text reads like prose: it is long, or (if ``short`` ones may count) a sentence."""
    return link < 0.25 * len(text) and (len(text) > 80 or short and bool(re.search(r"[.!?…。]\W*$", text)))


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    root, nodes = parse(html)
    blocks = _blocks(root)
    if not blocks:
        return ""
    scored: dict[int, Node] = {}
    for owner, text, link in blocks:
        points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)) * (1 - link / len(text))
        if owner.tag in ("h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "th"):
            points *= 0.3
        # a block that stands right in a container counts for that container itself
        x = owner if owner.tag not in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "dd", "dt", "th") else owner.parent or owner
        for share in (1.0, 0.5, 1 / 3):
            if x is None:
                break
            x.score += points * share
            scored.setdefault(id(x), x)
            x = x.parent
        owner.link += link
        owner.length += len(text)
    for x in reversed(nodes):  # children before parents
        if x.parent is not None:
            x.parent.link += x.link
            x.parent.length += x.length
    best = max(scored.values(), key=lambda x: x.score * (1 - x.link / max(1, x.length)))
    x = best
    while x is not None:
        if x.tag in ("article", "main"):
            best = x
            if x.tag == "article":
                break
        x = x.parent
    while best.tag not in ("article", "main") and best.parent is not None and best.parent.tag not in ("body", "html", "#root") and best.parent.length == best.length:
        best = best.parent  # nothing else is in there; its siblings are those that count
    kept = [best]
    if best.parent is not None and best.tag not in ("body", "html", "main"):
        least = 0.2 * best.score
        together = []
        for x in best.parent.children:
            if x is best:
                together.append(x)
            elif isinstance(x, Node) and x.tag in BLOCK and not x.dropped and x.length:
                clean = x.link < 0.33 * x.length
                if best.tag in ("article", "main"):
                    belongs = x.tag == best.tag and x.score >= max(3.0, least)
                else:
                    belongs = x.tag in HEADINGS or x.score >= max(3.0, least) or _prose(_text(x), x.link, x.tag in TEXT_TAGS)
                if clean and belongs:
                    together.append(x)
        kept = together
    inside = {id(x) for x in kept}
    memo: dict[int, bool] = {}

    def within(node: Node) -> bool:
        path, x, answer = [], node, False
        while x is not None:
            if id(x) in memo:
                answer = memo[id(x)]
                break
            if id(x) in inside:
                answer = True
                break
            path.append(id(x))
            x = x.parent
        memo.update(dict.fromkeys(path, answer))
        return answer

    return "\n\n".join(text for owner, text, _ in blocks if within(owner))


def _text(node: Node) -> str:
    return " ".join("".join(x for x, _ in _walk(node) if isinstance(x, str)).split())


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, SCHEMA)
