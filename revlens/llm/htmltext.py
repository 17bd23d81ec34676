"""Main text of web pages by composite text density."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset(
    "script style head title meta link template noscript iframe object embed svg math canvas audio video picture "
    "select option datalist button textarea xmp noembed noframes plaintext".split()
)
ASIDE = frozenset("nav header footer aside form menu dialog fieldset search".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q rb rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES = {"li": "li", "p": "p", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
# Words in class, id and role by which pages mark what isn't their main text.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent notice notification alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "recommendations comment comments disqus respond reply replies widget toolbar pagination pager skip "
    "complementary contentinfo search adsbygoogle rightbar leftbar commentlist commentform".split()
)
# Those of them that mark what isn't main text beside any other word, too ("post-comments", but not "has-comments").
STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion breadcrumb breadcrumbs sidebar cookie cookies consent popup newsletter subscribe "
    "subscription share sharing social related recommended recommendations comment comments disqus respond replies widget pagination adsbygoogle commentlist commentform".split()
)
DENIED = frozenset("has have no not non with without hide hidden show free".split())
# Words that may stand beside those without changing what is marked ("site-footer", but not "has-sidebar").
BESIDE_WORDS = frozenset(
    "site page global main primary secondary top bottom left right side box block container wrapper wrap inner outer "
    "section area list links item bar row col column text".split()
)
SMALL = 0.1  # of the densest text: what stands outside a marked wrapper, if it is less
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "aside", "items", "up", "chars", "tags", "link_chars", "link_tags", "density", "total", "marked", "block")

    def __init__(self, tag: str, up: Node | None, aside: bool = False, marked: bool = False):
        self.tag, self.up, self.aside, self.marked = tag, up, aside, marked
        self.block = up.block if up and tag in INLINE else self  # the nearest that is no inline element, so that none is climbed twice
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _marks(token: str) -> bool:
    """Whether a class, id or role names something that isn't main text: as a whole, or by a word that says so in any company but a denial's."""
    words = set(re.split(r"[^a-z]+", token)) - {""}
    if not STRONG_WORDS.isdisjoint(words) and DENIED.isdisjoint(words):
        return True
    return not ASIDE_WORDS.isdisjoint(words) and words <= ASIDE_WORDS | BESIDE_WORDS


def _is_aside(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is never main text; whether it is only marked as something else (see :func:`settle`)."""
    if tag in ASIDE and tag != "form":
        return True, False
    marked = tag == "form"  # some pages are one form
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        marked |= name in ("class", "id", "role") and any(map(_marks, value.split()))
    return False, marked


def parse(page: str) -> Node:
    """A tree of the page's elements and (raw) text; forgiving, without recursion, linear in the page's length."""
    root = at = Node("#root", None)
    end, n = 0, len(page)
    opened: Counter[str] = Counter()

    def close(node: Node) -> Node:
        """Closes all elements that are open from the present one up to ``node``."""
        inner = at
        while True:
            opened[inner.tag] -= 1
            if inner is node:
                return node.up
            inner = inner.up

    while end < n:
        found = TOKEN.search(page, end)
        text = page[end : found.start() if found else n]
        if text:
            at.items.append(text)
        if not found:
            break
        end = found.end()
        if not (tag := found[2]):
            continue
        tag = tag.lower()
        if found[1]:
            if opened[tag]:
                node = at
                while node.tag != tag:
                    node = node.up
                at = close(node)
            continue
        if tag in CLOSES or (tag not in INLINE and tag not in VOID and at.tag == "p"):
            node = at.block
            if node.tag in CLOSES.get(tag, "p").split():
                at = close(node)
        node = Node(tag, at, *(() if tag in ("html", "body", "article", "main") else _is_aside(tag, found[3])))
        at.items.append(node)
        if tag in RAW:
            last = re.compile(f"</{re.escape(tag)}", re.IGNORECASE).search(page, end)
            stop = last.start() if last else n
            node.items.append(page[end:stop])
            end = stop
            if last:
                over = page.find(">", last.end())
                end = n if over < 0 else over + 1
        elif tag not in VOID and not found[3].endswith("/"):
            at = node
            opened[tag] += 1
    return root


def _walk(root: Node) -> list[Node]:
    """Elements in page order, without those that are never main text."""
    out, rest = [], [root]
    while rest:
        node = rest.pop()
        out.append(node)
        rest.extend(x for x in reversed(node.items) if isinstance(x, Node) and x.tag not in UNSEEN and not x.aside)
    return out


def _measured(root: Node) -> tuple[list[Node], Node]:
    """Elements with their densities and sums, and the one of the greatest sum, the topmost of equals.

    Density of a node: visible characters per element below it, times the share of them outside links
    (the more elements are links, the more that share counts). A node's sum adds up its children's densities.
    """
    nodes = _walk(root)
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.total = 0.0
    for node in reversed(nodes):
        node.chars += sum(len(SPACE.sub(" ", x).strip()) for x in node.items if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        outside = 1 - node.link_chars / node.chars if node.chars else 0.0
        node.density = node.chars / max(node.tags, 1) * outside ** (1 + node.link_tags / max(node.tags, 1))
        if node.up:
            node.up.chars += node.chars
            node.up.tags += node.tags + 1
            node.up.link_chars += node.link_chars
            node.up.link_tags += node.link_tags
            node.up.total += node.density
    return nodes, max([x for x in nodes if x.chars] or [root], key=lambda x: x.total)


def settle(root: Node) -> None:
    """Makes marked elements aside, but not wrappers of the densest text.

    A marked element around the densest text stays, from the outermost in, unless more than half of it is links, as long as
    what stands outside the marks is small against that text, or while it holds the only article of the page.
    """
    nodes, top = _measured(root)
    if not (marked := [x for x in nodes if x.marked]):
        return
    around, node, most = [], top, top.total or top.chars
    heir = {x.up: x for x in nodes if x.up and 2 * x.chars > x.up.chars}
    while node in heir:  # down to what has most of the text
        node = heir[node]
    while node:
        if node.marked and 2 * node.link_chars <= node.chars:
            around.append(node)
        node = node.up
    for node in marked:
        node.aside = True
    for left in range(8, -1, -1):  # wrappers in wrappers: a few one by one, then the rest at once
        if not around:
            break
        seen, best = _measured(root)
        named = any(x.tag in ("article", "main") and x.chars for x in seen)
        if named or (best.total or best.chars) >= SMALL * most:
            break
        for _ in range(1 if left else len(around)):
            around.pop().aside = False


def best_nodes(root: Node) -> list[Node]:
    """Roots of the main text, in page order, found by composite text density (see :func:`_measured`).

    Going from the node of the greatest sum up to the body, the least density met on the way is the page's threshold.
    Every node that reaches it, and all those above it up to the body do too, gives the subtree of the greatest sum in it.
    """
    nodes, top = _measured(root)
    body = next((x for x in nodes if x.tag == "body"), root)
    threshold, node = top.density, top
    while node is not body and node.up:
        node = node.up
        threshold = min(threshold, node.density)
    start = node
    richest = {}  # of each subtree; the topmost, then the first of equals
    for node in reversed(nodes):
        own = richest[node] = max(richest.get(node, node), node, key=lambda x: (x.total, x is node)) if node.chars else node
        if node.up and node.chars:
            other = richest.get(node.up)
            if other is None or own.total >= other.total:
                richest[node.up] = own
    taken, open_ = {top}, {start}
    for node in nodes:
        if node is start or (node.up in open_ and node.chars and node.density >= threshold):
            open_.add(node)
            taken.add(richest[node])

    def named(node: Node) -> Node | None:
        while node and node.tag not in ("article", "main"):
            node = node.up
        return node

    if named(top):  # what the page itself calls its article holds its heading too
        taken = {x for node in taken if (x := named(node))}
    out, inside = [], set()
    for node in nodes:
        if node.up in inside:
            inside.add(node)
        elif node in taken:
            inside.add(node)
            out.append(node)
    return out


def _blocks(root: Node) -> Iterator[str]:
    """Text of each block, in page order, entities decoded, white space as one blank."""
    open_: list[str] = []
    rest: list[Node | str | None] = [root]
    while rest:
        item = rest.pop()
        if isinstance(item, str):
            open_.append(item)
            continue
        breaks = item is None or item.tag not in INLINE
        if breaks and open_:
            if block := SPACE.sub(" ", html.unescape("".join(open_))).strip():
                yield block
            open_ = []
        if item is None or item.tag in UNSEEN or (item.aside and item is not root):
            continue
        if breaks:
            rest.append(None)
        rest.extend(reversed(item.items))
    if block := SPACE.sub(" ", html.unescape("".join(open_))).strip():
        yield block


def extract(page: str | None) -> str:
    """Main text of one page; null, empty and textless pages give an empty text."""
    if not page:
        return ""
    root = parse(page)
    settle(root)
    return "\n".join(x for node in best_nodes(root) for x in _blocks(node))


def main_text(page: Column) -> Column:
    """Main text of whole pages (string, never null); see :func:`extract`."""

    @F.pandas_udf("string")
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([extract(x) for x in s], dtype="object")

    return extracted(page)


def with_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points), which replace columns of those names.

    Every row gives a row, repeated ones too; other columns stay as they are.
    """
    return pages.withColumn("text", main_text(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))
