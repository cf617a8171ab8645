"""Main text of web pages by composite text density.

A page becomes a tree of its elements. What is never text (scripts, styles,
forms, media, hidden parts) and what a page declares as furniture (menus,
headers, footers, sidebars, notices, adverts, reader comments, by element, role
or name) is taken out. Every other node has a density: its characters for each
tag, weighted down by its links. The node whose children have the largest sum of
densities is the core of the page; the smallest density on its way from the body
is the threshold, and every node that reaches it adds the subtree with the
largest sum beneath it. Pages are read in one pass, and a task holds one batch.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_words = str.split

# Elements of the HTML standard by what they do to text.
_VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template plaintext".split())
_NO_TEXT = frozenset("svg math canvas audio video object applet map select datalist button form dialog menu nav aside footer".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr img picture".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_PLAIN = _HEADINGS | frozenset("p ul ol dl blockquote pre table figure".split())
#: start tags that end an open element, and the elements that shield it
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
#: levels that an end tag or a start tag looks up at most
_REACH = 512

#: names (of classes and ids, in parts) of what is no article
_FURNITURE = re.compile(
    r"(?:ad|ads|adbox|adslot|adunit|adsense|advert\w*|sponsor\w*|promo|promos|promotion|banner\w*|cookie\w*|consent\w*|gdpr|notice\w*|notification\w*|alert\w*|popup\w*|modal\w*|overlay|paywall\w*"
    r"|newsletter\w*|subscribe|subscription|signup|login|search\w*|share\w*|sharing|social\w*|sidebar\w*|sidenav|aside|widget\w*|related\w*|recommend\w*|trending|teasers?|outbrain|taboola"
    r"|nav\w*|\w+nav|menu\w*|\w+menu|breadcrumbs?|pagination|pager|footer\w*|\w+footer|colophon|copyright|masthead|topbar|disclaimer"
    r"|comments?|commentlist|commentform|disqus\w*|replies|respond)"
)
_HEADER = re.compile(r"header\w*|\w+header")
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form status toolbar".split())
#: headings that open the readers' part of a page
_REPLIES = re.compile(r"(?:\d+\s+)?(?:(?:reader|user|all)\s+)?(?:comments?|responses|replies|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d+\)?)?\s*:?", re.I)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>", re.S)
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CLOSERS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}


class _Node:
    __slots__ = ("tag", "parent", "parts", "kind", "chars", "links", "tags", "anchors", "density", "total", "best", "marked")

    def __init__(self, tag: str, parent: _Node | None, kind: str = "") -> None:
        self.tag, self.parent, self.kind = tag, parent, kind
        self.parts: list[str | _Node] = []
        self.marked = False


def _kind(tag: str, attributes: str) -> str:
    """What an element declares: "gone" (no text), "furniture", "header", "article" or nothing."""
    if tag in _NO_TEXT:
        return "form" if tag == "form" else "gone" if tag not in ("nav", "aside", "footer") else "furniture"
    kind = {"header": "header", "article": "article", "main": "article"}.get(tag, "")
    if not attributes or attributes.isspace():
        return kind
    names: list[str] = []
    for key, *values in _ATTR.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return "gone"
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "gone"
        if key == "role":
            if value.lower() in _ROLES:
                return "header" if value.lower() == "banner" else "furniture"
            if value.lower() in ("main", "article"):
                kind = "article"
        elif key == "itemprop" and value.lower() == "articlebody":
            kind = "article"
        elif key in ("class", "id"):
            names.extend(_words(value))
    if tag not in _HEADINGS and tag != "main":
        for name in names:
            parts = [x.lower() for x in _PART.findall(name)]
            if parts and parts[0] in ("has", "with", "no", "without"):  # such a name speaks of another element
                continue
            if any(map(_FURNITURE.fullmatch, parts)):
                return "furniture"
            if tag not in _INLINE and any(map(_HEADER.fullmatch, parts)):
                kind = kind or "header"
    return kind


def _tree(page: str) -> list[_Node]:
    """Nodes of a page in the order they open; the first is the body, whose tags are not looked for."""
    root = _Node("body", None)
    nodes, stack, opened = [root], [root], {}
    at, size = 0, len(page)

    def say(text: str) -> None:
        if text:
            stack[-1].parts.append(html.unescape(text) if "&" in text else text)

    def close(to: int) -> None:
        while len(stack) > to:
            opened[stack.pop().tag] -= 1

    def find(names: tuple[str, ...], shields) -> int:
        for k in range(len(stack) - 1, max(0, len(stack) - 1 - _REACH), -1):
            if stack[k].tag in names:
                return k
            if shields(stack[k].tag):
                return 0
        return 0

    while at < size:
        found = _OPEN.search(page, at)
        if not found:
            say(page[at:])
            break
        start = found.start()
        say(page[at:start])
        if page.startswith("<!--", start):
            short = re.compile(r"-?>").match(page, start + 4)
            end = -1 if short else page.find("-->", start + 4)
            at = short.end() if short else end + 3 if end >= 0 else size
            continue
        if page.startswith("<![CDATA[", start):
            end = page.find("]]>", start)
            at = end + 3 if end >= 0 else size
            continue
        tag = _TAG.match(page, start)
        if not tag:
            if page[start + 1] in "!?/":
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
            else:  # a tag that never ends
                at = size
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if name in ("html", "body", "head", "br") or not opened.get(name):
                continue
            k = find((name,), (lambda t: t not in _INLINE) if name in _INLINE else (lambda t: False))
            if k:
                close(k)
            continue
        if name in _RAW:
            end = _CLOSERS[name].search(page, at)
            at = end.start() if end else size
            stack[-1].parts.append(" ")
            continue
        if name in ("html", "body", "head"):
            continue
        if name in _VOID:
            if name not in ("wbr", "img"):
                stack[-1].parts.append(" ")
            continue
        if name not in _INLINE and opened.get("p"):
            k = find(("p",), lambda t: False)
            if k:
                close(k)
        if name in _ENDS and any(opened.get(t) for t in _ENDS[name][0]):
            ended, shields = _ENDS[name]
            k = find(ended, lambda t: t in shields)
            if k:
                close(k)
        node = _Node(name, stack[-1], _kind(name, tag[3]))
        stack[-1].parts.append(node)
        nodes.append(node)
        stack.append(node)
        opened[name] = opened.get(name, 0) + 1
    return nodes


def _texts(node: _Node) -> list[str]:
    """Texts beneath a node in page order."""
    out, work = [], [node]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            work.extend(reversed(x.parts))
    return out


def _sizes(nodes: list[_Node]) -> None:
    """Characters, characters of links, tags and links of every subtree; a child follows its parent in ``nodes``."""
    for n in nodes:
        n.chars = sum(len(" ".join(_words(p))) for p in n.parts if isinstance(p, str))
        n.links, n.tags, n.anchors = 0, 1, 0
    for n in reversed(nodes):
        if n.tag == "a":
            n.links, n.anchors = n.chars, n.anchors + 1
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.links += n.links
            n.parent.tags += n.tags
            n.parent.anchors += n.anchors


def _without_furniture(nodes: list[_Node]) -> list[_Node]:
    """The nodes that are left when what is no article is gone; their ``parts`` hold no others."""
    _sizes(nodes)
    whole = nodes[0].chars
    shielded: set[_Node] = {nodes[0]}

    def shield(node: _Node | None) -> None:
        while node is not None and node not in shielded:
            shielded.add(node)
            node = node.parent

    # what holds the page's article is no furniture, whatever its name
    inside: set[_Node] = set()
    declared = False
    for n in nodes[1:]:
        if n.parent in inside or n.kind in ("furniture", "gone"):
            inside.add(n)
        elif n.kind == "article":
            shield(n.parent)
            declared = True
            if n.tag == "article":
                break
        elif n.tag == "h1" and 2 * n.parent.chars > whole:
            shield(n.parent)
    articles: set[_Node] = set()
    for n in nodes:
        if n.kind == "article" or n.parent in articles:
            articles.add(n)
    gone: set[_Node] = set()
    for n in nodes[1:]:
        if n in gone or n.parent in gone:
            gone.add(n)
        elif n.tag in _HEADINGS and n.chars <= 40 and _REPLIES.fullmatch(" ".join(_words("".join(_texts(n))))):
            at = n.parent.parts.index(n)  # the readers' part goes on to the end of its parent
            gone.update(p for p in n.parent.parts[at:] if not isinstance(p, str))
            n.parent.parts = n.parent.parts[:at]
    for n in nodes[1:]:
        if n in gone or n.parent in gone or n.kind == "gone":
            gone.add(n)
        elif n in shielded or (not declared and 5 * n.chars > 4 * whole):  # a wrapper of the page
            continue
        elif n.kind in ("furniture", "form") or (n.kind == "header" and n not in articles):
            gone.add(n)
    for n in nodes:
        if n.kind == "header" and n in articles and n not in gone and n not in shielded:  # of an article's header its headings stay
            gone.update(_all_but_headings(n))
    if gone:
        for n in nodes:
            if n not in gone:
                n.parts = [p if isinstance(p, str) or p not in gone else " " for p in n.parts]
    return [n for n in nodes if n not in gone]


def _all_but_headings(header: _Node) -> set[_Node]:
    """The nodes of a header that hold no heading and are in none; texts beside headings go at once."""
    order, work = [], [header]
    while work:
        n = work.pop()
        order.append(n)
        if n.tag not in _HEADINGS:
            work.extend(p for p in n.parts if not isinstance(p, str))
    holds: set[_Node] = set()
    for n in reversed(order):
        if n.tag in _HEADINGS or any(p in holds for p in n.parts if not isinstance(p, str)):
            holds.add(n)
    for n in order:
        if n in holds and n.tag not in _HEADINGS:
            n.parts = [" " if isinstance(p, str) else p for p in n.parts]
    lost, work = set(), [n for n in order if n not in holds and n is not header]
    while work:
        n = work.pop()
        if n not in lost:
            lost.add(n)
            work.extend(p for p in n.parts if not isinstance(p, str))
    return lost


def _density(chars: int, tags: int, links: int, anchors: int, share: float) -> float:
    """Composite text density; ``share`` is the body's share of characters in links.

    The base of the logarithm is at least 2: without links it would be 1.
    """
    if not chars:
        return 0.0
    odds = chars / max(links, 1) * tags / max(anchors, 1)
    base = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
    return chars / tags * math.log(max(odds, 1.0)) / math.log(max(base, 2.0))


def _measure(nodes: list[_Node]) -> None:
    """Densities, the sums of the children's densities, and the node with the largest sum of each subtree."""
    _sizes(nodes)
    share = nodes[0].links / max(nodes[0].chars, 1)
    for n in nodes:
        n.density = _density(n.chars, n.tags, n.links, n.anchors, share)
        # a text beside elements counts as a child of one tag
        n.total = sum(_density(len(" ".join(_words(p))), 1, 0, 0, share) for p in n.parts if isinstance(p, str) and not p.isspace()) if n.tag != "a" else 0.0
        n.best = n
    for n in reversed(nodes):
        # all children have been added; of equal sums the outer one
        if n.parent is not None:
            n.parent.total += n.density
    for n in reversed(nodes):
        if n.best is not n and n.best.total <= n.total:
            n.best = n
        if n.parent is not None and (n.parent.best is n.parent or n.best.total > n.parent.best.total):
            n.parent.best = n.best


def _article(core: _Node, nodes: list[_Node]) -> _Node:
    """The declared article that holds the core, or the page's only one if the core holds that; else the core."""
    above, n = [], core
    while n is not None:
        above.append(n)
        n = n.parent
    named = [n for n in above if n.tag == "article"] or [n for n in above if n.kind == "article"]
    if named:
        return named[0]
    only = [n for n in nodes if n.tag == "article" and n.chars]
    return only[0] if len(only) == 1 else core


def _mark(nodes: list[_Node]) -> None:
    """Mark the subtrees that are the article."""
    _measure(nodes)
    core = nodes[0].best
    threshold, n = core.density, core
    while n is not None:
        threshold, n = min(threshold, n.density), n.parent
    home = _article(core, nodes)
    home.marked = True
    if home.tag == "article":
        return
    reached = {nodes[0]}
    for n in nodes[1:]:
        if n.parent in reached and n.density >= threshold:
            reached.add(n)
            best = n.best
            # what lies outside the core is part of the article if it weighs as much as text does there
            if best.total >= 0.2 * core.total or (best.parent is core.parent and best.tag in _PLAIN):
                best.marked = True
    _fill(nodes)


def _fill(nodes: list[_Node]) -> None:
    """Headings before marked children, and what stands between them, if it is not mostly links."""
    held: set[_Node] = set()
    for n in nodes:
        if n.marked:
            p = n
            while p is not None and p not in held:
                held.add(p)
                p = p.parent
    for n in nodes:
        if n.marked or n not in held:
            continue
        children = [p for p in n.parts if not isinstance(p, str)]
        places = [k for k, p in enumerate(children) if p in held]
        for k in range(places[0], places[-1]):
            if children[k] not in held and 2 * children[k].links < children[k].chars:
                children[k].marked = True
        k = places[0] - 1
        while k >= 0 and children[k].tag in _HEADINGS:
            children[k].marked = True
            k -= 1


def _blocks(root: _Node) -> str:
    """Texts of marked subtrees, a line for each block."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(_words("".join(run)))
        if text:
            out.append(text)
        run.clear()

    work: list[tuple[_Node | str | None, bool]] = [(root, False)]
    while work:
        x, inside = work.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if inside:
                run.append(x)
        else:
            inside = inside or x.marked
            block = x.tag not in _INLINE
            if block and x.anchors >= 3 and 5 * x.links >= 4 * x.chars:  # a menu
                end()
                continue
            if block:
                end()
                work.append((None, False))
            work.extend((p, inside) for p in reversed(x.parts))
    end()
    return "\n".join(out)


def main_text(page: str | None) -> str:
    """The article of one page; "" for a null or empty page and for one without text."""
    if not page:
        return ""
    nodes = _without_furniture(_tree(page))
    if not any(not isinstance(p, str) or not p.isspace() for p in nodes[0].parts):
        return ""
    _mark(nodes)
    return _blocks(nodes[0])


def _main_texts(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield batch.map(main_text, na_action=None).astype(object)


def extract_text(pages: DataFrame, page: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``pages`` with the main text of each row and its code points; columns of these names are replaced.

    Blocks are joined by a line feed, white space inside one is one space,
    character references are decoded. Null, empty and text-free pages give the
    empty string; unclosed, crossed and unknown tags, pages without body and
    pages of any length are read as they are. Repeated rows each keep theirs;
    an empty table gives no rows.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in (text, n_chars)]
    found = pages.select(*kept, F.pandas_udf(_main_texts, "string")(F.col(page)).alias(text))
    return found.withColumn(n_chars, F.length(text).cast("long"))

