"""Main text of web pages by composite text density.

A page is read tag by tag into a tree (end tags that HTML lets authors leave out are
supplied). Elements that are never part of an article, by element name or ARIA role, are cut
off. A class or id marks an element if it has nothing but words for such parts and words for
boxes ("cookie-notice", "post-comments"). A marked element is cut off however large it is,
unless it holds a main element that is not in another marked part: its mark then says
something about a wrapper. Only where the page's text outside marked parts is smaller than an
article element in one of them that is not for readers' remarks is that article the page's
own, and only where nothing at all is left do marks for other things than remarks count for
nothing. A form is cut off too, unless it holds an article, a main element or most of the
page's plain text, which is then judged by itself. With
other words beside them ("notice-of-appeal", "social-history") it is evidence only: a small
element goes if most of it is links besides. Headings are never marked, nor are paragraphs and
inline elements by their ids, and a class that says what is there or not ("has-sidebar",
"no-comments") marks nothing.

For every remaining node the composite density is its characters per tag, adjusted by the
share of linked characters and tags and by the page's own link share. A node's density sum is
the sum of its children's densities. The container with the greatest density sum is selected;
the least density on its path up to body is the threshold, and in every other subtree that
reaches the threshold the container with that subtree's greatest sum is taken as well. A
selected container inside an article or main element stands for that whole element.
Paragraph-like and inline elements are blocks of their container and are not selected alone,
so short paragraphs stay; such blocks directly in a container around a selected one, and
headings directly in body, belong to it too unless most of them is links.

Null and empty pages give an empty text; a page of any length is read whole, in time that
grows with its length: tags are scanned once, and what a tag's surroundings say is handed
down to it. Repeated rows give repeated results, an empty table gives no rows.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import in_batches, without

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
_SPACE = re.compile(r"\s+")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF = HEADINGS | frozenset("p li dt dd pre td th caption figcaption summary address legend tr".split())
CUT = frozenset(
    "head nav footer aside script style noscript template iframe button select option optgroup input textarea dialog menu object embed canvas svg title xmp noembed noframes "
    "audio video datalist".split()
)
CUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar status".split())
#: Words of a class or id for what is not the article.
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal newsletter "
    "subscribe subscription signup sidebar rail widget widgets nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead footer comment comments disqus "
    "respond replies social share sharing related recommended recommendations trending login toolbar copyright hidden".split()
)
#: Those of them for what readers write.
_REMARKS = frozenset("comment comments disqus respond replies".split())
#: Words for boxes and places, which say nothing about what is in them.
BOX_WORDS = frozenset(
    "list box container wrapper wrap block section area inner outer item items bar panel content main top bottom left right side page site global primary secondary fixed "
    "sticky row col column grid group holder body title text link links button buttons icon icons small large module component region zone slot overlay dialog message "
    "form field reader user thread post entry article header mobile desktop google facebook twitter".split()
)
#: Words beside which a word of CUT_WORDS says what a wrapper has, not what it is.
_STATES = frozenset("has have having no not with without".split())
#: Start tags that close an open paragraph.
_CLOSES_P = HEADINGS | frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form header hr main menu nav ol p pre section table ul".split()
)
#: Kinds of elements that a next one of their kind closes, and the elements that shut an outer one off.
_KINDS = {"li": "item", "dt": "term", "dd": "term", "tr": "row", "td": "cell", "th": "cell", "option": "choice"}
_SHUTS = {"ul": ("item",), "ol": ("item",), "menu": ("item",), "dl": ("term",), "table": ("row", "cell"), "tr": ("cell",), "select": ("choice",)}


class _Node:
    """An element. ``inside``: in an article or main element, ``top`` the outermost of them; ``link``: its text is
    a link's; ``owner``: the container its text is a block of; ``open``: open elements by kind that a start tag may close."""

    __slots__ = ("tag", "parent", "children", "inside", "top", "link", "owner", "open", "chars", "linked", "tags", "links", "density", "sum", "best", "cut", "mark", "form", "picked")

    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.cut, self.mark, self.form, self.picked = tag, parent, False, 0, False, False
        self.children: list[_Node] = []
        self.chars = self.linked = self.tags = self.links = 0
        self.density = self.sum = 0.0
        self.best: _Node | None = None
        whole = tag in ("article", "main")
        self.inside = whole or (parent is not None and parent.inside)
        self.top = parent.top if parent is not None and parent.top is not None else self if whole else None
        self.link = tag == "a" or (tag in INLINE and parent is not None and parent.link)
        self.owner = parent.owner if parent is not None and (tag in INLINE or tag in LEAF) else self
        above = parent.open if parent is not None else {}
        if tag == "p":
            self.open = above | {"p": self}
        elif tag in _KINDS:
            self.open = {k: v for k, v in above.items() if k != "p" and k not in _SHUTS.get(tag, ())} | {_KINDS[tag]: self}
        elif tag in INLINE:
            self.open = above
        elif tag in _SHUTS or "p" in above:
            self.open = {k: v for k, v in above.items() if k != "p" and k not in _SHUTS.get(tag, ())}
        else:
            self.open = above


def _words_mark(value: str, inside: bool) -> int:
    """3 if a class or id names nothing but readers' remarks, 2 another part that is no article, 1 if it has such a word among others."""
    found = 0
    for one in value.split():
        words = {w.lower() for w in _TOKENS.findall(one) if not w.isdigit()}
        if words & _STATES or not (words & CUT_WORDS or ("header" in words and not inside)):
            continue
        found = max(found, 1 if not words <= CUT_WORDS | BOX_WORDS else 3 if words & _REMARKS else 2)
    return found


def _judge(node: _Node, attributes: str) -> None:
    """Sets whether an element is cut off whatever it holds, and how far it is marked to be."""
    tag, outer = node.tag, node.parent
    inside = outer is not None and outer.inside
    if tag in CUT or (tag == "header" and not inside):
        node.cut = True
        return
    node.form = tag == "form"
    if not attributes or tag in ("html", "body", "article", "main"):
        return
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        role = value.strip().lower() if name == "role" else ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or role in CUT_ROLES or (name == "style" and _INVISIBLE.search(value)):
            node.cut = True
            return
        if role == "form":
            node.form = True
        if tag not in HEADINGS and (name == "class" or (name == "id" and tag not in LEAF and tag not in INLINE)):
            node.mark = max(node.mark, _words_mark(value, inside))


class _Scanner:
    """Tags and texts of a page in order, each character looked at a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.last_close = page.rfind(">")
        self.plain_until = -1  # quotes of tags up to here do not match up

    def raw_end(self, tag: str) -> None:
        """Goes on behind the end tag of an element of plain characters."""
        m = re.compile(rf"</{tag}", re.I).search(self.page, self.at)
        end = self.page.find(">", m.end()) if m else -1
        self.at = end + 1 if end >= 0 else len(self.page)

    def _tag_end(self, start: int) -> int:
        """Behind the > that closes a tag, or -1; one in quotes does not close it, if the quotes are closed."""
        if start > self.last_close:
            return -1
        if start >= self.plain_until:
            if m := _QUOTED.match(self.page, start):
                return m.end()
            self.plain_until = len(self.page)
        return self.page.find(">", start) + 1

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        """(kind, value, attributes), kind one of text, start, end."""
        page, size, said = self.page, len(self.page), 0
        no_cdata_end = False
        while True:
            at = page.find("<", self.at)
            if at < 0:
                break
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = end + 3 if end >= 0 else size
                kind = None
            elif page.startswith("<![CDATA[", at) and not no_cdata_end and (end := page.find("]]>", at)) >= 0:
                if said < at:
                    yield "text", page[said:at], ""
                yield "text", page[at + 9 : end], ""
                said = self.at = end + 3
                continue
            elif page.startswith(("<!", "<?"), at):
                no_cdata_end = no_cdata_end or page.startswith("<![CDATA[", at)
                end = page.find(">", at) + 1 if at < self.last_close else size
                kind = None
            elif m := _TAG.match(page, at):
                end = self._tag_end(m.end())
                if end < 0:  # a tag that the page's end cuts off
                    end, kind = size, None
                else:
                    kind = "end" if m[1] else "start"
            else:
                self.at = at + 1
                continue
            if said < at:
                yield "text", page[said:at], ""
            said = self.at = end
            if kind:
                yield kind, m[2].lower(), page[m.end() : end - 1]
                said = self.at
        if said < size:
            yield "text", page[said:], ""


def _parse(page: str) -> tuple[list[_Node], list[tuple[_Node, _Node, str]]]:
    """All nodes, parents first, and the blocks in page order: container, first node, text."""
    root = node = _Node("html", None)
    nodes, runs, buffer, depth = [root], [], [], Counter()

    def flush() -> None:
        if buffer:
            runs.append(buffer.copy())
            buffer.clear()

    def close_to(target: _Node) -> None:
        nonlocal node
        while node is not target.parent and node.parent is not None:
            if node.tag not in INLINE:
                flush()
            depth[node.tag] -= 1
            node = node.parent

    scanner = _Scanner(page)
    for kind, value, attributes in scanner:
        if kind == "text":
            buffer.append((node, value))
            size = len(_SPACE.sub(" ", _html.unescape(value)).strip())
            node.chars += size
            node.linked += size if node.link else 0
            continue
        tag = value
        if kind == "end":
            if depth[tag]:
                found = node
                while found.tag != tag:
                    found = found.parent
                close_to(found)
            elif tag == "br":
                buffer.append((node, " "))
            continue
        if tag == "html":
            continue
        if tag in _CLOSES_P and "p" in node.open:
            close_to(node.open["p"])
        if tag == "body" and depth["head"]:
            while node.tag != "head":
                close_to(node)
            close_to(node)
        outer = [node.open[k] for k in (("row", "cell") if tag == "tr" else (_KINDS.get(tag),)) if k in node.open]
        if outer:
            close_to(outer[0])
        if tag not in INLINE:
            flush()
        child = _Node(tag, node)
        _judge(child, attributes)
        child.cut = child.cut or node.cut
        node.children.append(child)
        nodes.append(child)
        if tag == "br":
            buffer.append((node, " "))
        if tag in RAW:
            scanner.raw_end(tag)
        elif tag not in VOID and not attributes.endswith("/"):
            depth[tag] += 1
            node = child
    flush()
    _settle(nodes)
    blocks = []
    for run in runs:
        run = [(n, text) for n, text in run if not n.cut]
        if text := _SPACE.sub(" ", _html.unescape("".join(text for _, text in run))).strip():
            blocks.append((run[0][0].owner, run[0][0], text))
    return nodes, blocks


def _settle(nodes: list[_Node]) -> None:
    """Cuts the marked elements and forms that are no wrappers of the article."""
    if any((n.mark or n.form) and not n.cut for n in nodes):
        chars, linked, plain = {}, {}, {}
        for n in reversed(nodes):
            chars[n], linked[n] = n.chars + sum(chars[c] for c in n.children if not c.cut), n.linked + sum(linked[c] for c in n.children if not c.cut)
            plain[n] = chars[n] - linked[n]
        marks: dict[_Node, int] = {}  # the marked elements around, by the gravest of their marks
        outside = 0  # plain text outside of marked parts
        for n in nodes:
            above = marks[n.parent] if n.parent is not None else 0
            marks[n] = max(above, n.mark if n.mark > 1 else 0)
            outside += 0 if marks[n] or n.cut else n.chars - n.linked
        spared: set[_Node] = set()

        def spare(n: _Node | None) -> None:
            while n is not None and n not in spared:
                spared.add(n)
                n = n.parent

        mains = [n for n in nodes if n.tag == "main" and not n.cut and plain[n] and marks[n] < 3]
        articles = [n for n in nodes if n.tag == "article" and not n.cut and plain[n] and marks[n] < 3]
        free = [n for n in articles if not marks[n]]
        for n in mains or free:
            spare(n)
        if not mains and not free and articles and plain[best := max(articles, key=plain.__getitem__)] > outside:
            spare(best)
        elif not mains and not outside:  # nothing but marked parts: their densities decide
            for n in nodes:
                if n.mark == 2 and not n.cut and marks[n] < 3:
                    spare(n)
        for n in nodes:
            if n not in spared:
                small = 2 * linked[n] >= chars[n] and 5 * chars[n] <= chars[nodes[0]]
                n.cut = n.cut or n.mark > 1 or (n.form and 2 * plain[n] <= plain[nodes[0]]) or (n.mark == 1 and small)
    for n in nodes[1:]:
        n.cut = n.cut or n.parent.cut


def _measure(nodes: list[_Node]) -> _Node:
    """Sums up the tree, sets densities and every node's best container; gives the body."""
    kept = [n for n in nodes if not n.cut]
    for n in reversed(kept):
        for c in n.children:
            if not c.cut:
                n.chars += c.chars
                n.linked += c.linked
                n.tags += c.tags + 1
                n.links += c.links + (c.tag == "a")
    body = next((n for n in kept if n.tag == "body"), nodes[0])
    ratio = body.linked / max(1, body.chars)
    for n in kept:
        if n.chars:
            plain, linked, tags, links = max(1, n.chars - n.linked), max(1, n.linked), max(1, n.tags), max(1, n.links)
            base = math.log(n.chars / plain * n.linked + ratio * n.chars + math.e)
            n.density = n.chars / tags * math.log(max(1.0, n.chars / linked * tags / links)) / base
            if n.density <= 0:
                n.density = 1e-9 * n.chars
    for n in reversed(kept):
        # the container with the greatest density sum in the subtree, the outermost and first of equals
        n.sum = sum(c.density for c in n.children if not c.cut)
        n.best = n if n.chars and n.owner is n else None
        for c in n.children:
            if not c.cut and c.best is not None and (n.best is None or c.best.sum > n.best.sum):
                n.best = c.best
    return body


def main_text(page: str | None) -> str:
    if not page:
        return ""
    nodes, blocks = _parse(page)
    body = _measure(nodes)
    target = body.best or nodes[0].best
    if target is None:
        return ""
    threshold, n = body.density, target
    while n is not None and n is not body:
        threshold, n = min(threshold, n.density), n.parent
    (target.top or target).picked = True
    stack = [body]
    while stack:
        n = stack.pop()
        if not (n.picked or n.cut):
            if n is not body and n.density >= threshold and n.best is not None:
                (n.best.top or n.best).picked = True
            if not n.picked:
                stack.extend(n.children)
    around: set[_Node] = set()  # containers of selected ones
    within: set[_Node] = set()
    for n in nodes:
        if n.picked or n.parent in within:
            within.add(n)
        if n.picked:
            up = n.parent
            while up is not None and up not in around:
                around.add(up)
                up = up.parent
    kept = []
    for owner, first, text in blocks:
        if owner not in within and owner in around:
            leaf = first
            while leaf.tag in INLINE and leaf.parent is not owner:
                leaf = leaf.parent
            belongs = leaf.tag in HEADINGS if owner is body or owner.parent is None else leaf.tag in LEAF
            if not belongs or 2 * leaf.linked >= leaf.chars:
                continue
        elif owner not in within:
            continue
        kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, *, keep: list[str] | None = None, html: str = "html") -> DataFrame:
    """Adds ``text`` to the columns of ``keep`` (default: all but html), in place of one of that name."""
    keep = without(keep if keep is not None else [c for c in pages.columns if c != html], ("text",))
    out = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = [main_text(p) for p in rb.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([rb.column(c) for c in keep] + [pa.array(found, pa.string())], names=[*keep, "text"])

    return in_batches(pages).select(*[pages[c] for c in keep], pages[html].alias("__html")).mapInArrow(run, out)
