"""Main text of web pages by composite text density.

The page becomes a tree. For every node the characters per tag are adjusted by its links:

    density = C/T * log(C*T' / (L*T_L)) / log(C*L/N + L_b*C/C_b + e)

with C characters, T tags, L linked characters, N the others, T_L link tags (counts of 0 as 1), b the
body. The density sum of a node is the sum over its children; the node with the largest one holds
the article. The threshold is the least density on the path from it up to the body: the article starts at the
highest node of that path that reaches the threshold without adding children below it, and parts of it
are left out when they are link lists of lower density than the threshold. Parts that markup itself declares not to
be the article (navigation, header, footer, sidebar, form, script, style, notice, advert, comments) never
count, neither for densities nor as text.

A block ends at every block tag; white space inside becomes one space, blocks are joined by one line end.
``br`` is white space. Null and empty pages, and pages without text, give an empty string.
"""

from __future__ import annotations

import math
import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import workers_find_package

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead tr ul".split())
NEVER_TEXT = frozenset(
    "head title script style noscript template iframe object embed svg math canvas audio video map select option "
    "textarea button input datalist form nav aside footer menu dialog noframes".split())
CLOSES_P = BLOCKS - frozenset("html body option optgroup legend caption".split())
SAME_LEVEL = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
              "th": {"tr", "table"}, "option": {"select"}}

# Names in class, id and role that mark what is not the article.
_NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|"
    r"subscribe|signup|nav\w*|menu\w*|breadcrumbs?|pagination|pager|side-?bar|widget\w*|toolbar|footer|masthead|"
    r"site-?header|page-?header|top-?bar|comments?|replies|reply|disqus|discussion|related|recommend\w*|share|sharing|social|"
    r"navigation|contentinfo|complementary|search|alert|skip-?link|copyright|legal|disclaimer)(?:$|[\s_-])", re.I)

_TAG = re.compile(
    r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))
         |(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
         |(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>
         |[!?/][^>]*+(?:>|\Z))""", re.S | re.X)
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in
        ("script", "style", "title", "textarea", "iframe", "noframes", "noembed", "xmp")}


class _Node:
    __slots__ = ("tag", "parent", "parts", "off", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: _Node | None, off: bool):
        self.tag, self.parent, self.off = tag, parent, off
        self.parts: list[_Node | str] = []


class _Tree:
    """Tree of a page, with the end tags that authors leave out."""

    def __init__(self):
        self.root = self.here = _Node("html", None, False)
        self.body: _Node | None = None

    def feed(self, html: str) -> None:
        at = start = 0
        while (m := _TAG.search(html, at)) is not None:
            if m.start() > start:
                self.here.parts.append(unescape(html[start:m.start()]))
            at = start = m.end()
            closing, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            tag = name.lower()
            if closing:
                self._end(tag)
                continue
            attrs = [(k.lower(), unescape(a or b or c or "")) for k, a, b, c in _ATTR.findall(rest)] if rest.strip("/ ") else ()
            self._start(tag, attrs)
            if rest.endswith("/") and tag in ("svg", "math"):
                self._end(tag)
            elif tag in _RAW:
                close = _RAW[tag].search(html, at)
                at = start = close.start() if close else len(html)
        if start < len(html):
            self.here.parts.append(unescape(html[start:]))

    def _start(self, tag, attrs):
        if tag == "html":
            return
        if tag == "body":
            if self.body is None:
                while self.here.parent is not None:
                    self.here = self.here.parent
                self.body = self.here = self._add("body", False)
            return
        if tag in CLOSES_P:
            self._close("p", {"table", "button", "object"})
        if tag in SAME_LEVEL:
            for other in ({"dt", "dd"} if tag in ("dt", "dd") else {"td", "th"} if tag in ("td", "th") else {tag}):
                self._close(other, SAME_LEVEL[tag])
            if tag == "tr":
                self._close("td", {"table"})
                self._close("th", {"table"})
        named = attrs and " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        hidden = attrs and any(k == "hidden" or k == "aria-hidden" and v == "true" or
                     k == "style" and v and "display:none" in v.replace(" ", "") for k, v in attrs)
        off = bool(tag in NEVER_TEXT or hidden or tag not in ("body", "article", "main") and bool(named and _NOT_ARTICLE.search(named))
               or tag == "header" and not self._inside("article", "main"))
        node = self._add(tag, off)
        if tag not in VOID:
            self.here = node

    def _end(self, tag):
        if tag not in ("html", "body") and tag not in VOID:
            self._close(tag, set() if tag in ("nav", "aside", "footer", "article", "form") else {"nav", "aside", "footer", "form"})

    def _add(self, tag, off):
        node = _Node(tag, self.here, off or self.here.off)
        self.here.parts.append(node)
        return node

    def _inside(self, *tags):
        node = self.here
        while node is not None:
            if node.tag in tags:
                return True
            node = node.parent
        return False

    def _close(self, tag, within):
        """Close the nearest open ``tag``; an element in ``within`` hides what stands above it."""
        node = self.here
        while node.parent is not None and node.tag != "body":
            if node.tag == tag:
                self.here = node.parent
                return
            if node.tag in within:
                return
            node = node.parent


def _postorder(root: _Node) -> list[_Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, _Node) and not p.off)
    return order[::-1]


def _measure(body: _Node) -> None:
    nodes = _postorder(body)
    for node in nodes:
        link = node.tag == "a"
        node.chars = own = sum(len(" ".join(p.split())) for p in node.parts if isinstance(p, str))
        node.total = own if node.tag in BLOCKS else 0
        node.link_chars = node.chars if link else 0
        node.tags, node.link_tags = 0, 0
        for child in node.parts:
            if isinstance(child, _Node) and not child.off:
                node.chars += child.chars
                node.link_chars += child.chars if link else child.link_chars
                node.tags += 1 + child.tags
                node.link_tags += (child.tag == "a") + child.link_tags
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in nodes:
        if not node.chars:
            node.density = 0.0
        else:
            c, t = node.chars, max(1, node.tags)
            lc, lt = max(1, node.link_chars), max(1, node.link_tags)
            base = math.log(c * lc / max(1, c - node.link_chars) + share * c + math.e)
            node.density = max(0.0, c / t * math.log(max(1.0, c * t / (lc * lt)), base)) if c * t > lc * lt else 0.0
        node.total += sum(p.density for p in node.parts if isinstance(p, _Node) and not p.off)


def _article(body: _Node) -> tuple[_Node, float]:
    """Node of the largest density sum, raised while its parents hold no other text, and the path's least density."""
    best = body
    for node in reversed(_postorder(body)):
        if node.total > best.total or (node.total == best.total and node is not best and best is body):
            best = node
    threshold, node = best.density, best
    while node.parent is not None and node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    declared = best
    while declared is not body and declared.tag not in ("article", "main"):
        declared = declared.parent
    if declared is not body:
        return declared, threshold
    while best is not body and (best.parent.chars == best.chars or best.tag not in BLOCKS):
        best = best.parent
    return best, threshold


def _text(top: _Node, threshold: float) -> str:
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        block = " ".join("".join(line).split())
        if block:
            blocks.append(block)
        line.clear()

    stack: list = [(top, 0)]
    while stack:
        node, at = stack.pop()
        if at == 0 and node.tag in BLOCKS:
            end()
        while at < len(node.parts):
            part = node.parts[at]
            at += 1
            if isinstance(part, str):
                line.append(part)
            elif part.tag == "br":
                line.append(" ")
            elif not part.off and not _link_list(part, threshold):
                stack.append((node, at))
                stack.append((part, 0))
                break
        else:
            if node.tag in BLOCKS:
                end()
    end()
    return "\n".join(blocks)


def _link_list(node: _Node, threshold: float) -> bool:
    """Several links that make up most of a block which is thinner than the threshold."""
    return (node.tag in ("ul", "ol", "div", "section", "table", "p") and node.link_tags >= 3
            and node.link_chars > 0.6 * node.chars and node.density < threshold)


def main_text(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    body = tree.body or tree.root
    _measure(body)
    return _text(*_article(body))


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of every whole page; an existing column ``out`` is replaced."""
    workers_find_package(pages.sparkSession)
    return pages.withColumn(out, F.udf(main_text, "string", useArrow=True)(F.col(html)))
