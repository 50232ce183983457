"""Main text of HTML pages by composite text density.

Each page is parsed into a tree. Every node has its characters, tags, link characters and link tags; its density
is characters per tag, adjusted by how much of them are links. A node's density sum adds up the densities of its children. The
node with the largest sum is the core of the text; the threshold is the smallest density on the path from body to
it. Going up that path, the selection widens to an ancestor as long as what the ancestor adds is at least as dense as
the threshold (headings always are part of the text they stand above), and at once to an enclosing article (with articles
of like size beside it) or main element. The logarithm's base of the published density is raised by ``e - 1``, so that it stays
finite on pages without links. Parts that are marked as something else (menus, page headers and footers, sidebars, notices, adverts,
forms, reader comments, scripts, styles) are left out of the tree before any density is taken. A class or id only tells
what a part may be (``page-with-sidebar`` is no sidebar) and a form may wrap a whole page, so such a part stays if it holds the page's
article, main element or first heading, or most of the text, and nothing outside it could be the main text.

Character references are decoded; white space inside a block becomes one space; blocks are joined in page
order by one space.

Defined results: null, empty or textless pages give an empty text; pages cut off in the middle are read as far as they go;
plain text without tags is the text; repeated rows each have their result; further columns are ignored.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from claimweave.llm.common import workers

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
SKIPPED = frozenset("head nav header footer aside label legend script style noscript iframe template svg math button select option textarea input object embed canvas audio video dialog menu title noembed noframes xmp fieldset".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
#: Start tags that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("article main section div body html table td th ul ol dl aside blockquote figure form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
MARKED = re.compile(
    r"(?<![a-z])(ads?|advert\w*|adsense|adslot|adbox|sponsor\w*|promo\w*|banner|sidebar\w*|side-bar|nav|navbar|navigation|menu\w*|breadcrumbs?|footer|header|masthead|topbar"
    r"|comments?|comment-?list|disqus|replies|respond|cookie\w*|consent|gdpr|notice|notices|notification\w*|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share\w*|sharing|social\w*"
    r"|related|recommend\w*|trending|popular|widget\w*|toolbar|pagination|pager|skip-?link|copyright|legal|disclaimer|paywall|outbrain|taboola)(?![a-z])")
#: Names that tell what a container has or lacks, not what it is.
STATE = re.compile(r"(has|no|with|without|is|show|hide)[-_]")
#: Names of one reader's comment, which is no article of the page.
ONE_COMMENT = re.compile(r"(?<![a-z])comment(?![a-z])")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop|style)(?![\w-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "density", "total", "mark", "plain", "holds")

    def __init__(self, tag: str, parent: Node | None, mark: int = 0):
        self.tag, self.parent, self.mark = tag, parent, mark
        self.children: list[Node | str] = []


def _left_out(tag: str, attributes: str) -> bool:
    """Whether an element is one of the parts that are not main text, whatever they hold."""
    if tag in SKIPPED:
        return True
    if not attributes or tag in ("html", "body", "main") or tag == "article" and "comment" not in attributes.lower():
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "itemprop" and value == "comment":
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _mark(tag: str, attributes: str) -> int:
    """What a form, class or id says: 0 nothing, 1 a name with the word of a part in it, 2 that word alone, 3 one reader's comment as an article."""
    if tag == "form":
        return 2
    if not attributes or tag in ("html", "body", "main") or tag == "article" and "comment" not in attributes.lower():
        return 0
    names = [v for name, *values in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for v in "".join(values).lower().split() if MARKED.search(v) and not STATE.match(v)]
    if tag == "article" and any(ONE_COMMENT.search(v) for v in names):
        return 3
    return 0 if not names else 2 if any(MARKED.fullmatch(v) for v in names) else 1


def _stays(part: Node, all_text: int, outside: int, rival: int) -> bool:
    """Whether a marked part holds the main text. ``outside``: text in no marked part; ``rival``: the most of it in one article."""
    if part.mark == 3:
        return False
    if part.holds:
        return part.plain * (4 if part.mark == 1 else 2) >= all_text and rival * 3 < part.plain
    return part.plain * 2 > all_text and outside * (4 if part.mark == 1 else 20) < part.plain and rival * 10 < part.plain


#: The mark of a page part named ``header`` inside an article: its headings are the article's.
OWN_HEADER = 4


def _below(node: Node) -> list[Node]:
    """All nodes under one, in page order."""
    found, todo = [], [c for c in reversed(node.children) if isinstance(c, Node)]
    while todo:
        n = todo.pop()
        found.append(n)
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return found


def _in_article(node: Node | None) -> bool:
    while node is not None and node.tag not in ("article", "body"):
        node = node.parent
    return node is not None and node.tag == "article"


def without_marked(root: Node) -> Node:
    """``root`` after taking out the parts marked by their names that do not hold the main text; every node is seen once or twice."""
    nodes = [root]
    for n in nodes:
        nodes.extend(c for c in n.children if isinstance(c, Node))
    for n in nodes:
        if n.mark == OWN_HEADER:
            n.children, n.mark = [h for h in _below(n) if h.tag in HEADINGS and h.parent.tag not in HEADINGS], 0
    if not any(n.mark for n in nodes):
        return root
    for n in reversed(nodes):
        below = [c for c in n.children if isinstance(c, Node)]
        own = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        # what is very likely no main text does not count against what may be
        n.plain = 0 if n.tag == "a" else own + sum(c.plain for c in below if c.mark < 2 or c.mark == 2 and c.holds)
        n.holds = n.mark != 3 and (n.tag in ("article", "main") or n.tag == "h1" and n.plain > 0 or any(c.holds for c in below))
    outside, articles, start = 0, {}, [(root, None)]
    while start:  # marked parts in marked parts are judged after those around them
        found: list[tuple[Node, Node | None]] = []
        while start:
            n, article = start.pop()
            if n.tag == "a":
                continue
            if n.tag in ("article", "main"):
                article = n
            for c in n.children:
                if isinstance(c, str):
                    size = len("".join(c.split()))
                    outside += size
                    if article is not None:
                        articles[article] = articles.get(article, 0) + size
                else:
                    (found if c.mark else start).append((c, article))
        rival = max(articles.values(), default=0)
        for n, article in found:
            if _stays(n, root.plain, outside, rival):
                n.mark = 0
                start.append((n, article))
    for n in nodes:
        n.children = [c for c in n.children if isinstance(c, str) or not c.mark]
    return root


def parse(page: str) -> Node:
    """The tree of a page without the parts that are left out; children are nodes and texts."""
    root = Node("html", None)
    node, at, size = root, 0, len(page)
    out_of, depth = "", 0  # inside a part that is left out: its element name, and how many of that name are open
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at:m.start() if m else size]
        if text and not out_of:
            node.children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            if m[0].startswith("<![CDATA[") and not out_of:
                node.children.append(m[0][9:].removesuffix("]]>"))
            continue
        closing, attributes = m[1], m[3]
        if out_of:
            if tag == out_of and not (attributes.endswith("/") and tag in ("svg", "math")):
                depth += -1 if closing else 1
                if depth == 0:
                    out_of = ""
            elif closing and tag in ("body", "html") or closing and tag == "article" and out_of not in ("article", "div", "section"):
                out_of = ""
            continue
        if closing:
            n = node
            while n is not root and n.tag != tag:
                if n.tag in SCOPES and tag in INLINE or n.tag in ("article", "main", "body") and tag not in ("html", "body", "main", "article"):
                    n = root
                    break
                n = n.parent
            if n is not root:
                node = n.parent
            continue
        if tag in ENDS_P or tag in CLOSES:
            shut, n = ("p",) if tag in ENDS_P else CLOSES[tag], node
            while n is not root and n.tag not in shut and (n.tag not in SCOPES or n.tag in shut):
                n = n.parent
            if n is not root and n.tag in shut:
                node = n.parent
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s>/]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID:
            if tag == "br":
                node.children.append("\n")
            elif tag == "hr":
                node.children.append(Node("hr", node))
            continue
        own_header = tag == "header" and _in_article(node)
        if _left_out("div" if own_header else tag, attributes):
            if not attributes.endswith("/"):
                out_of, depth = tag, 1
            continue
        if tag in ("html", "body") and root.children and (tag == "html" or any(isinstance(c, Node) and c.tag == "body" for c in root.children)):
            continue
        if tag == "html":
            continue
        child = Node(tag, node, OWN_HEADER if own_header else _mark(tag, attributes))
        node.children.append(child)
        if not attributes.endswith("/"):
            node = child
    return root


def measure(root: Node) -> list[Node]:
    """Sets counts, densities and density sums; returns the nodes, parents first."""
    nodes = [root]
    for n in nodes:
        nodes.extend(c for c in n.children if isinstance(c, Node))
    for n in reversed(nodes):
        own = sum(len("".join(c.split())) for c in n.children if isinstance(c, str))
        below = [c for c in n.children if isinstance(c, Node)]
        n.chars = own + sum(c.chars for c in below)
        n.tags = len(below) + sum(c.tags for c in below)
        link = n.tag == "a"
        n.link_chars = n.chars if link else sum(c.link_chars for c in below)
        n.link_tags = sum(c.link_tags for c in below) + link
    body_chars, body_links = max(root.chars, 1), root.link_chars
    for n in reversed(nodes):
        tags, link_tags = max(n.tags, 1), max(n.link_tags, 1)
        plain = max(n.chars - n.link_chars, 1)
        base = math.log(max(n.chars * n.link_chars / plain + body_links * n.chars / body_chars + math.e, math.e))
        ratio = max(n.chars * tags / (max(n.link_chars, 1) * link_tags), 1.0)
        n.density = n.chars / tags * math.log(ratio) / math.log(base + math.e - 1) if n.chars else 0.0
        n.total = sum(c.density for c in n.children if isinstance(c, Node))
    return nodes


def _with_equals(article: Node, threshold: float) -> Node:
    """An article, or a holder of it and the articles beside it that are as much text as it is (at least half)."""
    if article.parent is None:
        return article
    beside = [c for c in article.parent.children if isinstance(c, Node) and c.tag == "article" and c.density >= threshold and c.link_chars * 2 < c.chars and c.chars * 2 >= article.chars]
    if len(beside) < 2 or article not in beside:
        return article
    holder = Node("section", article.parent)
    holder.children = list(beside)
    return holder


def select(root: Node) -> Node:
    """The subtree that holds the main text."""
    nodes = measure(root)
    core = max(nodes, key=lambda n: n.total)  # the first of equals, so the outermost
    if core.total == 0:
        return root
    path = [core]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    for n in path:
        if n.tag in ("article", "main"):
            return _with_equals(n, threshold) if n.tag == "article" else n
    articles = [c for c in core.children if isinstance(c, Node) and c.tag == "article" and c.link_chars * 2 < c.chars]
    if sum(c.chars for c in articles) * 2 > core.chars:
        return _with_equals(max(articles, key=lambda c: c.chars), 0.0)
    chosen = core
    for above in path[1:]:
        added = [c for c in above.children if isinstance(c, Node) and c is not chosen and c.chars]
        if all(c.tag in HEADINGS or c.density >= threshold and c.link_chars * 2 < c.chars for c in added):
            chosen = above
        else:
            break
    return chosen


def text_in(node: Node) -> str:
    """Blocks in page order, white space inside each as one space, joined by one space."""
    parts: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            parts.append(n)
            continue
        block = n.tag not in INLINE
        if block:
            stack.append("\n")
        stack.extend(reversed(n.children))
        if block:
            stack.append("\n")
    return " ".join("".join(parts).split())


def main_text(page: str | None) -> str:
    return text_in(select(without_marked(parse(page)))) if page else ""


@F.arrow_udf(StringType())
def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p) for p in pages.to_pylist()], type=pa.string())


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` per page."""
    rows = workers(pages).select("page_id", "url", _main_texts(F.col("html").cast("string")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
