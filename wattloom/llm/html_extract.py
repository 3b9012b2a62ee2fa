"""HTML extraction by composite text density.

For every node of the page's tree: characters per tag, weighed down by the share of linked characters and tags. A node's
sum is that of its children's densities. The subtree with the largest sum is the article (or the article, main part or
division that this one is a part of); the smallest density on its path to the body is the threshold from which other
subtrees count as content, too. Names that mark an element as something else (`MARKS`) drop nothing by themselves: its
characters count `MARK_WEIGHT` only, and inside the content it goes if its density then is below the threshold.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
#: Between the parts of a name: what is no letter, and before a capital inside a word.
_NAME_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe xmp".split())
#: Their ends, at any case; looked up in the page itself, as lower case can have other lengths (U+0130).
_RAW_ENDS = {tag: re.compile(f"</{tag}", re.IGNORECASE | re.ASCII) for tag in RAW}
#: Their text is never the article's.
DROPPED = (RAW - {"xmp"}) | set("head nav aside form button select option dialog menu".split())
#: Not the article's unless they stand inside one.
OUTER = {"header", "footer"}
BLOCKS = set(
    "address article blockquote body caption center dd details div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr html"
    " li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = set("article body center div html main section table tbody td tr ul ol dl blockquote".split())
#: These are parts of what stands around them.
PARTS = set("section table tbody td tr ul ol dl blockquote".split())
#: Opening one of the first ends an open one of the second.
CLOSES = {
    **{tag: {"p"} for tag in BLOCKS if tag not in ("html", "body")},
    "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"},
    "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"},
}
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Parts of class names, ids and roles of what is not the article.
MARKS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment commentlist comments complementary consent"
    " contentinfo cookie cookies copyright disqus footer header masthead menu modal nav navbar navigation newsletter notice notices popup"
    " promo promoted related replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE_MARKS = {"footer", "header"}
#: A name with one of these says what an element has, or has not, beside the article; the element is not that.
STATES = set("has have hide no non not show with without".split())
#: Marks tell nothing about these.
UNMARKED = {"html", "body", "main", "article"}
#: An element that holds one of these may be around the article.
HEADS = {"main", "h1"}
#: What a character counts in an element that its name marks.
MARK_WEIGHT = 0.02


class Node:
    __slots__ = (
        "tag", "parent", "children", "dropped", "marked", "article", "around", "weight", "own_chars", "plain_chars", "chars", "tags", "link_chars",
        "link_tags", "density", "total",
    )

    def __init__(self, tag: str, parent: Node | None, dropped: bool, marked: int, article: bool) -> None:
        self.tag, self.parent, self.dropped, self.marked, self.article = tag, parent, dropped, marked, article
        self.around = tag in HEADS
        self.children: list[Node | str] = []
        self.own_chars = self.plain_chars = self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0
        self.weight = 1.0


def _signs(attributes: str, article: bool) -> tuple[bool, int]:
    """Whether an element is hidden, and whether a class, id or role marks it: 1 by a part of a name, 2 by a whole one."""
    marked = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((x for x in values if x), "")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, marked
        if name in ("class", "id", "role"):
            for one in value.split():
                parts = {x.lower() for x in _NAME_PARTS.split(one) if x}
                found = MARKS & parts
                if found and not parts & STATES and (found - ARTICLE_MARKS or not article):
                    marked = max(marked, 2 if found == parts else 1)
    return False, marked


def _tree(page: str) -> Node:
    """The page's tree; unclosed and stray tags are mended as browsers mostly do."""
    root = node = Node("html", None, False, 0, False)
    at = 0
    while True:
        found = _TOKEN.search(page, at)
        text = page[at : found.start()] if found else page[at:]
        if text:
            node.children.append(html.unescape(text))
        if not found:
            return root
        at = found.end()
        closing, tag, attributes = found[1], found[2], found[3]
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            up = node
            while up is not None and up.tag != tag:
                # A stray end tag does not reach beyond the block it stands in.
                up = None if tag not in BLOCKS and up.tag in BLOCKS else up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if tag == "html":
            continue
        ended = CLOSES.get(tag)
        if ended:
            up, scope = node, SCOPES.get(tag, {"article", "body", "div", "main", "section", "table", "td", "th", "li", "blockquote"})
            while up is not None and up.tag not in scope:
                if up.tag in ended and up.parent is not None:
                    node = up.parent
                up = up.parent
        article = node.article or tag in ("article", "main")
        hidden, marked = _signs(attributes or "", article)
        dropped = node.dropped or tag in DROPPED or (tag in OUTER and not article) or hidden
        own = Node(tag, node, dropped, 0 if tag in UNMARKED else marked, article)
        node.children.append(own)
        if tag in VOID or (attributes or "").endswith("/"):
            continue
        if tag in RAW:
            # Nothing inside is markup.
            end = _RAW_ENDS[tag].search(page, at)
            if not dropped:
                own.children.append(page[at : end.start()] if end else page[at:])
            if not end:
                return root
            close = page.find(">", end.end())
            at = len(page) if close < 0 else close + 1
            continue
        node = own


def _walk(root: Node) -> list[Node]:
    """All nodes in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return out


def _weigh_marks(nodes: list[Node]) -> None:
    """Lower the weight of what is marked, but of no element that may be around the article, where a mark tells nothing.

    Such an element holds most of the page's characters outside links; if its whole name is a mark, it has to hold the main
    part or a first heading, too, as an advertisement can be longer than a short article.
    """
    for node in reversed(nodes):
        if node.dropped:
            continue
        for child in node.children:
            if isinstance(child, str):
                node.own_chars += len("".join(child.split()))
            else:
                node.plain_chars += child.plain_chars
                node.around |= child.around and not child.dropped
        node.plain_chars = 0 if node.tag == "a" else node.plain_chars + node.own_chars
    for node in nodes:
        if node.parent is not None:
            node.dropped |= node.parent.dropped
            node.weight = node.parent.weight
        if node.marked and 2 * node.plain_chars > nodes[0].plain_chars and (node.marked < 2 or node.around):
            node.marked = 0
        if node.marked:
            node.weight *= MARK_WEIGHT


def density(chars: float, tags: int, link_chars: float, link_tags: int, share: float) -> float:
    """Composite text density: characters per tag by a logarithm of how few of both are linked.

    `share` is the share of linked characters in the body. The base of the logarithm is one more than in its usual form,
    which has none where a page has no links.
    """
    if chars <= 0:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    unlinked = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * math.log(max(unlinked, 1.0)) / math.log1p(base)


def _weigh(nodes: list[Node], body: Node) -> None:
    """The density of every node, and the sum of its children's."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        node.chars = node.own_chars * node.weight
        for child in node.children:
            if isinstance(child, Node) and not child.dropped:
                node.chars += child.chars
                node.tags += child.tags + 1
                node.link_chars += child.link_chars
                node.link_tags += child.link_tags + (child.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        if not node.dropped:
            node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
            node.total = sum(x.density for x in node.children if isinstance(x, Node))


def _whole(best: Node) -> Node:
    """The article around a node, else the main part, else the first that is no mere part of another."""
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    for tag in ("article", "main"):
        found = next((x for x in path if x.tag == tag), None)
        if found is not None:
            return found
    return next((x for x in path if x.tag in CONTAINERS - PARTS), best)


def _chosen(nodes: list[Node], body: Node) -> tuple[set[int], set[int]]:
    """The roots of what counts as content, and the marked elements that do not."""
    candidates = [x for x in nodes if not x.dropped and x.tag in CONTAINERS and x.chars]
    if not candidates:
        return {id(body)}, set()
    best = _whole(max(candidates, key=lambda x: x.total))
    path = [best]
    while path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    threshold = min(x.density for x in path)
    above = {id(x) for x in path}
    roots = {id(x) for x in candidates if x is best or (id(x) not in above and x.density >= threshold)}
    return roots, {id(x) for x in nodes if x.marked and id(x) not in above and x.density < threshold}


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, one per line."""
    root = _tree(page or "")
    nodes = _walk(root)
    _weigh_marks(nodes)
    body = next((x for x in nodes if x.tag == "body" and not x.dropped), root)
    _weigh(nodes, body)
    roots, apart = _chosen(nodes, body)
    blocks: list[list[str]] = [[]]
    todo: list[tuple[Node | str | None, bool]] = [(root, False)]
    while todo:
        item, inside = todo.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            if inside:
                blocks[-1].append(item)
        elif not item.dropped and id(item) not in apart:
            inside = inside or id(item) in roots
            if item.tag in BLOCKS:
                blocks.append([])
                todo.append((None, inside))
            elif item.tag == "br":
                blocks[-1].append(" ")
            todo.extend((x, inside) for x in reversed(item.children))
    lines = (" ".join("".join(block).split()) for block in blocks)
    return "\n".join(x for x in lines if x)


def extracted(pages: DataFrame) -> DataFrame:
    """Per row of `pages` (page_id, url, html): page_id, url, text (empty if there is none), n_chars (code points).

    Null and empty pages have no text. Pages are read whole; repeated rows are taken one by one; an empty table gives no
    rows; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")
