"""HTML extraction by composite text density.

Every node of a page's tree gets a composite density: characters per tag, lowered by the share of its
characters that stand in links. The subtree whose children's densities sum highest is the main text,
looked for below the threshold that the densities on its path from the body set. Menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, markup and reader comments are left out by tag,
role or class before that. A class or id counts where it is such a part's own name (``cookie-notice``,
not ``with-sidebar`` or ``related-work``), and not on an element that holds the page's article or the
larger part of its text without links; the density decides there.

Of several articles all stay that are as dense as the thinnest node on the path from the body to the best
one. Without an article or main, what stands beside the path from the body to the main text is text too where
it is a heading or as dense as the path's thinnest node. Short blocks are less dense than any node that
holds many; beside the main text itself the bar is therefore its own thinnest block, and paragraphs,
quotes, lists, tables and (inside an element of the body) blocks without blocks in them stay unless most
of them is links. So do elements of the same tag and class beside it: a page's posts, whether they are articles or not.

The density follows the published composite one (characters by tag, times a logarithm of characters by linked character and tags
by linked tag, to a base that grows with the page's share of links) but for three things: one is added inside the logarithm
and what it is taken of is 1 at least, so that no density is negative; the base's logarithm is 1 at least, where the published one
is undefined on pages without links; and a node without links takes its base from the page's linked characters alone, which
would otherwise not count for it. Readers' comments are never the text of a page where anything else has any.

Character references are decoded, white space ``[\\x20\\x09-\\x0D]`` inside a block becomes one space,
blocks are trimmed and joined in page order by one space.

Defined results: null, empty or blank html, or html without a text, gives an empty text; html without
tags is one block; tags left open are closed where their parent ends; rows that repeat are all
extracted; an empty table gives an empty table; other columns are ignored. Trees are walked without
recursion, so neither depth nor length matters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from boxlake.llm.common import read_table

#: Fixed values of HTML: elements without content, with raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp template noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of the value, within the nearest of SCOPES.
CLOSES = {x: ("p",) for x in "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()} | {
    "li": ("li", "p"),
    "dt": ("dt", "dd", "p"),
    "dd": ("dt", "dd", "p"),
    "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"),
    "th": ("td", "th", "p"),
    "option": ("option",),
}
SCOPES = frozenset("html body table ul ol dl td th div article section main aside nav header footer form blockquote button template object".split())
#: Elements, roles and words of classes and ids that mark what isn't main text.
DROPPED = frozenset("nav footer aside script style noscript iframe button select option textarea input svg canvas object embed template head title menu dialog xmp noembed noframes audio video map".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share sharing social comment comments reply replies disqus respond related recommended widget toolbar pagination pager masthead topbar skip copyright disclaimer form search".split()
)
#: Words that may stand beside those in the name of such a part; any other word makes the name another thing's.
NAME_WORDS = frozenset("site page main top bottom left right primary secondary global bar box block container wrapper inner outer area list item items link links icon icons button buttons section panel media post posts user reader".split())
#: Readers' words, which are never the text of a page that has an article beside them.
READER_WORDS = frozenset("comment comments reply replies disqus respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Blocks that hold text and no parts of a page.
TEXTS = frozenset("p pre blockquote ul ol dl table figure".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Node:
    __slots__ = ("tag", "kids", "parent", "dropped", "named", "kind", "place", "size", "chars", "links", "tags", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, named: frozenset[str] = frozenset(), kind: str = ""):
        self.tag, self.parent, self.dropped, self.named, self.kind, self.kids = tag, parent, dropped, named, kind, []
        self.place, self.size = 0, 1
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0


def _is_dropped(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in DROPPED or (tag == "header" and not inside_article):
        return True
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), unescape(value.strip("\"'")).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value.strip() in DROPPED_ROLES:
            return True
    return False


def _named(tag: str, attrs: str, inside_article: bool) -> frozenset[str]:
    """Words of the classes and the id that name the element itself as boilerplate. A heading's id is its text's."""
    if tag == "form":
        return frozenset(["form"])
    if not attrs or tag in ("html", "body", "main", "article"):
        return frozenset()
    found: set[str] = set()
    for name, value in _ATTR.findall(attrs):
        if (name := name.lower()) == "class" or (name == "id" and tag not in HEADINGS):
            for one in unescape(value.strip("\"'")).lower().split():
                words = set(_WORDS.findall(one))
                marks = {w for w in words if w in DROPPED_WORDS or (w == "header" and not inside_article)}
                if marks and words - marks <= NAME_WORDS:
                    found |= marks
    return frozenset(found)


def _class(attrs: str) -> str:
    """The element's classes as they are written, in lower case."""
    return next((" ".join(unescape(value.strip("\"'")).lower().split()) for name, value in _ATTR.findall(attrs) if name.lower() == "class"), "") if attrs else ""


def parse(html: str) -> Node:
    """The page's tree; kids are nodes and strings (text, references decoded)."""
    root = Node("html", None)
    open_nodes, articles, at = [root], 0, 0
    find = _TOKEN.search
    while m := find(html, at):
        node = open_nodes[-1]
        if m.start() > at:
            node.kids.append(unescape(html[at : m.start()]))
        at = m.end()
        if m["cdata"] is not None:
            node.kids.append(m["cdata"])
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in ("html", "body"):
                continue
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag == tag:
                    articles -= sum(x.tag in ("article", "main") for x in open_nodes[k:])
                    del open_nodes[k:]
                    break
                if open_nodes[k].tag in SCOPES and tag not in SCOPES:
                    break  # an end tag with no start in this part
            continue
        if tag == "body" and len(open_nodes) > 1:  # the head's elements end here
            del open_nodes[1:]
            articles = 0
        if closes := CLOSES.get(tag):
            for k in range(len(open_nodes) - 1, 0, -1):
                if open_nodes[k].tag in closes:
                    del open_nodes[k:]
                    break
                if open_nodes[k].tag in SCOPES:
                    break
        parent = open_nodes[-1]
        if tag == "html":
            continue
        new = Node(tag, parent, _is_dropped(tag, m["attrs"], articles > 0), _named(tag, m["attrs"], articles > 0), _class(m["attrs"]))
        parent.kids.append(new)
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif tag not in VOID and not m["attrs"].rstrip().endswith("/") or tag in BLOCKS and tag not in VOID:
            open_nodes.append(new)
            articles += tag in ("article", "main")
    if at < len(html):
        open_nodes[-1].kids.append(unescape(html[at:]))
    _drop_named(root)
    return root


def _drop_named(root: Node) -> None:
    """Drops the elements that are named as boilerplate, but for those that hold the page's text."""
    nodes = _ordered(root)
    if not any(n.named for n in nodes):
        return
    plain: dict[Node, int] = {}  # characters outside links
    articles: dict[Node, int] = {}  # of these in the largest article or main below the node or in itself
    for node in reversed(nodes):
        kids = [k for k in node.kids if not isinstance(k, str) and not k.dropped]
        plain[node] = 0 if node.tag == "a" else sum(len(_SPACE.sub("", k)) for k in node.kids if isinstance(k, str)) + sum(plain[k] for k in kids)
        articles[node] = max((articles[k] for k in kids), default=0)
        if node.tag in ("article", "main"):
            articles[node] = max(articles[node], plain[node])
    free = 0  # of these in the largest article or main outside all named elements
    above: dict[Node, tuple[bool, int]] = {}  # stands in a named element; characters of the article or main around it
    for node in nodes:
        named, around = above[node.parent] if node.parent else (False, 0)
        named = named or bool(node.named)
        if node.tag in ("article", "main"):
            around = max(around, plain[node])
            if not named:
                own = plain[node] - sum(plain[x] for x in _first_of(node, lambda n: bool(n.named)))
                free = max(free, own)
        above[node] = named, around
    readers = _first_of(root, lambda n: bool(n.named & READER_WORDS))
    others = plain[root] - sum(plain[n] for n in readers)
    for node in nodes:
        if node.named:
            around = above[node][1]
            if node.named & READER_WORDS and others:
                holds = False  # readers' words are never the text where anything else has any
            elif around:  # a part of the article
                holds = articles[node] > free or 2 * plain[node] > plain[root]
            elif articles[node]:
                holds = articles[node] > free
            else:
                holds = not free and 2 * plain[node] > plain[root]
            node.dropped = not holds


def _first_of(top: Node, wanted: Callable[[Node], bool]) -> list[Node]:
    """The uppermost elements below a node that are wanted."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        for k in node.kids:
            if not isinstance(k, str) and not k.dropped:
                (out if wanted(k) else todo).append(k)
    return out


def _ordered(root: Node) -> list[Node]:
    """Nodes that aren't dropped, parents before kids."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(k for k in reversed(node.kids) if not isinstance(k, str) and not k.dropped)
    return out


def _density(root: Node, chars: int, links: int, tags: int, link_tags: int) -> float:
    whole = max(root.chars, 1)
    plain = max(chars - links, 1)
    per_tag = chars / max(tags, 1)
    spread = chars / max(links, 1) * max(tags, 1) / max(link_tags, 1)
    scale = math.log(chars / plain * links + root.links / whole * chars + math.e) if links else math.log(root.links + math.e)
    return per_tag * math.log(max(spread, 1.0) + 1.0) / max(scale, 1.0)


def measure(root: Node) -> list[Node]:
    """Composite densities of all nodes and the sums of their children's; nodes get their places in page order and how many
    nodes their subtrees have, so that one below another is known by its place."""
    nodes = _ordered(root)
    for place, node in enumerate(nodes):
        node.place = place
    for node in reversed(nodes):
        node.size = 1 + sum(k.size for k in node.kids if not isinstance(k, str) and not k.dropped)
        for kid in node.kids:
            if isinstance(kid, str):
                n = len(_SPACE.sub("", kid))
                node.chars += n
            elif not kid.dropped:
                node.chars += kid.chars
                node.links += kid.links
                node.tags += kid.tags + 1
                node.link_tags += kid.link_tags + (kid.tag == "a")
        if node.tag == "a":
            node.links = node.chars
    for node in nodes:
        if node.chars:
            node.density = _density(root, node.chars, node.links, node.tags, node.link_tags)
    for node in nodes:
        node.total = sum(k.density for k in node.kids if not isinstance(k, str) and not k.dropped)
        own = sum(len(_SPACE.sub("", k)) for k in node.kids if isinstance(k, str))
        if own:  # text that stands in the node itself counts as a child without tags
            node.total += own
    return nodes


def main_node(root: Node) -> tuple[Node, float]:
    """The node with the highest sum, and the least density on its path from the body."""
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.total)
    marked = [n for n in nodes if n.tag in ("article", "main") and n.chars]
    inside = [n for n in marked if _below(n, best)]
    outer: list[Node] = []
    for n in inside:  # in page order
        if not outer or not _below(n, outer[-1]):
            outer.append(n)
    if inside and best.tag not in ("article", "main") and 2 * sum(n.chars for n in outer) >= best.chars and not any(_below(best, n) for n in marked):
        best = max(outer, key=lambda n: n.chars - n.links)
    for n in marked:  # part of an article: the article
        if n is not best and _below(best, n):
            best = n
            break
    threshold, node = math.inf, best
    while node is not None and node.tag != "body":
        threshold = min(threshold, node.density)
        node = node.parent
    return best, threshold


def _below(node: Node, top: Node) -> bool:
    return top.place <= node.place < top.place + top.size


def _with_path(root: Node, best: Node, threshold: float) -> list:
    """The best node and what belongs to it along its path from the body, in page order; None ends a block."""
    blocks = [k.density for k in best.kids if not isinstance(k, str) and not k.dropped and k.tag in BLOCKS and k.tag not in HEADINGS and 2 * k.links < k.chars]
    least = min([threshold, *blocks])
    before: list[list] = []
    after: list[list] = []
    node, near = best, True  # near: nothing but the best node's text has been passed
    while node.parent is not None and node.tag != "body":
        parts: list[list] = [[], []]
        side, run = 0, []

        def close() -> None:
            inner = [k for k in run if not isinstance(k, str)]  # noqa: B023
            own = sum(len(_SPACE.sub("", k)) for k in run if isinstance(k, str))  # noqa: B023
            chars, links = own + sum(k.chars for k in inner), sum(k.links for k in inner)
            tags, link_tags = sum(k.tags + 1 for k in inner), sum(k.link_tags + (k.tag == "a") for k in inner)
            if chars and 2 * links < chars and (near or _density(root, chars, links, tags, link_tags) >= least):  # noqa: B023
                parts[side].extend([None, *run, None])  # noqa: B023
            run.clear()  # noqa: B023

        for k in node.parent.kids:
            if isinstance(k, str) or (k is not node and not k.dropped and k.tag not in BLOCKS):
                run.append(k)
                continue
            close()
            if k is node:
                side = 1
            elif not k.dropped and k.chars:
                leaf = node.parent.tag not in ("html", "body") and not any(not isinstance(x, str) and x.tag in BLOCKS for x in k.kids)
                bar = least if near or k.tag in TEXTS else threshold
                post = k.kind != "" and near and _alike(k, node)
                if post or k.tag in HEADINGS or (near and _only_headings(k)) or k.density >= bar > 0 or (near and (k.tag in TEXTS or leaf) and 2 * k.links < k.chars):
                    parts[side].append(k)
        close()
        before.append(parts[0])
        after.append(parts[1])
        node = node.parent
        near = near and node.chars == best.chars
    return [x for part in reversed(before) for x in part] + [None, best, None] + [x for part in after for x in part]


def _alike(node: Node, other: Node) -> bool:
    """Both stand in one element, with the same tag and class, and most of the node isn't links: posts of one page."""
    return node.parent is other.parent and (node.tag, node.kind) == (other.tag, other.kind) and 2 * node.links < node.chars


def _only_headings(node: Node) -> bool:
    """All text of the node stands in headings."""
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if _SPACE.sub("", x):
                return False
        elif not x.dropped and x.tag not in HEADINGS:
            todo.extend(x.kids)
    return True


def _articles(root: Node, best: Node, threshold: float) -> list:
    """The best article, and the page's others that stand beside it with its class or are as dense as its path's thinnest node."""
    out: list = []
    todo: list[Node] = [root]
    while todo:
        node = todo.pop()
        if node is best or _alike(node, best) or (node.tag == best.tag and 2 * node.links < node.chars and node.density >= threshold and not _below(best, node)):
            out += [None, node, None]
        elif node.tag != best.tag:
            todo.extend(k for k in reversed(node.kids) if not isinstance(k, str) and not k.dropped)
    return out


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    root = parse(html)
    best, threshold = main_node(root)
    tops: list = _articles(root, best, threshold) if best.tag in ("article", "main") else _with_path(root, best, threshold)
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if block := _SPACE.sub(" ", "".join(held)).strip(" "):
            blocks.append(block)
        held.clear()

    todo: list = list(reversed(tops))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append("\n")
        elif not x.dropped:
            if x.tag in BLOCKS:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
    flush()
    return " ".join(blocks)


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row; a page is worked on alone, so nothing is shuffled."""
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(_run, f"page_id {kind}, url string, text string, n_chars bigint")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_html_text": op1_html_text}
ORACLE: dict[str, str] = {}
