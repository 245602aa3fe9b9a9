"""Main text of web pages by composite text density over the whole DOM."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr li dd dt".split())
#: A start tag ends an open element of these kinds, up to the boundary named after them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"})}
#: Never part of the main text.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select textarea input iframe object embed svg canvas video audio map menu dialog".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
#: A class or id that is one of these words, alone or with words of layout, is no content at any density.
CERTAIN = frozenset("ad ads advert adverts advertisement advertisements advertising comment comments cookie cookies disqus notice notices sidebar sponsor sponsored".split())
LAYOUT = frozenset("area bar block body box container content holder inner item list outer panel section slot thread unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar toolbar".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.S)
_SPLIT = re.compile(r"[^a-z0-9]+")
_WATCHED = ("class", "id", "role", "hidden", "style", "aria-hidden")

#: How much denser an article or main element beside the content counts.
NAMED_BONUS = 6
#: What the density of a subtree named like page furniture counts; inside the content it is kept as dense text with at
#: least this share of the threshold, this many characters outside links, and less than a third of its text in links.
DOUBT, DENSE_SHARE, DENSE_CHARS = 0.25, 0.5, 80


class Node:
    __slots__ = ("tag", "parent", "items", "attrs", "chars", "tags", "link_chars", "link_tags", "density", "total", "doubtful")

    def __init__(self, tag: str, parent: "Node | None", attrs: dict):
        self.tag, self.parent, self.attrs = tag, parent, attrs
        self.items: list = []  # child nodes and strings in page order
        self.doubtful = False  # named like page furniture


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    out: dict[str, str] = {}
    for k, v in _ATTR.findall(raw):
        k = k.lower()
        if k in _WATCHED:
            out.setdefault(k, html.unescape(v.strip("\"'")).lower())
    return out


def parse(page: str) -> Node:
    """A forgiving DOM: implied end tags of paragraphs, list items and cells; unclosed and stray tags do no harm. Work is
    in proportion to the page: open elements are counted by tag, so that only what is there is looked for."""
    root = Node("html", None, {})
    at, pos, end, has_body = root, 0, len(page), False
    open_ = Counter()

    def close(to: Node) -> Node:
        """End all open elements below ``to``."""
        up = at
        while up is not to:
            open_[up.tag] -= 1
            up = up.parent
        return to

    while pos < end:
        m = _TOKEN.search(page, pos)
        if not m:
            at.items.append(page[pos:])
            break
        if m.start() > pos:
            at.items.append(page[pos : m.start()])
        pos = m.end()
        if m[1] is not None:
            at.items.append(html.escape(m[1]))
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:  # an end tag
            up = at if open_[tag] > 0 else None
            while up is not None and up.tag != tag:
                if up.tag in ("table", "td", "th") and tag not in BLOCK:
                    up = None
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                at = close(up.parent)
            continue
        attrs = _attributes(m[4] if m[4] is not None else m[7] or "")
        if tag == "html" or (tag == "body" and has_body):
            continue
        if tag == "body":
            at, has_body = close(root), True
        elif tag in CLOSES_P and open_["p"] > 0:
            up = at
            while up is not None and up.tag not in ("p", "td", "th", "table", "button"):
                up = up.parent
            if up is not None and up.tag == "p":
                at = close(up.parent)
        if tag in ENDS and any(open_[x] > 0 for x in ENDS[tag][0]):
            kinds, stops = ENDS[tag]
            up, hit = at, None
            while up is not None and up.tag not in stops:
                if up.tag in kinds:
                    hit = up
                up = up.parent
            if hit is not None:
                at = close(hit.parent)
        node = Node(tag, at, attrs)
        at.items.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            node.items.append(page[pos : stop.start() if stop else end])
            pos = stop.end() if stop else end
        elif tag not in VOID and not (m[4] or "").endswith("/"):
            at = node
            open_[tag] += 1
    return root


def _certain(node: Node) -> bool:
    """Whether a whole class or id says comments, adverts, notices, cookies or sidebar; part of a longer name does not."""
    for name in (node.attrs.get("class", "") + " " + node.attrs.get("id", "")).split():
        words = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
        if any(w in CERTAIN for w in words) and all(w in CERTAIN or w in LAYOUT for w in words):
            return True
    return False


def _noise(node: Node, inside: bool) -> bool:
    """Whether a subtree is page furniture by its tag, role, state or unmistakable name. ``inside``: below an article or
    main element, where headings go with their section."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    if not (inside and tag in HEADINGS) and _certain(node):
        return True
    if tag == "article":
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
        return True
    return attrs.get("role") in NOISE_ROLES


def _doubtful(node: Node, inside: bool) -> bool:
    """Whether class or id name a subtree like page furniture; its density decides. Headings go with their section."""
    if not node.attrs or node.tag in ("html", "body", "article", "main") or (inside and node.tag in HEADINGS):
        return False
    words = set(_SPLIT.split(node.attrs.get("class", "") + " " + node.attrs.get("id", "")))
    return bool(words & NOISE_WORDS) or ("header" in words and not inside)


def _named(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role") == "main"


def prune(root: Node) -> None:
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside = inside or _named(node)
        node.items = [x for x in node.items if isinstance(x, str) or not _noise(x, inside)]
        for x in node.items:
            if isinstance(x, Node):
                x.doubtful = _doubtful(x, inside)
                todo.append((x, inside))


def measure(root: Node) -> list[Node]:
    """Composite text density and density sum of every node, in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in reversed(node.items) if isinstance(x, Node)]
    for node in reversed(order):
        own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
        kids = [x for x in node.items if isinstance(x, Node)]
        node.chars, node.tags = own + sum(x.chars for x in kids), len(kids) + sum(x.tags for x in kids)
        linked = node.tag in ("a", "button")
        node.link_chars = node.chars if linked else sum(x.link_chars for x in kids)
        node.link_tags = sum(x.link_tags + (x.tag in ("a", "button")) for x in kids)
    share = root.link_chars / max(1, root.chars)
    for node in order:
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c == 0:
            node.density = 0.0
            continue
        base = math.log(c / max(1, c - node.link_chars) * node.link_chars + share * c + math.e)
        node.density = max(0.0, c / t * (math.log(max(1.0, c / lc * t / lt)) / math.log(base) if base > 1.0000001 else math.log(max(1.0, c / lc * t / lt)) + 1.0))
    for node in order:
        node.total = sum(x.density * (DOUBT if x.doubtful else 1) for x in node.items if isinstance(x, Node))
    return order


def drop_doubtful(order: list[Node], path: set[int], floor: float) -> None:
    """Take out the subtrees named like page furniture that neither hold the content nor are dense text themselves."""
    gone, parents = set(), {}
    for node in order:
        if node.doubtful and id(node) not in path:
            dense = node.density >= DENSE_SHARE * floor and node.chars - node.link_chars >= DENSE_CHARS and 3 * node.link_chars < node.chars
            if not dense:
                gone.add(id(node))
                parents[id(node.parent)] = node.parent
    for parent in parents.values():
        parent.items = [x for x in parent.items if id(x) not in gone]


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below ``nodes``: references decoded, white space made one space, empty ones left out."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append(text)
        held.clear()

    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            held.append(html.unescape(x))
        elif x is None:
            flush()
        elif x.tag == "br":
            held.append("\n")
        elif x.tag in BLOCK:
            flush()
            todo.append(None)
            todo += reversed(x.items)
        else:
            todo += reversed(x.items)
    flush()
    return out


def extract(page: str | None) -> str:
    """Main text of one whole page.

    The subtree with the largest density sum is the content; the least density on its path to the body is the
    threshold that other subtrees beside that path must reach. Elements whose whole class or id says comments, adverts,
    notices, cookies or sidebar go at any density; other words of page furniture lower a subtree's weight, but dense text
    inside the content stays. An article or main element on the path is taken whole;
    one beside it, such as the next post of a thread, reaches the threshold with a sixth of the density.
    """
    if not page:
        return ""
    root = parse(page)
    body = next((x for x in root.items if isinstance(x, Node) and x.tag == "body"), root)
    prune(body)
    order = measure(body)
    if not body.chars:
        return ""
    best = max(order, key=lambda x: x.total)
    if best.total == 0:
        best = body
    path, up, floor = {id(best)}, best, best.density
    while up is not body:
        up = up.parent
        path.add(id(up))
        floor = min(floor, up.density)
    drop_doubtful(order, path, floor)
    chosen, todo = [], [body]
    while todo:  # in page order
        node = todo.pop()
        if node is best or (id(node) in path and _named(node)):
            chosen.append(node)
        elif id(node) in path:
            chosen += [x for x in node.items if isinstance(x, str) and node.total == 0]
            todo += [x for x in reversed(node.items) if isinstance(x, Node)]
        elif node.chars and node.density * (NAMED_BONUS if _named(node) else 1) * (DOUBT if node.doubtful else 1) >= floor and 2 * node.link_chars < node.chars:
            chosen.append(node)
    return "\n\n".join(blocks(chosen))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without content, give an empty text. Repeated rows give repeated rows; extra
    columns are ignored; no rows give no rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [extract(x) for x in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInPandas(run, "page_id long, url string, text string, n_chars long")
