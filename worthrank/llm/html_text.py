"""Main text of HTML pages by tree scoring.

Every paragraph passes points for its length and its commas to the containers above it; a container's
points are discounted by its link density. An article is kept with siblings that score well beside it; on a
page without one, the best container and all other text but blocks of links. What a page's markup calls a menu, a banner
or the like goes only if most of the page's text is elsewhere. Pages are parsed one by one where they are read: there is no
shuffle, a task holds a few pages at a time, and the time is in proportion to the page however deep it nests.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worthrank.llm.common import map_arrow, text_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"']+))?""")
#: Elements whose content is text up to their own end tag.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that never hold main text.
_OUT = {"head", "script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "nav", "footer", "aside", "svg", "math", "canvas", "object", "audio", "video", "button", "select", "option", "datalist", "menu", "dialog", "label", "input"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
           "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Blocks that are paragraphs: their points go to what holds them.
_PARAGRAPHS = {"p", "pre", "blockquote", "li", "dd", "dt", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption", "caption"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: A start tag of the key closes an open element of these names, up to the nearest of the scope.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of classes and ids that mark what surrounds an article.
_BESIDE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "consent",
           "cookie", "cookies", "footer", "header", "menu", "masthead", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
           "pager", "pagination", "popup", "promo", "promotion", "related", "share", "sharing", "sidebar", "skip", "social",
           "sponsor", "sponsored", "subscribe", "subscription", "tags", "toolbar", "widget", "widgets"}
#: Words that mark what readers have written, which may be longer than the article.
_READERS = {"comment", "comments", "disqus", "reply", "replies", "respond"}
#: Ends of compound names that say where or how an element is, not what it holds; and parts that say that something else is there or isn't.
_PLACES = {"area", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "form", "group", "inner", "item", "items", "left", "link",
           "links", "list", "outer", "panel", "posts", "right", "row", "section", "signup", "slot", "thread", "top", "unit", "wrap", "wrapper"}
_OTHERS = {"has", "have", "hide", "no", "not", "show", "with", "without"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form", "toolbar"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    """``out``: left out with all that it holds. ``mark``: 1 if the markup says that it surrounds an article, 2 if readers' comments."""

    __slots__ = ("tag", "parent", "children", "out", "mark", "points", "chars", "link_chars", "inside")

    def __init__(self, tag: str, parent: Node | None, out: bool = False, mark: int = 0):
        self.tag, self.parent, self.out, self.mark = tag, parent, out, mark
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.link_chars = 0
        self.inside = False


def _marked(names: str) -> int:
    """The mark of an element by its class and id. A name counts if its last part, but for parts that say where it is, is a
    word of the lists, and nothing in it says that something else has or lacks it: sidebar, page-header, share-buttons, but not
    has-sidebar, ad-free or related-work."""
    found = 0
    for name in names.split():
        parts = [w.lower() for w in _WORDS.findall(name)]
        while len(parts) > 1 and parts[-1] in _PLACES:
            parts.pop()
        if parts and not _OTHERS.intersection(parts):
            found = max(found, 2 if parts[-1] in _READERS else 1 if parts[-1] in _BESIDE else 0)
    return found


def _kind(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element is left out in any case, and its mark."""
    if tag in _OUT:
        return True, 0
    mark = 1 if tag in ("form", "header") else 0
    if not attributes or tag in ("html", "body", "article", "main"):
        return False, mark
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True, 0
    if found.get("role", "").lower() in _ROLES:
        mark = 1
    return False, max(mark, _marked(found.get("class", "") + " " + found.get("id", "")))


def parse(html: str) -> Node:
    """A tree of the page's elements and texts; tolerant of what is not closed or not opened."""
    root = Node("html", None)
    at = root
    pos = 0
    opened: Counter[str] = Counter()  # open elements by name: what isn't open isn't searched for

    def close(upto: Node) -> Node:
        nonlocal at
        while at is not upto:
            opened[at.tag] -= 1
            at = at.parent
        return at

    while pos < len(html):
        m = _TOKEN.search(html, pos)
        if not m:
            at.children.append(html[pos:])
            break
        if m.start() > pos:
            at.children.append(html[pos : m.start()])
        pos = m.end()
        if not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):  # an end tag closes up to its element; one of an inline element or paragraph stays in its container
            up = at if opened[tag] else root
            while up.parent and up.tag != tag and (tag not in _INLINE and tag != "p" or up.tag in _INLINE or up.tag == "p"):
                up = up.parent
            if up.tag == tag and up.parent:
                close(up.parent)
            continue
        if tag in ("html", "body"):
            continue
        if tag not in _INLINE and opened["p"]:  # a block ends an open paragraph
            up = at
            while up.parent and up.tag in _INLINE:
                up = up.parent
            if up.tag == "p" and up.parent:
                close(up.parent)
        if tag in _CLOSES:
            names, scope = _CLOSES[tag]
            up = at if any(opened[n] for n in names) else root
            while up.parent and up.tag not in names and up.tag not in scope:
                up = up.parent
            if up.tag in names:
                close(up.parent)
        out, mark = _kind(tag, m.group(3))
        if tag == "header" and (opened["article"] or opened["main"]):
            mark = 0  # it holds the headline
        node = Node(tag, at, out, mark)
        at.children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(html, pos)
            pos = end.end()
        elif tag not in _VOID and not m.group(3).endswith("/"):
            at = node
            opened[tag] += 1
    return root


def _blocks(node: Node, out: list[tuple[Node, str, int]]) -> None:
    """Append (block element, text, characters in links) for every run of inline content, in page order."""
    stack: list[tuple[Node, int, bool]] = [(node, 0, False)]
    run: list[str] = []
    linked = 0

    def end(owner: Node) -> None:
        nonlocal linked
        text = " ".join(unescape("".join(run)).split())
        if text:
            out.append((owner, text, min(linked, len(text))))
        run.clear()
        linked = 0

    owners = [node]
    while stack:
        at, k, in_link = stack.pop()
        if k == len(at.children):
            if at.tag not in _INLINE:
                end(owners.pop())
            continue
        stack.append((at, k + 1, in_link))
        child = at.children[k]
        if isinstance(child, str):
            run.append(child)
            if in_link:
                linked += len(child.strip())
        elif child.tag == "br":
            run.append(" ")
        elif not child.out and child.tag not in _VOID:
            if child.tag not in _INLINE:
                end(owners[-1])
                owners.append(child)
            stack.append((child, 0, in_link or child.tag == "a"))
        elif child.out and child.tag not in _INLINE or child.tag == "hr":
            end(owners[-1])


#: Levels above a paragraph's container that still get points from it: what they get falls with the level.
_LEVELS = 24


def _nodes(root: Node) -> list[Node]:
    """All elements, each before what it holds."""
    found = [root]
    for node in found:
        found.extend(c for c in node.children if isinstance(c, Node))
    return found


def _weigh(nodes: list[Node], blocks: list[tuple[Node, str, int]]) -> None:
    """Set the characters, and those in links, that each element holds."""
    for node in nodes:
        node.chars = node.link_chars = 0
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.link_chars += linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.chars += node.chars
            node.parent.link_chars += node.link_chars


def _drop_marked(nodes: list[Node]) -> bool:
    """Leave out the marked elements; whether there were any. One that holds over half of the page's running text stays, unless it
    is mostly links; readers' comments go as long as a tenth of the running text is elsewhere."""
    total = nodes[0].chars - nodes[0].link_chars
    found = False
    for node in nodes:
        if node.mark and node.chars and not node.out:
            own = node.chars - node.link_chars
            node.out = 2 * own <= total or 2 * own < node.chars or node.mark == 2 and 10 * own <= 9 * total
            found |= node.out
    return found


def main_text(html: str) -> str:
    """Blocks of the best container and its good siblings, and without an article all that is running text, in page
    order, one a line; empty if none."""
    root = parse(html)
    nodes = _nodes(root)
    blocks: list[tuple[Node, str, int]] = []
    _blocks(root, blocks)
    _weigh(nodes, blocks)
    if _drop_marked(nodes):
        blocks = []
        _blocks(root, blocks)
        _weigh(nodes, blocks)
    for owner, text, linked in blocks:
        points = (1.0 + text.count(",") + min(len(text) / 100.0, 3.0)) * (1.0 - linked / len(text))
        holder, share = owner.parent if owner.tag in _PARAGRAPHS and owner.parent else owner, 1.0
        level = 0
        while holder is not None and level < _LEVELS:
            holder.points += points * share
            level += 1
            share = 0.5 if level == 1 else 1.0 / (3 * level)
            holder = holder.parent
    best, most = None, 0.0
    seen: set[int] = set()
    for owner, _, _ in blocks:
        at: Node | None = owner.parent if owner.tag in _PARAGRAPHS and owner.parent else owner
        while at is not None and id(at) not in seen:
            seen.add(id(at))
            own = _score(at)
            if own > most:
                best, most = at, own
            at = at.parent
    if best is None:
        return ""
    up = best
    while up is not None:  # a container inside an article stands for the whole article
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    best.inside = True
    if best.parent is not None:
        for sibling in best.parent.children:
            if isinstance(sibling, Node) and sibling is not best and not sibling.out and sibling.chars:
                density = sibling.link_chars / sibling.chars
                if _score(sibling) >= max(10.0, 0.2 * most) or sibling.tag == "p" and sibling.chars > 80 and density < 0.25 and best.tag not in ("article", "main"):
                    sibling.inside = True
    for node in nodes:
        node.inside = node.inside or node.parent is not None and node.parent.inside
    path: set[int] = set()
    up = best
    while up is not None:
        path.add(id(up))
        up = up.parent
    lines = []
    for owner, text, linked in blocks:
        if owner.inside or best.tag not in ("article", "main") and _running(owner, text, linked, path):
            lines.append(text)
    return "\n".join(lines)


def _running(owner: Node, text: str, linked: int, path: set[int]) -> bool:
    """Whether a block beside the best container (the lowest of ``path``) isn't a menu: it, or what holds it apart from
    the path, is not mostly links; a heading may be a link."""
    if 2 * linked < len(text):
        return True
    holder = owner.parent if owner.tag in _PARAGRAPHS and owner.parent else owner
    return 2 * holder.link_chars < holder.chars and (id(holder) not in path or owner.tag in _HEADINGS)


def _score(node: Node) -> float:
    if not node.chars:
        return 0.0
    bonus = 25.0 if node.tag in ("article", "main") else 0.0
    return (node.points + bonus * (node.points > 0)) * (1.0 - node.link_chars / node.chars)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add text, the main text of each page, in place of a column of that name.

    The whole html is parsed. A null or empty page has the empty text, as has one without any text
    outside menus, headers, footers, sidebars, notices, adverts, forms, scripts and comments. The other
    columns pass unchanged, repeated rows too."""
    if html_col != "text":
        pages = pages.drop("text")
    at = pages.columns.index(html_col)
    schema = pages.select("*", F.lit("").alias("main_text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 128):
            texts = [main_text(h) if h else "" for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema.fields])

    done = map_arrow(pages, run, schema)
    return done.drop("text").withColumnRenamed("main_text", "text") if html_col == "text" else done.withColumnRenamed("main_text", "text")
