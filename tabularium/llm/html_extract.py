"""Main text of web pages, with each site's templates removed.

A page is read once into a tree of elements. Elements that are never main text by their kind or their declared role
(menus, headers, footers, forms, adverts, comments and so on) are left out; a word in a class or id leaves none out that
carries the page's text. Every block element's subtree is hashed;
Spark counts per host under how many different page bodies each hash occurs, and subtrees that recur on many pages of
their host are deleted. A body is known by its longest block, so copies of one page count once, and paragraphs and
headings of an article are its text even where copies repeat them.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, slices, task_number, written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)>|(?P<text>[^<]+|<(?!/?[a-zA-Z]))", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# fixed values: kinds of HTML elements
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br",
}
DROPPED = {
    "head", "script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "template", "nav", "footer", "aside", "form", "button",
    "select", "option", "svg", "canvas", "object", "embed", "audio", "video", "dialog", "menu", "map", "math",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
LABELS = {
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "ad", "ads", "advert", "adverts", "advertisement",
    "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "share", "sharing", "social", "related", "recommended",
    "widget", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "pagination", "pager", "toolbar", "masthead", "skip",
}
#: labels of what readers write
COMMENTS = {"comment", "comments", "commentlist", "respond", "reply", "replies", "disqus"}
#: outside the article only: an article's own header holds its title
OUTER_LABELS = {"header", "topbar", "logo"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: an open paragraph or item is not closed from inside these
SCOPES = {"html", "body", "article", "main", "section", "div", "table", "ul", "ol", "dl", "blockquote", "button", "form", "aside", "nav", "header", "footer", "td", "th"}
PROTECTED = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "td", "th", "dd", "dt", "table", "figcaption"}


KEEP, DROP, LABELLED, COMMENTARY = range(4)


class Node:
    __slots__ = ("tag", "parent", "dropped", "label", "inside", "parts", "prose", "hash", "size", "titled")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool, inside: bool):
        self.tag, self.parent, self.dropped, self.inside = tag, parent, dropped, inside
        self.parts: list = []
        self.prose = False
        self.hash = 0
        #: KEEP, DROP, LABELLED or COMMENTARY; characters of text in it; whether it is or holds an article, main or h1
        self.label = KEEP
        self.size = 0
        self.titled = tag in ("article", "main", "h1")


def unwanted(tag: str, attrs: str, inside: bool) -> int:
    """DROP for no main text by kind or role, LABELLED or COMMENTARY for a word of class or id, else KEEP."""
    if tag in DROPPED or (tag == "header" and not inside):
        return DROP
    if tag in ("html", "body", "article", "main") and "comment" not in attrs:
        return KEEP
    label = KEEP
    for name, *values in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), "".join(values)
        if name in ("class", "id"):
            words = set(re.findall(r"[a-z]+|[A-Z][a-z]*", re.sub(r"([a-z])([A-Z])", r"\1 \2", value)))
            words = {w.lower() for w in words}
            if words & LABELS or (not inside and words & OUTER_LABELS):
                label = max(label, COMMENTARY if words & COMMENTS else LABELLED)
        elif name == "role" and value.strip().lower() in ROLES:
            return DROP
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return DROP
    return label


def settle(nodes: list[Node]) -> None:
    """Decide the labelled elements of a page; ``nodes`` in page order.

    One that holds half of the page's text or more stays if an article, main or h1 is in it or is it, or, unless its
    label is of comments, if less than a tenth of the text is outside of labels, and none of that in an article or main.
    """
    for node in nodes:
        node.dropped |= node.label == DROP or (node.parent is not None and node.parent.dropped)
        if not node.dropped:
            node.size = sum(len(part.strip()) for part in node.parts if isinstance(part, str))
    labelled: set[int] = set()
    clear, stated = 0, False
    for node in nodes:
        if node.label in (LABELLED, COMMENTARY) or id(node.parent) in labelled:
            labelled.add(id(node))
        else:
            clear += node.size
            stated |= node.size > 0 and (node.inside or node.tag in ("article", "main"))
    for node in reversed(nodes):
        if node.parent is not None and not node.dropped:
            node.parent.size += node.size
            node.parent.titled |= node.titled
    total = nodes[0].size
    for node in nodes:
        if node.label in (LABELLED, COMMENTARY):
            carries = 2 * node.size >= total and (node.titled or (node.label == LABELLED and not stated and 10 * clear < total))
            node.dropped |= not carries
        node.dropped |= node.parent is not None and node.parent.dropped


def parse(page: str) -> Node:
    """Tree of a page; missing end tags are implied."""
    root = Node("", None, False, False)
    nodes = [root]
    now, at = root, 0
    while at < len(page):
        match = TOKEN.match(page, at)
        if match is None:  # a tag that never ends
            break
        at = match.end()
        if match["text"] is not None:
            now.parts.append(match["text"])
            continue
        if match["name"] is None:
            continue
        tag = match["name"].lower()
        if match["end"]:
            up = now
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                now = up.parent
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                now.parts.append(" " if tag == "br" else Node("hr", now, False, False))
            continue
        closes = CLOSES.get(tag, () if tag in INLINE else {"p"})
        up = now
        while up is not root and up.tag not in closes and (up.tag not in SCOPES or up.tag in CLOSES.get(tag, ())):
            up = up.parent
        if up is not root and up.tag in closes:
            now = up.parent
            if tag in ("tr", "tbody", "tfoot"):
                while now.tag in closes:
                    now = now.parent
        made = Node(tag, now, False, now.inside or tag in ("article", "main"))
        made.label = unwanted(tag, match["attrs"], now.inside)
        now.parts.append(made)
        nodes.append(made)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif not match["attrs"].endswith("/"):
            now = made
    settle(nodes)
    return root


def walk(root: Node) -> tuple[list[Node], list[tuple[str, Node]]]:
    """(elements in end order, blocks of text with the element that holds them); sets each block element's hash."""
    elements: list[Node] = []
    blocks: list[tuple[str, Node]] = []
    held: list[str] = []

    def flush(owner: Node) -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            blocks.append((text, owner))

    # (element, position in its parts, block element around it); a stack, since pages may nest deeper than Python does
    stack: list[tuple[Node, int, Node]] = [(root, 0, root)]
    sums: dict[int, list[bytes]] = {id(root): []}
    while stack:
        node, i, block = stack.pop()
        if i < len(node.parts):
            stack.append((node, i + 1, block))
            part = node.parts[i]
            if isinstance(part, str):
                text = html.unescape(part) if "&" in part else part
                sums[id(block)].append(text.encode("utf-8", "surrogatepass"))
                if not node.dropped:
                    held.append(text)
            else:
                inline = part.tag in INLINE
                if not inline:
                    flush(block)
                    sums[id(part)] = []
                stack.append((part, 0, block if inline else part))
        elif node.tag not in INLINE:
            flush(node)
            content = b" ".join(b" ".join(sums.pop(id(node))).split())
            node.hash = int.from_bytes(hashlib.blake2b(node.tag.encode() + b"|" + content, digest_size=8).digest(), "little", signed=True) if content else 0
            node.prose |= node.tag in PROTECTED
            if node.parent is not None:
                outer = node.parent
                while outer.parent is not None and outer.tag in INLINE:
                    outer = outer.parent
                outer.prose |= node.prose
                sums[id(outer)].append(b"<" + node.hash.to_bytes(8, "little", signed=True).hex().encode() + b">")
            elements.append(node)
    return elements, blocks


def scope_of(elements: list[Node], blocks: list[tuple[str, Node]]) -> list[Node]:
    """The article with the most text and its sibling articles, if they hold half or more of the text of the main
    element, or of the page where there is none; else that main element; else nothing: the whole page."""
    sizes: dict[int, int] = {}
    for text, owner in blocks:
        up = owner
        while up is not None:
            if up.tag in ("article", "main", ""):
                sizes[id(up)] = sizes.get(id(up), 0) + len(text)
            up = up.parent
    articles, mains = ([n for n in elements if n.tag == tag and not n.dropped and sizes.get(id(n))] for tag in ("article", "main"))
    main = max(mains, key=lambda n: sizes[id(n)], default=None)
    if articles:
        longest = max(articles, key=lambda n: sizes[id(n)])
        joined = [n for n in articles if n.parent is longest.parent]
        around = sum(len(text) for text, _ in blocks) if main is None else sizes[id(main)]
        if 2 * sum(sizes[id(n)] for n in joined) >= around:
            return joined
    return [] if main is None else [main]


def page_parts(page: str) -> dict:
    """blocks (text, hashes of the subtrees it may be deleted with), body (hash of the longest block)."""
    elements, blocks = walk(parse(page))
    scope = scope_of(elements, blocks)
    out = []
    for text, owner in blocks:
        within, up = [], owner
        while up is not None and up not in scope:
            if up.hash and up.tag not in ("", "html", "body") and not (scope and up.prose):
                within.append(up.hash)
            up = up.parent
        if not scope or up is not None:
            out.append({"text": text, "within": within})
    longest = max((b["text"] for b in out), key=len, default="")
    body = int.from_bytes(hashlib.blake2b(longest.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return {"blocks": out, "body": body}


def host_of(url: str | None) -> str:
    match = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return match[1].lower() if match else ""


def main_text(pages: DataFrame, min_pages: int = 10, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    ``min_pages``: under so many different bodies of its host a subtree is a template. Null and empty pages have the
    empty text; pages without url share one host; repeated rows get equal results; an empty table gives no rows; other
    columns are not read.
    """
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row = task_number() << 33
        for batch in slices(batches):
            parts = [page_parts(page or "") for page in batch.column(2).to_pylist()]
            yield {"row": list(range(row, row + len(parts))), "page_id": batch.column(0), "url": batch.column(1), "host": [host_of(u) for u in batch.column(1).to_pylist()],
                   **{c: [p[c] for p in parts] for c in ("blocks", "body")}}
            row += len(parts)

    kind = dict(source.dtypes)["page_id"]
    schema = f"row bigint, page_id {kind}, url string, host string, blocks array<struct<text:string,within:array<bigint>>>, body bigint"
    parsed = written(map_arrow(source, run, schema), "pages")
    # only subtrees that hold a block and are no article text can be deleted, so only they are counted
    held = parsed.select("row", "host", "body", F.explode(F.array_distinct(F.flatten("blocks.within"))).alias("subtree"))
    bodies = held.select("host", "subtree", "body").distinct()
    templates = bodies.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages).select("host", "subtree")
    # at most the subtrees of one page in a group; written, so that Spark knows the size and moves pages only if it is large
    deleted = written(held.join(templates, ["host", "subtree"]).groupBy("row").agg(F.collect_set("subtree").alias("deleted")), "deleted")
    stays = F.filter("blocks", lambda b: F.col("deleted").isNull() | ~F.arrays_overlap(b["within"], F.col("deleted")))
    text = F.array_join(F.transform(stays, lambda b: b["text"]), "\n")
    return parsed.join(deleted, "row", "left").select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("bigint"))
