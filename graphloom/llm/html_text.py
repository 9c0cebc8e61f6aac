"""Main text of web pages by tree scoring.

A page is read into a tree of block elements. Menus, headers, footers, side bars, notices, adverts,
forms, scripts, styles and reader comments are left out by element, role or the words of a class or
id; a container that is only named so stays if it holds most of the page's points. Every paragraph
gives points for its length and its commas to its ancestors, less with each level; a container's points
are discounted by the share of its text that stands in links. The best container is kept, with
those siblings that score well, look like it or are paragraphs of prose themselves; one inside an article
or the main element stands for that whole element, whatever the sizes of its sections. Reading and scoring
take time in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# quotes count only in a value after "="; possessive parts never look at a character twice
_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?P<close>>?)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'<>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp", "template"}
_RAW_END = {name: re.compile(rf"</{name}\b", re.I) for name in _RAW}
_OUT = _RAW | {
    "nav", "footer", "aside", "select", "option", "input", "dialog", "menu", "svg", "canvas", "object", "embed",
    "audio", "video", "head",
}
_CONTROLS = {"label", "button"}  # part of the text inside a block of prose, part of a form elsewhere
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
_BLOCK = {
    "html", "body", "div", "p", "section", "article", "main", "header", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol",
    "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre",
    "figure", "figcaption", "address", "center", "details", "summary", "hgroup", "search", "fieldset", "legend",
} | _OUT | _CONTROLS | {"form"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_TEXTUAL = {"p", "li", "dt", "dd", "td", "th", "caption", "blockquote", "pre", "figcaption", "summary", "address", "legend", *_HEADINGS}
_ENDS_P = _BLOCK - {"html", "body", "input", "option", "select"} | {"hr"}
#: which open elements a new one ends: the nearest of these kinds, unless one of the others lies between
_KINDS = ({"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"})
_SCOPES = ({"ul", "ol", "menu"}, {"dl"}, {"table"}, {"tr", "table"})
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "alertdialog", "menu", "menubar", "form"}
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: a name that begins so speaks of layout or subject, not of what the element is
_ABOUT = {"has", "with", "no", "without", "not", "non", "is", "hide", "show", "category", "tag", "topic", "type", "status", "format", "layout", "template", "theme"}
_COMMENTS = {"comment", "comments", "commentlist", "disqus", "replies", "respond", "reactions"}
_NAMES = _COMMENTS | {
    "ad", "ads", "adsense", "banner", "banners", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "side",
    "footer", "foot", "masthead", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "notifications", "alert", "popup",
    "popups", "modal", "newsletter", "signup", "login", "share", "sharing", "social", "related", "recommended", "recommendations", "widget",
    "widgets", "pagination", "pager", "toolbar", "skip",
}
_STEMS = ("advert", "sponsor", "promo", "subscri", "sidebar")
#: words that stand beside these in the names of layout; a name with any other word may be about the text's subject
_BESIDE = {
    "accept", "also", "area", "article", "articles", "author", "bar", "block", "blocks", "body", "bottom", "box", "button", "buttons", "call", "card", "cards", "col", "column", "component", "container",
    "content", "count", "cta", "dark", "desktop", "dialog", "email", "entry", "fixed", "floating", "fluid", "follow", "form", "global", "grid", "group", "header", "heading", "holder", "icon", "icons", "info",
    "inline", "inner", "item", "items", "js", "left", "light", "like", "link", "links", "list", "lists", "local", "mail", "main", "may", "media", "message", "meta", "mobile", "module", "more", "news", "next",
    "outer", "overlay", "page", "panel", "policy", "post", "posts", "prev", "previous", "primary", "privacy", "read", "reader", "readers", "region", "reply", "right", "row", "secondary", "section", "site",
    "slot", "sticky", "stories", "story", "sub", "text", "this", "thread", "title", "tool", "tools", "top", "trail", "unit", "us", "user", "users", "visitor", "wp", "wrap", "wrapper", "you", "zone",
}
_OF_TEXT = {"post", "article", "entry", "content", "story", "page", "section", "blog", "chapter"}
_PROSE = {"article", "main"}


class Node:
    __slots__ = ("name", "kids", "up", "out", "header", "prose", "scope", "look", "doubt", "points", "below", "chars", "linked", "weight", "kept")

    def __init__(self, name: str, up: Node | None, out: bool = False, weight: float = 0.0):
        self.name, self.up, self.out, self.weight = name, up, out, weight
        self.kids: list = []  # nodes, and (text, inside a link) pairs
        self.points = self.below = self.chars = self.linked = 0.0
        self.header = up is not None and up.header  # of a text: only its headings count
        self.prose = name in _PROSE or (up is not None and up.prose)
        self.look = self.doubt = ""
        self.kept = False
        scope = [None] * 4 if up is None else list(up.scope)
        for k in range(4):
            if name in _SCOPES[k]:
                scope[k] = None
            if name in _KINDS[k]:
                scope[k] = self
        self.scope = scope


def _named(names: str, prose: bool) -> str:
    """What a class or id says of an element: out, comments, header (of a text), or nothing; with a ? where, inside an article, the name has words
    that are none of layout: side-effects, social-history."""
    said = ""
    for name in names.split():
        parts = [p.lower() for p in _PART.findall(name)]
        if not parts or parts[0] in _ABOUT:
            continue
        sure = not prose or all(p in _NAMES or p in _BESIDE or len(p) == 1 or p.isdigit() or p.startswith(_STEMS) for p in parts)
        if not _COMMENTS.isdisjoint(parts):
            if sure:
                return "comments"
            said = said or "comments?"
        elif not _NAMES.isdisjoint(parts) or any(p.startswith(_STEMS) for p in parts):
            said = "out" if sure else said or "out?"
        elif parts[-1] == "header" and not said.strip("?"):
            said = "header" if prose or (len(parts) > 1 and parts[0] in _OF_TEXT) else "out"
    return said


def _unseen(name: str, attrs: dict[str, str]) -> bool:
    if name in _OUT or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _ROLES:
        return True
    style = attrs.get("style")
    return bool(style and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", style))


def parse(page: str) -> Node:
    root = node = Node("#root", None)
    open_: dict[str, int] = {}
    links = at = 0

    def text(raw: str) -> None:
        if raw and not node.out:
            node.kids.append((html.unescape(raw), links > 0))

    def leave(last: Node) -> None:
        """Close everything up to ``last``."""
        nonlocal node
        while True:
            x, node = node, node.up
            open_[x.name] -= 1
            if x is last:
                return

    while True:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            return root
        text(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(html.escape(m["cdata"], quote=False))
        if m["name"] is None:
            continue
        if not m["close"]:  # the page ends inside a tag
            return root
        name = m["name"].lower()
        if m["end"]:
            if name == "a":
                links = max(0, links - 1)
            elif name == "br":
                text(" ")
            elif open_.get(name):
                while node.name != name:
                    leave(node)
                leave(node)
                links = 0 if name in ("article", "div", "section", "li", "p", "td", "ul", "nav") else links
            continue
        if name in _RAW:
            stop = _RAW_END[name].search(page, at)
            at = page.find(">", stop.end()) + 1 if stop else 0
            text(" ")
            if not at:
                return root
            continue
        if name in ("br", "hr", "wbr") or name not in _BLOCK or (name in _CONTROLS and node.name in _TEXTUAL):
            text(" ") if name == "br" else None
            if name == "a" and not m["attrs"].endswith("/"):
                links = 1
            if name == "hr" and node.name == "p":
                leave(node)
            continue
        if name in _VOID:
            continue
        if name in _ENDS_P:
            x = node
            while x.name in _HEADINGS and x.up.name == "p":
                x = x.up
            if x.name == "p":
                leave(x)
        if name in _HEADINGS and node.name in _HEADINGS:
            leave(node)
        for k in range(4):
            if name in _KINDS[k]:
                last = node.scope[k] or (node.scope[3] if k == 2 else None)
                if last is not None:
                    leave(last)
        attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(m["attrs"])} if m["attrs"] else {}
        out = node.out or _unseen(name, attrs) or name in _CONTROLS or (name == "header" and not node.prose)
        child = Node(name, node, out, 25.0 if name in _PROSE or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articleBody" else 0.0)
        if not out:
            node.kids.append(child)
            child.look = attrs.get("class", "")
            child.header |= name == "header"
            if name not in ("html", "body", *_PROSE) and name not in _HEADINGS and (child.look or "id" in attrs):
                child.doubt = _named(child.look + " " + attrs.get("id", ""), node.prose)
            if name == "form":
                child.doubt = "form"
        if not m["attrs"].rstrip().endswith("/"):
            node = child
            open_[name] = open_.get(name, 0) + 1


def _walk(node: Node, found: list, order: list) -> None:
    """Blocks of text below ``node`` in page order: (text, node, characters inside links); nodes before what they hold."""
    order.append(node)
    stack = [(node, iter(node.kids), [])]
    while stack:
        node, kids, parts = stack[-1]
        for kid in kids:
            if isinstance(kid, tuple):
                parts.append(kid)
            else:
                _close(node, parts, found)
                order.append(kid)
                stack.append((kid, iter(kid.kids), []))
                break
        else:
            _close(node, parts, found)
            stack.pop()


def _close(node: Node, parts: list, found: list) -> None:
    if parts:
        body = " ".join("".join(t for t, _ in parts).split())
        if body and (not node.header or node.name in _HEADINGS):
            found.append((body, node, sum(len("".join(t.split())) for t, a in parts if a)))
        parts.clear()


def _score(x: Node) -> float:
    return (x.points + x.below + x.weight) * (1 - x.linked / max(1.0, x.chars))


def _weigh(blocks: list, order: list) -> None:
    """Points, characters and linked characters of all nodes, from the leaves up."""
    for x in order:
        x.points = x.below = x.chars = x.linked = 0.0
    for body, node, linked in blocks:
        points = (1 + body.count(",") + body.count("，") + min(len(body) / 100, 3)) if len(body) >= 25 else 0.3
        holder = node.up if node.name == "p" or node.name in _HEADINGS or node.name in ("li", "td", "dd", "pre", "blockquote") else node
        (holder or node).points += points
        node.chars += len(body)
        node.linked += min(linked, len(body))
    for x in reversed(order):
        if x.up is not None:
            x.up.below += 0.5 * x.points + 0.6 * x.below
            x.up.chars += x.chars
            x.up.linked += x.linked


def _doubtful(order: list) -> bool:
    """Drop the containers that their names give away, and forms; True if there were any.

    A form around most of a page that holds its article, or paragraphs, is the page's own and stays. Where a name is in doubt, a part with a heading or
    80 characters that are no links stays.
    """
    held: dict[int, float] = {}
    titled: dict[int, bool] = {}
    headed: dict[int, bool] = {}
    prose: dict[int, int] = {}
    for x in reversed(order):
        held[id(x)] = x.points + sum(held[id(k)] for k in x.kids if isinstance(k, Node))
        titled[id(x)] = x.name in ("h1", "main") or any(titled[id(k)] for k in x.kids if isinstance(k, Node))
        headed[id(x)] = x.name in _HEADINGS or any(headed[id(k)] for k in x.kids if isinstance(k, Node))
        prose[id(x)] = (2 if x.weight else x.name == "p" and x.chars >= 80) + sum(prose[id(k)] for k in x.kids if isinstance(k, Node))
    some, most = False, 0.5 * held[id(order[0])]
    for x in order:
        if x.up is not None:
            x.out, x.header = x.up.out, x.header or x.up.header
        if x.doubt == "form":
            if not (held[id(x)] > most and (titled[id(x)] or prose[id(x)] > 1)):
                x.out = some = True
        elif x.doubt.endswith("?"):
            if x.linked >= 0.25 * x.chars or not (headed[id(x)] or x.chars >= 80):
                x.out = some = True
        elif x.doubt == "comments" and not titled[id(x)] or x.doubt == "out" and held[id(x)] <= most:
            x.out = some = True
        elif x.doubt == "header" and held[id(x)] <= most:
            x.header = some = True
    return some


def extract(page: str | None) -> str:
    """Main text of one page; its blocks joined by line feeds, empty if there is none."""
    if not page:
        return ""
    root = parse(page)
    blocks: list = []
    order: list[Node] = []
    _walk(root, blocks, order)
    if not blocks:
        return ""
    _weigh(blocks, order)
    if any(x.doubt for x in order) and _doubtful(order):
        blocks = [b for b in blocks if not b[1].out and (not b[1].header or b[1].name in _HEADINGS)]
        order = [x for x in order if not x.out]
        _weigh(blocks, order)
        if not blocks:
            return ""
    best = max((x for x in order if x.chars and x.name not in ("p", *_HEADINGS, "ul", "ol", "li", "tr", "td")), key=_score, default=root)
    article = best  # a long section scores above its article, which holds the others too
    while article is not None and not (article.weight and article.linked < 0.5 * article.chars):
        article = article.up
    best = article or best
    least = max(3.0, 0.25 * (_score(best) - best.weight))
    best.kept = True
    if best.up is not None and best.weight == 0:
        for x in best.up.kids:
            if isinstance(x, Node) and x is not best and x.chars:
                density = x.linked / x.chars
                like = (x.name, x.look) == (best.name, best.look) and density < 0.33
                if like or _score(x) >= least or density < 0.25 and (x.name in _HEADINGS or x.name == "p" and x.chars >= 80):
                    x.kept = True
    elif best.up is not None:  # several articles on one page
        for x in best.up.kids:
            if isinstance(x, Node) and x.weight and _score(x) >= least + x.weight / 2:
                x.kept = True
    for x in order:
        x.kept |= x.up is not None and x.up.kept
    return "\n".join(body for body, node, _ in blocks if node.kept)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``, from the whole html.

    Null and empty html, and pages without text, give an empty text. Repeated rows and rows with a
    null page_id or url give a row each. Other columns are ignored. An empty table gives an
    empty table.
    """

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
