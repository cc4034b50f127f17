"""Main text of web pages by composite text density.

Every element of a page gets a density: its characters per tag, damped by the
share of its characters and tags that belong to links. An element's density sum
is the sum over its children that are blocks. Going from the body to the element of the largest
sum, the lowest density on that path is the threshold; among the elements that
reach it, the one with the largest sum is of the article. No element's name decides
which one that is.

From there the way goes up to what holds the whole article. An article element
around it is taken as it is. Else, level by level, what stands beside it stays as
long as it belongs: headings, paragraphs, lists, tables and the like, elements of
the same tag and class, blocks of one or two lines (not below the body), and blocks
that reach the threshold; not what is nearly all links, nor lines of copyright. Where
a block doesn't belong, nothing further in that direction does, and above that level
only a title before the article is looked for.

Elements whose tag or role says what they are (navigation, footers, forms and so
on) are taken out before any density is computed. So are blocks with a class or id
made of nothing but such words (``sidebar``, ``cookie-notice``, ``site-header``),
unless they hold an article or main element. Where such a word stands beside other
words (``td-ad-slot``) density decides: the block goes if it is less dense than the
body. Names of formatting elements, and words that say what a block has or lacks
(``with-sidebar``, ``has-banner``), count for nothing; nor do names count at all
where nothing would be left of the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes plaintext".split())
#: Elements that an article's text is made of.
FLOW = frozenset("p ul ol dl table blockquote pre figure time address hr details".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split()
)
DROPPED = frozenset(
    "nav footer aside form script style noscript template textarea title head iframe object embed svg canvas math button select option input dialog menu audio video map xmp noembed noframes".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alertdialog alert form".split())
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager sidebar sidebars aside rail widget widgets "
    "header masthead topbar footer foot colophon copyright comment comments disqus respond replies reply "
    "cookie cookies consent gdpr notice notices banner banners popup modal overlay newsletter subscribe subscription signup "
    "login reactions share sharing social related recommended recommendations trending form search skip toolbar".split()
)
#: Words that may stand beside those without making them say something else.
BESIDE = frozenset(
    "site page top bottom main left right center inner outer box list item bar wrapper wrap section block area container content group panel title text links link "
    "global primary secondary mobile desktop side entry post article blog user js is the and of a".split()
)
#: Words of the article itself: a name with one of them is its own, but for those of OTHERS.
OWN = frozenset("article content main post entry story".split())
OTHERS = frozenset("comment comments ad ads advert sidebar related footer nav navigation menu share sharing respond replies newsletter sponsored promo".split())
#: A block that has or lacks something is no such thing itself.
ABOUT = frozenset("with has have no without layout not".split())
HEADERS = frozenset("header masthead".split())
#: A header with one of these words isn't the article's, wherever it stands.
OF_SITE = frozenset("site global".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dt dd".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}

TAG = re.compile(r"<(?:!--|!|\?|(/?)([A-Za-z][^\s/>]*))")
ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
TAG_END = re.compile(r"""[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""")
RAW_END = {x: re.compile(rf"</{x}\b[^>]*>?", re.I) for x in RAW}
WORDS = re.compile(r"[a-z]+")


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup header".split())


class Node:
    """An element; dropped if it is no text for certain, named if a class or id says so (1) or may say so (2)."""

    __slots__ = ("block", "blocks", "chars", "children", "density", "dropped", "holds", "kind", "links", "link_tags", "name", "named", "parent", "parts", "sum", "tags", "titles")

    def __init__(self, name: str, parent: Node | None, dropped: bool, named: int = 0, kind: str = ""):
        self.name, self.parent, self.dropped, self.named, self.kind = name, parent, dropped, named, kind
        self.block = parent.block if parent and name in INLINE else self  # the nearest element that is no formatting
        self.blocks = self.titles = 0
        self.children: list[Node] = []
        self.parts: list[str | Node] = []
        self.chars = self.tags = self.links = self.link_tags = 0
        self.density = self.sum = 0.0
        self.holds = False


def no_text(name: str, attributes: dict[str, str], inside_article: bool) -> bool:
    """Whether an element's tag, role or state says that it is none of the text."""
    if name in DROPPED or name == "header" and not inside_article:
        return True
    return bool(attributes) and ("hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in DROPPED_ROLES)


def named(name: str, attributes: dict[str, str], inside_article: bool) -> int:
    """1 if a class or id says that a block is no text, 2 if it may, else 0."""
    if not attributes or name in INLINE or name in ("body", "html", "article", "main"):
        return 0
    found = 0
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = set(WORDS.findall(token))
        says = words & DROPPED_WORDS - (HEADERS if inside_article and not words & OF_SITE else frozenset())
        if not says or words & ABOUT or words & OWN and not says & OTHERS:
            continue
        if words <= DROPPED_WORDS | BESIDE:
            return 1
        found = 2
    return found


def parse(page: str) -> Node:
    """A tree of elements; unclosed and misplaced tags are mended as the HTML standard does for the common cases."""
    root = Node("#root", None, False)
    at, here, n = 0, root, len(page)
    opened: Counter[str] = Counter()  # so that no search goes up for what isn't open

    def leave(top: Node) -> Node:
        """Closes what is open below top."""
        node = here
        while node is not top:
            opened[node.name] -= 1
            node = node.parent
        return top

    def text(piece: str) -> None:
        if piece and not here.dropped:
            here.parts.append(html.unescape(piece))

    while at < n:
        m = TAG.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        if m[2] is None:  # comment, declaration or processing instruction
            if page.startswith("<!--", m.start()):
                close = page.find("-->", m.start() + 4)
                at = n if close < 0 else close + 3
            else:
                close = page.find(">", m.start())
                at = n if close < 0 else close + 1
            continue
        at = page.find(">", m.end()) + 1
        if not at or '"' in (raw := page[m.end() : at]) or "'" in raw:  # a quoted value may hold a >
            end = TAG_END.match(page, m.end())
            at = end.end() if end else at or n
        name = m[2].lower()
        if m[1]:
            if name == "br":
                text(" ")
                continue
            node = here if opened[name] else root
            while node is not root and node.name != name:
                if name in INLINE and node.name not in INLINE:  # formatting doesn't close blocks
                    node = root
                    break
                node = node.parent
            if node is not root:
                here = leave(node.parent)
            continue
        if name == "br":
            text(" ")
        if name in CLOSES_P and opened["p"]:
            if here.block.name == "p":
                here = leave(here.block.parent)
        if name in SIBLINGS:
            closed, limit = SIBLINGS[name]
            node = here if any(opened[x] for x in closed) else root
            while node is not root and node.name not in limit and node.name not in closed:
                node = node.parent
            if node.name in closed:
                here = leave(node.parent)
        raw = page[m.end() : at - 1]
        attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in ATTR.finditer(raw)} if raw.strip(" /") else {}
        inside = opened["article"] + opened["main"] > 0
        node = Node(name, here, here.dropped or no_text(name, attributes, inside), named(name, attributes, inside), attributes.get("class", "").strip())
        here.children.append(node)
        here.parts.append(node)
        if name in VOID:
            continue
        if name in RAW:
            close = RAW_END[name].search(page, at)
            at = close.end() if close else n
            continue
        if not raw.endswith("/") or name not in ("svg", "math"):
            here = node
            opened[name] += 1
    return root


def measured(root: Node) -> list[Node]:
    """Fills in the counts of the elements that aren't dropped; children come before parents."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.children if not x.dropped]
    order.reverse()
    for node in order:
        node.chars = sum(len("".join(x.split())) for x in node.parts if x.__class__ is str)
        node.tags = node.links = node.link_tags = node.blocks = 0
        node.titles = int(node.name == "h1")
        own = node.chars
        node.holds = node.name in ("article", "main", "body")
        for x in node.children:
            if not x.dropped:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.links += x.links
                node.link_tags += x.link_tags + (x.name == "a")
                node.holds |= x.holds
                node.titles += x.titles
                node.blocks += x.blocks if x.name not in INLINE else 0
                own += x.chars if x.name in INLINE else 0
        node.blocks += own > 0  # texts of blocks of their own
        if node.name == "a":
            node.links = node.chars
    body = next((x for x in order if x.name == "body"), root)
    share = body.links / body.chars if body.chars else 0.0
    for node in order:
        node.density = density(node.chars, node.tags, node.links, node.link_tags, share)
        # Formatting is part of its block: it would count a paragraph's characters again.
        node.sum = sum(x.density for x in node.children if not x.dropped and x.name not in INLINE) or node.density
    return order


def density(chars: int, tags: int, links: int, link_tags: int, share: float) -> float:
    """Composite text density: characters a tag, damped by the share of links; share is that of the whole body."""
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - links, 1) * links + share * chars + math.e)
    ratio = chars / max(links, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * max(math.log(ratio), 0.0) / base


def without_named(root: Node) -> list[Node]:
    """The measured elements that are left without those whose name says that they are no text; all if nothing would be left."""
    order = measured(root)
    body = next((x for x in order if x.name == "body"), root)
    gone = [x for x in order if x.named and not x.holds and (x.named == 1 or x.density < body.density)]
    if not gone:
        return order
    for x in gone:
        x.dropped = True
    left = measured(root)
    if root.chars or not root.parts:
        return left
    for x in gone:
        x.dropped = False
    return measured(root)


def article(root: Node) -> list[Node]:
    """The elements of the article, in page order: see the module's text. What they hold that doesn't belong is marked as dropped.

    Of elements with equal sums the one with more characters is of the article, of these the one that closes first.
    """
    order = without_named(root)
    body = next((x for x in order if x.name == "body"), root)
    inside = [x for x in order if x.name not in INLINE and x.chars]
    if not inside:
        return [body]
    best, threshold = densest(inside, body)
    whole, node = None, best
    while node is not None:
        whole, node = node if node.name == "article" else whole, node.parent
    return climbed(whole or best, threshold, whole is not None)


def densest(inside: list[Node], body: Node) -> tuple[Node, float]:
    """The element of the largest density sum among those that reach the threshold of the body's path, and the threshold."""
    top = max(inside, key=lambda x: (x.sum, x.chars))
    threshold = path_threshold(top, body)
    return max((x for x in inside if x.density >= threshold), key=lambda x: (x.sum, x.chars)), threshold


def path_threshold(top: Node, body: Node) -> float:
    """The lowest density on the way from an element up to the body."""
    threshold, node = top.density, top
    while node is not None and node is not body.parent:
        threshold = min(threshold, node.density)
        node = node.parent
    return threshold


COPYRIGHT = ("©", "(c)", "copyright", "all rights")


def links_only(x: Node) -> bool:
    return x.name not in HEADINGS and x.links > 0.8 * x.chars


def no_line_of_text(x: Node) -> bool:
    """Whether a block is nearly all links, or a line of copyright."""
    return links_only(x) or x.blocks <= 2 and block_text([x])[:40].lower().startswith(COPYRIGHT)


def climbed(node: Node, threshold: float, narrow: bool) -> list[Node]:
    """An element with what belongs to the article on every level above it. If narrow, only articles beside an article and a title do."""
    found, titled = [node], node.titles > 0
    while node.name != "body" and node.parent is not None:
        up = node.parent
        free = up.name not in ("body", "html", "#root")
        siblings = [x for x in up.children if not x.dropped and x.chars]
        at = next(k for k, x in enumerate(siblings) if x is node)

        def belongs(x: Node, node: Node = node, free: bool = free) -> bool:
            if x.name in INLINE or no_line_of_text(x):
                return False
            peer = x.name == node.name and (x.name in ("article", "section") or bool(x.kind) and x.kind == node.kind)
            if narrow:
                return x.name == node.name == "article"
            return peer or x.name in FLOW or x.name in HEADINGS or x.density >= threshold or free and x.blocks <= 2

        first = last = at
        while last + 1 < len(siblings) and belongs(siblings[last + 1]):
            last += 1
        # A heading after which nothing of the text comes is the next part's.
        while last > at and siblings[last].name in HEADINGS:
            last -= 1
        while first and belongs(siblings[first - 1]):
            first -= 1
        if not titled and not any(x.titles for x in siblings[first:at]):
            first = title_before(siblings, first)
        kept = siblings[first : last + 1]
        lost = siblings[:first] + siblings[last + 1 :]
        titled = titled or any(x.titles for x in kept)
        if free and not narrow and all(map(no_line_of_text, lost)):
            # All that isn't text goes, and the rest stays, with what stands between the elements.
            for x in lost:
                x.dropped = x.name not in INLINE
            found = [up]
        else:
            found = siblings[first:at] + found + siblings[at + 1 : last + 1]
            narrow = True
        node = up
    return found


def title_before(siblings: list[Node], at: int) -> int:
    """Where a heading stands before an element with nothing but short blocks between; else the element's own place."""
    for k in range(at - 1, -1, -1):
        if siblings[k].name in HEADINGS:
            return k
        if siblings[k].blocks > 2 or no_line_of_text(siblings[k]):
            break
    return at


def block_text(tops: list[Node]) -> str:
    """The text below some elements: white space in a block becomes one space, blocks are joined by newlines."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if line := " ".join("".join(run).split()):
            blocks.append(line)
        run.clear()

    todo: list[str | Node | None] = tops[::-1]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif x.__class__ is str:
            run.append(x)
        elif not x.dropped:
            block = x.name not in INLINE
            if block:
                flush()
                todo.append(None)
            todo += reversed(x.parts)
    flush()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    return block_text(article(parse(page))) if page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row; a page is parsed whole, in the task that read it.

    Null or blank html gives an empty text. Repeated rows stay repeated, other columns don't matter.
    """

    def run(values: list[str | None]) -> list[tuple[str, int]]:
        return [(text, len(text)) for text in map(main_text, values)]

    return add_columns(pages.select("page_id", "url", F.col(column)), column, run, "text string, n_chars long", drop=True)
