"""Main text of web pages by tree scoring.

A page becomes a tree; what never holds article text (menus, scripts, forms and
the like) is left out by tag or role. Elements that a class or id names as
something else (adverts, sidebars, comments) are left out if the page's text
agrees: not if they hold its article, or nearly all text around them. Every
paragraph then gets points for its length and commas, which it passes to its
ancestors in falling shares, and a container's points are discounted by the
share of its text that is link text. The best container, together with the
siblings that score like it, is the article; its blocks are returned in page
order, whole.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset(
    "script style noscript template head title nav footer aside form button iframe object svg canvas select textarea dialog menu".split()
)
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html td th tr tbody thead tfoot".split()) | frozenset(["nav", "footer", "aside", "form", "menu"])
SAME_LEVEL = {
    "li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")), "tr": ("tr", ("table",)), "option": ("option", ("select",)),
}
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Names (class or id words) that mark what is not the article.
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead topbar cookie cookies consent gdpr notice popup modal overlay comment comments disqus replies respond related "
    "recommended share sharing social newsletter subscribe signup login pagination pager toolbar widget".split()
)
TALK_NAMES = frozenset("comment comments disqus replies respond".split())
# Words that may follow such a name without changing what it names, and words that say the element is without or around it.
NAME_TAILS = frozenset(
    "area bar block body bottom box button buttons container content cta first footer form group header icons inner item items label last left "
    "link links list main media outer panel post posts primary right row secondary section slot stories articles text this title top unit widget "
    "wrap wrapper".split()
)
NAME_NEGATIONS = frozenset("has no non not with without".split())
_NAME = re.compile(r"[a-z]+")
_PARAGRAPHS = frozenset(["p", "pre", "td", "blockquote", "li", "dd"])
_TAG_POINTS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 3.0, "blockquote": 2.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "table": -3.0}


class Node:
    __slots__ = ("tag", "parent", "children", "skip", "named", "within", "points", "size", "linked", "marked", "articles")

    def __init__(self, tag: str, parent: Node | None, skip: bool, named: str = ""):
        self.tag, self.parent, self.skip, self.named = tag, parent, skip, named
        self.within = tag in ("article", "main") or (parent is not None and parent.within)
        self.children: list[Node | str] = []
        self.points, self.size, self.linked, self.marked, self.articles = 0.0, 0, 0, 0, 0

    @property
    def plain(self) -> int:
        return self.size - self.linked


class TreeBuilder(HTMLParser):
    """Builds the tree with the usual repairs: implied ends, stray ends, open elements at the end of the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", None, False)

    def _close(self, tags, stop) -> None:
        """End the nearest open element of `tags`, unless one of `stop` lies between."""
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._close(("p",), ("article", "section", "div", "td", "li", "blockquote", "body"))
        if tag in SAME_LEVEL:
            same, stop = SAME_LEVEL[tag]
            self._close(same.split(), stop)
        if tag in VOID:
            self.at.children.append("\n" if tag in ("br", "hr") else "")
            return
        node = Node(tag, self.at, self.at.skip or self._is_other(tag, attrs), self._name(tag, attrs))
        self.at.children.append(node)
        self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if node.tag in ("article", "main", "body") and tag not in ("body", "html", "article", "main"):
                return
            node = node.parent

    def handle_data(self, data):
        if not self.at.skip:
            self.at.children.append(data)

    def _is_other(self, tag: str, attrs) -> bool:
        if tag in NO_TEXT:
            return True
        if tag == "header":
            return not self.at.within
        if tag in ("html", "body", "article", "main"):
            return False
        for key, value in attrs:
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return True
            if key == "role" and value in OTHER_ROLES:
                return True
            if key == "style" and value and "display:none" in value.replace(" ", ""):
                return True
        return False

    def _name(self, tag: str, attrs) -> str:
        """What the class or id names the element as: "other", "talk", or nothing."""
        if tag in ("html", "body", "main") or (tag == "article" and not self.at.within):
            return ""
        heads = {head_name(name) for key, value in attrs if key in ("class", "id") and value for name in value.lower().split()}
        return "talk" if heads & TALK_NAMES else "other" if heads & OTHER_NAMES else ""


def head_name(name: str) -> str:
    """The word that says what a compound name names: comment of comment-list, nothing of no-sidebar."""
    words = _NAME.findall(name)
    if not NAME_NEGATIONS.isdisjoint(words):
        return ""
    while len(words) > 1 and (words[-1] in NAME_TAILS or len(words[-1]) == 1):
        words.pop()
    return words[-1] if words else ""


def parse(html: str) -> Node:
    cut = html.rfind("<")
    if cut > html.rfind(">") and cut + 1 < len(html) and (html[cut + 1].isalpha() or html[cut + 1] in "/!"):
        html = html[:cut]  # a tag that the page's end cuts off
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return builder.root


def in_order(root: Node) -> list[Node]:
    """The nodes with possible article text, parents first."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.skip:
            found.append(node)
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def text_sizes(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.size += sum(len(c.strip()) for c in node.children if isinstance(c, str))
        if node.tag == "a":
            node.linked = node.size
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked


def leave_out_named(root: Node) -> None:
    """Skip named elements, outermost first, unless the text says that they hold the article.

    An element is compared with the text without a name in its scope: the nearest
    article, main or kept named element around it, or the page. It stays if it
    has more than that text and all articles of the scope, or over three times
    that text and no article of the scope lies outside. Comments stay only
    around a main element.
    """
    nodes = in_order(root)
    text_sizes(nodes)
    for node in reversed(nodes):
        node.articles += node.tag in ("article", "main") and not node.named and node.plain > 0
        if node.parent is not None:
            node.parent.articles += node.articles
            node.parent.marked += node.plain if node.named else node.marked
    mains = {n for n in nodes if n.tag == "main"}
    todo = [(root, root)]
    while todo:
        node, scope = todo.pop()
        if node.named:
            around = scope.plain - scope.marked
            outside = scope.articles - (scope.tag in ("article", "main")) - node.articles
            if node.named == "talk":
                stays = bool(mains) and any(n in mains for n in in_order(node))
            else:
                stays = outside <= 0 and node.plain > (1 if node.articles else 3) * around
            if not stays:
                node.skip = True
                continue
        if node.named or node.tag in ("article", "main"):
            scope = node
        todo.extend((c, scope) for c in node.children if isinstance(c, Node) and not c.skip)
    for node in nodes:
        node.size = node.linked = 0


def own_text(node: Node) -> str:
    """The text of a paragraph without that of blocks inside it."""
    parts, todo = [], [node]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            parts.append(at)
        elif not at.skip and (at is node or at.tag not in BLOCKS):
            todo.extend(reversed(at.children))
    return " ".join("".join(parts).split())


def score(nodes: list[Node]) -> None:
    """Paragraphs pass points to their ancestors: whole to the parent, half to the next, then a third of the share each time."""
    for node in nodes:
        node.points += _TAG_POINTS.get(node.tag, 0.0) if node.size else 0.0
        if node.tag not in _PARAGRAPHS and not (node.tag in BLOCKS and any(isinstance(c, str) and c.strip() for c in node.children)):
            continue
        text = own_text(node)
        if not text:
            continue
        points = min(len(text) / 25, 1.0) + text.count(",") + len(text) / 100
        points *= 1 - min(1.0, node.linked / max(node.size, 1))
        share, level, above = 1.0, 0, node.parent
        while above is not None:
            above.points += points * share
            level += 1
            share, above = 1 / (2 if level == 1 else 3 * level), above.parent
    for node in nodes:
        if node.points > 0:
            node.points *= 1 - min(1.0, node.linked / max(node.size, 1))


def article_nodes(root: Node) -> list[Node]:
    """The best container with the siblings that belong to it, in page order."""
    leave_out_named(root)
    nodes = in_order(root)
    text_sizes(nodes)
    score(nodes)
    containers = [n for n in nodes if n.size and n.tag in BLOCKS and n.tag not in _PARAGRAPHS and not re.fullmatch("h[1-6]", n.tag)]
    if not containers:
        return [root]
    best = max(containers, key=lambda n: n.points)
    whole, above = best, best.parent
    while above is not None:  # an article is not cut into its sections
        if above.tag in ("article", "main"):
            whole = above
            break
        above = above.parent
    if whole.parent is None:
        return [whole]
    least = max(5.0, 0.2 * whole.points)
    runs = sibling_runs(whole.parent)
    sparse = [sum(n.linked for n in run if isinstance(n, Node)) < 0.25 * size for run, size in runs]
    chosen = []
    for place, (run, _) in enumerate(runs):
        near = run[0]
        if not isinstance(near, Node) or near.tag not in BLOCKS:
            continue
        alone = re.fullmatch("p|pre|blockquote|h[1-6]|article|main", near.tag) is not None
        if near is whole or near.points >= least or (alone and sparse[place]):
            chosen.append(place)
    between, chosen = range(chosen[0], chosen[-1] + 1), set(chosen)
    return [n for place in between if place in chosen or sparse[place] for n in runs[place][0]]


def sibling_runs(parent: Node) -> list[tuple[list[Node | str], int]]:
    """The children with text and the length of it: a block alone, text and inline elements beside each other as one."""
    runs, inline = [], []
    for child in [*parent.children, None]:
        if isinstance(child, Node) and child.skip:
            continue
        if isinstance(child, str) or (child is not None and child.tag not in BLOCKS):
            inline.append(child)
            continue
        runs.append((list(inline), sum(len(c.strip()) if isinstance(c, str) else c.size for c in inline)))
        inline.clear()
        if child is not None:
            runs.append(([child], child.size))
    return [(run, size) for run, size in runs if size]


def blocks(nodes: list[Node]) -> list[str]:
    """Block texts in page order, white space collapsed, empty ones left out."""
    out, inline = [], []

    def end():
        text = " ".join("".join(inline).split())
        if text:
            out.append(text)
        inline.clear()

    todo: list = list(reversed(nodes))
    while todo:
        at = todo.pop()
        if at is None:
            end()
        elif isinstance(at, str):
            inline.append(at)
        elif not at.skip:
            if at.tag in BLOCKS:
                end()
                todo.append(None)
            todo.extend(reversed(at.children))
    end()
    return out


def extract(html: str | None) -> str:
    """The article of a page as blocks joined by an empty line; empty if there is none."""
    return "\n\n".join(blocks(article_nodes(parse(html)))) if html else ""


def main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of `pages`, repeated rows included.

    A null or empty page, or one without text, has the empty text. Null ids and
    urls pass through; other columns are not looked at. A map over rows: nothing
    is shuffled.
    """

    def work(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [extract(h) for h in part.column("html").to_pylist()]
                columns = [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
