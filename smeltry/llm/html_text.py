"""Main text of web pages by tree scoring.

A page is parsed into a tree in one linear pass. Every paragraph earns points for its
length and its commas and passes them to its ancestors, less with each level; a
container's score is discounted by the share of its text that stands in links. The
best container leads to the article: the article or main element around it, or else
the least ancestor that holds nearly all points of the page. Of that everything is
kept, headings and blocks of any length. Parts that are named as something else than
the article (menus, footers, forms, adverts, notices, comments), and lists of bare
links, are left out; but a name only lowers a part's worth, and where the article is
in it, it stays.

Character references are decoded, white space inside a block becomes one space, and
blocks are joined in page order by one line end. Null, empty and text-free pages give
an empty text. Nothing is cut by length; broken markup is read as browsers read it:
an open paragraph ends at the next block, what is never closed ends with the page.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from smeltry.llm.common import table
from smeltry.llm.sentence_pieces import _slices

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]++))?""", re.S)
_WORD = re.compile(r"[a-z]+")
# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that may stand in a head; any other one ends it.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements without text of an article.
LOST = RAW | frozenset("head button select option datalist svg canvas object template math audio video map".split())
#: Elements beside an article; one of them around it lacks its end.
BESIDE_IT = frozenset("nav header footer aside menu dialog".split())
#: Words of class, id and role that name such parts.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside widget footer header masthead "
    "contentinfo complementary comment comments disqus reply replies respond share sharing social follow related recommended recommendations "
    "newsletter subscribe subscription signup login search toolbar skip hidden form copyright".split()
)
#: Words that may stand beside those in one name.
NEUTRAL = frozenset(
    "site page main post entry article blog top bottom left right box wrap wrapper container section block list area bar inner outer item items "
    "links primary secondary global slot unit body visually".split()
)
#: With one of these words, a header is the article's own.
_OWN = frozenset("page main post entry article section".split())
#: What a named part's worth counts for, against parts that are not.
NAMED_WORTH = 0.05
#: Times that names are lifted: around an article, then inside it.
LIFTS = 3
#: Elements whose own text counts as a paragraph, and levels up to which points go.
_PARAGRAPH = frozenset("p pre td blockquote li dd div section article main body html figcaption".split())
LEVELS = 4
#: Elements that hold text rather than divide a page.
_TEXT = frozenset("p pre blockquote ul ol dl table figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A list of links: at least so much of its text is in at least so many links. It is navigation if a link has fewer characters, and fewer beside it.
LINK_SHARE, LINKS, LINK_CHARS, BESIDE = 0.5, 2, 40, 8
#: Share of a page's points that is nearly all, and that a block has which belongs to an article standing in the page itself.
NEARLY, BELONGS = 0.95, 0.05


class Node:
    #: lost: its text isn't kept. named: 1 by a name (or a form), 2 by its tag. inside: 1 in main, 2 in article.
    __slots__ = ("tag", "parent", "parts", "lost", "named", "under", "dropped", "inside", "chars", "linked", "links", "commas", "score", "points", "all_points")

    def __init__(self, tag: str, parent: Node | None, lost: bool):
        self.tag, self.parent, self.lost, self.named = tag, parent, lost, 0
        self.parts: list[Node | str] = []
        self.inside: int = max(parent.inside if parent else 0, 2 if tag == "article" else tag == "main")
        self.place()
        self.clear()

    def place(self) -> None:
        """Names of a part hold for what is in it."""
        self.under: int = max(self.named, self.parent.under if self.parent else 0)
        self.dropped = self.lost or self.under > 0

    def clear(self) -> None:
        self.chars = self.linked = self.links = self.commas = 0
        self.score = self.points = self.all_points = 0.0


def _names_part(token: str) -> bool:
    """If a token of class, id or role is nothing but the name of a part."""
    words = set(_WORD.findall(token))
    named = words & NAMED
    return bool(named) and words <= NAMED | NEUTRAL and not (named == {"header"} and words & _OWN)


def _named(attributes: str) -> tuple[bool, bool]:
    """If an element is hidden, and if it is named as something else than an article."""
    hidden = named = False
    seen: set[str] = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in seen:
            continue
        seen.add(name)
        value = (value.strip(value[0]) if value[:1] in ("'", '"') else value).lower()
        if name == "hidden":
            hidden = True
        elif name == "style":
            style = value.replace(" ", "")
            hidden = hidden or "display:none" in style or "visibility:hidden" in style
        elif name == "aria-hidden":
            named = named or value == "true"
        elif name in ("class", "id", "role"):
            named = named or any(map(_names_part, value.split()))
    return hidden, named


def parse(page: str) -> Node:
    """The tree of a page; text of lost parts isn't kept."""
    root = node = Node("html", None, False)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if node.tag == "head" and text.strip():
            node = node.parent or node  # text ends an open head
        if text and not node.lost:
            node.parts.append(text)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = m.groups()
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            above: Node | None = node
            while above is not None and above.tag != tag:
                # a stray inline end tag doesn't close blocks around it
                above = None if tag not in BLOCK and tag != "template" and above.tag in BLOCK else above.parent
            if above is not None and above.parent is not None:
                node = above.parent
            continue
        if node.tag == "head" and tag not in HEAD and tag != "html":
            node = node.parent or node
        if tag in ("html", "body"):
            continue  # attributes of the page itself name no part of it
        if tag in BLOCK:
            above = node
            while above is not None and (above.tag == "p" or above.tag not in BLOCK):
                if above.tag == "p":
                    node = above.parent or node
                    break
                above = above.parent
        if tag in ("li", "tr", "td", "th", "dd", "dt", "option") and node.tag in (tag, *(("dd", "dt") if tag in ("dd", "dt") else ("td", "th") if tag in ("td", "th") else ())):
            node = node.parent or node
        hidden, named = _named(attributes) if attributes.strip() else (False, False)
        child = Node(tag, node, node.lost or hidden or tag in LOST)
        if tag in BESIDE_IT and not (tag == "header" and node.inside):
            child.named = 2
        elif tag == "form" or named and tag != "main" and not (tag == "article" and node.inside < 2):
            child.named = 1
        child.place()
        node.parts.append(child)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.rstrip().endswith("/"):
            node = child
        elif attributes.rstrip().endswith("/") and tag not in VOID and tag not in ("svg", "path", "use"):
            node = child  # in HTML a slash closes nothing
    return root


def _ordered(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    return out


def score(root: Node) -> list[Node]:
    """Counts text, links and commas bottom-up, then lets paragraphs pass points upwards."""
    nodes = _ordered(root)
    for node in reversed(nodes):
        own = own_commas = inline = 0
        for x in node.parts:
            if isinstance(x, str):
                k = len(x.strip())
                own, own_commas = own + k, own_commas + x.count(",")
                node.chars, node.commas = node.chars + k, node.commas + x.count(",")
                continue
            node.all_points += x.all_points
            if not x.lost and not x.named:
                node.chars, node.linked, node.links, node.commas = node.chars + x.chars, node.linked + x.linked, node.links + x.links, node.commas + x.commas
                node.points += x.points
                if x.tag not in BLOCK:
                    inline, own_commas = inline + x.chars - x.linked, own_commas + x.commas
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
        if node.tag in _PARAGRAPH and own + inline:
            points, up, level = 1.0 + own_commas + min((own + inline) / 100, 3.0), node if node.tag not in ("p", "li", "td", "dd", "pre", "blockquote", "figcaption") else node.parent, 1
            node.points += points
            node.all_points += points
            while up is not None and level <= LEVELS:
                up.score += points / level
                up, level = None if up.named else up.parent, level + 1
    return nodes


def _link_share(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _worth(node: Node) -> float:
    return node.score * (1 - _link_share(node)) * (1.5 if node.tag in ("article", "main") else 1.0)


def _navigation(node: Node) -> bool:
    """A list of bare links."""
    return (
        node.tag in ("ul", "ol", "dl", "table", "div", "section", "p") and node.links >= LINKS and _link_share(node) > LINK_SHARE
        and node.chars - node.linked < BESIDE * node.links and node.linked < LINK_CHARS * node.links
    )


def _titles(node: Node, stop: Node | None) -> list[Node]:
    """Headings that stand before a node, out to an ancestor, unless that holds other articles too."""
    found: list[list[Node]] = []
    while node is not stop and node.parent is not None:
        beside = [x for x in node.parent.parts if isinstance(x, Node) and not x.dropped and x.chars]
        if any(x is not node and any(y.tag == "article" for y in _ordered(x)) for x in beside):
            break
        found.append([x for x in beside[: beside.index(node)] if x.tag in HEADINGS or x.tag == "header"])
        node = node.parent
    return [x for level in reversed(found) for x in level]


def _spare(root: Node, nodes: list[Node]) -> bool:
    """Lifts the names off the parts around the article; false if there are none.

    They are around an article or main element with more than half of all points, or
    around the best named container if the rest is worth little beside it.
    """
    held = [x for x in nodes if x.tag in ("article", "main") and not x.lost and x.dropped and 2 * x.all_points > root.all_points]
    if not held:
        blocks = [x for x in nodes if not x.lost and x.chars and x.tag in BLOCK]
        plain = max((_worth(x) for x in blocks if not x.dropped), default=0.0)
        best = max((x for x in blocks if x.under == 1), key=_worth, default=None)
        if best is None or NAMED_WORTH * _worth(best) <= plain:
            return False
        held = [best]
    lifted: set[Node] = set()
    for x in held:
        up: Node | None = x
        while up is not None and up not in lifted:
            lifted.add(up)
            up.named, up = 0, up.parent
    for x in nodes:
        x.clear()
        x.place()
    return True


def chosen(root: Node, nodes: list[Node]) -> list[Node]:
    """The article around the best container, in page order."""
    best = max((x for x in nodes if not x.dropped and x.chars and x.tag in BLOCK), key=_worth, default=None)
    if best is None or best is root:
        return [root]
    article = main = None
    up: Node | None = best
    while up is not None:
        article, main = up if up.tag == "article" else article, up if up.tag == "main" else main
        up = up.parent
    if article is not None:
        return [*_titles(article, main or article.parent), article]
    if main is not None:
        return [*_titles(main, main.parent), main]
    whole = best if best.parent is root else best.parent
    while whole.parent is not root and whole.points < NEARLY * root.points:
        whole = whole.parent
    out, bar, before = [], max(2.0, BELONGS * root.points), True
    for x in whole.parent.parts:
        if isinstance(x, Node) and not x.dropped:
            before = before and x is not whole
            if x is whole or x.tag in HEADINGS and before or x.tag in _TEXT and not _navigation(x) or x.tag in BLOCK and x.points * (1 - _link_share(x)) >= bar:
                out.append(x)
    return [*_titles(whole.parent, root), *out]


def text_of(parts: list[Node]) -> str:
    """Blocks of the chosen parts, joined by one line end."""
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        block = " ".join(html.unescape("".join(line)).split())
        if block:
            blocks.append(block)
        line.clear()

    for part in parts:
        todo: list[Node | str | None] = [part]
        while todo:
            x = todo.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif not x.dropped and (x is part or not _navigation(x)):
                if x.tag in BLOCK:
                    end()
                    todo.append(None)
                elif x.tag == "br":
                    line.append(" ")
                todo.extend(reversed(x.parts))
        end()
    return "\n".join(blocks)


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = score(root)
    for _ in range(LIFTS):
        if not _spare(root, nodes):
            break
        score(root)
    return text_of(chosen(root, nodes))


def extract(pages: DataFrame, key: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """key, the columns in `keep`, text and n_chars (code points) of every page."""
    source = pages.select(F.col(key).alias("key"), *[F.col(c).cast("string").alias(f"c{k}") for k, c in enumerate(keep)], F.col(page).cast("string").alias("page"))
    kind = source.schema["key"].dataType.simpleString()
    names = ["key", *[f"c{k}" for k in range(len(keep))]]

    def run(batches):
        for part in _slices(batches):
            texts = [main_text(x) for x in part.column("page").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"])

    out = source.mapInArrow(run, f"key {kind}, " + "".join(f"c{k} string, " for k in range(len(keep))) + "text string, n_chars long")
    return out.toDF(key, *keep, "text", "n_chars")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
