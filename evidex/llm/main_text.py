"""The main text of web pages by tree scoring.

A page becomes a tree.  What is no content by its tag, role or name (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, reader comments) is cut first, unless it holds the
article itself; for its name, its heading or as a form only where it holds a small part of the
page's paragraphs, else it loses points.  Every block of text passes points for its length and commas to its ancestors,
fewer with every step up; a container's points are discounted by the share of its text that is
inside links.  The best container is kept, widened to the article and main elements around it.
Without a main element all that is not cut beside and around it stays too, but for menus and
doubtful names that score low.  The blocks, in page order, are the text.

Pages are independent: a projection over Arrow batches, without a shuffle.

Defined results: a null or empty page has an empty text; repeated rows are answered each; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
NO_CONTENT = frozenset(
    "head title script style noscript template nav footer aside form button select option textarea input iframe frame object embed "
    "svg canvas audio video dialog menu map math datalist".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
# Opening one of these ends an open one of those, up to the named parents.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)), "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)),
}
HOLDERS = frozenset("html body main article".split())
BONUS = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 3.0, "td": 1.0, "blockquote": 1.0, "body": 0.0}
# Words in class names and ids of what is no content.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall sidebar "
    "sidebars rail related recommended recommendations share sharing social comment comments commentlist disqus respond replies "
    "discussion breadcrumb breadcrumbs menu menus nav navbar navigation footer header masthead topbar toolbar pagination pager "
    "widget widgets login search skip toc outbrain taboola".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
TITLES = re.compile(
    r"\s*(?:\d+\s+)?(?:reader\s+)?(?:comments?|responses|replies|leave a (?:reply|comment)|related(?: \w+)?|advertisement|share this|"
    r"you may also like|subscribe)(?:\s*\(\d+\))?\s*:?\s*", re.I,
)
# Headings that sections of an article have as well.
MAYBE = re.compile(r"\s*(?:\d+\s+)?(?:comments?|responses|replies|related work)\s*:?\s*", re.I)
READERS = frozenset("comment comments commentlist disqus respond replies".split())
# An element goes for its name, heading or form tag if it holds less than this share of the page's paragraphs:
# SURE for what readers wrote; UNSURE for other names, or MUCH where its paragraphs are shorter than SOME.
SURE, UNSURE, MUCH, SOME = 0.9, 0.1, 0.3, 200
PENALTY = 0.5  # on the points of an element that was kept in spite of its name
LONG = 80  # loose text from here on is a paragraph in any block
MENU = 0.5  # share of links of a block beside the article that is a menu
TITLED = 25  # characters a link: from here on a list of links names sources
SOURCES = re.compile(
    r"\s*(?:\d+\.?\s+)?(?:references|sources|bibliography|(?:foot)?notes|citations|works cited|further reading|literature|external links|see also|"
    r"quellen|literatur|einzelnachweise|weblinks|références|liens externes|bibliographie|fuentes|referencias|bibliografía|enlaces externos)\s*:?\s*", re.I,
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "cut", "points", "size", "linked", "links", "commas", "holds", "prose", "doubted", "listed",
                 "inner", "prior", "last")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.cut, self.points, self.size, self.linked, self.links, self.commas, self.holds = False, 0.0, 0, 0, 0, 0, False
        self.prose, self.doubted, self.listed = 0, False, False
        self.inner = parent is not None and (parent.inner or parent.tag in ("article", "main"))
        self.prior, self.last = parent.last if parent is not None else None, None
        if parent is not None:
            parent.last = self


class Tree(HTMLParser):
    """Nodes in page order; text is in the children lists."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {}, None)
        self.nodes, self.open = [self.root], [self.root]
        self.endless: set[str] = set()  # beginnings of comments and sections whose end the page has not

    def _end(self, tags: tuple[str, ...], parents: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return self._end(tags, parents)
            if self.open[i].tag in parents:
                return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._end(("p",), ("table", "button", "td", "div", "article", "section"))
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open[-1])
        self.open[-1].children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)

    def parse_comment(self, i, report=1):
        """A comment without an end is text; an end that is nowhere is not looked for again."""
        end = -1 if "<!--" in self.endless else super().parse_comment(i, report)
        if end < 0:
            self.endless.add("<!--")
        return end

    def parse_marked_section(self, i, report=1):
        """A section the parser does not know (``<![foo[``) is a comment up to the next ``>``."""
        kind = self.rawdata[i : i + 6].lower()
        try:
            end = -1 if kind in self.endless else super().parse_marked_section(i, report)
        except AssertionError:
            return self.rawdata.find(">", i) + 1 or -1
        if end < 0:
            self.endless.add(kind)
        return end

    def read(self, html: str) -> None:
        """The whole page; nothing after its last ``>`` is markup."""
        end = html.rfind(">") + 1
        self.feed(html[:end])
        self.close()
        if html[end:] and not self.cdata_elem:
            self.handle_data(unescape(html[end:]))


def _names(node: Node) -> set[str]:
    said = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    return {w.lower() for w in WORD.findall(said)} if said != " " else set()


def _is_boilerplate(node: Node) -> bool:
    """What goes whatever it holds: by tag, hidden, or by role."""
    attrs = node.attrs
    if node.tag in HOLDERS:
        return False
    if node.tag in NO_CONTENT - {"form"} or node.tag == "header":
        return True
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    return attrs.get("role", "").lower() in ROLES - {"form"}


def _first(node: Node) -> Node | None:
    first = next((c for c in node.children if isinstance(c, Node) or c.strip()), None)
    return first if isinstance(first, Node) else None


def _doubt(node: Node) -> float:
    """The share of the page's paragraphs below which an element goes for its name or heading; 0 if neither says so."""
    if node.tag in HOLDERS:
        return 0.0
    names = _names(node) & NAMES
    if names & READERS:
        return SURE
    first = _first(node) if node.tag in ("section", "div") else None
    title = _text([first]) if first is not None and first.tag in ("h2", "h3", "h4", "h5", "h6") else ""
    if TITLES.fullmatch(title):
        return UNSURE if MAYBE.fullmatch(title) else SURE
    return UNSURE if names or node.tag == "form" or node.attrs.get("role", "").lower() == "form" else 0.0


def _measure(nodes: list[Node]) -> None:
    """Text sizes, commas and links below every node that is not cut, from the leaves up."""
    for node in reversed(nodes):
        node.size, node.linked, node.links, node.commas = 0, 0, 0, 0
        if node.cut:
            continue
        for child in node.children:
            if isinstance(child, str):
                size = len(" ".join(child.split()))
                node.size += size
                node.commas += child.count(",")
            elif not child.cut:
                node.size += child.size
                node.commas += child.commas
                node.linked += child.linked
                node.links += child.links
        if node.tag == "a":
            node.linked, node.links = node.size, node.links + 1


def _prose(nodes: list[Node]) -> None:
    """Text outside links in the paragraphs below every node; on a page without paragraphs, all text outside links."""
    for node in reversed(nodes):
        node.prose = 0
        if node.cut:
            continue
        loose = 0
        for child in node.children:
            if isinstance(child, str):
                loose += len(" ".join(child.split()))
            elif not child.cut:
                node.prose += child.prose
                loose += child.size - child.linked if child.tag in INLINE else 0
        if node.tag not in INLINE and (node.tag in ("p", "pre", "blockquote") or loose >= LONG):
            node.prose += loose
    if not nodes[0].prose:
        for node in nodes:
            node.prose = 0 if node.cut else node.size - node.linked


def _pass_down(nodes: list[Node]) -> None:
    for node in nodes[1:]:
        node.cut = node.cut or node.parent.cut


def _cut(nodes: list[Node]) -> None:
    for node in reversed(nodes):
        node.holds = node.tag in ("article", "main", "h1") or any(c.holds for c in node.children if isinstance(c, Node) and not c.cut)
        inside = node.tag == "header" and any(a.tag in ("article", "main") for a in _above(node))
        if _is_boilerplate(node) and not (node.holds and node.tag not in NO_CONTENT and (node.tag != "header" or inside)):
            node.cut = True
    _pass_down(nodes)
    _measure(nodes)
    _prose(nodes)
    total = nodes[0].prose
    for node in nodes:
        least = 0.0 if node.cut or node.holds else _doubt(node)
        if least:
            some = least == UNSURE and node.prose >= SOME and node.prose >= UNSURE * total
            node.cut = not (some or node.prose and node.prose >= max(least, MUCH) * total)
            node.doubted = not node.cut
    _pass_down(nodes)


def _above(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def _blocks(tops: list[Node]) -> list[str]:
    """The texts of the blocks below, in page order."""
    blocks, run = [], []

    def close() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    todo: list = list(reversed(tops))
    while todo:
        item = todo.pop()
        if item is None:
            close()
        elif isinstance(item, str):
            run.append(item)
        elif item.tag == "br":
            run.append(" ")
        elif not item.cut:
            if item.tag not in INLINE:
                close()
                todo.append(None)
            todo.extend(reversed(item.children))
    close()
    return blocks


def _text(tops: list[Node]) -> str:
    return " ".join(_blocks(tops))


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _best(nodes: list[Node]) -> Node:
    for node in nodes:
        if node.cut or node.tag in INLINE:
            continue
        loose = sum(len(" ".join(c.split())) for c in node.children if isinstance(c, str))
        loose += sum(c.size for c in node.children if isinstance(c, Node) and c.tag in INLINE and not c.cut)
        if not loose or node.tag in ("root", "html", "li"):
            continue
        points = (min(loose / 100, 3.0) + min(node.commas, 10) * (loose / max(1, node.size))) * (1 - _density(node))
        share = 1.0 if node.tag in ("p", "pre", "h1", "h2", "h3", "blockquote") else 0.5
        if share < 1:
            node.points += points * share
        for step, above in enumerate(_above(node)):
            above.points += points * share / (1, 2, 6, 9, 12)[min(step, 4)]
            if step == 4:
                break
    held = [n for n in nodes if not n.cut and n.size and n.tag in BONUS]
    if not held:
        return nodes[0]
    return max(held, key=_score)


def _score(node: Node) -> float:
    return (node.points + BONUS.get(node.tag, 0.0)) * (1 - _density(node)) * (PENALTY if node.doubted else 1.0)


def _names_sources(node: Node) -> bool:
    """Whether a list of links belongs to the text: led in as sources, or in running text numbered, long-titled or led in."""
    if node.tag not in ("ul", "ol"):
        return False
    before = node.prior
    while before is not None and (before.cut or not before.size):
        before = before.prior
    lead = _text([before]) if before is not None and (before.tag in HEADINGS or before.tag == "p") else ""
    if lead and before.tag in HEADINGS and SOURCES.fullmatch(lead):
        return True
    if not node.inner and node.parent.prose < node.size:
        return False
    led = lead.endswith(":") if before is not None and before.tag == "p" else lead and not TITLES.fullmatch(lead)
    return bool(node.tag == "ol" or led or node.linked >= TITLED * node.links)


def _cut_menus(nodes: list[Node]) -> None:
    """Menus without a name; a list of sources and what is around it stay."""
    for node in reversed(nodes[1:]):
        if node.cut:
            continue
        dense = node.tag in ("ul", "ol", "div", "section", "table", "p") and node.links >= 3 and _density(node) > 0.8 and not node.holds
        node.listed = node.listed or dense and _names_sources(node)
        node.parent.listed = node.parent.listed or node.listed
        node.cut = dense and not node.listed
    _pass_down(nodes)


def _cut_beside(best: Node) -> None:
    """Cut the menus beside ``best`` and beside what is around it, and doubtful elements of few points; the rest of the page stays."""
    least = max(3.0, 0.2 * _score(best))
    here = best
    while here.parent is not None:
        run: list[int] = []
        around = here.parent.children
        for i, child in enumerate([*around, None]):
            if isinstance(child, str) or child is not None and child is not here and child.tag in INLINE:
                run.append(i)
                continue
            held = [around[j] for j in run]
            size = sum(len(" ".join(c.split())) if isinstance(c, str) else c.size for c in held)
            if sum(c.linked for c in held if isinstance(c, Node)) > MENU * size:
                for j in run:
                    around[j] = ""
            run = []
            if child is not None and child is not here and not child.cut:
                menu = child.tag not in HEADINGS and not child.listed and not child.holds and _density(child) > MENU
                child.cut = menu or child.doubted and _score(child) < least
        here = here.parent


def main_text(html: str | None) -> str:
    """The blocks of the article of a page, joined by an empty line."""
    if not html:
        return ""
    tree = Tree()
    tree.read(html)
    nodes = tree.nodes
    _cut(nodes)
    _measure(nodes)
    _cut_menus(nodes)
    best = _best(nodes)
    best = next((a for a in _above(best) if a.tag == "article"), best)
    best = next((a for a in _above(best) if a.tag == "main" or a.attrs.get("role") == "main"), best)
    if best.tag == "main" or best.attrs.get("role") == "main":
        return "\n\n".join(_blocks([best]))
    _cut_beside(best)
    return "\n\n".join(_blocks([nodes[0]]))


def extract(pages: DataFrame) -> DataFrame:
    """(``page_id``, ``url``, ``text``, ``n_chars``) of every page."""
    schema = pages.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("bigint").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).mapInArrow(run, schema)
