"""Main text of web pages by tree scoring.

A page becomes a tree.  Scripts, menus, headers, footers and hidden parts never count;
elements whose class or id names side matter (a sidebar, comments, an advert) and forms
are left out too, unless nothing would be left.  Each paragraph passes points for its
length and commas, discounted by its share of link text, to its parent, half to the
grandparent and less further up.  The best container stays, with those siblings that
score well or are paragraphs of prose.  Blocks of what stays are joined in page order.

A class that only mentions such a word (`has-sidebar`, `tags-news`) is no verdict: it
costs a container some of its score, and a box of little text or mostly links its place,
but never the element that holds the best container.

Defined results: null and empty html, and pages without text, give the empty text.
Unclosed and stray tags, cut pages and broken references are read as browsers do, in
time linear in the page whatever its nesting.  Ties go to the element that is scored
first in page order.  All rows are kept, repeated ones too; other columns than the three
are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import plain, slices

# HTML's void elements, elements that end an open paragraph, elements that
# hold no article text, words of class, id and role names that mark side matter, words
# that say nothing beside them, and words that turn one into its opposite.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("applet aside audio button canvas datalist dialog embed footer head header iframe input link map math menu meta nav noscript object script select style svg template textarea title video".split())
RAW = frozenset(("script", "style"))
SIDE = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pager paginate pagination pagenav popup promo promoted promotion rail related recommended reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola tags toc toolbar topbar widget widgets".split()
)
PLAIN = frozenset("area article articles bar block body bottom box buttons container content entry form global group holder inner item items left links list main module page panel post posts primary reader reading right row secondary section site small stories story text thread top unit user wrap wrapper".split())
NEGATED = frozenset("has is no non not with without".split())
SIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
MAIN = frozenset(("article", "main"))
PARAGRAPH = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 div section article main body figcaption form".split())
LEAF = frozenset("p pre li td dd figcaption h1 h2 h3 h4 h5 h6".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an open element of each sort is closed by, and the elements that it is not closed across.
SORTS = {
    "p": (frozenset(("p",)), frozenset("button td th table object".split())),
    "item": (frozenset(("li",)), frozenset("ul ol menu".split())),
    "term": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "row": (frozenset(("tr",)), frozenset(("table",))),
    "cell": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
CLOSES = {"li": ("item",), "dt": ("term",), "dd": ("term",), "tr": ("row", "cell"), "td": ("cell",), "th": ("cell",), "option": ("option",)}
SPACE = re.compile(r"\s+")
#: A box that only mentions side matter goes with less text than this, or a larger share of links.
SHORT, LINKS = 200, 1 / 3
NO, WEAK, STRONG, NEVER = 0, 1, 2, 3


class Node:
    __slots__ = ("tag", "side", "parent", "children", "depth", "near", "points", "chars", "linked", "own", "commas", "own_linked")

    def __init__(self, tag: str, parent: Node | None = None, side: int = NO) -> None:
        self.tag, self.parent, self.side, self.children = tag, parent, side, []
        self.depth = parent.depth + 1 if parent else 0
        self.points = self.chars = self.linked = self.own = self.commas = self.own_linked = 0
        near = parent.near if parent else {}
        if any(tag in opens or tag in fence for opens, fence in SORTS.values()):
            near = {k: v for k, v in near.items() if tag not in SORTS[k][1]} | {k: self for k, (opens, _) in SORTS.items() if tag in opens}
        #: the open element of each sort that a new one would close
        self.near = near

    def density(self) -> float:
        return self.linked / max(1, self.chars)


def _named(value: str) -> int:
    """What the names in a class or an id say: side matter, a mention of it, or nothing."""
    found = NO
    for name in value.split():
        parts = [p.rstrip("0123456789") for p in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())]
        parts = [p for p in parts if p]
        if not any(p in SIDE for p in parts) or parts[0] in NEGATED or any(a in NEGATED and b in SIDE for a, b in zip(parts, parts[1:], strict=False)):
            continue
        found = max(found, STRONG if all(p in SIDE or p in PLAIN for p in parts) else WEAK)
    return found


def _side(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    if tag in DROPPED:
        return NEVER
    if tag in ("html", "body"):
        return NO
    found = STRONG if tag == "form" else NO
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return NEVER
        if name == "role" and value.lower() in SIDE_ROLES:
            found = STRONG
        elif name in ("class", "id") and tag not in MAIN:
            found = max(found, _named(value))
    return found


class _Tree(HTMLParser):
    """The tree of a page; every tag costs the same, however deep it stands."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.stack, self.blocks, self.where = [self.root], [0], {}

    def _close_to(self, depth: int) -> None:
        """Closes the open elements from that depth on."""
        while len(self.stack) > depth:
            n = self.stack.pop()
            self.where[n.tag].pop()
            if n.tag in BLOCK:
                self.blocks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for sort in (("p",) if tag in BLOCK else ()) + CLOSES.get(tag, ()):
            if old := self.stack[-1].near.get(sort):
                self._close_to(old.depth)
        node = Node(tag, self.stack[-1], _side(tag, attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.where.setdefault(tag, []).append(node.depth)
            if tag in BLOCK:
                self.blocks.append(node.depth)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if at := self.where.get(tag):
            # an inline element is not closed from within a block inside it
            if tag in BLOCK or at[-1] > self.blocks[-1]:
                self._close_to(at[-1])

    def handle_data(self, data: str) -> None:
        if self.stack[-1].tag not in RAW:
            self.stack[-1].children.append(data)


def _measured(root: Node, out: int) -> list[Node]:
    """Elements in page order without those whose side is `out` or more, with their text and link text, and with the text of no block inside them."""
    order: list[Node] = []
    todo: list[tuple[Node, Node, bool]] = [(root, root, False)]
    while todo:
        n, host, in_link = todo.pop()
        host, in_link = (n if n.tag in BLOCK else host), in_link or n.tag == "a"
        n.points = n.chars = n.linked = n.own = n.commas = n.own_linked = 0
        order.append(n)
        for c in reversed(n.children):
            if not isinstance(c, str):
                if c.side < out:
                    todo.append((c, host, in_link))
            elif k := len(SPACE.sub(" ", c).strip()):
                n.chars += k
                host.own += k
                host.commas += c.count(",")
                if in_link:
                    n.linked += k
                    host.own_linked += k
    for n in reversed(order):
        if n.parent is not None:
            n.parent.chars += n.chars
            n.parent.linked += n.linked
    return order


def _blocks(roots: list[Node], out: int, gone: set[int] | frozenset[int] = frozenset()) -> list[str]:
    texts: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := SPACE.sub(" ", "".join(run)).strip():
            texts.append(text)
        run.clear()

    todo: list[Node | str | None] = list(reversed(roots))
    while todo:
        n = todo.pop()
        if n is None:
            flush()
        elif isinstance(n, str):
            run.append(n)
        elif n.tag == "br":
            run.append(" ")
        elif n.side < out and id(n) not in gone:
            if n.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(n.children))
    flush()
    return texts


def _final(n: Node) -> float:
    """A container's score."""
    part = 0.5 if n.tag in ("ul", "ol", "table", "body", "html") else 1
    return (n.points + (10 if n.tag in MAIN else 0)) * (1 - n.density()) * part * (0.5 if n.side else 1)


def _scored(order: list[Node]) -> list[Node]:
    """The containers that paragraphs gave points to."""
    found = []
    for n in order:
        if n.tag not in PARAGRAPH or not n.own:
            continue
        points = (1 + n.commas + min(n.own / 100, 3.0)) * (1 - n.own_linked / n.own) * (1.0 if n.own >= 25 else 0.2)
        share, up = 1.0, n.parent if n.tag in LEAF and n.parent else n
        for level in range(4):
            if up is None or up.tag == "#root":
                break
            up.points += points * share
            found.append(up)
            up, share = up.parent, 0.5 if level == 0 else share * 0.6
    return found


def _extracted(root: Node, out: int) -> list[str]:
    order = _measured(root, out)
    scored = _scored(order)
    if not scored:
        return _blocks([root], out)
    best = max(scored, key=_final)
    # an article that was found by one of its parts is taken as a whole
    around, up = set(), best
    while up is not None:
        around.add(id(up))
        if up.tag in MAIN:
            best = up
        up = up.parent
    gone = {id(n) for n in order if n.side and id(n) not in around and (n.chars < SHORT or n.density() > LINKS)}
    if best.tag in MAIN or best.parent is None or best.tag in ("body", "html"):
        return _blocks([best], out, gone)
    least, kept = 0.2 * _final(best), []
    for c in best.parent.children:
        if isinstance(c, str) or c.side >= out or id(c) in gone:
            continue
        prose = c.tag == "p" and c.chars >= 25 and c.density() < 0.25
        heading = c.tag in HEADING and c.density() < 0.25
        if c is best or prose or heading or (c.points and _final(c) >= least):
            kept.append(c)
    return _blocks(kept, out, gone)


def main_text(html: str | None) -> str:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    texts = _extracted(tree.root, STRONG)
    if max(map(len, texts), default=0) < 25:
        # names of side matter are believed only if they leave a sentence
        more = _extracted(tree.root, NEVER)
        if max(map(len, more), default=0) >= 25 or not texts:
            texts = more
    return "\n\n".join(texts)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in slices(plain(b.column(2)), 4 << 20):
                got = [main_text(x) for x in part.to_pylist()]
                yield pa.record_batch([b.column(0).slice(first, len(part)), b.column(1).slice(first, len(part)), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long"), "url", "html").mapInArrow(work, "page_id long, url string, text string, n_chars long")


def op6(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
