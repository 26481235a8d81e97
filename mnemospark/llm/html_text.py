"""Main text of web pages: paragraphs pass points to their ancestors, the best container is kept."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import slices

#: Comments, sections, declarations and tags. A tag ends at >, or where the next one begins or the page
#: ends; nothing is read twice, whatever is left open.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)(?:>|(?=<)|\Z)", re.S)
SPACE = re.compile(r"\s+")
ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")

#: Elements whose content is markup or code, to their end tag.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea select title".split())
#: Elements that never hold article text.
ASIDE = frozenset("nav header footer aside form button dialog menu head".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block before and after them.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a new one of the same group closes, where the writer left out the end tag, and up to which ancestor.
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
#: Words in a class, id or role that mark what is beside the article.
UNWANTED = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|byline|comments?|consent|cookies?|disqus|footer|header|legal|masthead|menu|modal|nav\w*|newsletter|notices?|pagination|pager|popup|promo\w*|related|replies|respond|share\w*|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget|navigation|complementary|contentinfo|search)(?:$|[\s_-])", re.I)
WANTED = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    unwanted: bool
    bonus: float
    score: float = 0.0
    chars: int = 0
    linked: int = 0
    children: list = field(default_factory=list)  # nodes, and the numbers of blocks


@dataclass(slots=True)
class Block:
    node: Node
    text: list = field(default_factory=list)
    linked: int = 0


class Path:
    """The open elements from the page down to the one that is read. Where the nearest one of a tag
    is open is known without a walk, so deep pages cost no more than flat ones."""

    def __init__(self):
        self.nodes = [Node("", None, False, 0.0)]
        self.at: dict[str, list[int]] = {}

    def nearest(self, tags: list[str]) -> int:
        """The depth of the innermost open element with one of the tags; 0 where none is open."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, depth: int) -> None:
        while len(self.nodes) > depth:
            self.at[self.nodes.pop().tag].pop()

    def open(self, tag: str, bad: bool, bonus: float) -> Node:
        up = self.nodes[-1]
        node = Node(tag, up, up.unwanted or bad, bonus)
        up.children.append(node)
        self.at.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        return node


def parse(html: str) -> tuple[list[Node], list[Block]]:
    """The block elements of a page, each after the one around it, and its blocks of text in page order."""
    path, blocks, block, links, at = Path(), [], None, 0, 0
    nodes = [path.nodes[0]]

    def text(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        s = unescape(raw)
        if block is None:
            if s.isspace():
                return
            block = Block(path.nodes[-1])
            block.node.children.append(len(blocks))
            blocks.append(block)
        block.text.append(s)
        if links:
            block.linked += len(s.strip())

    for m in TOKEN.finditer(html):
        if m.start() < at:
            continue
        text(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        if not m["tag"]:
            continue
        tag, end = m["tag"].lower(), m["end"]
        if tag in RAW and not end:
            if not m["attrs"].rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(html, at)
                at = close.end() if close else len(html)
            continue
        if tag == "br":
            text(" ")
        elif tag == "a":
            links = 0 if end else 1
        elif tag in BLOCK or tag in ASIDE:
            block = None
            if end:
                if depth := path.nearest([tag]):
                    path.close(depth)
                    links = 0
                continue
            if tag in VOID:
                continue
            if tag in IMPLIED:
                closes, until = (x.split() for x in IMPLIED[tag])
                depth = path.nearest(closes)
                if depth > path.nearest(until):
                    path.close(depth)
            while (open_ := path.nodes[-1].tag) == "p" or (open_[:1] == "h" and open_[1:].isdigit()):
                path.close(len(path.nodes) - 1)  # a block ends an open paragraph or heading
            attrs = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m["attrs"])} if m["attrs"].strip() else {}
            names = " ".join(attrs.get(k, "") for k in ("class", "id", "role"))
            hidden = "hidden" in m["attrs"].lower().split() or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            bad = tag in ASIDE or hidden or (tag not in ("html", "body", "article", "main") and bool(UNWANTED.search(names)))
            nodes.append(path.open(tag, bad, 25.0 if tag in ("article", "main") or WANTED.search(names) else 0.0))
    text(html[at:])
    return nodes, blocks


def main_text(html: str, least: int = 25) -> str:
    """The article of a page: its blocks, white space single and trimmed, joined by two line feeds.

    Blocks in menus, headers, footers, forms, adverts, comments and the like have no part. Each other
    block of at least least characters passes 1 point, 1 for each comma and 1 for each hundred
    characters (3 at most) to its container, half of that to the next, a third to the one above. A
    container's points are discounted by the share of its characters that are in links. The best
    container is kept whole, with the siblings that have a fifth of its points, and paragraphs
    among the siblings that are long and hardly linked. Where no block has points, all are kept.
    Equal points: the container that comes first."""
    nodes, blocks = parse(html)
    texts = [SPACE.sub(" ", "".join(b.text)).strip() for b in blocks]
    scored: dict[int, Node] = {}
    usable = [bool(t) and not b.node.unwanted for b, t in zip(blocks, texts, strict=True)]
    for b, t, ok in zip(blocks, texts, usable, strict=True):
        if not ok:
            continue
        b.node.chars += len(t)
        b.node.linked += min(b.linked, len(t))
        if len(t) < least:
            continue
        points = (1 + sum(map(t.count, ",،、，")) + min(len(t) // 100, 3)) * (1 - min(b.linked / len(t), 1))
        up = b.node if b.node.tag in ("article", "main", "section", "div", "body", "td", "") else b.node.parent
        for level in range(1, 4):
            if up is None:
                break
            if id(up) not in scored:
                up.score = up.bonus
                scored[id(up)] = up
            up.score += points / level
            up = up.parent
    for n in reversed(nodes[1:]):  # from the inside out: each has what is within it by then
        n.parent.chars += n.chars
        n.parent.linked += n.linked
    if not scored:
        return "\n\n".join(t for t, ok in zip(texts, usable, strict=True) if ok)

    def final(n: Node) -> float:
        return n.score * (1 - n.linked / max(n.chars, 1))

    best = max(scored.values(), key=final)
    keep: set[int] = set()

    def take(n: Node) -> None:
        todo = [n]
        while todo:
            x = todo.pop()
            for c in x.children:
                if isinstance(c, int):
                    keep.add(c)
                else:
                    todo.append(c)

    take(best)
    floor = max(10.0, final(best) / 5)
    for c in best.parent.children if best.parent else []:
        if isinstance(c, int):
            if len(texts[c]) >= 80 and blocks[c].linked < len(texts[c]) / 4:
                keep.add(c)
        elif c is not best and not c.unwanted:
            long = c.tag == "p" and c.chars >= 80 and c.linked < c.chars / 4
            heading = c.tag in ("h1", "h2") and c.chars > 0
            if long or heading or (id(c) in scored and final(c) >= floor):
                take(c)
    return "\n\n".join(texts[i] for i in sorted(keep) if usable[i])


def extract(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The keep columns and text of each page: its main text, empty where it has none.

    Null and empty pages give empty texts; pages of any length are read whole; broken markup is
    read as far as it goes. Repeated rows and null keys keep their rows; an empty table gives none;
    other columns are ignored. Nothing is shuffled."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "_html"):
            texts = [main_text(h or "") for h in s.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(s.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    rows = pages.select(*keep, F.col(html).cast("string").alias("_html"))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_html")
    return rows.mapInArrow(apply, f"{ddl}, text string")
