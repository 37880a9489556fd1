"""HTML extraction by layout-aware rendering: all visible text, as laid out in blocks.

A tree builder reads tags with one compiled pattern, closes and inserts what HTML implies (p before blocks,
li, dt/dd, option, table sections, rows and cells), tolerates misnesting and ends raw-text elements at their
own end tags. A renderer walks the visible tree: white space collapses outside pre, blocks start lines,
paragraph-like blocks are set off by an empty line, lists get markers and hanging indents, table cells are
aligned in columns (colspan and rowspan kept) in tables of every size: a cell with others to its right is broken
into lines of CELL_WIDTH between words, so padding stays small. A word is never cut, it pushes its own line aside.
Columns in which no cell begins take no place. A table whose padding would be over MOST_PADDING times its text, cells
and lines has its cells set off by bars without padding, so the text stays within a fixed multiple of the html.

Invisible: head matter, script, style, template, noscript, embedded media's fallbacks, comments, elements with
the hidden attribute or display:none, dialogs that aren't open, details that aren't open but for their summary. Text
under visibility:hidden or collapse is, unless an element between says visibility:visible.

Cases: null html gives a null text, empty html an empty one; unclosed or unknown tags are tolerated, in time linear
in the tags however deep they nest; elements nested deeper than MAX_DEPTH (which bounds indentation) are laid out as if
at that depth, with all their text; repeated ids are rendered row by row; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import ready, table

MAX_DEPTH = 120
#: A column is padded to so many places at most; cells with others to their right are broken there.
CELL_WIDTH = 100
#: Places of padding in a table for each character of text, cell and line.
MOST_PADDING = 200
#: HTML's own largest spans.
COLSPAN, ROWSPAN = 1000, 65534

_TAG = re.compile(r"<(?:!--(?P<c>.*?)(?:-->|\Z)|(?P<decl>[!?][^>]*)>|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>[^>\"']*+(?:\"[^\"]*+\"[^>\"']*+|'[^']*+'[^>\"']*+)*+)>)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNSEEN_STYLE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>", re.I) for n in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template")}

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes meta link base object video audio canvas map datalist rp".split())
#: Blocks set off by an empty line, and those that only start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset xmp hr menu".split())
PLAIN = frozenset("address article aside body details dialog div dt dd footer form header hgroup html legend li main nav section summary center figcaption caption tr td th thead tbody tfoot option optgroup search textarea".split())
BLOCKS = SPACED | PLAIN
ENDS_P = (SPACED | frozenset("address article aside details dialog div dl footer form header hgroup main nav section center figcaption search".split())) - {"caption"}
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
#: tag: (open tags that it closes, tags at which the search stops)
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (frozenset(("tr", "caption", "colgroup")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), frozenset(("table",))),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",))),
}


class Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if raw and not raw.isspace():
        for k, v in _ATTR.findall(raw):
            out.setdefault(k.lower(), html.unescape(v.strip("\"'")) if v else "")
    return out


class Open:
    """The elements that are open, and where each tag is among them, so none is looked for from the top down."""

    def __init__(self, root: Node):
        self.nodes: list[Node | None] = [root]  # None: closed before those that were opened in it
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.top.kids.append(node)
        self.at.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCKS:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        return node

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags; 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Close the element at a place, and all that were opened in it."""
        while len(self.nodes) > place or self.nodes[-1] is None:
            node = self.nodes.pop()
            if node is not None:
                self.at[node.tag].pop()
                if node.tag in BLOCKS:
                    self.blocks.pop()

    def pop(self) -> None:
        if len(self.nodes) > 1:
            self.cut(len(self.nodes) - 1)

    def close(self, names: frozenset, stop: frozenset) -> None:
        """Close the innermost element of names, unless one of stop is within it."""
        place = self.last(names)
        if place > self.last(stop - names):
            self.cut(place)

    def end(self, name: str) -> None:
        """An end tag: closes to its element; an inline one that blocks have been opened in is only taken off."""
        place = self.last((name,))
        wall = _ROW_WALL if name in _TABLE_PARTS else _WALL
        if not place or place < self.last(wall - {name}):
            return
        if name in BLOCKS or not (self.blocks and self.blocks[-1] > place):
            self.cut(place)
        else:
            self.at[name].pop()
            self.nodes[place] = None


_TABLE_PARTS = frozenset(("table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "body", "html"))
_WALL, _ROW_WALL = frozenset(("td", "th", "table", "caption", "button")), frozenset(("table",))
_P, _P_STOP = frozenset(("p",)), frozenset(("td", "th", "table", "button", "caption"))


def build(source: str) -> Node:
    """The element tree. Text is a str among the kids."""
    root = Node("#root", {})
    opened = Open(root)
    push, close = opened.push, opened.close
    at, find = 0, _TAG.search
    while True:
        m = find(source, at)
        if m is None:
            if at < len(source):
                opened.top.kids.append(html.unescape(source[at:]))
            return root
        if m.start() > at:
            text = source[at : m.start()]
            opened.top.kids.append(html.unescape(text) if "&" in text else text)
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "br":
                opened.top.kids.append(Node("br", {}))
            elif name == "p" and not opened.last(_P):
                opened.top.kids.append(Node("p", {}))
            else:
                opened.end(name)
            continue
        raw = m["attrs"]
        attrs = attributes(raw)
        if name in ENDS_P:
            close(_P, _P_STOP)
        rule = CLOSES.get(name)
        if rule is not None:
            close(*rule)
            if name in ("td", "th"):
                if opened.top.tag == "table":
                    push("tbody", {})
                if opened.top.tag in SECTIONS:
                    push("tr", {})
            if name == "tr" and opened.top.tag == "table":
                push("tbody", {})
            elif name == "tr":
                close(frozenset(("td", "th", "tr")), frozenset(("table", *SECTIONS)))
        if name in ("h1", "h2", "h3", "h4", "h5", "h6") and opened.top.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            opened.pop()
        if name == "body" and opened.top.tag == "head":
            opened.pop()
        if opened.top.tag == "head" and name not in UNSEEN:
            opened.pop()  # content ends an unclosed head
        if name in VOID:
            opened.top.kids.append(Node(name, attrs))
            continue
        if name in _RAW:
            end = _RAW[name].search(source, at)
            node = Node(name, attrs)
            inner = source[at : end.start() if end else len(source)]
            node.kids.append(html.unescape(inner) if name in ("textarea", "title") else inner)
            opened.top.kids.append(node)
            at = end.end() if end else len(source)
            continue
        push(name, attrs)


def unhidden(root: Node) -> Node:
    """The tree without the text under visibility:hidden, where no element between is visible again, and without what
    closed details hold besides their summary."""
    work = [(root, True)]
    while work:
        node, shown = work.pop()
        if node.tag == "details" and "open" not in node.attrs:
            node.kids = [k for k in node.kids if isinstance(k, Node) and k.tag == "summary"][:1]
        kids = []
        for kid in node.kids:
            if isinstance(kid, str):
                if shown:
                    kids.append(kid)
                continue
            said = _VISIBILITY.findall(kid.attrs.get("style", ""))
            seen = said[-1].lower() == "visible" if said else shown
            if seen or kid.kids:
                kids.append(kid)
                work.append((kid, seen))
        node.kids = kids
    return root


def visible(node: Node) -> bool:
    if node.tag in UNSEEN:
        return False
    a = node.attrs
    if not a:
        return node.tag != "dialog"
    if "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False
    style = a.get("style")
    return not (style and _UNSEEN_STYLE.search(style))


def width_of(s: str) -> int:
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Block:
    """Lines laid out so far, and the line under way."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = False
        self.blank_due = False

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s == " " or s == "":
            self.gap = self.gap or bool(s)
            return
        if s[0] == " ":
            self.gap = True
        if self.gap and self.line:
            self.line.append(" ")
        self.line.append(s.strip(" "))
        self.gap = s[-1] == " "

    def verbatim(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        if first:
            self.line.append(first)
        for r in rest:
            self._put("".join(self.line).rstrip())
            self.line = [r] if r else []

    def _put(self, s: str) -> None:
        if self.blank_due and self.lines:
            self.lines.append("")
        self.blank_due = False
        self.lines.append(s)

    def flush(self) -> None:
        if self.line:
            self._put("".join(self.line).rstrip())
            self.line = []
        self.gap = False

    def newline(self) -> None:
        if self.line:
            self.flush()
        elif self.lines and self.lines[-1] != "":
            self._put("")

    def space(self) -> None:
        self.flush()
        self.blank_due = bool(self.lines)

    def add(self, lines: list[str]) -> None:
        self.flush()
        for s in lines:
            self._put(s)

    def done(self) -> list[str]:
        self.flush()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


def lay_out(node: Node, out: Block, depth: int, pre: bool = False) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            out.verbatim(kid) if pre else out.text(kid)
            continue
        tag = kid.tag
        if tag == "br":
            out.newline()
            continue
        if not visible(kid):
            continue
        if depth >= MAX_DEPTH:
            _flat(kid, out)
        elif tag == "table":
            out.space()
            lines = _table(kid, depth + 1)
            out.add(lines)
            out.space()
        elif tag in ("ul", "ol", "menu"):
            out.space() if depth == 0 or node.tag not in ("li",) else out.flush()
            out.add(_list(kid, depth + 1))
            out.space() if node.tag != "li" else out.flush()
        elif tag in ("pre", "xmp"):
            out.space()
            inner = Block()
            lay_out(kid, inner, depth + 1, True)
            lines = inner.done()
            out.add(lines[1:] if lines and not lines[0] else lines)
            out.space()
        elif tag == "hr":
            out.space()
        elif tag in ("blockquote", "dd"):
            out.space() if tag == "blockquote" else out.flush()
            inner = Block()
            lay_out(kid, inner, depth + 1, pre)
            out.add(["  " + s if s else "" for s in inner.done()])
            out.space() if tag == "blockquote" else out.flush()
        elif tag in SPACED:
            out.space()
            lay_out(kid, out, depth + 1, pre)
            out.space()
        elif tag in PLAIN:
            out.flush()
            lay_out(kid, out, depth + 1, pre)
            out.flush()
        elif tag == "img" or tag in VOID:
            continue
        elif tag == "q":
            out.text('"')
            lay_out(kid, out, depth + 1, pre)
            out.text('"')
        else:
            lay_out(kid, out, depth + 1, pre)


def _flat(node: Node, out: Block) -> None:
    """Everything below a node, without recursion: blocks only start lines."""
    work: list = [node]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.text(x)
        elif x is None or x.tag == "br":
            out.flush()
        elif visible(x):
            if x.tag in BLOCKS:
                out.flush()
                work.append(None)
            work.extend(reversed(x.kids))


def _list(node: Node, depth: int) -> list[str]:
    out: list[str] = []
    number = node.attrs.get("start", "1")
    number = int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1
    loose = Node("li", {})
    items: list[Node] = []
    for kid in node.kids:
        if isinstance(kid, Node) and kid.tag == "li":
            items.append(kid)
        elif isinstance(kid, Node) or not kid.isspace():
            if not items or items[-1] is not loose:
                loose = Node("#loose", {})
                items.append(loose)
            loose.kids.append(kid)
    for item in items:
        if not visible(item):
            continue
        block = Block()
        lay_out(item, block, depth)
        lines = block.done()
        if item.tag == "#loose":
            out += ["  " + s if s else "" for s in lines]
            continue
        value = item.attrs.get("value", "")
        if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", value):
            number = int(value)
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        if lines:
            out.append(mark + lines[0])
            out += [" " * len(mark) + s if s else "" for s in lines[1:]]
    return out


def _span(node: Node, name: str, most: int) -> int:
    v = node.attrs.get(name, "").strip()
    if not (v.isascii() and v.isdigit()):
        return 1
    v = v.lstrip("0")
    return min(most, int(v[:6])) if v else most if name == "rowspan" else 1


def _broken(lines: list[str]) -> list[str]:
    """lines, those over CELL_WIDTH broken at single spaces; spaces beside others stay as they are."""
    out: list[str] = []
    for s in lines:
        if width_of(s) <= CELL_WIDTH:
            out.append(s)
            continue
        now, room = "", 0
        for k, word in enumerate(s.split(" ")):
            w = width_of(word)
            if k and now.strip(" ") and word and room + 1 + w > CELL_WIDTH:
                out.append(now)
                now, room = word, w
            else:
                now, room = (now + " " + word, room + 1 + w) if k else (word, w)
        out.append(now)
    return out


def _table(node: Node, depth: int) -> list[str]:
    before, rows = Block(), []

    def collect(parent: Node) -> None:
        for kid in parent.kids:
            if isinstance(kid, str):
                if not kid.isspace():
                    before.text(kid)  # text between cells is laid out before its table
            elif not visible(kid):
                continue
            elif kid.tag == "tr":
                rows.append([c for c in kid.kids if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)])
                for c in kid.kids:
                    if isinstance(c, str):
                        if not c.isspace():
                            before.text(c)
                    elif c.tag not in ("td", "th") and visible(c):
                        _flat(c, before)
            elif kid.tag in SECTIONS:
                collect(kid)
            elif kid.tag == "caption":
                before.flush()
                lay_out(kid, before, depth)
                before.flush()
            elif kid.tag not in ("colgroup", "col"):
                before.flush()
                lay_out(_wrap(kid), before, depth)
                before.flush()

    collect(node)
    grid: list[list[tuple[int, int, list[str]]]] = []
    busy: list[tuple[int, int, int]] = []  # columns from, to, and the row after the last one that they are taken in
    for r, row in enumerate(rows):
        busy = [x for x in busy if x[2] > r]
        col, taken, cells, new = 0, iter(busy), [], []
        now = next(taken, None)
        for cell in row:
            while now is not None and now[0] <= col:
                col = max(col, now[1])
                now = next(taken, None)
            block = Block()
            lay_out(cell, block, depth)
            lines = block.done()
            wide, high = _span(cell, "colspan", COLSPAN), _span(cell, "rowspan", ROWSPAN)
            cells.append((col, wide, lines if cell is row[-1] else _broken(lines)))
            if high > 1:
                if new and new[-1][1:] == (col, r + high):
                    new[-1] = (new[-1][0], col + wide, r + high)
                else:
                    new.append((col, col + wide, r + high))
            col += wide
        busy = sorted(busy + new) if new else busy
        grid.append(cells)
    return [*before.done(), *_aligned(grid)]


def _aligned(grid: list[list[tuple[int, int, list[str]]]]) -> list[str]:
    """The lines of a table's rows of cells (column, columns that it spans, lines)."""
    # only columns in which some cell begins have a place
    begins = sorted({c[0] for cells in grid for c in cells})
    place = {c: k for k, c in enumerate(begins)}
    width = [0] * len(begins)
    for cells in grid:
        for col, wide, lines in cells:
            k = place[col]
            if wide == 1 or k + 1 == len(begins) or begins[k + 1] >= col + wide:
                width[k] = min(CELL_WIDTH, max(width[k], max(map(width_of, lines), default=0)))
    edge = [0, *itertools.accumulate(w + 3 for w in width)]  # where each column begins
    size, text = 0, 0
    for cells in grid:
        high = max((len(c[2]) for c in cells), default=0)
        size += high * edge[place[cells[-1][0]]] if cells else 0
        text += high + sum(1 + sum(map(len, c[2])) for c in cells)
    pad = size <= MOST_PADDING * text
    out = []
    for cells in grid:
        ends = [edge[bisect.bisect_left(begins, col + wide)] for col, wide, _ in cells]
        for k in range(max((len(c[2]) for c in cells), default=0)):
            if not pad:
                out.append(" | ".join(c[2][k] for c in cells if k < len(c[2]) and c[2][k]))
                continue
            line, used = [], 0  # used: where the next column begins
            for (col, _, lines), end in zip(cells, ends, strict=True):
                for c in range(bisect.bisect_left(edge, used), place[col]):  # places that a rowspan or a short row leaves empty
                    line.append(" " * width[c] + " | ")
                s = lines[k] if k < len(lines) else ""
                line.append(s + " " * max(0, end - edge[place[col]] - 3 - width_of(s)) + " | ")
                used = end
            out.append("".join(line)[:-3].rstrip() if line else "")
    return out


def _wrap(kid: Node) -> Node:
    holder = Node("div", {})
    holder.kids.append(kid)
    return holder


def render(source: str | None) -> str | None:
    if source is None:
        return None
    out = Block()
    root = build(source)
    low = source.lower()
    lay_out(unhidden(root) if "visibility" in low or "<details" in low else root, out, 0)
    lines = out.done()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def _render_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [render(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every row."""
    ready(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(_render_batches, "page_id long, text string")


def op8_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_pages(table(spark, sf_dir, "pages"))
    return out.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")
