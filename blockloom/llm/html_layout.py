"""HTML extraction by layout-aware rendering.

A tree builder reads tags, closes what the next tag implies to be closed and opens table rows that are implied.
A renderer walks the tree: it leaves out what is not visible and emits all other text with its layout: lines
for blocks, blank lines around paragraphs and the like, markers and indents for lists, columns for tables.

The work grows with the length of a page, whatever its tags: neither part recurses or searches the open elements,
cells that span rows are kept as runs of columns, and what would make the layout larger than the text without end
(indents of deep lists, columns within columns, padding of a long table with one very wide cell) is bounded. No
text is left out for that.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left, bisect_right, insort
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLANK = re.compile(r"[ \t\n\r\f]+")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.DOTALL)

# Elements by what HTML says of them (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNESCAPED = frozenset("textarea title".split())
INVISIBLE = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas datalist".split())
#: What svg and math hold besides what they show.
INVISIBLE |= frozenset("defs desc metadata symbol clippath annotation annotation-xml".split())
FOREIGN = frozenset("svg math".split())
#: Values of the properties that decide on visibility; a declaration with another one doesn't count.
STYLES = {
    "display": frozenset(
        "none block inline inline-block flex inline-flex grid inline-grid table inline-table table-row table-cell table-row-group table-header-group "
        "table-footer-group table-column table-column-group table-caption list-item contents flow-root run-in ruby inherit initial unset revert".split()
    ),
    "visibility": frozenset("visible hidden collapse inherit initial unset revert".split()),
}
#: Blocks that close an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "li main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Blocks with a blank line before and after.
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
BLOCKS = CLOSES_P | frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
LISTS = frozenset("ul ol menu dir".split())
#: An implied end does not reach beyond these.
BARRIERS = frozenset("table td th caption button object template html".split())
SECTIONS = frozenset("tbody thead tfoot".split())
CELLS = frozenset("td th".split())
#: What an end tag closes within its own table only.
PARTS = CELLS | SECTIONS | {"tr", "caption"}
HEAD, PARAGRAPH, ROW, TABLE, NONE = (frozenset(x.split()) for x in ("head", "p", "tr", "table", ""))
#: What the start of a tag closes, and where the search for it stops.
IMPLIED = {
    "li": (frozenset(["li"]), LISTS | BARRIERS),
    "dt": (frozenset(["dt", "dd"]), BARRIERS | {"dl"}),
    "dd": (frozenset(["dt", "dd"]), BARRIERS | {"dl"}),
    "option": (frozenset(["option"]), BARRIERS | {"select"}),
    "optgroup": (frozenset(["option", "optgroup"]), BARRIERS | {"select"}),
    "td": (CELLS, frozenset(["tr", "table"])),
    "th": (CELLS, frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "tbody": (SECTIONS | {"caption"}, frozenset(["table"])),
    "thead": (SECTIONS | {"caption"}, frozenset(["table"])),
    "tfoot": (SECTIONS | {"caption"}, frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
#: What may stand in an unclosed head; any other start closes it.
IN_HEAD = frozenset("base link meta title style script noscript template html head".split())

INDENT = "  "
#: Lists and quotes indent up to this column; deeper ones stay there.
MAX_INDENT = 120
#: Tables within tables have columns up to this depth; deeper ones have a line for each row.
MAX_TABLES = 8
#: A table is as wide as its widest cells, unless the padding would be this many times its text (and a few pages of
#: it): then wide cells push the next ones aside.
MAX_PADDING, FREE_PADDING = 32, 100_000
MAX_COLUMNS, MAX_ROWS = 1000, 65534


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []

    def get(self) -> dict[str, str]:
        if not self.attributes:
            return {}
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(self.attributes):
            found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        return found


class Builder:
    """Builds the tree of one document."""

    def __init__(self) -> None:
        self.root = Node("")
        self.stack = [self.root]
        self.places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are

    def push(self, tag: str, attributes: str = "") -> None:
        node, stack = Node(tag, attributes), self.stack
        stack[-1].children.append(node)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(stack))
            stack.append(node)

    def pop(self) -> None:
        self.places[self.stack.pop().tag].pop()

    def last(self, tags: frozenset[str]) -> int:
        """Place of the innermost open element of `tags`, 0 if there is none."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=0)

    def close(self, tags: frozenset[str], barriers: frozenset[str]) -> None:
        """Closes the innermost open element of `tags` and all in it, unless one of `barriers` lies further in."""
        at = self.last(tags)
        if at and at >= self.last(barriers):
            while len(self.stack) > at:
                self.pop()

    def start(self, tag: str, attributes: str) -> None:
        if self.places.get("head") and tag not in IN_HEAD:
            self.close(HEAD, NONE)
        if tag in CLOSES_P and self.places.get("p"):
            self.close(PARAGRAPH, BARRIERS)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop()
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag in CELLS and self.last(ROW) < self.last(TABLE):
            self.push("tr")
        self.push(tag, attributes)
        if tag not in VOID and attributes.endswith("/") and self.last(FOREIGN):
            self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.push("br")
        elif self.places.get(tag):
            self.close(frozenset([tag]), NONE if tag == "table" else TABLE if tag in PARTS else BARRIERS)

    def feed(self, html: str) -> Node:
        at = 0
        while m := TOKEN.search(html, at):
            if m.start() > at:
                self.stack[-1].children.append(unescape(html[at : m.start()]))
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag in RAW and self.stack[-1].tag == tag:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
                text = html[at : end.start() if end else len(html)]
                self.stack[-1].children.append(unescape(text) if tag in UNESCAPED else text)
                self.pop()
                close = html.find(">", end.start()) if end else -1
                at = close + 1 if close >= 0 else len(html)
        if at < len(html):
            self.stack[-1].children.append(unescape(html[at:]))
        return self.root


class Flow:
    """Lines of a flow of blocks and inline text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False  # collapsed white space that is due before the next text
        self.blank = False  # a blank line that is due before the next line
        self.indent = ""
        self.marker = ""

    def text(self, text: str) -> None:
        words = BLANK.sub(" ", text)
        body = words.strip(" ")
        if not body:
            self.space |= bool(words)
            return
        if self.parts and (self.space or words[0] == " "):
            self.parts.append(" ")
        self.parts.append(body)
        self.space = words[-1] == " "

    def indented(self, by: int) -> None:
        self.indent = " " * min(len(self.indent) + by, max(MAX_INDENT, len(self.indent)))

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = self.indent
        if self.marker:
            lead = lead[: max(len(lead) - len(self.marker), 0)] + self.marker
            self.marker = ""
        self.lines.append((lead + line).rstrip())

    def line(self, blank: bool = False) -> None:
        """Ends the line, if one has begun."""
        if self.parts:
            self.put("".join(self.parts).replace("\xa0", " "))
            self.parts = []
        self.space = False
        self.blank |= blank

    def broken(self) -> None:
        """A line break, which makes an empty line where no line has begun."""
        if self.parts:
            self.line()
        elif self.lines and not self.blank:
            self.lines.append("")

    def kept(self, text: str) -> None:
        """Preformatted text."""
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.parts += [first] if first else []
        for x in rest:
            self.put("".join(self.parts))
            self.parts = [x] if x else []

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Taken:
    """Columns that cells of earlier rows take: runs that don't touch, and when each cell's part of them ends."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.until: list[tuple[int, int, int]] = []  # heap of (row, start, end)

    def free(self, column: int) -> tuple[int, int]:
        """The first free column from `column` on, and how many are free from there (MAX_COLUMNS stands for all)."""
        i = bisect_right(self.starts, column)
        if i and self.ends[i - 1] > column:
            column = self.ends[i - 1]
        return column, self.starts[i] - column if i < len(self.starts) else MAX_COLUMNS

    def take(self, start: int, end: int, row: int) -> None:
        """Free columns from start to end are taken before `row`."""
        heapq.heappush(self.until, (row, start, end))
        i = bisect_left(self.starts, end)
        if i < len(self.starts) and self.starts[i] == end:
            end = self.ends[i]
            del self.starts[i], self.ends[i]
        if i and self.ends[i - 1] == start:
            self.ends[i - 1] = end
        else:
            insort(self.starts, start)
            self.ends.insert(i, end)

    def begin(self, row: int) -> None:
        """Frees what ends before `row`."""
        while self.until and self.until[0][0] <= row:
            _, start, end = heapq.heappop(self.until)
            i = bisect_right(self.starts, start) - 1
            first, last = self.starts[i], self.ends[i]
            rest = [x for x in ((first, start), (end, last)) if x[0] < x[1]]
            self.starts[i : i + 1], self.ends[i : i + 1] = [x for x, _ in rest], [y for _, y in rest]


class Table:
    """Cells of a table, rendered in columns."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.taken = Taken()
        self.begun: list[tuple[int, int, int]] = []  # cells of this row that reach into the next
        self.captions: list[str] = []

    def row(self) -> None:
        n = len(self.rows)
        self.taken.begin(n)
        for start, end, until in self.begun:
            self.taken.take(start, end, until)
        self.begun = []
        self.rows.append([])

    def cell(self, lines: list[str], across: int, down: int) -> None:
        """A cell goes to the next free column and ends where one from above begins."""
        if not self.rows:
            self.row()
        row = self.rows[-1]
        column, room = self.taken.free(row[-1][0] + row[-1][1] if row else 0)
        across = min(across, room)
        row.append((column, across, lines))
        if down > 1:
            self.begun.append((column, column + across, len(self.rows) - 1 + down))

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        text = 0
        rows: list[list[tuple[int, str]]] = []  # lines of (column, text)
        for row in self.rows:
            own: list[list[tuple[int, str]]] = [[] for _ in range(max((len(lines) for _, _, lines in row), default=0))]
            for column, across, lines in row:
                if across == 1:
                    width[column] = max(width.get(column, 0), max(map(len, lines), default=0))
                for parts, line in zip(own, lines, strict=False):
                    if line:
                        parts.append((column, line))
                        text += len(line)
            rows += own
        columns = sorted(c for c, w in width.items() if w)
        most = max(width.values(), default=0)
        while True:
            starts = [0]  # of the columns, and where all end
            for c in columns:
                starts.append(starts[-1] + min(width[c], most) + 2)
            at = [[starts[bisect_left(columns, c)] for c, _ in parts] for parts in rows]
            if sum(x[-1] for x in at if x) <= MAX_PADDING * text + FREE_PADDING:
                break
            if not most:  # too many columns to align any
                at = [[0] * len(parts) for parts in rows]
                break
            most //= 2
        out = list(self.captions)
        for parts, leads in zip(rows, at, strict=True):
            line, size = [], 0
            for (_, x), lead in zip(parts, leads, strict=True):
                gap = lead - size if size + 2 <= lead or not size else 2
                line += [" " * gap, x]
                size += gap + len(x)
            out.append("".join(line).rstrip())
        return out


class Rows(Table):
    """A table that is too deep for columns."""

    def lines(self) -> list[str]:
        return [*self.captions, *(" ".join(filter(None, (x for _, _, lines in row for x in lines))) for row in self.rows)]


def styled(attributes: dict[str, str]) -> dict[str, str]:
    """Values of STYLES in a style attribute: of several the last one, an important one before others."""
    found: dict[str, tuple[bool, str]] = {}
    for declaration in COMMENT.sub("", attributes.get("style", "")).split(";"):
        name, _, value = declaration.partition(":")
        name = name.strip().lower()
        if name in STYLES:
            value, _, mark = value.strip().lower().partition("!")
            value, important = value.strip(), mark.strip() == "important"
            if value in STYLES[name] and (important or not found.get(name, (False,))[0]):
                found[name] = (important, value)
    return {k: v for k, (_, v) in found.items()}


def hidden(node: Node, attributes: dict[str, str], style: dict[str, str]) -> bool:
    if node.tag in INVISIBLE or "hidden" in attributes and attributes["hidden"].lower() != "until-found" and style.get("display", "none") == "none":
        return True
    return node.tag == "dialog" and "open" not in attributes or style.get("display") == "none"


def number(text: str | None, least: int, most: int, default: int) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text or "")
    return min(max(int(m[1]), least), most) if m else default


def render(root: Node) -> str:
    """Visible text of the tree."""
    flows, tables, lists = [Flow()], [], []
    visible = True
    todo: list[tuple] = [("child", root, None)]
    pre = 0
    while todo:
        what, node, more = todo.pop()
        flow = flows[-1]
        if what == "call":
            node(*more)
            continue
        if what == "see":
            visible = node
            continue
        if what == "pre":
            pre += node
            continue
        if isinstance(node, str):
            if visible:
                flow.kept(node) if pre else flow.text(node)
            continue
        attributes = node.get()
        style = styled(attributes) if "style" in attributes else {}
        if hidden(node, attributes, style):
            continue
        tag = node.tag
        shown = style.get("visibility")
        shown = "visible" if shown == "initial" else None if shown in ("inherit", "unset", "revert") else shown
        children: list[Node | str] = node.children
        if tag == "details" and "open" not in attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        after: list[tuple] = []
        if shown:
            after.append(("see", visible, None))
            visible = shown == "visible"
        if tag == "br":
            flow.broken()
        elif tag == "hr":
            flow.line(True)
        elif tag == "table":
            flow.line(True)
            tables.append(Table() if len(tables) < MAX_TABLES else Rows())

            def end_table(flow=flow) -> None:
                for line in tables.pop().lines():
                    flow.put(line)
                flow.line(True)

            after.append(("call", end_table, ()))
        elif tag == "tr" and tables:
            tables[-1].row()
        elif tag in CELLS | {"caption"} and tables:
            flows.append(Flow())

            def end_cell(tag=tag, attributes=attributes) -> None:
                lines = flows.pop().done()
                if tag == "caption":
                    tables[-1].captions += lines
                else:
                    tables[-1].cell(lines, number(attributes.get("colspan"), 1, MAX_COLUMNS, 1), number(attributes.get("rowspan"), 0, MAX_ROWS, 1) or MAX_ROWS)

            after.append(("call", end_cell, ()))
        elif tag in BLOCKS:
            nested = tag in LISTS and bool(lists)
            flow.line(tag in SPACED and not nested)
            indent, marker = flow.indent, flow.marker
            if tag in LISTS:
                lists.append([tag == "ol", number(attributes.get("start"), -(10**9), 10**9, 1)])
            elif tag == "li":
                ordered, n = lists[-1] if lists else (False, 0)
                flow.marker = f"{n}. " if ordered else "* "
                if lists:
                    lists[-1][1] += 1
                flow.indented(len(flow.marker))
            elif tag in ("blockquote", "dd"):
                flow.indented(len(INDENT))

            def end_block(flow=flow, tag=tag, nested=nested, indent=indent, marker=marker) -> None:
                flow.line(tag in SPACED and not nested)
                flow.indent = indent
                if tag in LISTS:
                    lists.pop()
                if tag == "li":
                    flow.marker = ""

            after.append(("call", end_block, ()))
        if tag in ("pre", "textarea", "xmp"):
            pre += 1
            after.append(("pre", -1, None))
            if children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
        todo += after
        todo += [("child", c, None) for c in reversed(children)]
    return "\n".join(flows[0].done())


def text_of(html: str) -> str:
    return render(Builder().feed(html))


def extracted(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and visible text of every page.

    A null page has null text, an empty one empty text. A page of any length and depth is read whole. Rows are
    independent: repeated rows, null ids and empty tables give what each row alone gives. Other columns are ignored,
    whatever their names.
    """

    def run(batches):
        for batch in sliced(batches):
            texts = [None if h is None else text_of(h) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, text string")
