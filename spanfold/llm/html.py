"""Layout-aware rendering of HTML: a tree with implied tags, rules of visibility, and text set in blocks."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanfold.llm.common import spread_out, with_columns

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(?:!|\?|/(?![a-zA-Z]))[^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"'=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[=\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?:^|;)\s*(display|visibility|content-visibility)\s*:\s*(none|hidden|collapse|visible|[a-z-]+)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HIDDEN = frozenset("head title script style template noscript noembed noframes iframe datalist video audio canvas area base link meta param source track rp annotation annotation-xml".split())
#: In drawings only text elements and foreign objects are seen, and not inside these.
DRAWN = frozenset(["text", "foreignobject"])
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
#: Elements inside which a drawing or a formula holds HTML again, and tags that end a drawing or a formula that was left open.
_INNER = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_FOREIGN = frozenset(["svg", "math"])
_BREAKS = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Blocks set apart by an empty line, and blocks that only start a line.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr xmp menu".split())
LINE = frozenset(
    "address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li listing main nav optgroup option search section summary tr caption thead tbody tfoot".split()
)
CLOSES_P = (APART | LINE) - frozenset("body html optgroup option tr caption thead tbody tfoot legend".split())
#: An open element that a start tag ends, and the elements beyond which it doesn't look.
_LISTS = frozenset("ul ol menu dir".split())
_TABLE = frozenset(["table"])
_CELL = frozenset("td th caption table".split())
IMPLIED = {
    "li": (frozenset(["li"]), _LISTS | _CELL),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _CELL),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _CELL),
    "option": (frozenset(["option"]), frozenset(["select", "optgroup", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset("tr td th caption colgroup".split()), _TABLE),
    "td": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th", "caption", "colgroup"]), frozenset(["tr", "table"])),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), _TABLE),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), _TABLE),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), _TABLE),
    "caption": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), _TABLE),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
#: Elements that make up a table; what else stands in a row, a row group or a table belongs before the table.
_ROWS = frozenset("thead tbody tfoot tr".split())
_FOSTERING = _ROWS | _TABLE | frozenset(["colgroup"])
_OF_TABLE = _ROWS | frozenset("caption colgroup col td th script style template".split())
_BOUNDS = _CELL | frozenset(["template"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Cells are padded to the width of their column, and to this width where the column is wider.
WIDEST = 120
#: Columns by which nested lists and quotes are indented at most.
INDENTED = 80


class Node:
    """An element: its tag, its attributes as written, its children (elements and strings)."""

    __slots__ = ("tag", "rest", "children")

    def __init__(self, tag: str, rest: str = "") -> None:
        self.tag, self.rest, self.children = tag, rest, []

    def attributes(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for name, a, b, c in _ATTRIBUTE.findall(self.rest):
            out.setdefault(name.lower(), html.unescape(a or b or c))
        return out


class Open:
    """The open elements from the root inwards, and where those of each tag are, so that none has to be searched for."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places, self.deepest = [root], {}, 1

    @property
    def now(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.deepest = max(self.deepest, len(self.nodes))

    def cut(self, size: int) -> None:
        """Leave `size` elements open."""
        while len(self.nodes) > size:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags: frozenset[str], but: frozenset[str] = frozenset()) -> int:
        """The place of the innermost of these tags, 0 if none is open."""
        places = self.places
        return max((places[t][-1] for t in tags if t not in but and places.get(t)), default=0)

    def close(self, wanted: frozenset[str], beyond: frozenset[str], all_: bool = False) -> None:
        """End the innermost wanted element (with all_, every one) that is open inside the elements beyond."""
        limit = self.last(beyond, wanted)
        while (at := self.last(wanted)) > limit:
            self.cut(at)
            if not all_:
                return

    def table(self) -> int:
        """The place of the innermost table, 0 if none is open or a cell, caption or template is open in it."""
        at = self.last(_BOUNDS)
        return at if self.nodes[at].tag == "table" else 0

    def foster(self, child: Node | str) -> None:
        """Put what is no part of a table before the table that it stands in."""
        k = self.table()
        if k and self.now.tag == "colgroup":
            self.cut(len(self.nodes) - 1)
        if k:
            self.nodes[k - 1].children.insert(-1, child)  # an open table is its parent's last child
        else:
            self.now.children.append(child)

    def words(self, text: str) -> None:
        if text:
            plain = html.unescape(text) if "&" in text else text
            if self.now.tag in _FOSTERING and not text.isspace():
                self.foster(plain)
            else:
                self.now.children.append(plain)

    def clear(self, tag: str) -> None:
        """End what stands in an open table where it doesn't belong, up to what may hold the tag."""
        k = self.table()
        if k and not (tag == "col" and self.now.tag == "colgroup"):
            holds = {"tr": _ROWS - {"tr"}, "td": _ROWS, "th": _ROWS}.get(tag, frozenset())
            while k + 1 < len(self.nodes) and self.nodes[k + 1].tag in holds:
                k += 1
            self.cut(k + 1)


_P, _A, _TEMPLATE, _NONE = frozenset(["p"]), frozenset(["a"]), frozenset(["template"]), frozenset()
_BEYOND_P = _CELL | frozenset(["button", "object"])


def end_tag(stack: Open, tag: str) -> None:
    one = frozenset([tag])
    if tag == "br":
        stack.now.children.append(Node("br"))
    elif tag == "p":
        if not stack.places.get("p"):
            stack.now.children.append(Node("p"))
        stack.close(_P, _BEYOND_P)
    elif tag in HEADINGS:
        stack.close(HEADINGS, _CELL)
    elif tag in ("body", "html"):
        return
    elif tag in ("table", "tr", "thead", "tbody", "tfoot"):
        stack.close(one, _TABLE - one)
    elif tag in ("td", "th", "caption"):
        stack.close(one, _TABLE)
    elif tag == "li":
        stack.close(one, _LISTS | _CELL)
    elif tag == "template":
        stack.close(one, _NONE)
    else:
        stack.close(one, _CELL - one)


def start_tag(stack: Open, tag: str, rest: str, foreign: bool) -> Node | None:
    """Put a new element in its place and give it; none if the tag makes no element."""
    if tag in ("html", "body"):
        if tag == "body":
            stack.cut(1)
        return None
    if tag not in HIDDEN and len(stack.nodes) > 1 and stack.nodes[1].tag == "head" and tag != "head":
        stack.cut(1)  # the body begins
    if tag in _ROWS and not stack.places.get("table"):
        return None  # no table is open
    if tag in CLOSES_P and not foreign:
        stack.close(_P, _BEYOND_P)
    if tag in HEADINGS and stack.now.tag in HEADINGS:
        stack.cut(len(stack.nodes) - 1)
    if tag in IMPLIED:
        wanted, beyond = IMPLIED[tag]
        stack.close(wanted, beyond, all_=tag not in ("li", "dt", "dd"))
    if tag == "a":
        stack.close(_A, _CELL)
    if tag in _OF_TABLE and tag not in RAW and tag != "template":
        stack.clear(tag)
    elif tag == "table" and (k := stack.table()):
        stack.cut(k)  # a table can't hold a table but in a cell
    elif tag == "form" and stack.table():
        return None  # holds nothing there
    if tag in ("td", "th") and stack.now.tag in ("table", "thead", "tbody", "tfoot"):
        row = Node("tr")
        stack.now.children.append(row)
        stack.push(row)
    if tag == "option" and stack.now.tag == "option":
        stack.cut(len(stack.nodes) - 1)
    node = Node(tag, rest)
    if stack.now.tag in _FOSTERING and tag not in _OF_TABLE:
        stack.foster(node)
    else:
        stack.now.children.append(node)
    return node


def tree(source: str) -> tuple[Node, int]:
    """The tree of a page, with the tags that HTML lets an author leave out, and how deep it is."""
    root = Node("html")
    stack = Open(root)
    at = 0
    while found := _TOKEN.search(source, at):
        stack.words(source[at : found.start()])
        at = found.end()
        if not found["tag"]:
            continue
        tag, rest = found["tag"].lower(), found["rest"] or ""
        if found["end"]:
            end_tag(stack, tag)
            continue
        drawing = stack.last(_FOREIGN)
        foreign = drawing > stack.last(_INNER) if drawing else False
        if foreign and tag in _BREAKS:
            stack.cut(drawing)
            foreign = False
        node = start_tag(stack, tag, rest, foreign)
        if foreign and rest.rstrip().endswith("/"):
            continue  # an element that ends itself
        if tag in RAW or tag in RCDATA:
            text, at = raw_text(source, tag, at, len(source))
            if node is not None and tag in ("textarea", "xmp"):
                node.children.append(html.unescape(text) if tag == "textarea" else text)
        elif node is not None and tag not in VOID:
            stack.push(node)
    stack.words(source[at:])
    return root, stack.deepest


def build(source: str) -> Node:
    """The tree of a page."""
    return tree(source)[0]


def raw_text(source: str, tag: str, at: int, size: int) -> tuple[str, int]:
    """What stands up to the element's own end tag, and where that ends."""
    found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
    return (source[at : found.start()], found.end()) if found else (source[at:], size)


class Page:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks, self.space = 0, False
        self.indent, self.marker = "", ""

    def begin(self, lines: int) -> None:
        """The next text starts a line, after lines - 1 empty ones."""
        self.breaks, self.space = max(self.breaks, lines), False

    def forced(self) -> None:
        """A line break of the author's: each one counts."""
        if self.parts:
            self.breaks, self.space = (self.breaks or 0) + 1 if self.breaks < 2 else self.breaks, False

    def lead(self) -> str:
        if not self.marker:
            return self.indent
        shown = self.indent[: len(self.indent) - len(self.marker)] + self.marker
        self.marker = ""
        return shown

    def open_line(self) -> None:
        if not self.parts:
            self.parts.append(self.lead())
        elif self.breaks or self.marker:
            self.parts.append("\n" * max(1, self.breaks) + self.lead())
        elif self.space:
            self.parts.append(" ")
        self.breaks, self.space = 0, False

    def text(self, words: str) -> None:
        """Words of the page, with runs of white space as one space."""
        plain = _SPACE.sub(" ", words)
        if plain == " " or not plain:
            self.space = self.space or bool(plain)
            return
        self.space = self.space or plain[0] == " "
        self.open_line()
        self.parts.append(plain.strip(" "))
        self.space = plain[-1] == " "

    def lines(self, rows: list[str]) -> None:
        """Lines that are set already."""
        for n, row in enumerate(rows):
            if n:
                self.breaks = 1
            if row or n:
                self.open_line()
                self.parts.append(row)

    def result(self) -> str:
        return "\n".join(line.rstrip(" ") for line in "".join(self.parts).split("\n")).strip("\n")


def hidden(node: Node, seen: bool | None) -> tuple[bool, bool | None]:
    """Whether the element takes no place at all, and whether text in it is seen (None: in a drawing, where only some elements show theirs)."""
    if node.tag in HIDDEN or (seen is None and node.tag in UNDRAWN):
        return True, False
    if node.tag == "svg":
        seen = None if seen else seen
    elif seen is None and node.tag in DRAWN:
        seen = True
    if not node.rest.strip():
        return node.tag == "dialog", seen
    a = node.attributes()
    until = a.get("hidden")
    if until is not None or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (node.tag == "dialog" and "open" not in a):
        return True, False
    for name, value in _HIDING.findall(a.get("style", "")):
        if (name.lower(), value.lower()) in (("display", "none"), ("content-visibility", "hidden")):
            return True, False
        if name.lower() == "visibility":
            seen = (seen is not None or None) if value.lower() == "visible" else False
    return False, seen


def render(node: Node, page: Page, seen: bool | None = True, kept: bool = False, number: list | None = None) -> None:
    """Set what is visible in an element; kept: its white space stands as written."""
    for child in node.children:
        if isinstance(child, str):
            if seen:
                if kept:
                    page.lines(child.replace("\r\n", "\n").split("\n"))
                else:
                    page.text(child)
            continue
        tag = child.tag
        gone, shown = hidden(child, seen)
        if gone:
            continue
        if tag == "br":
            page.forced()
        elif tag == "hr":
            page.begin(2)
        elif tag == "input":
            a = child.attributes()
            if shown and a.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number") and a.get("value"):
                page.text(a["value"])
        elif tag == "img" or tag == "wbr":
            continue
        elif tag in _LISTS:
            nested = number is not None
            page.begin(1 if nested else 2)
            count = None
            if tag == "ol":
                first = child.attributes().get("start", "1")
                count = int(first) - 1 if re.fullmatch(r"-?[0-9]{1,9}", first) else 0
            render(child, page, shown, kept, [count])
            page.begin(1 if nested else 2)
        elif tag == "li":
            page.begin(1)
            marker = "- "
            if number and number[0] is not None:
                value = child.attributes().get("value", "")
                number[0] = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else number[0] + 1
                marker = f"{number[0]}. "
            outer, page.marker = page.indent, marker if shown else ""
            page.indent = (outer + " " * len(marker))[:INDENTED]
            render(child, page, shown, kept, [None])
            page.indent, page.marker = outer, ""
            page.begin(1)
        elif tag == "table":
            page.begin(2)
            table(child, page, shown)
            page.begin(2)
        elif tag in ("pre", "listing", "xmp", "textarea"):
            page.begin(2 if tag != "textarea" else 1)
            render(child, page, shown, True, number)
            page.begin(2 if tag != "textarea" else 1)
        elif tag == "dd" or tag == "blockquote":
            page.begin(2 if tag == "blockquote" else 1)
            outer, page.indent = page.indent, (page.indent + "  ")[:INDENTED]
            render(child, page, shown, kept, None)
            page.indent = outer
            page.begin(2 if tag == "blockquote" else 1)
        elif tag == "details" and "open" not in child.attributes():
            page.begin(1)
            for part in child.children:
                if isinstance(part, Node) and part.tag == "summary":
                    render(part, page, shown, kept)
                    break
            page.begin(1)
        elif tag == "optgroup" or tag == "option":
            page.begin(1)
            label = child.attributes().get("label", "") if child.rest.strip() else ""
            if shown and label:
                page.text(label)
                page.begin(1)
            if tag == "optgroup" or not label:
                render(child, page, shown, kept)
            page.begin(1)
        elif tag in APART or tag in LINE:
            lines = 2 if tag in APART else 1
            page.begin(lines)
            render(child, page, shown, kept, number if tag in ("div",) else None)
            page.begin(lines)
        elif tag in ("td", "th") or (tag in DRAWN and seen is None):
            page.begin(1)
            render(child, page, shown, kept)
            page.begin(1)
        elif tag == "q" and shown:
            page.text('"')
            render(child, page, shown, kept, number)
            page.text('"')
        else:
            render(child, page, shown, kept, number)


def span(value: str | None, most: int) -> int:
    return min(most, max(1, int(value))) if value and re.fullmatch(r"[0-9]{1,6}", value) else 1


def table(node: Node, page: Page, seen: bool) -> None:
    """Caption, then rows in the order head, bodies, foot; cells of a column stand under one another."""
    groups: dict[str, list[tuple[Node, bool]]] = {"thead": [], "tbody": [], "tfoot": []}
    for child in node.children:
        if isinstance(child, str):
            continue
        gone, shown = hidden(child, seen)
        if gone:
            continue
        if child.tag == "caption":
            render(child, page, shown)
            page.begin(1)
        elif child.tag in groups:
            for row in child.children:
                if isinstance(row, Node) and row.tag == "tr":
                    away, visible = hidden(row, shown)
                    if not away:
                        groups[child.tag].append((row, visible))
        elif child.tag == "tr":
            groups["tbody"].append((child, shown))
        elif child.tag not in ("colgroup", "col"):
            render(_wrap(child), page, shown)
            page.begin(1)
    grid: list[dict[int, list[str]]] = []
    spanning: set[tuple[int, int]] = set()
    taken: dict[int, int] = {}  # columns that a cell from above still covers, and for how many rows
    for row, shown in [x for g in groups.values() for x in g]:
        cells: dict[int, list[str]] = {}
        column, after = 0, {c: n - 1 for c, n in taken.items() if n > 1}
        for cell in row.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                continue
            gone, visible = hidden(cell, shown)
            if gone:
                continue
            while taken.get(column):
                column += 1
            a = cell.attributes() if cell.rest.strip() else {}
            inner = Page()
            render(cell, inner, visible)
            cells[column] = inner.result().split("\n")
            wide, deep = span(a.get("colspan"), 1000), span(a.get("rowspan"), 65534)
            if wide > 1:
                spanning.add((len(grid), column))
            for c in range(column, column + wide):
                if deep > 1:
                    after[c] = deep - 1
            column += wide
        taken = after
        grid.append(cells)
    widths: dict[int, int] = {}
    for k, cells in enumerate(grid):
        for c, lines in cells.items():
            # a cell over several columns is shown, but does not widen the first of them
            longest = max(len(x) for x in lines)
            widths[c] = max(widths.get(c, 0), min(longest, 1) if (k, c) in spanning else longest)
    shown_columns = sorted(c for c, w in widths.items() if w)
    for cells in grid:
        height = max((len(cells[c]) for c in cells), default=0)
        for k in range(height):
            line = []
            for c in shown_columns:
                words = cells[c][k] if c in cells and k < len(cells[c]) else ""
                line.append(words.ljust(min(widths[c], WIDEST)))
            joined = " | ".join(line).rstrip()
            if joined.strip(" |"):
                page.begin(1)
                page.lines([joined])


def _wrap(node: Node) -> Node:
    outer = Node("div")
    outer.children.append(node)
    return outer


def to_text(source: str | None) -> str | None:
    """The visible text of a page; null for null."""
    if source is None:
        return None
    page = Page()
    root, deepest = tree(source)
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 4 * deepest + 1_000))  # rendering takes up to three calls a level, all of them on the heap
    try:
        render(root, page)
    finally:
        sys.setrecursionlimit(before)
    return page.result()


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "page_text") -> DataFrame:
    """pages with page_text, the text that a reader would see, in place of the HTML column.

    A tree is built with the tags that may be left out (p, li, dt, dd, tr, td, tbody, option, ... and head and
    body); unclosed, misplaced and cut-off tags do no harm. Not shown: head, scripts, styles, templates, noscript,
    images, frames, and video, audio and canvas with what they hold for readers that lack them; `hidden`, display:none, visibility:hidden, hidden inputs, closed
    dialogs and all but the summary of closed details; in drawings all but text elements, in formulas annotations. All other text is, at any depth,
    also what stands where a table can't hold it (it goes before the table), labels of options, and what objects hold for readers that can't load them.
    Blocks start lines, and paragraphs, headings, lists and tables are set apart by an empty line; list items have
    "- " or their number and are indented by depth, up to INDENTED columns; cells are joined with " | " and padded to the column's
    width, up to WIDEST characters (longer cells push the next ones on); pre keeps its white space.

    One narrow pass, no exchange. Null gives null, empty gives empty. Pages of any length and depth are read whole, in time that grows with their length. Other columns pass through; one named page_text is replaced. Repeated
    rows are rendered each. No rows give no rows.
    """

    @F.arrow_udf("string")
    def rendered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sources in batches:
            yield pa.array((to_text(s.as_py()) for s in sources), pa.string())

    out = with_columns(spread_out(pages), {text_col: rendered(F.col(f"`{html_col}`").cast("string"))})
    return out.drop(*(c for c in out.columns if c.lower() == html_col.lower() and c.lower() != text_col.lower()))
