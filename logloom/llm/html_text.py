"""Layout-aware text of HTML: a tree builder with implied tags, visibility rules, and a block renderer."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm import html_style

#: Fixed values of the HTML standard: elements by how they are parsed and shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link datalist area param source track iframe noembed noframes audio video canvas".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav aside main address form fieldset legend li dt dd tr caption thead tbody tfoot figcaption details summary center dir menu hgroup search dialog select option optgroup text".split())
CLOSES_P = SPACED | frozenset("div section article header footer nav aside main address form fieldset details center dir menu hgroup search dialog".split())
#: A start tag closes an open element of these names, unless an element of the second set stands between.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: What a head may hold; any other start tag or text ends one that was left open.
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: Elements of SVG and MathML end at "/>" (below INSIDE, which holds HTML again, they do not); UNSHOWN of them show no text.
FOREIGN = frozenset("svg math".split())
INSIDE = frozenset("foreignobject desc annotation-xml".split())
UNSHOWN = frozenset("defs desc metadata symbol annotation annotation-xml".split())
LISTS = frozenset("ul ol menu dir".split())
SCOPE = frozenset("table td th caption button html template".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NONE = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
#: Raw elements in which character references stand for characters.
REFERENCES = frozenset("textarea title".split())
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+$")
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None) -> None:
        self.name, self.attrs, self.children = name, attrs or {}, []


def parse(page: str) -> Node:
    """Tree of a page: void and raw-text elements, implied ends, and end tags that match nothing are ignored."""
    root = Node("#root")
    stack, at = Stack(root), 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        if m is None:  # a tag that never ends is text
            if stack[-1].name == "head":
                stack.pop()
            stack[-1].children.append("<")
            at += 1
            continue
        at = m.end()
        if m[4] is not None:
            shown = html.unescape(m[4])
            if stack[-1].name == "head" and shown.strip(" \t\n\r\f"):
                stack.pop()
            stack[-1].children.append(shown)
        elif m[2] is None:
            continue
        elif m[1]:
            _end(stack, m[2].lower())
        else:
            name = m[2].lower()
            _start(stack, name)
            attrs = {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTR.findall(m[3])} if m[3].strip(" \t\n\r\f/") else {}
            if name in UNSHOWN and _foreign(stack):
                attrs["hidden"] = ""
            node = Node(name, attrs)
            stack[-1].children.append(node)
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                held = page[at : close.start() if close else len(page)]
                node.children.append(html.unescape(held) if name in REFERENCES else held)
                at = close.end() if close else len(page)
            elif name not in VOID and not (m[3].endswith("/") and not _UNQUOTED.search(m[3]) and (name in FOREIGN or _foreign(stack))):
                stack.append(node)
    return root


def _foreign(stack: Stack) -> bool:
    if not any(stack.of[n] for n in FOREIGN):
        return False
    return next((x.name for x in reversed(stack) if x.name in FOREIGN or x.name in INSIDE), "") in FOREIGN


def _start(stack: Stack, name: str) -> None:
    if stack[-1].name == "head" and name not in HEAD:
        stack.pop()
    if name in CLOSES_P:
        _close(stack, _P, SCOPE)
    elif name in IMPLIED:
        while _close(stack, *IMPLIED[name]):
            pass
    if name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):  # a row that was left out
        stack[-1].children.append(row := Node("tr"))
        stack.append(row)


class Stack(list):
    """Open elements, counted by name, so that looking for one that is not open costs nothing."""

    def __init__(self, root: Node) -> None:
        super().__init__([root])
        self.of: Counter[str] = Counter()

    def append(self, node: Node) -> None:
        super().append(node)
        self.of[node.name] += 1

    def pop(self) -> Node:
        node = super().pop()
        self.of[node.name] -= 1
        return node


_P = frozenset({"p"})


def _close(stack: Stack, names: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> bool:
    if not any(stack.of[n] for n in names):
        return False
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            while len(stack) > i:
                stack.pop()
            return True
        if stack[i].name in walls:
            return False
    return False


def _end(stack: Stack, name: str) -> None:
    if name == "br":
        stack[-1].children.append(Node("br"))
        return
    parts = ("td", "th", "tr", "tbody", "thead", "tfoot", "caption")
    _close(stack, {name}, frozenset() if name == "table" else {"table"} if name in parts else SCOPE - {name})


def hidden(node: Node) -> bool:
    a = node.attrs
    return node.name in HIDDEN or "hidden" in a or ("style" in a and _NONE.search(a["style"]) is not None) or (node.name == "dialog" and "open" not in a)


def visible(node: Node, inherited: bool) -> bool:
    """Visibility is inherited, and may be given back to what stands inside."""
    said = _VISIBILITY.findall(node.attrs["style"]) if "style" in node.attrs else ()
    return said[-1].lower() == "visible" if said else inherited


class Page:
    """Lines of rendered text; runs of blanks collapse, blocks start lines, spaced blocks leave one empty line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.gap, self.blank = "", 0, False
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(s.replace("\r\n", "\n").split("\n")):
                if i:
                    self.end(forced=True)
                if part:
                    self.put(part)
            return
        words = [w for w in _SPACES.split(s) if w]
        if not words:
            self.blank |= bool(s)
            return
        lead = self.blank or s[0] in " \t\n\r\f"
        self.put((" " if lead and self.line else "") + " ".join(words))
        self.blank = s[-1] in " \t\n\r\f"

    def put(self, s: str) -> None:
        if not self.line:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = 0
            self.line = "".join(self.indent) + self.marker
            self.marker = ""
        self.line += s

    def end(self, forced: bool = False) -> None:
        if self.line or forced:
            self.lines.append(self.line.rstrip())
        self.line, self.blank = "", False

    def space(self) -> None:
        self.end()
        self.gap = 1

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


def render(root: Node) -> str:
    """All visible text under root. Tables in cells in tables are worked off on a list, not by recursion."""
    open_, value = [_page(root, True)], None
    while open_:
        try:
            open_.append(open_[-1].send(value))
            value = None
        except StopIteration as done:
            open_.pop()
            value = done.value
    return value


def _page(root: Node, seen: bool) -> Iterator:
    """Renders what is under root; yields each table that it needs the lines of."""
    page = Page()
    work: list[tuple[str, object, bool]] = [("open", root, seen)]
    pre, lists = 0, []
    while work:
        what, node, seen = work.pop()
        if what == "leave":
            name = node.name
            if name == "pre":
                pre -= 1
            if name in LISTS:
                lists.pop()
            if name in ("li", "dd", "blockquote"):
                page.indent.pop()
                page.end()
                page.marker = ""
            if name in SPACED and not (name in ("ul", "ol") and lists):
                page.space()
            elif name in BLOCK:
                page.end()
            continue
        if isinstance(node, str):
            if seen:
                page.text(node, pre > 0)
            continue
        name = node.name
        if hidden(node):
            continue
        seen = visible(node, seen)
        if name == "br":
            page.end(forced=True)
            continue
        if name in SPACED and not (name in ("ul", "ol") and lists):
            page.space()
        elif name in BLOCK:
            page.end()
        if name == "table":
            for line in (yield _table(node, seen)):
                page.put(line)
                page.end()
            page.space()
            continue
        if name == "hr":
            continue
        if name == "pre":
            pre += 1
        elif name in LISTS:
            start = node.attrs.get("start", "1")
            lists.append(int(start) if name == "ol" and start.isdecimal() else (1 if name == "ol" else None))
        elif name == "li":
            number = lists[-1] if lists else None
            if number is not None:
                lists[-1] += 1
            page.marker = f"{number}. " if number is not None else "- "
            page.indent.append("  " if lists[1:] else "")
        elif name in ("dd", "blockquote"):
            page.indent.append("  ")
        work.append(("leave", node, seen))
        work.extend(("open", c, seen) for c in reversed(node.children))
    return page.result()


def _inner(children: list, name: str = "#cell") -> Node:
    node = Node(name)
    node.children = children
    return node


def _span(cell: Node, name: str, most: int) -> int:
    """A span of a cell; those of the standard's limits and more are cut to them."""
    said = cell.attrs.get(name, "1")
    return max(1, min(int(said), most)) if said.isdecimal() else 1


def _table(node: Node, seen: bool) -> Iterator:
    """Caption, then a line for each line of a row, cells padded to the columns' widths; a colspan leaves empty cells
    beside it and a rowspan below it. Yields each cell that it needs the text of."""
    rows, out, work = [], [], [(c, seen) for c in reversed(node.children)]
    taken: dict[int, int] = {}  # columns that a cell above reaches into, and for how many rows more
    while work:
        x, seen = work.pop()
        if isinstance(x, str):
            if seen and x.strip():
                out.append(" ".join(_SPACES.split(x.strip())))
            continue
        if hidden(x):
            continue
        seen = visible(x, seen)
        if x.name == "tr":
            row, below = [], {k: n - 1 for k, n in taken.items() if n > 1}
            for c in x.children:
                if isinstance(c, str):
                    if seen and c.strip():  # stands before the table, as do elements that are no cells
                        out.append(" ".join(_SPACES.split(c.strip())))
                    continue
                if hidden(c):
                    continue
                if c.name not in ("td", "th"):
                    out += (yield _page(_inner([c]), seen)).split("\n")
                    continue
                while len(row) in taken:
                    row.append([""])
                text = yield _page(_inner(c.children), visible(c, seen))
                wide, high = _span(c, "colspan", 1000), _span(c, "rowspan", 65534)
                if high > 1:
                    below |= dict.fromkeys(range(len(row), len(row) + wide), high - 1)
                row += [text.split("\n"), *[[""]] * (wide - 1)]
            taken = below
            rows.append(row)
        elif x.name in ("thead", "tbody", "tfoot"):
            taken = {}
            work.extend((c, seen) for c in reversed(x.children))
        elif x.name not in ("colgroup", "col"):
            out += (yield _page(_inner(x.children), seen)).split("\n")
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            if i == len(widths):
                widths.append(0)
            widths[i] = max(widths[i], *map(len, cell))
    for row in rows:
        for k in range(max(map(len, row), default=0)):
            cells = [(cell[k] if k < len(cell) else "").ljust(w) for cell, w in zip(row, widths, strict=False)]
            out.append("  ".join(cells).rstrip())
    return [x for x in out if x]


def page_text(page: str | None) -> str | None:
    if page is None:
        return None
    root = parse(page)
    html_style.apply(root)
    return render(root)


def extract(markup: str | Column) -> Column:
    """Visible text of HTML with its layout; null gives null, empty or textless markup gives ''."""

    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array([page_text(x.as_py()) for x in pages], pa.string())

    return of(markup)


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, text) of every row, repeated rows and null ids included; null markup gives a null text, an empty table
    nothing; other columns are not looked at."""
    return pages.select(F.col(id_col), extract(F.col(html_col)).alias("text"))
