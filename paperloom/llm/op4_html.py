"""Layout-aware text of HTML pages.

A tree builder with implied tags (an open paragraph ends where a block begins, list
items, cells, rows, options and definition terms end one another) feeds a renderer
that emits all visible text: block spacing as blank lines, ordered and unordered lists
with their markers and nesting, preformatted text as it stands, and tables with cells
padded to the width of their column, with column and row spans.  Of forms, the texts of
text areas, the values of buttons and the chosen options of selects are visible; so are the
texts of drawings and formulas.  Not visible: head, scripts, styles, templates, fallback
content (``noscript``, ``iframe``, ``object``, ``canvas``, ``audio``, ``video``), data
lists, titles, definitions and annotations of drawings and formulas, comments, the
``hidden`` attribute, ``aria-hidden="true"``, ``display:none`` and ``visibility:hidden``
styles, hidden inputs.

Defined cases: null html gives null text; an empty page, or one of no visible text,
gives an empty string; unclosed and stray tags, numbers of any length and signs that are
no ASCII digits never fail; a table whose alignment would be mostly blanks (``STRETCH``), such
as one of few wide or far-reaching cells, has its cells side by side without it, so the text
stays in proportion to what is visible; nesting is kept on a stack of
its own, so its depth is unbounded and costs nothing; repeated rows give equal texts; a
column of the name of ``into`` is replaced, all others stay; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .words import slices

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template noscript iframe object canvas audio video head title datalist desc defs metadata annotation annotation-xml".split())
TEXT_ONLY = frozenset("script style textarea title iframe".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split())
#: Blocks with a blank line before and after.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dt", "dd", "option", "optgroup", "legend", "summary"}
#: What an opening tag ends, and where the search for it stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
SCOPE = frozenset("table td th caption button html".split())
#: Closing tags that reach through a scope.
CROSSES = frozenset("tr tbody thead tfoot body html".split())

LONG_NUMBER = re.compile(r"&#(?:[0-9]{10,}|[xX][0-9a-fA-F]{9,});?")
TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|([!?])[^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
HIDDEN_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def attributes_of(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescaped(next((v for v in values if v), "")))
    return out


def hidden(node: Node) -> bool:
    a = node.attributes
    return bool(a) and ("hidden" in a or a.get("aria-hidden", "").strip().lower() == "true" or bool(HIDDEN_STYLE.search(a.get("style", ""))))


class Open:
    """The stack of open elements, with the places of each tag on it, so that no step walks it."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []

    @property
    def top(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag in SCOPE:
            self.scopes.append(at)

    def last(self, tag: str) -> int:
        """The place of the innermost open ``tag``, 0 for none."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def cut(self, at: int) -> None:
        """Closes the element at this place and all in it."""
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def close(self, tag: str) -> None:
        at = self.last(tag)
        if tag == "p" and not at:
            self.top.children.append(Node("p"))
        elif at and (tag in SCOPE or tag in CROSSES or not self.scopes or at > self.scopes[-1]):
            self.cut(at)

    def imply(self, tag: str) -> None:
        """Ends what the opening of ``tag`` ends."""
        if tag == "body" and self.last("head"):
            self.cut(self.last("head"))
        elif self.top.tag == "head" and tag in BLOCK:
            self.cut(len(self.stack) - 1)
        if tag in CLOSES_P:
            at = self.last("p")
            if at and (not self.scopes or at > self.scopes[-1]):
                self.cut(at)
        if tag in IMPLIED:
            ends, limit = IMPLIED[tag]
            low = max(self.last(x) for x in limit)
            inside = [found[i] for x in ends if (found := self.places.get(x)) and (i := bisect_right(found, low)) < len(found)]
            if inside:
                self.cut(min(inside))


def parse(source: str) -> Node:
    """The tree of a page; text is a str child."""
    root = Node("#root")
    open_, at = Open(root), 0
    n = len(source)
    while at < n:
        m = TAG.search(source, at)
        if m is None:
            open_.top.children.append(unescaped(source[at:]))
            break
        if m.start() > at:
            open_.top.children.append(unescaped(source[at : m.start()]))
        at = m.end()
        if m[4] is None:  # a comment, doctype or instruction
            continue
        tag = m[4].lower()
        if m[3]:
            open_.close(tag)
            continue
        open_.imply(tag)
        raw = m[5]
        node = Node(tag, attributes_of(raw) if raw.strip("/ \t\n\r\f") else None)
        open_.top.children.append(node)
        if tag in VOID:
            continue
        if tag in TEXT_ONLY:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(source, at)
            inner = source[at : end.start() if end else n]
            node.children.append(unescaped(inner) if tag == "textarea" else inner)
            if end is None:
                break
            close = source.find(">", end.start())
            at = n if close < 0 else close + 1
            continue
        open_.push(node)
    return root


def width(text: str) -> int:
    """Columns of a line: two for wide and full-width signs, none for combining marks."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Lines:
    """Lines under way: inline text is collapsed, blocks break, spaced blocks leave one blank line."""

    def __init__(self):
        self.out: list[str] = []
        self.inline: list[str] = []
        self.gap = self.pending = self.raw = False  # raw: the line is preformatted
        self.prefix = ""  # a list marker that waits for its text

    def text(self, raw: str) -> None:
        lead, tail = raw[:1].isspace(), raw[-1:].isspace()
        body = SPACE.sub(" ", raw).strip(" ")
        if not body:
            self.pending = self.pending or bool(raw)
            return
        if self.inline and (self.pending or lead):
            self.inline.append(" ")
        self.inline.append(body)
        self.pending = tail

    def line(self, force: bool = False) -> None:
        text = "".join(self.inline)
        text = text.rstrip() if self.raw else text.strip(" ")
        self.inline, self.pending, self.raw = [], False, False
        if text or force:
            self.put(text)

    def put(self, text: str) -> None:
        if self.gap and self.out:
            self.out.append("")
        self.gap = False
        if self.prefix:
            text, self.prefix = self.prefix + text, ""
        self.out.append(text.rstrip())

    def block(self, spaced: bool) -> None:
        self.line()
        if spaced and not self.prefix:
            self.gap = True


def _lists(lines: list[str], marker: str) -> list[str]:
    pad = " " * len(marker)
    return [(marker if i == 0 else pad if x else "") + x for i, x in enumerate(lines)] if lines else []


def render(root: Node) -> str:
    """The visible text of a tree, by a stack of (node, next child, lines) frames."""
    frames: list[list] = [[root, 0, Lines(), None]]
    done: list[str] = []
    while frames:
        frame = frames[-1]
        node, i, lines, state = frame
        if i == len(node.children):
            frames.pop()
            tag = node.tag
            if not frames:
                lines.line()
                done = lines.out
                break
            above = frames[-1]
            if lines is above[2]:
                if tag in BLOCK or tag == "text":
                    lines.block(tag in SPACED)
                continue
            lines.line()
            _finish(node, lines.out, state, above)
            continue
        frame[1] += 1
        child = node.children[i]
        if isinstance(child, str):
            if state == "pre":
                _preformatted(lines, child)
            elif not (node.tag in ("table", "tr", "tbody", "thead", "tfoot", "colgroup") and not child.strip()):
                lines.text(child)
            continue
        tag = child.tag
        if tag in RAW or hidden(child) or (tag == "input" and child.attributes.get("type", "").lower() == "hidden"):
            continue
        if tag == "br":
            lines.line(force=True)
        elif tag == "hr":
            lines.block(True)
            lines.put("---")
            lines.gap = True
        elif tag == "img":
            if alt := child.attributes.get("alt", ""):
                lines.text(alt)
        elif tag == "textarea":
            lines.block(False)
            _preformatted(lines, "".join(x for x in child.children if isinstance(x, str)))
            lines.block(False)
        elif tag == "select":
            for text in chosen(child):
                lines.text(f" {text} ")
        elif tag == "input":
            if child.attributes.get("type", "text").lower() in ("submit", "button", "reset"):
                lines.text(child.attributes.get("value", ""))
        elif tag == "table":
            lines.block(True)
            frames.append([child, 0, Lines(), {"rows": [], "caption": []}])
        elif tag in ("td", "th", "caption", "li", "blockquote", "dd"):
            if tag not in ("td", "th"):
                lines.block(tag == "blockquote")
            frames.append([child, 0, Lines(), _inherited(node, state)])
        elif tag == "tr" or tag in ("thead", "tbody", "tfoot", "colgroup"):
            if tag == "tr" and isinstance(state, dict):
                state["rows"].append([])
            frames.append([child, 0, lines, state])
        elif tag in ("ol", "ul", "menu", "dir"):
            nested = any(f[0].tag == "li" for f in frames[-2:])
            lines.block(not nested)
            start = child.attributes.get("start", "1")
            frames.append([child, 0, lines, [tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1]])
        else:
            if tag in BLOCK or tag == "text":  # a line of a drawing
                lines.block(tag in SPACED)
            frames.append([child, 0, lines, "pre" if tag == "pre" or state == "pre" else None])
    while done and not done[-1]:
        done.pop()
    return "\n".join(done)


def plain(node: Node) -> str:
    """The text in a node, white space collapsed."""
    out, left = [], [node]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            left.extend(reversed(x.children))
    return SPACE.sub(" ", "".join(out)).strip(" ")


def unescaped(text: str) -> str:
    """Character references as signs; a number of many digits is no sign, as any beyond the last."""
    return html.unescape(LONG_NUMBER.sub("\ufffd", text))


def number(text: str, most: int, default: int) -> int:
    """A whole number of ASCII digits, ``most`` at most however many digits it has; else the default."""
    if not re.fullmatch(r"[0-9]+", text):
        return default
    digits = text.lstrip("0")
    return most if len(digits) > 9 else min(int(digits or 0), most)


def chosen(select: Node) -> list[str]:
    """Texts of the options that a select shows: all of a list, else the last selected, else the first."""
    options, left = [], [select]
    while left:
        x = left.pop()
        if isinstance(x, str) or (x is not select and hidden(x)):
            continue
        if x.tag == "option":
            options.append(x)
        else:
            left.extend(reversed(x.children))
    size = select.attributes.get("size", "1")
    if "multiple" not in select.attributes and number(size, 2, 1) < 2:
        options = [x for x in options if "selected" in x.attributes][-1:] or options[:1]
    return [plain(x) for x in options]


def _inherited(node: Node, state):
    """What a nested flow knows of its list or table."""
    return state if isinstance(state, (dict, list)) else None


def _preformatted(lines: Lines, raw: str) -> None:
    head, *rest = raw.replace("\r\n", "\n").split("\n")
    lines.inline.append(head)
    lines.raw = True
    for x in rest:
        text, lines.inline = "".join(lines.inline), []
        if text or lines.out:
            lines.put(text)
        lines.inline.append(x)


def _finish(node: Node, out: list[str], state, above: list) -> None:
    """Puts the lines of a finished flow where they belong."""
    tag, lines = node.tag, above[2]
    while out and not out[-1]:
        out.pop()
    if tag in ("td", "th") and isinstance(state, dict):
        if not state["rows"]:
            state["rows"].append([])
        across, down = (node.attributes.get(k, "1") for k in ("colspan", "rowspan"))
        # A rowspan of 0 reaches to the end.
        state["rows"][-1].append((out, number(across, 1000, 1) or 1, number(down, 65534, 1) or 65534))
        return
    if tag == "caption" and isinstance(state, dict):
        state["caption"] += out
        return
    if tag == "table":
        own = _table(state)
        for x in own if not out else [*out, *own]:
            lines.put(x)
        lines.gap = True
        return
    if tag == "li":
        marker = "- "
        if isinstance(state, list) and state[0]:
            value = node.attributes.get("value", "")
            if re.fullmatch(r"-?\d{1,9}", value):
                state[1] = int(value)
            marker = f"{state[1]}. "
            state[1] += 1
        out = _lists(out, marker)
    elif tag in ("blockquote", "dd"):
        out = [("> " if tag == "blockquote" else "    ") + x if x or tag == "blockquote" else x for x in out]
    for x in out:
        lines.put(x)
    if tag == "blockquote":
        lines.gap = True


#: A table is aligned while that makes at most so many signs of each sign in it.
STRETCH, SLACK = 8, 1024


def _grid(rows: list[list[tuple]]) -> list[list[tuple[int, int, list[str] | None]]] | None:
    """Rows of (first column, column after it, cell), None for a cell under one that reaches down from a row above.

    None for the whole if such places outnumber the cells by far.
    """
    most = STRETCH * sum(map(len, rows)) + SLACK
    out, open_ = [], []  # open_: places that rows above still take, by column: first, after, rows
    for i, row in enumerate(rows):
        line, column, k, taken = [], 0, 0, []

        def fill(upto: int | None) -> None:
            """Passes the places that begin up to a column."""
            nonlocal column, k
            while k < len(open_) and (upto is None or open_[k][0] <= upto):
                first, after, _ = open_[k]
                if after > column:
                    line.append((max(first, column), after, None))
                    column = after
                    upto = None if upto is None else column
                k += 1

        for cell, across, down in row:
            fill(column)
            line.append((column, column + across, cell))
            if min(down, len(rows) - i) > 1:
                taken.append((column, column + across, min(down, len(rows) - i) - 1))
            column += across
        fill(None)
        open_ = sorted([(a, b, n - 1) for a, b, n in open_ if n > 1] + taken)
        most -= len(line) - len(row)
        if most < 0:
            return None
        out.append(line)
    return out


def _table(state: dict) -> list[str]:
    """The rows of a table, columns aligned; without alignment where that would be out of proportion."""
    rows = [r for r in state["rows"] if r]
    out = list(state["caption"])
    grid = _grid(rows)
    lines = _aligned(grid) if grid is not None else None
    if lines is None:
        lines = []
        for row in rows:
            for k in range(max(1, *(len(c) for c, _, _ in row)) if len(row) > 1 else max(1, len(row[0][0]))):
                lines.append(" | ".join(c[k] if k < len(c) else "" for c, _, _ in row).rstrip())
    out += lines
    return out if any(x.strip(" |") for x in out) else []


def _aligned(grid: list[list[tuple[int, int, list[str] | None]]]) -> list[str] | None:
    """Lines of a grid; columns in which no cell begins are none.  None if blanks would be most of it."""
    starts = sorted({first for row in grid for first, _, _ in row})
    at = {c: i for i, c in enumerate(starts)}
    placed = [[(at[a], max(at[a] + 1, bisect_left(starts, b)), cell) for a, b, cell in row] for row in grid]
    widths = [0] * len(starts)
    held = 0
    for row in placed:
        for first, after, cell in row:
            if cell is not None:
                held += 4 + sum(map(width, cell))
                if after == first + 1:
                    widths[first] = max([widths[first], *map(width, cell)])
    upto = [0, *accumulate(widths)]
    room = lambda first, after: upto[after] - upto[first] + 3 * (after - first - 1)
    tall = [max([1, *(len(c) for _, _, c in row if c is not None)]) for row in placed]
    if sum(h * sum(room(a, b) + 3 for a, b, _ in row) for h, row in zip(tall, placed, strict=True)) > STRETCH * held + SLACK:
        return None
    out = []
    for row, h in zip(placed, tall, strict=True):
        for k in range(h):
            parts = []
            for first, after, cell in row:
                text = cell[k] if cell is not None and k < len(cell) else ""
                parts.append(text + " " * (room(first, after) - width(text)))
            out.append(" | ".join(parts).rstrip())
    return out


def visible_text(source: str) -> str:
    return render(parse(source))


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``column`` in ``into``; no shuffle."""
    names = [c for c in pages.columns if c != into]
    kept = [c for c in names if c != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, 4 << 20):
                texts = [None if x is None else visible_text(x) for x in part.column(column).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, into])

    schema = pages.select(*kept).schema.add(into, "string")
    return pages.select(*names).mapInArrow(run, schema)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", F.col("html").cast("string").alias("html"))).withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLES: dict[str, str] = {}
