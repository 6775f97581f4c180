"""HTML pages rendered to the text a reader sees.

A tree builder closes what the markup leaves open (paragraphs, list items, table parts, options)
and ignores end tags without a start. Elements that a browser does not show are left out:
document heads, scripts, styles, templates, `hidden`, closed details and dialogs, hidden
inputs, and inline `display:none` or `visibility:hidden`. What is left is laid out: blocks on
lines of their own, a blank line around paragraphs, headings, lists and tables, list items
marked and indented, preformatted text as it is, and table cells in aligned columns.

Pages are worked on one by one in time linear in their length, but for indentation: elements
nested deeper than DEPTH become children of the element at that depth. Cells wider than WIDE
are not padded to, so one long cell does not widen every row; their text is whole.

Defined results: a null or empty page has an empty text; plain text is a page too; repeated rows
are rendered each; extra columns pass, and those that share a name with a result are replaced
by it; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .common import carried

DEPTH = 200
WIDE = 80


def _set(names: str) -> frozenset[str]:
    return frozenset(names.split())


# What HTML's rules say of its elements.
VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style xmp iframe noembed noframes textarea title")
UNSEEN = _set(
    "head script style template noscript title meta link base iframe noembed noframes object audio video canvas "
    "datalist area param source track col colgroup rp svg math"
)
BLOCK = _set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul xmp caption select textarea"
)
MARGIN = _set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul xmp dir fieldset")
#: A start tag closes an open element of these names, up to the nearest border.
CLOSES = {
    **dict.fromkeys(
        "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 "
        "h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split(),
        (_set("p"), _set("button td th caption table object")),
    ),
    "li": (_set("li p"), _set("ul ol menu dir td th table")),
    **dict.fromkeys(("dt", "dd"), (_set("dt dd p"), _set("dl td th table"))),
    **dict.fromkeys(("td", "th"), (_set("td th caption"), _set("table"))),
    "tr": (_set("tr td th caption"), _set("table")),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (_set("tbody thead tfoot tr td th caption"), _set("table"))),
    "option": (_set("option"), _set("select datalist")),
    "optgroup": (_set("option optgroup"), _set("select datalist")),
    "body": (_set("head"), _set("")),
}
#: An end tag does not close across these, other than its own.
BORDER = _set("table td th caption button object")
SPACE = re.compile(r"[ \t\n\r\f]+")
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?[ \t\n\r\f]*(=)?[ \t\n\r\f]*")
BARE = re.compile(r"[^\s>]*")
HIDING = re.compile(r"display:none|visibility:(hidden|collapse)")


@dataclass(slots=True)
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)


def tokens(page: str) -> Iterator[tuple]:
    """("text", s), ("start", name, attributes) and ("end", name), in one pass."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", html.unescape(page[at:])
            return
        if lt > at:
            yield "text", html.unescape(page[at:lt])
        if page.startswith("<!--", lt):
            empty = re.compile("-?>").match(page, lt + 4)
            end = page.find("-->", lt + 4)
            at = empty.end() if empty else n if end < 0 else end + 3
            continue
        closing = page.startswith("</", lt)
        name = NAME.match(page, lt + 1 + closing)
        if not name:
            if closing or page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<"
                at = lt + 1
            continue
        attrs, at = _attributes(page, name.end())
        if at < 0:
            return  # the page ends inside a tag
        tag = name[0].lower()
        yield ("end", tag) if closing else ("start", tag, attrs)
        if not closing and tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                body = page[at:stop]
                yield "text", html.unescape(body) if tag in ("textarea", "title") else body
            at = stop


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    found: dict[str, str] = {}
    n = len(page)
    while at < n:
        m = ATTRIBUTE.match(page, at)
        at = m.end()
        if at < n and page[at] == ">" and not m[2]:
            if m[1]:
                found.setdefault(m[1].lower(), "")
            return found, at + 1
        value = ""
        if m[2] and at < n:
            if page[at] in "\"'":
                end = page.find(page[at], at + 1)
                if end < 0:
                    return found, -1
                value, at = page[at + 1 : end], end + 1
            else:
                bare = BARE.match(page, at)
                value, at = bare[0], bare.end()
        if m[1]:
            found.setdefault(m[1].lower(), html.unescape(value))
        elif m.end() == m.start() and not value:
            at += 1  # a stray sign
    return found, -1


def tree(page: str) -> Node:
    root = Node("html", {})
    stack, opened = [root], Counter()

    def close_to(i: int) -> None:
        for node in stack[i:]:
            opened[node.tag] -= 1
        del stack[i:]

    def imply(tag: str) -> None:
        names, borders = CLOSES[tag]
        if not any(opened[x] for x in names):
            return
        lowest = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in borders:
                break
            if stack[i].tag in names:
                lowest = i
        if lowest is not None:
            close_to(lowest)

    for token in tokens(page):
        if token[0] == "text":
            stack[-1].children.append(token[1])
        elif token[0] == "end":
            tag = token[1]
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif opened[tag]:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close_to(i)
                        break
                    if stack[i].tag in BORDER and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body"):
                        break
        else:
            _, tag, attrs = token
            if tag == "html":
                root.attrs = {**attrs, **root.attrs}
                continue
            if opened["head"] and stack[-1].tag == "head" and tag in BLOCK:
                close_to(len(stack) - 1)
            if tag in CLOSES:
                imply(tag)
            if tag == "tr" and stack[-1].tag == "table":
                body = Node("tbody", {})
                stack[-1].children.append(body)
                stack.append(body)
                opened["tbody"] += 1
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                row = Node("tr", {})
                stack[-1].children.append(row)
                stack.append(row)
                opened["tr"] += 1
            node = Node(tag, attrs)
            stack[-1].children.append(node)
            if tag not in VOID and len(stack) < DEPTH:
                stack.append(node)
                opened[tag] += 1
    return root


def hidden(node: Node) -> bool:
    a = node.attrs
    return (
        node.tag in UNSEEN
        or "hidden" in a
        or (node.tag == "input" and a.get("type", "").lower() == "hidden")
        or (node.tag == "dialog" and "open" not in a)
        or ("style" in a and HIDING.search(re.sub(r"\s+", "", a["style"]).lower()) is not None)
    )


class Flow:
    """Lines of a container; `gap` asks for a blank line before the next one."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = False

    def end_line(self) -> None:
        if self.inline:
            line = SPACE.sub(" ", "".join(self.inline)).strip(" ")
            self.inline = []
            if line:
                self.put([line])

    def put(self, lines: list[str]) -> None:
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def margin(self) -> None:
        self.end_line()
        self.gap = True


def flowed(node: Node) -> list[str]:
    flow = Flow()
    _fill(node, flow)
    flow.end_line()
    return flow.lines


def _fill(node: Node, flow: Flow) -> None:
    number = _number(node.attrs.get("start"), 1)
    shut = node.tag == "details" and "open" not in node.attrs
    summary = next((c for c in node.children if isinstance(c, Node) and c.tag == "summary"), None) if shut else None
    for child in node.children:
        if shut and child is not summary:
            continue
        if isinstance(child, str):
            flow.inline.append(child)
        elif hidden(child):
            continue
        elif child.tag == "br":
            if flow.inline:
                flow.end_line()
        elif child.tag == "img":
            continue
        elif child.tag == "input":
            if child.attrs.get("type", "text").lower() in ("button", "submit", "reset", "text") and child.attrs.get("value"):
                flow.inline.append(f" {child.attrs['value']} ")
        elif child.tag not in BLOCK:
            _fill(child, flow)
        else:
            flow.end_line()
            apart = child.tag in MARGIN and not (node.tag == "li" and child.tag in ("ul", "ol"))
            if apart:
                flow.margin()
            if child.tag == "li":
                mark = "- "
                if node.tag == "ol":
                    number = _number(child.attrs.get("value"), number)
                    mark, number = f"{number}. ", number + 1
                lines = flowed(child)
                pad = " " * len(mark)
                flow.put([(mark if i == 0 else pad) + x if x or i == 0 else x for i, x in enumerate(lines)])
            elif child.tag in ("blockquote", "dd"):
                flow.put(["  " + x if x else x for x in flowed(child)])
            elif child.tag in ("pre", "textarea", "xmp"):
                flow.put(_as_is(child))
            elif child.tag == "table":
                flow.put(table(child))
            else:
                _fill(child, flow)
                flow.end_line()
            if apart:
                flow.margin()


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?[0-9]{1,9})", value or "")
    return int(m[1]) if m else default


def _as_is(node: Node) -> list[str]:
    parts: list[str] = []

    def walk(x: Node) -> None:
        for c in x.children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag == "br":
                parts.append("\n")
            elif not hidden(c):
                walk(c)

    walk(node)
    lines = [x.rstrip() for x in "".join(parts).replace("\r\n", "\n").replace("\r", "\n").split("\n")]
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return lines


def table(node: Node) -> list[str]:
    """Captions and stray content above, then rows of aligned cells, heads first, feet last."""
    parts: dict[str, list[Node]] = {"thead": [], "tbody": [], "tfoot": []}
    above = Node("div", {})
    for child in node.children:
        if isinstance(child, Node) and child.tag in parts:
            if not hidden(child):
                parts[child.tag].append(child)
        else:
            above.children.append(child)
    lines = flowed(above)
    rows: list[list[tuple[int, int, list[str]]]] = []  # (column, span, lines)
    for part in [*parts["thead"], *parts["tbody"], *parts["tfoot"]]:
        busy: list[tuple[int, int, int]] = []  # (from, to, rows left): cells that reach down
        for row in part.children:
            if not isinstance(row, Node) or row.tag != "tr":
                stray = flowed(Node("div", {}, [row]))
                rows += [[(0, 1, stray)]] if stray else []
                continue
            if hidden(row):
                continue
            at, cells, down = 0, [], []
            taken = sorted(busy)
            extra = Node("div", {}, [c for c in row.children if isinstance(c, str) or c.tag not in ("td", "th")])
            for cell in row.children:
                if isinstance(cell, str) or cell.tag not in ("td", "th") or hidden(cell):
                    continue
                while taken and taken[0][0] <= at:
                    at = max(at, taken.pop(0)[1])
                span = min(max(_number(cell.attrs.get("colspan"), 1), 1), 1000)
                reach = min(_number(cell.attrs.get("rowspan"), 1), 65534) or 65534
                cells.append((at, span, flowed(cell)))
                if reach > 1:
                    down.append((at, at + span, reach - 1))
                at += span
            busy = [(a, b, r - 1) for a, b, r in busy if r > 1] + down
            stray = flowed(extra)
            rows += [[(0, 1, stray)]] if stray else []
            rows.append(cells)
    rows = [[c for c in r if c[2]] for r in rows]
    columns = sorted({c[0] for r in rows for c in r})
    width = dict.fromkeys(columns, 0)
    for r in rows:
        for at, span, held in r:
            if span == 1:
                width[at] = max(width[at], *[len(x) for x in held if len(x) <= WIDE] or [0])
    left, begin = 0, {}
    for c in columns:
        begin[c], left = left, left + width[c] + 2
    for r in rows:
        for i in range(max((len(held) for _, _, held in r), default=0)):
            line = ""
            for at, _, held in r:
                if i < len(held) and held[i]:
                    line = line.ljust(begin[at]) if len(line) + 2 <= begin[at] or not line else line + "  "
                    line += held[i]
            lines.append(line.rstrip(" "))
    return lines


def render(page: str | None) -> str:
    return "\n".join(flowed(tree(page.replace("\0", "")))) if page else ""


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """The other columns of each page with `text`, n_lines and n_chars (code points)."""
    doc, back = carried(pages, [column, "text", "n_lines", "n_chars"])
    rows = pages.select(common.column(pages, column).cast("string").alias("page"), doc)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):  # so many pages are held at a time
                some = batch.slice(i, 500)
                texts = [render(p.as_py()) for p in some.column(0)]
                counts = [[t.count("\n") + 1 if t else 0 for t in texts], [len(t) for t in texts]]
                yield pa.RecordBatch.from_arrays(
                    [some.column(1), pa.array(texts, pa.string()), *[pa.array(c, pa.int64()) for c in counts]],
                    ["doc", "text", "n_lines", "n_chars"],
                )

    out = rows.select("doc").schema.add("text", "string").add("n_lines", "long").add("n_chars", "long")
    return rows.mapInArrow(run, out).select(*back, "text", "n_lines", "n_chars")
