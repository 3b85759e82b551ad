"""Operator 8: visible text of HTML pages, laid out as a text browser would.

The standard library's tokenizer feeds a tree builder that supplies implied end tags (paragraphs, list items,
table parts, options) and closes what is left open. Rendering walks the tree without recursion:

* Nothing invisible is emitted: scripts, styles, templates, the head but for its title, comments, elements with
  ``hidden``, ``aria-hidden="true"``, ``display:none`` or ``visibility:hidden``, and closed parts of ``details``;
  what browsers replace or run (``noscript``, ``iframe``, ``object``, ``canvas``, ``audio``, ``video``, ``datalist``); and
  what drawings and formulas hold without showing it (titles, definitions, annotations).
* Blocks stand on lines of their own, paragraphs and headings with a blank line around them; so do the options of a
  ``select``, the lines of a ``textarea`` and each text of a drawing. Parts of a formula that stand above or below
  each other are kept apart by a blank.
* List items get bullets or numbers and are indented by their depth; ``br``, ``hr`` and ``pre`` are kept.
* A table is one line per row, its cells padded to the width of their column; blocks within a cell are kept apart by a
  blank. Columns are at most 80 characters wide and aligned up to character 240 of a line; longer cells run over, so
  the output stays in proportion to the page. Deeper indents than 20 look alike, and a cell spans at most 100 columns. Tables whose cells hold lists, tables or ``pre`` are laid out as blocks.

A tag or comment that nothing closes hides what follows it. Pages of any length are parsed in one pass over tags and open elements.
White space outside ``pre`` collapses to one blank. Everything else that is visible is emitted, in order.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = frozenset("script style template head noscript iframe object canvas audio video datalist annotation annotation-xml".split())
# Elements of a drawing that are not drawn where they stand, and those of a formula whose parts are not set in one line.
_UNDRAWN = frozenset("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter".split())
_APART = frozenset("mfrac mroot msub msup msubsup munder mover munderover mmultiscripts mtr mlabeledtr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header html legend main nav ol section summary table ul li hgroup menu optgroup option tr caption mtr mlabeledtr".split())
_SPACED = frozenset("p h1 h2 h3 h4 h5 h6 pre ul ol dl table blockquote article section figure".split())
# Start tag: the open elements that it ends, and the elements beyond which it does not look.
_ENDS = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select datalist optgroup"),
    "optgroup": ("option optgroup", "select datalist"),
    "tr": ("tr td th caption colgroup", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot tr td th caption colgroup", "table"), "tbody": ("thead tbody tfoot tr td th caption colgroup", "table"),
    "tfoot": ("thead tbody tfoot tr td th caption colgroup", "table"), "body": ("head", "html"),
}
_ENDS = {tag: (frozenset(ended.split()), frozenset(within.split())) for tag, (ended, within) in _ENDS.items()}
_ENDS_P = (_BLOCK | _SPACED | {"hr"}) - {"option", "optgroup", "mtr", "mlabeledtr"}
_SCOPE = frozenset("table td th caption button".split())
# End tags that reach beyond the cell or table in which they stand.
_PAST_CELLS = frozenset("table tr tbody thead tfoot td th body html".split())
_GAP = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_MAX_INDENT = 20
_COLUMN, _LINE = 80, 240
# A character number longer than Python turns into an integer; what has more than seven digits names no character.
_LONG_NUMBER = re.compile(r"&#([0-9]{1000,});?")


class Node:
    __slots__ = ("attrs", "children", "drawn", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None], drawn: bool = False):
        self.tag, self.attrs, self.children, self.drawn = tag, attrs, [], drawn


class TreeBuilder(HTMLParser):
    """Elements and texts of a page below one root."""

    CDATA_CONTENT_ELEMENTS = (*HTMLParser.CDATA_CONTENT_ELEMENTS, "textarea")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.held: dict[str, list[int]] = defaultdict(list)  # places of a tag's open elements

    def _close(self, at: int) -> None:
        for node in reversed(self.open[at:]):
            self.held[node.tag].pop()
        del self.open[at:]

    def _last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element with one of ``tags``; 0 without one."""
        return max((self.held[t][-1] for t in tags if self.held[t]), default=0)

    def _end(self, tags: frozenset[str], within: frozenset[str]) -> None:
        """Close open elements down to the outermost of ``tags`` that lies inside ``within``."""
        if not any(self.held[t] for t in tags):
            return
        bound = self._last(within)
        inside = [places[at] for places in (self.held[t] for t in tags) if (at := bisect_right(places, bound)) < len(places)]
        if inside:
            self._close(min(inside))

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P:
            self._end(frozenset(("p",)), _SCOPE)
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        elif self.open[-1].tag == "head" and tag not in ("title", "meta", "link", "base", "style", "script", "noscript", "template"):
            self._close(len(self.open) - 1)
        node = Node(tag, dict(attrs), bool(self.held["svg"]))
        if node.drawn and tag in _UNDRAWN:
            node.attrs["hidden"] = ""
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.held[tag].append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        at = self._last((tag,))
        if at and (tag in _PAST_CELLS or at >= self._last(("table", "td", "th"))):
            self._close(at)

    def handle_data(self, data):
        self.open[-1].children.append(unescape(data) if self.cdata_elem == "textarea" else data)

    def _settled(self, i: int, end: int) -> int:
        """What nothing closes hides the rest of the page, as in browsers, and is looked for once only."""
        return len(self.rawdata) if end < 0 and self.rawdata.find(">", i) < 0 else end

    def parse_starttag(self, i):
        return self._settled(i, super().parse_starttag(i))

    def parse_endtag(self, i):
        return self._settled(i, super().parse_endtag(i))

    def parse_pi(self, i):
        return self._settled(i, super().parse_pi(i))

    def parse_comment(self, i, report=True):
        end = super().parse_comment(i, report)
        return len(self.rawdata) if end < 0 else end

    def parse_html_declaration(self, i):
        """Of ``<![ ... >``, a section of characters is text in drawings and formulas; all else is a comment up to the next ``>``.
        Without an end, both run to the end of the page, which is fed as one."""
        if not self.rawdata.startswith("<![", i):
            return self._settled(i, super().parse_html_declaration(i))
        text = self.rawdata.startswith("<![CDATA[", i) and (self.held["svg"] or self.held["math"])
        closing = "]]>" if text else ">"
        end = self.rawdata.find(closing, i + 3)
        end = len(self.rawdata) if end < 0 else end
        if text:
            self.handle_data(self.rawdata[i + 9 : end])
        return min(end + len(closing), len(self.rawdata))

    def close(self):
        super().close()
        if self.cdata_elem == "textarea" and self.rawdata:  # never closed: all that follows is its text
            self.handle_data(self.rawdata)


def visible(node: Node) -> bool:
    a = node.attrs
    if node.tag in _UNSEEN or "hidden" in a or (a.get("aria-hidden") or "").lower() == "true":
        return False
    return not (a.get("style") and _HIDING.search(a["style"]))


class _Page:
    """Lines so far. Blanks and blank lines are held back until something visible follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.blank, self.indent, self.lead = False, False, 0, ""

    def text(self, data: str) -> None:
        words = _GAP.sub(" ", data)
        if words.startswith(" "):
            self.gap = True
            words = words[1:]
        if words:
            if not self.line:
                self._begin()
            elif self.gap:
                self.line.append(" ")
            self.gap = words.endswith(" ")
            self.line.append(words[:-1] if self.gap else words)

    def _begin(self) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.line.append("  " * min(self.indent, _MAX_INDENT) + self.lead)
        self.blank, self.lead = False, ""

    def end_line(self, spaced: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.gap = False
        self.blank |= spaced

    def raw(self, lines: list[str]) -> None:
        """Lines as they are."""
        self.end_line()
        for i, line in enumerate(lines):
            if line or i:
                self._begin()
                self.line.append(line)
                self.end_line()

    def done(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _shown(node: Node) -> list[Node | str]:
    """Children of a visible node but for the closed part of ``details``."""
    if node.tag == "details" and "open" not in node.attrs:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"]
    return node.children


def _inner_text(node: Node) -> str:
    """Visible text below a node, its white space unchanged and its blocks on lines of their own; without recursion."""
    out, todo = [], [node]

    def new_line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.extend([at] if at else [])
        elif callable(at):
            at()
        elif at is node:
            todo.extend(reversed(at.children))
        elif not visible(at):
            continue
        elif at.tag in ("br", "hr", "img"):
            if at.tag == "hr":
                new_line()
            out.append({"br": "\n", "hr": "---\n", "img": at.attrs.get("alt") or ""}[at.tag])
        else:
            if at.tag in _BLOCK or at.tag in _SPACED or at.tag == "textarea":
                new_line()
                todo.append(new_line)
            elif at.tag in ("td", "th") and out and not out[-1][-1:].isspace():
                out.append(" ")
            todo.extend(reversed(_shown(at)))
    return "".join(out)


def _cell_text(cell: Node) -> str:
    """A cell's visible text in one line."""
    if all(isinstance(c, str) for c in cell.children):
        return _GAP.sub(" ", "".join(cell.children)).strip(" ")
    return " ".join(line for line in (line.strip(" ") for line in render(cell).split("\n")) if line)


def _rows(table: Node) -> tuple[list[list[Node]], list[object]]:
    """Rows of cells of a table, its own only, and what else lies in it (captions, stray content)."""
    rows, rest, todo = [], [], list(reversed(table.children))

    def apart() -> None:
        if rest and rest[-1] != " ":
            rest.append(" ")

    while todo:
        at = todo.pop()
        if isinstance(at, str):
            if at.strip():
                rest.append(at)
            else:
                apart()
        elif not visible(at):
            continue
        elif at.tag in ("thead", "tbody", "tfoot"):
            todo.extend(reversed(at.children))
        elif at.tag == "tr":
            rows.append([c for c in at.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)])
            apart()
            for c in at.children:
                if c.strip() if isinstance(c, str) else c.tag not in ("td", "th"):
                    rest.append(c)
                else:
                    apart()
            apart()
        elif at.tag in ("td", "th"):
            rows.append([at])
            apart()
        elif at.tag not in ("col", "colgroup"):
            rest.append(at)
    return rows, rest


def _nested(node: Node) -> bool:
    """Whether a cell holds a table or a list, which one line could not show."""
    todo = list(node.children)
    while todo:
        at = todo.pop()
        if isinstance(at, Node):
            if at.tag in ("table", "ul", "ol", "menu", "pre"):
                return True
            todo.extend(at.children)
    return False


def _span(cell: Node) -> int:
    value = re.fullmatch(r"\s*0*([1-9][0-9]*)\s*", cell.attrs.get("colspan") or "1")
    return 1 if not value else 100 if len(value[1]) > 3 else min(int(value[1]), 100)


def _aligned(rows: list[list[Node]]) -> list[str]:
    """A line for each row. A column is as wide as its longest cell, ``_COLUMN`` at most; a longer cell runs over and pushes what follows.
    Columns that would start beyond ``_LINE`` follow the text before them, so the blanks added to a row are bounded."""
    grid, widths = [], defaultdict(int)
    for row in rows:
        cells, column = [], 0
        for cell in row:
            text = _cell_text(cell)
            if text:
                cells.append((column, text))
                widths[column] = max(widths[column], min(len(text), _COLUMN))
            column += _span(cell)
        if cells:
            grid.append(cells)
    starts, wide = {}, 0
    for column in sorted(widths):
        starts[column] = wide + 2 * column
        wide += widths[column]
    lines = []
    for cells in grid:
        parts, length = [], 0
        for column, text in cells:
            gap = 2 if length else 0
            if starts[column] <= _LINE:
                gap = max(gap, starts[column] - length)
            parts += [" " * gap, text]
            length += gap + len(text)
        lines.append("".join(parts).rstrip(" "))
    return lines


def render(root: Node) -> str:
    """The page's visible text. Steps wait on a stack: a node to open, a text, or what closes a node."""
    page = _Page()
    lists: list[list] = []
    todo: list[object] = [root]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            page.text(at)
        elif callable(at):
            at()
        elif at.tag == "head":
            todo.extend(c for c in at.children if isinstance(c, Node) and c.tag == "title")
        elif not visible(at):
            continue
        else:
            _open(at, page, lists, todo)
    return page.done()


def _open(node: Node, page: _Page, lists: list[list], todo: list[object]) -> None:
    tag, children = node.tag, _shown(node)
    if tag == "br":
        if not page.line:
            page.blank = True
        page.end_line()
        return
    if tag == "hr":
        page.raw(["---"])
        return
    if tag == "img":
        page.text(node.attrs.get("alt") or "")
        return
    if tag == "pre":
        page.end_line(True)
        page.raw(_inner_text(node).removeprefix("\n").rstrip("\n").split("\n"))
        page.end_line(True)
        return
    if tag == "textarea":
        text = _inner_text(node).removeprefix("\n").rstrip("\n")
        if text:
            page.raw(text.split("\n"))
        return
    if tag == "table":
        rows, rest = _rows(node)
        if not any(_nested(cell) for row in rows for cell in row):
            page.end_line(True)
            lines = _aligned(rows)
            todo.append(lambda: (page.end_line(), page.raw(lines) if lines else None, page.end_line(True)))
            todo.extend(reversed(rest))
            return
    spaced = tag in _SPACED and not (tag in ("ul", "ol") and lists)
    block = tag in _BLOCK or tag in _SPACED or tag in ("td", "th", "title") or (tag == "text" and node.drawn)
    if block:
        page.end_line(spaced)
    if tag == "optgroup" and node.attrs.get("label"):
        page.text(node.attrs["label"])
        page.end_line()
    elif tag in _APART:
        children = [x for c in children for x in (c, " ")]
    if tag in ("ul", "ol", "menu"):
        start = node.attrs.get("start") or "1"
        lists.append([int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if tag == "ol" else None])
        page.indent += len(lists) > 1
    elif tag == "li":
        number = lists[-1][0] if lists else None
        if number is not None:
            lists[-1][0] += 1
        page.lead = "* " if number is None else f"{number}. "
    elif tag in ("blockquote", "dd"):
        page.indent += 1

    def close() -> None:
        if block:
            page.end_line(spaced)
        if tag in ("ul", "ol", "menu"):
            page.indent -= len(lists) > 1
            lists.pop()
        elif tag == "li":
            page.lead = ""
        elif tag in ("blockquote", "dd"):
            page.indent -= 1

    todo.append(close)
    todo.extend(reversed(children))


def page_text(html: str | None) -> str:
    """Visible text of one page; null and empty pages have none."""
    builder = TreeBuilder()
    builder.feed(_LONG_NUMBER.sub(lambda m: f"&#{n};" if len(n := m[1].lstrip("0") or "0") < 8 else "\ufffd", html or ""))
    builder.close()
    return render(builder.root)


def extract_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text of each as ``into``, which replaces a column of that name. Every page gives a row."""
    kept = [c for c in pages.columns if c != into]
    schema = pages.select(*[F.col(f"`{c}`") for c in kept]).schema.add(into, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [page_text(h) for h in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.string())], names=[*kept, into])

    return pages.mapInArrow(run, schema)
