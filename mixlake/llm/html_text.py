"""Layout-aware text of HTML pages.

A page is read tag by tag into a stack of open elements, with the end tags that HTML lets authors leave
out. An element that isn't shown (head, script, hidden, display:none ...) hides all in it. Blocks
start lines, paragraphs and tables have an empty line around them, list items their bullets or numbers,
and the cells of a table's column are aligned. No text that a reader would see is left out.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from mixlake.llm.shared import table, unused, without

#: Elements by their part in the layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas datalist".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr".split())
BLOCK = SPACED | frozenset("html body div section article header footer nav main aside address li dt dd form figcaption details summary legend option tr caption center".split())
#: An open element of the key ends where one of these starts.
ENDED_BY = {
    "p": BLOCK - {"option", "tr", "caption", "html", "body"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}),
    "td": frozenset("td th tr tbody thead tfoot".split()), "th": frozenset("td th tr tbody thead tfoot".split()), "tr": frozenset("tr tbody thead tfoot".split()),
    "thead": frozenset("tbody tfoot".split()), "tbody": frozenset("tbody tfoot thead".split()), "tfoot": frozenset({"tbody"}), "caption": frozenset("tr td th tbody thead tfoot".split()),
    "head": frozenset({"body"}) | BLOCK - {"html"},
}
#: Elements beyond which an implied or stray end tag doesn't reach.
WALLS = {"li": frozenset("ul ol table td th".split()), "dt": frozenset({"dl"}), "dd": frozenset({"dl"})}
TABLE_WALL = frozenset({"table"})
#: A column is padded to this at most; wider cells stay whole. Columns that a cell may span.
WIDEST, MOST_SPANNED = 60, 1000
#: Levels of lists that are indented; deeper ones stand below the last.
MOST_INDENTED = 64
#: A table's lines may be put together anew this often, by tables around it, and take so many times its text and, for each cell, so many times that.
MOST_PUT, ROOM = 6, 8

# names don't give characters back, so a tag is read once
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?/][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s"'>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_MAY_HIDE = re.compile("hidden|none", re.I)
_HIDING_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_SPAN = re.compile(r"\s*([0-9]{1,9})")
_LONG_NUMBER = re.compile(r"&#(?:0*+[0-9]{8,}+|[xX]0*+[0-9a-fA-F]{8,}+);?")
_LONG_ZEROS = re.compile(r"(&#[xX]?)0{8,}+(?=[0-9a-fA-F])")
_CELLS = frozenset({"td", "th"})
_STAYS_IN_BLOCK = frozenset("tr td th tbody thead tfoot li dt dd".split())


def _unescaped(text: str) -> str:
    """Character references as characters; numbers beyond Unicode, however long, as U+FFFD."""
    if "&#" in text:
        text = _LONG_NUMBER.sub("\ufffd", _LONG_ZEROS.sub(r"\g<1>0", text))
    return unescape(text)


def _blocks_way(name: str, tag: str) -> bool:
    """Whether the start of `tag` reaches no element outside an open `name`."""
    return name in WALLS.get(tag, ()) or name in TABLE_WALL or name in ("td", "th", "ul", "ol", "dl") or name in BLOCK and tag not in _STAYS_IN_BLOCK


#: Tags whose start may end an element, grouped by what it ends and what keeps it from doing so.
_KINDS: dict[str, int] = {}
#: By element: the kinds whose start ends it, and those that it keeps within.
_ENDS: dict[str, tuple[int, ...]] = {}
_KEEPS: dict[str, tuple[int, ...]] = {}


def _group() -> None:
    names = sorted(BLOCK | set(ENDED_BY) | {"table", "td", "th", "ul", "ol", "dl"})
    rules: dict[tuple, int] = {}
    for tag in sorted(set().union(*ENDED_BY.values())):
        rule = tuple((tag in ENDED_BY.get(n, ()), _blocks_way(n, tag)) for n in names)
        _KINDS[tag] = rules.setdefault(rule, len(rules))
    for at, n in enumerate(names):
        _ENDS[n] = tuple(k for rule, k in rules.items() if rule[at][0])
        _KEEPS[n] = tuple(k for rule, k in rules.items() if rule[at][1] and not rule[at][0])


_group()


def _attributes(raw: str) -> dict[str, str]:
    """Values by lower-cased name, the first of a repeated name as in browsers; names without a value have an empty one."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        if name:
            out.setdefault(name.lower(), "".join(values))
    return out


def _hides(raw: str) -> bool:
    """Whether an element with these attributes isn't shown."""
    if not _MAY_HIDE.search(raw):
        return False
    found = _attributes(raw)
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_HIDING_STYLE.search(_unescaped(found.get("style", ""))))


class _Laid:
    """Lines that are laid out: strings and what is laid out within them, held by reference. raw and cells: the text's length and its table cells; height: how often its lines were put together anew."""

    __slots__ = ("parts", "n", "width", "raw", "cells", "height")

    def __init__(self):
        self.parts: list[str | _Laid] = []
        self.n = self.width = self.raw = self.cells = self.height = 0

    def put(self, part: str | _Laid) -> None:
        """Adds a line, or all lines of another."""
        self.parts.append(part)
        if isinstance(part, str):
            self.n, self.width = self.n + 1, max(self.width, len(part))
        else:
            self.n, self.width, self.height = self.n + part.n, max(self.width, part.width), max(self.height, part.height)

    def count(self, inner: _Laid) -> None:
        self.raw, self.cells = self.raw + inner.raw, self.cells + inner.cells

    def lines(self) -> Iterator[str]:
        todo = [iter(self.parts)]
        while todo:
            for part in todo[-1]:
                if not isinstance(part, str):
                    todo.append(iter(part.parts))
                    break
                yield part
            else:
                todo.pop()

    @property
    def room(self) -> int:
        """Characters that its lines may take when they are put together."""
        return ROOM * (self.raw + ROOM * self.cells)


class _Lines:
    """Text laid out line by line; runs of white space are one space, none at a line's ends."""

    def __init__(self):
        self.laid = _Laid()
        self.parts: list[str] = []
        self.space = self.blank = False
        self.indent, self.bullet = 0, ""

    def add(self, text: str, pre: bool) -> None:
        self.laid.raw += len(text)
        if pre:
            first, *more = text.split("\n")
            self._put(first)
            for line in more:
                self.end(keep=True)
                self._put(line)
            return
        text = _SPACE.sub(" ", text)
        if text == " ":
            self.space = bool(self.parts)
        elif text:
            if (self.space or text[0] == " ") and self.parts:
                self.parts.append(" ")
            self._put(text.strip(" "))
            self.space = text[-1] == " "

    def _put(self, text: str) -> None:
        if text:
            if not self.parts:
                self._space()
                self.parts.append("  " * self.indent + self.bullet)
                self.bullet = ""
            self.parts.append(text)

    def _space(self) -> None:
        """The empty line before a block."""
        if self.blank and self.laid.parts:
            self.laid.put("")
        self.blank = False

    def end(self, blank: bool = False, keep: bool = False) -> None:
        """Ends the line. blank: an empty line follows; keep: an empty line of preformatted text stays."""
        if self.parts:
            self.laid.put("".join(self.parts))
        elif keep and self.laid.parts:
            self.laid.put("")
        self.parts, self.space = [], False
        self.blank |= blank

    def table(self, laid: _Laid) -> None:
        """Lines of a table, indented as text here is if there is room for that."""
        self.end()
        self.laid.count(laid)
        if not laid.n:
            return
        self._space()
        indent, bullet = "  " * self.indent, self.bullet
        self.bullet = ""
        if not (indent or bullet):
            self.laid.put(laid)
        elif laid.height < MOST_PUT and laid.n * len(indent + bullet) <= laid.room:
            own = _Laid()
            for k, line in enumerate(laid.lines()):
                own.put(indent + bullet * (k == 0) + line)
            own.height = laid.height + 1
            self.laid.put(own)
        else:
            if bullet:
                self.laid.put(indent + bullet.rstrip(" "))
            self.laid.put(laid)

    def text(self) -> str:
        self.end()
        return "\n".join(self.laid.lines())

    def cell(self) -> _Laid:
        """What a cell holds: its lines but for empty ones."""
        self.end()
        out = _Laid()
        out.raw, out.cells = self.laid.raw, self.laid.cells + 1
        for part in self.laid.parts:
            part = part.rstrip(" ") if isinstance(part, str) else part
            if part:
                out.put(part)
        return out


def _laid_out(rows: list[list[tuple[_Laid, int]]]) -> _Laid:
    """The lines of a table of cells and the columns that they span: cells of a column start at the same place.

    Columns in which no cell starts have no place. A line ends with its last cell, the first line of a row with the row's. A row whose
    lines would take more room than its text warrants, by cells of many lines beside many others or by wide spans, isn't aligned: cells of
    one line stand side by side, others below one another. So do cells that hold lines which were put together MOST_PUT times.
    """
    widths: dict[int, int] = {}
    placed: list[list[tuple[int, int, _Laid]]] = []  # column, the one after its span, cell
    for row in rows:
        at, own = 0, []
        for cell, span in row:
            widths[at] = max(widths.get(at, 0), min(WIDEST, cell.width))
            own.append((at, at + span, cell))
            at += span
        placed.append(own)
    columns, offsets, empty = sorted(widths), [0], []
    for c in columns:
        empty.append(" " * widths[c] + " | ")
        offsets.append(offsets[-1] + len(empty[-1]))
    template, out = "".join(empty), _Laid()
    for row in placed:
        for _, _, cell in row:
            out.count(cell)
        starts = [bisect_left(columns, at) for at, _, _ in row]
        end = offsets[bisect_left(columns, row[-1][1])]
        if len(row) == 1 and end == offsets[starts[0] + 1]:
            out.put(row[0][2])
            continue
        cells, inner = [cell for _, _, cell in row], _Laid()
        for cell in cells:
            inner.count(cell)
            inner.height = max(inner.height, cell.height)
        size, below = end, 1
        for i, cell in zip(reversed(starts), reversed(cells), strict=True):
            size += max(0, cell.n - below) * offsets[i + 1]
            below = max(below, cell.n)
        own = _Laid()
        if inner.height >= MOST_PUT:
            for cell in cells:
                own.put(cell)
            out.put(own)
            continue
        if size <= inner.room:
            active = [(i, widths[columns[i]], cell.lines(), cell.n) for i, cell in zip(starts, cells, strict=True)]
            for k in range(max(1, *(cell.n for cell in cells))):
                active = [x for x in active if x[3] > k]
                line, before = [], 0
                for i, width, lines, _ in active:
                    line += [template[before : offsets[i]], next(lines).ljust(width)]
                    before = offsets[i] + width
                if k == 0:
                    line.append(template[before : end - 3])
                own.put("".join(line).rstrip(" "))
        elif all(cell.n <= 1 for cell in cells):
            own.put(" | ".join(next(cell.lines(), "") for cell in cells).rstrip(" "))
        else:
            for cell in cells:
                own.put(cell)
            out.put(own)
            continue
        kept = _Laid()
        for line in own.parts:
            if line:
                kept.put(line)
        kept.height = inner.height + 1
        out.put(kept)
    return out


class _Page:
    def __init__(self):
        self.open: list[tuple[str, bool]] = []  # tag, hidden
        self.out = [_Lines()]  # of the page, and of each open cell
        self.tables: list[list[list[tuple[_Laid, int]]]] = []
        self.spans: list[int] = []
        self.lists: list[int | None] = []  # the next number of each open list, None for bullets
        self.pre = 0
        # places in `open`, lowest first: of each tag, of blocks and of cells, and by kind of start tag what it ends and what keeps it in
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.cells: list[int] = []
        self.ends: list[list[int]] = [[] for _ in range(max(_KINDS.values()) + 1)]
        self.keeps: list[list[int]] = [[] for _ in range(max(_KINDS.values()) + 1)]

    def _push(self, tag: str, hidden: bool) -> None:
        place = len(self.open)
        self.open.append((tag, hidden))
        for held in self._held(tag):
            held.append(place)

    def _pop(self) -> tuple[str, bool]:
        tag, hidden = self.open.pop()
        for held in self._held(tag):
            held.pop()
        return tag, hidden

    def _held(self, tag: str) -> Iterator[list[int]]:
        """The lists of places that an element of this name is on."""
        yield self.at.setdefault(tag, [])
        if tag in BLOCK or tag in _CELLS:
            yield self.blocks
        if tag in _CELLS:
            yield self.cells
        for k in _ENDS.get(tag, ()):
            yield self.ends[k]
        for k in _KEEPS.get(tag, ()):
            yield self.keeps[k]

    @property
    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1][1]

    def text(self, data: str) -> None:
        if not self.hidden and data:
            self.out[-1].add(_unescaped(data), self.pre > 0)

    def start(self, tag: str, attributes: str) -> None:
        while name := self._nearest(tag):
            self._close(name)
        hidden = self.hidden or tag in HIDDEN or bool(attributes and _hides(attributes))
        lines = self.out[-1]
        if tag in VOID:
            if not hidden and tag in ("br", "hr"):
                if tag == "br":
                    lines.end(keep=self.pre > 0)
                else:
                    lines.end(blank=True)
            return
        self._push(tag, hidden)
        if hidden:
            return
        if tag in ("td", "th"):
            if not self.tables:
                lines.end()
                return
            if not self.tables[-1]:
                self.tables[-1].append([])
            found = _SPAN.match(_attributes(attributes).get("colspan", ""))
            self.spans.append(min(MOST_SPANNED, int(found[1])) if found else 1)
            self.out.append(_Lines())
            return
        if tag in BLOCK:
            lines.end(blank=tag in SPACED and not (tag in ("ul", "ol") and self.lists))
        if tag in ("ul", "ol"):
            self.lists.append(1 if tag == "ol" else None)
        elif tag == "li" and self.lists:
            number = self.lists[-1]
            lines.indent, lines.bullet = min(MOST_INDENTED, len(self.lists) - 1), "- " if number is None else f"{number}. "
            if number is not None:
                self.lists[-1] = number + 1
        elif tag == "pre":
            self.pre += 1
        elif tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])

    def _nearest(self, tag: str) -> str:
        """The innermost open element that the start of tag ends, empty if there is none within reach."""
        kind = _KINDS.get(tag)
        if kind is None or not self.ends[kind]:
            return ""
        place = self.ends[kind][-1]
        return "" if self.keeps[kind] and self.keeps[kind][-1] > place else self.open[place][0]

    def end(self, tag: str) -> None:
        places = self.at.get(tag)
        if not places:
            if tag in ("br", "p"):  # as browsers do
                self.start(tag, "")
            if tag != "p":
                return
            places = self.at["p"]
        place = places[-1]
        if tag != "table" and self.at.get("table") and self.at["table"][-1] > place:
            return
        if tag in BLOCK - {"table", "tr"} and self.cells and self.cells[-1] > place:
            return
        # an inline element's end tag is misplaced if a block is open in it; then it has no bearing on the text
        if tag in BLOCK or tag in ENDED_BY or tag in HIDDEN or place == len(self.open) - 1 or not (self.blocks and self.blocks[-1] > place):
            self._close(tag)

    def _close(self, tag: str) -> bool:
        """Ends the innermost `tag` and all that is open in it."""
        if not tag:
            return False
        while self.open:
            name, hidden = self._pop()
            if not hidden:
                self._ended(name)
            if name == tag:
                return True
        return False

    def _ended(self, tag: str) -> None:
        lines = self.out[-1]
        if tag in ("td", "th"):
            if self.spans and len(self.out) > 1:
                self.out.pop()
                self.tables[-1][-1].append((lines.cell(), max(1, self.spans.pop())))
            return
        if tag == "table" and self.tables:
            lines.table(_laid_out([r for r in self.tables.pop() if r]))
        if tag == "pre":
            self.pre -= 1
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in BLOCK:
            lines.end(blank=tag in SPACED and not (tag in ("ul", "ol") and self.lists))
        if tag == "li":
            lines.bullet, lines.indent = "", min(MOST_INDENTED, max(0, len(self.lists) - 1))
        if tag in ("ul", "ol") and not self.lists:
            lines.indent = 0

    def finish(self) -> str:
        while self.open:
            self._close(self.open[-1][0])
        return self.out[0].text()


def render(html: str | None) -> str:
    """The page's visible text; null and empty pages give an empty one. Time follows the page's length."""
    if not html:
        return ""
    page, at, seek = _Page(), 0, 0
    last = html.rfind(">") + 1  # no tag ends beyond
    while (begin := html.find("<", seek)) >= 0:
        if begin >= last and not html.startswith("<!--", begin):
            seek = html.find("<!--", begin)  # a comment may go on to the end
            if seek < 0:
                break
            continue
        found = _TAG.match(html, begin)
        if not found:
            seek = begin + 1
            continue
        page.text(html[at:begin])
        at = seek = found.end()
        name = found[2] or found[5]
        if not name:
            continue
        name = name.lower()
        if found[1] or found[4]:
            page.end(name)
            continue
        page.start(name, found[3] or found[6] or "")
        if name in RAW:  # its text has no tags
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I).search(html, at, max(at, last))
            if not page.hidden:
                page.text(html[at : close.start() if close else len(html)])
            at = seek = close.end() if close else len(html)
            page.end(name)
    page.text(html[at:])
    return page.finish()


def extract(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """pages with `html` replaced by its text (string). Null pages give an empty text; repeated rows repeat, other columns stay,
    but for one that has the name of the text, which is replaced.

    A page is held whole by one task, as its layout can depend on all of it.
    """
    pages = without(pages, [name], html)
    out, place = unused(pages, "_text"), pages.columns.index(html)
    schema = T.StructType([*pages.drop(html).schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = pa.array([render(x) for x in part.column(place).to_pylist()], pa.string())
                rest = [(n, part.column(i)) for i, n in enumerate(part.schema.names) if i != place]
                yield pa.RecordBatch.from_arrays([*(c for _, c in rest), texts], names=[*(n for n, _ in rest), out])

    return pages.mapInArrow(run, schema).withColumnRenamed(out, name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
