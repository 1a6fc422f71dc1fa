"""HTML extraction by layout-aware rendering.

Method: a tokenizer and tree builder with implied tags follow a page's elements;
each element that lays out its content (list item, quote, table cell, ...) fills a
flow of lines, and hands it to its parent when it ends. All visible text comes
out, with the spacing that blocks, lists and tables give it.

What is rendered how
* white space collapses, but for ``pre`` and ``textarea``; ``br`` ends a line.
* blocks begin on a new line; paragraphs, headings, lists, tables, quotes and
  ``pre`` have an empty line around them, never more than one.
* list items have ``- ``, or their number in ordered lists (``start``, ``value``
  and ``reversed`` count), and hang; lists in lists are indented (by no more than DEEPEST levels).
* text fields show their value, or else their placeholder.
* a table's cells are laid out in columns as wide as their widest cell, two
  spaces apart; ``colspan`` and ``rowspan`` keep the columns aligned; cells may
  have several lines.

What isn't visible: comments, ``head``, scripts, styles, templates and the like;
elements with ``hidden``, or ``display:none`` or ``visibility:hidden`` in their
style attribute or in a rule of a ``style`` element with a simple selector (a
tag, class or id, or a tag with a class or id), where the rule holds on a plain
screen (not for print, nor for screens narrower or wider than SCREEN_PX); closed ``details`` but for their summary, closed dialogs;
inputs that are hidden, passwords, or no text fields or buttons; of a drawing (``svg``) all but its text elements. ``visibility:visible`` within ``visibility:hidden`` shows again.

Defined results
* null html: null text; empty html: empty text.
* broken html never fails: unclosed tags end with their parents, stray end tags
  are left out, a ``<`` that begins no tag is text, an unclosed comment or script
  goes to the end.
* rows that repeat a page_id give a row each; an empty table gives an empty
  table; other columns pass through unchanged.

Pages are rendered one by one, so no page meets another and nothing is shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm import common

# The elements of HTML by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe noembed noframes xmp title textarea".split())
NEVER = frozenset("head script style template noscript iframe noembed noframes title object audio video canvas datalist".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir table blockquote pre hr figure fieldset xmp".split())
BLOCK = MARGIN | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main nav search section summary tr td th caption tbody thead tfoot option optgroup".split())
#: Parts of drawings and formulas that no browser shows as text; of a drawing only the text in SHOWN_IN_SVG shows.
NEVER_IN_SVG = frozenset("defs symbol desc metadata annotation annotation-xml".split())
SHOWN_IN_SVG = frozenset("text foreignobject".split())
#: Elements that end a drawing or formula that wasn't closed.
BREAKS_OUT = BLOCK | frozenset("b big br code em i img nobr s small span strike strong sub sup tt u var".split())
LISTS = frozenset("ul ol menu dir".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split())
#: An element that begins ends the nearest of these, unless one of those stands between.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Elements over whose edge an end tag or an implied end doesn't reach.
WALLS = frozenset("table td th caption html button".split())
#: Levels up to which lists and quotes are indented further; marks and numbers stand at every level.
DEEPEST = 24
#: Fields whose content shows, or else the hint that stands for it.
FIELDS = frozenset(("", "text", "search", "email", "url", "tel", "number", "date", "time", "month", "week", "datetime-local"))
#: Most columns and rows of a cell, as the standard has them.
MOST_ACROSS, MOST_DOWN = 1000, 65534

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*)?(?:([.#])([\w-]+))?\Z")
_BEGINS = re.compile(r"[^{};]*([{};])")
#: Width of a plain screen, by which rules for narrow or wide screens hold or don't.
SCREEN_PX = 1280
_SPACE = re.compile(r"[ \t\n\r\f]+")


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(next(filter(None, values), "")))
    return found


def _declared(style: str) -> dict[str, str]:
    pairs = (d.split(":", 1) for d in style.lower().split(";") if ":" in d)
    return {k.strip(): v.replace("!important", "").strip() for k, v in pairs}


def _plain_screen(query: str) -> bool:
    """Whether a media query holds on a plain screen; one that isn't understood doesn't, so that it hides nothing."""

    def part(q: str) -> bool:
        words = q.split(" and ")
        kind = words[0].removeprefix("only ").strip()
        turned = kind.startswith("not ")
        kind = kind.removeprefix("not ").strip()
        if turned:
            return len(words) == 1 and kind not in ("screen", "all") and not kind.startswith("(")
        if not kind.startswith("("):
            if kind not in ("screen", "all", ""):
                return False
            words = words[1:]
        for w in words:
            m = re.fullmatch(r"\(\s*(min|max)-width\s*:\s*([\d.]+)(px|em|rem)\s*\)", w.strip())
            if not m:
                return False
            px = float(m[2]) * (1 if m[3] == "px" else 16)
            if not (px <= SCREEN_PX if m[1] == "min" else px >= SCREEN_PX):
                return False
        return True

    return any(part(" ".join(q.split())) for q in query.lower().split(","))


def _holding(source: str) -> str:
    """A style sheet's plain rules, with those of at-rules that hold on a plain screen."""
    out, at = [], 0
    while m := _BEGINS.match(source, at):
        head, start = m[0][:-1].strip(), at
        at = m.end()
        if m[1] != "{":
            continue
        depth = 1
        for b in re.finditer(r"[{}]", source[at:]):
            depth += 1 if b[0] == "{" else -1
            if not depth:
                end, after = at + b.start(), at + b.end()
                break
        else:
            end = after = len(source)
        at, body = after, source[at:end]
        name, _, query = head.lower().partition(" ")
        if "(" in name:
            name, _, query = head.lower().partition("(")
            query = "(" + query
        if not head.startswith("@"):
            out.append(source[start:after])
        elif name == "@layer" or (name == "@media" and _plain_screen(query)) or (name == "@supports" and not query.strip().startswith("not")):
            out.append(_holding(body))
    return "".join(out)


def _number(value: str | None, default: int, most: int) -> int:
    try:
        return max(-most, min(most, int((value or "").strip())))
    except ValueError:
        return default


def width(text: str) -> int:
    """Columns on the page: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines, the line being filled, and whether an empty line is due before the next."""

    __slots__ = ("lines", "parts", "due", "space")

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.due = False
        self.space = False

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if not words:
            return
        if words == " ":
            self.space = self.space or bool(self.parts)
            return
        if self.parts and (self.space or words[0] == " "):
            self.parts.append(" ")
        self.parts.append(words.strip(" "))
        self.space = words[-1] == " "

    def verbatim(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.parts.append(first)
        for line in rest:
            self.end(always=True)
            self.parts.append(line)

    def end(self, always: bool = False) -> None:
        """End the line being filled."""
        line = "".join(self.parts).rstrip()
        self.parts, self.space = [], False
        if line or always:
            self.line(line)

    def line(self, line: str) -> None:
        if self.due and self.lines:
            self.lines.append("")
        self.due = False
        self.lines.append(line)

    def block(self, margin: bool) -> None:
        self.end()
        self.due = self.due or margin

    def take(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Lines of a part of the layout."""
        for k, line in enumerate(lines):
            self.line(((first if k == 0 else rest) + line).rstrip())

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    """Cells by row; rendered when the table ends."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.captions: list[list[str]] = []

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.rows.append([])
        self.rows[-1].append((lines, across, down))

    def render(self) -> list[str]:
        placed: list[tuple[int, int, int, list[str]]] = []  # row, column, columns, lines
        taken: dict[int, int] = {}  # column: rows for which a cell from above still holds it
        for r, row in enumerate(self.rows):
            column, held = 0, {}
            for lines, across, down in row:
                while taken.get(column, 0) > 0:
                    column += 1
                placed.append((r, column, across, lines))
                if down > 1:
                    held.update(dict.fromkeys(range(column, column + across), down))
                column += across
            taken = {c: n - 1 for c, n in taken.items() if n > 1} | {c: n - 1 for c, n in held.items()}
        columns = max((c + a for _, c, a, _ in placed), default=0)
        widths = [0] * columns
        for _, c, a, lines in placed:
            if a == 1:
                widths[c] = max([widths[c], *map(width, lines)])
        for _, c, a, lines in placed:
            need = max(map(width, lines), default=0) - sum(widths[c : c + a]) - 2 * (a - 1)
            if a > 1 and need > 0:
                widths[c + a - 1] += need
        starts = [sum(widths[:c]) + 2 * c for c in range(columns)] if columns < 200 else []
        if not starts:
            at = 0
            for w in widths:
                starts.append(at)
                at += w + 2
        out = [line for caption in self.captions for line in caption]
        by_row: dict[int, list[tuple[int, list[str]]]] = {}
        for r, c, _, lines in placed:
            by_row.setdefault(r, []).append((starts[c], lines))
        for r in sorted(by_row):
            for k in range(max(len(lines) for _, lines in by_row[r])):
                line, at = [], 0
                for start, lines in sorted(by_row[r], key=lambda x: x[0]):
                    if k < len(lines) and lines[k]:
                        line.append(" " * max(0, start - at) + lines[k])
                        at = max(at, start) + width(lines[k])
                out.append("".join(line).rstrip())
        return out


class Element:
    __slots__ = ("tag", "flow", "shown", "visible", "pre", "table", "count", "step", "mark", "across", "down", "open", "depth")

    def __init__(self, tag: str, parent: Element | None):
        self.tag = tag
        self.flow = parent.flow if parent else Flow()
        self.shown = parent.shown if parent else True  # display
        self.visible = parent.visible if parent else True  # visibility
        self.pre = parent.pre if parent else False
        self.table = parent.table if parent else None
        self.count, self.step = 1, 0  # of an ordered list
        self.mark = ""
        self.across = self.down = 1
        self.open = True  # of details
        self.depth = parent.depth if parent else 0


class Renderer:
    def __init__(self):
        self.root = Element("", None)
        self.stack = [self.root]
        self.open = Counter()
        self.rules: list[tuple[str | None, str | None, str | None, dict[str, str]]] = []

    def render(self, source: str) -> str:
        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                inside = source[at : close.start()] if close else source[at:]
                if tag == "style":
                    self.style(inside)
                elif tag in ("textarea", "xmp"):
                    self.text(inside.removeprefix("\n"), raw=tag == "xmp")
                at = close.start() if close else end
        while len(self.stack) > 1:
            self.pop()
        return "\n".join(self.root.flow.done())

    def style(self, source: str) -> None:
        for selectors, body in _RULE.findall(_holding(re.sub(r"/\*.*?\*/", "", source, flags=re.S))):
            d = {k: v for k, v in _declared(body).items() if k in ("display", "visibility")}
            for s in selectors.split(",") if d else ():
                if (m := _SELECTOR.match(s.strip())) and m[0]:
                    self.rules.append((m[1] and m[1].lower(), m[2], m[3], d))

    def text(self, source: str, raw: bool = False) -> None:
        top = self.stack[-1]
        if not (top.shown and top.visible) or (top.tag == "details" and not top.open) or (top.tag in ("table", "tr", "tbody", "thead", "tfoot", "colgroup") and not source.strip()):
            return
        if self.open["svg"] and not any(self.open[t] for t in SHOWN_IN_SVG):
            return
        text = html.unescape(source) if not raw and "&" in source else source
        top.flow.verbatim(text) if top.pre else top.flow.text(text)

    def nearest(self, ends: set[str], walls: set[str] | frozenset[str]) -> int:
        """The place in the stack of the nearest of ``ends`` before a wall, or 0."""
        if not any(self.open[t] for t in ends):
            return 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in ends:
                return k
            if self.stack[k].tag in walls:
                return 0
        return 0

    def pop_to(self, k: int) -> None:
        while k and len(self.stack) > k:
            self.pop()

    def start(self, tag: str, source: str) -> None:
        if tag in BREAKS_OUT and (self.open["svg"] or self.open["math"]) and not self.open["foreignobject"]:
            self.pop_to(self.nearest({"svg", "math"}, set()))
        if tag in CLOSES_P and self.open["p"]:
            self.pop_to(self.nearest({"p"}, WALLS))
        if tag in IMPLIED_END:
            ends, walls = IMPLIED_END[tag]
            self.pop_to(self.nearest(ends, walls))
            if tag == "tr":
                self.pop_to(self.nearest({"td", "th"}, {"table"}))
                self.pop_to(self.nearest({"tr"}, {"table"}))
            elif tag in ("tbody", "thead", "tfoot"):
                self.pop_to(self.nearest({"tbody", "thead", "tfoot"}, {"table"}))
        if tag not in NEVER and tag not in ("html", "meta", "link", "base") and self.open["head"]:
            self.pop_to(self.nearest({"head"}, set()))
        if tag in ("td", "th") and self.open["table"] and not self.nearest({"tr"}, {"table"}):
            self.start("tr", "")
        a = _attributes(source) if source and not source.isspace() else {}
        parent = self.stack[-1]
        e = Element(tag, parent)
        d: dict[str, str] = {}
        for t, kind, name, rule in self.rules:
            if (t is None or t == tag) and (kind is None or (kind == "." and name in a.get("class", "").split()) or (kind == "#" and name == a.get("id"))):
                d |= rule
        d |= _declared(a["style"]) if "style" in a else {}
        drawn = self.open["svg"] or self.open["math"]
        if tag in NEVER or (drawn and tag in NEVER_IN_SVG) or d.get("display") == "none" or ("hidden" in a and "display" not in d) or (tag == "dialog" and "open" not in a):
            e.shown = False
        if parent.tag == "details" and not parent.open and tag != "summary":
            e.shown = False
        if "visibility" in d:
            e.visible = d["visibility"] not in ("hidden", "collapse")
        if tag == "details":
            e.open = "open" in a
        if tag == "br" and e.shown:
            e.flow.end(always=True) if not e.flow.due or e.flow.parts else None
        elif tag == "input" and e.shown and e.visible:
            kind = a.get("type", "").strip().lower()
            if kind in FIELDS or kind in ("submit", "button", "reset"):
                e.flow.text(a.get("value") or (a.get("placeholder", "") if kind in FIELDS else ""))
        if e.shown and tag in BLOCK:
            parent.flow.block(tag in MARGIN and not (tag in LISTS and parent.tag == "li"))
        if tag == "text" and self.open["svg"] and e.shown and e.visible:
            e.flow.text(" ")  # each stands in a place of its own
        if tag in VOID or (tag in ("svg", "math") or drawn) and source.endswith("/"):
            return
        if tag in ("pre", "textarea", "xmp"):
            e.pre = True
        elif tag in LISTS:
            e.step = (-1 if "reversed" in a else 1) if tag == "ol" else 0
            e.count = _number(a.get("start"), 1, 10**9)
        elif tag == "li":
            e.flow = Flow()
            e.depth += 1
            owner = next((x for x in reversed(self.stack) if x.tag in LISTS), None) if any(self.open[t] for t in LISTS) else None
            if owner is not None and owner.step:
                owner.count = _number(a.get("value"), owner.count, 10**9)
                e.mark = f"{owner.count}. "
                owner.count += owner.step if e.shown else 0
            else:
                e.mark = "- "
        elif tag in ("blockquote", "dd"):
            e.flow = Flow()
            e.depth += 1
            e.mark = "  "
        elif tag == "table":
            e.table = Table()
            e.flow = Flow()  # text that stands outside the cells
        elif tag == "tr" and e.table is not None and e.shown:
            e.table.rows.append([])
        elif tag in ("td", "th", "caption") and e.table is not None:
            e.flow = Flow()
            e.across = max(1, _number(a.get("colspan"), 1, MOST_ACROSS))
            e.down = max(1, _number(a.get("rowspan"), 1, MOST_DOWN) or MOST_DOWN)  # 0: all rows that follow
            e.pre = False
        self.stack.append(e)
        self.open[tag] += 1

    def end(self, tag: str) -> None:
        if not self.open[tag]:
            if tag == "p":
                self.stack[-1].flow.block(True)
            elif tag == "br":
                self.start("br", "")
            return
        walls = frozenset() if tag in WALLS or tag in ("tr", "tbody", "thead", "tfoot", "body") else frozenset(("td", "th", "caption", "table")) - {tag}
        k = self.nearest({tag}, walls)
        if not k:
            return
        if tag not in BLOCK and tag not in NEVER and any(x.tag in BLOCK for x in self.stack[k + 1 :]):
            self.open[tag] -= 1  # a part of a line that ends within a later block: the block goes on
            del self.stack[k]
            return
        self.pop_to(k)

    def pop(self) -> None:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        if not e.shown:
            return
        parent = self.stack[-1]
        if e.tag == "table":
            stray, lines = e.flow.done(), e.table.render()
            parent.flow.take(stray)
            parent.flow.due = parent.flow.due or bool(stray)
            parent.flow.take(lines)
        elif e.tag in ("td", "th") and e.table is not None and e.flow is not parent.flow:
            e.table.cell(e.flow.done(), e.across, e.down)
            return
        elif e.tag == "caption" and e.table is not None and e.flow is not parent.flow:
            e.table.captions.append(e.flow.done())
            return
        elif e.tag in ("li", "blockquote", "dd"):
            lines = e.flow.done()
            deep = e.depth > DEEPEST
            parent.flow.take(lines, e.mark if e.mark.strip() or not deep else "", "" if deep else " " * len(e.mark))
        if e.tag in BLOCK:
            parent.flow.block(e.tag in MARGIN and not (e.tag in LISTS and parent.tag == "li"))


def render(source: str | None) -> str | None:
    """All visible text of a page, laid out."""
    return None if source is None else Renderer().render(source.replace("\0", ""))


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(None if s is None else s.decode("utf-8", "replace")) for s in batch.column("_html_source").to_pylist()]
        yield batch.drop_columns(["_html_source"]).append_column("text", pa.array(texts, pa.string()))


def html_text(pages: DataFrame) -> DataFrame:
    """``pages`` without ``html``, and with ``text`` (replacing a column of this name)."""
    common.tune(pages.sparkSession)
    others = [f for f in pages.schema if f.name not in ("html", "text")]
    source = pages.select(*(F.col(f"`{f.name}`") for f in others), F.col("html").cast("binary").alias("_html_source"))
    return source.mapInArrow(_pages, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "text string"]))
