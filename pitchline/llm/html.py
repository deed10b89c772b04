"""Operator 2: layout-aware text of HTML pages.

A tree builder reads tags leniently (implied ends of p, li, dt, dd, tr, td, th, option and their
like, void elements, raw text, stray end tags), visibility rules (attributes, inline styles, simple selectors of style elements) drop what a browser wouldn't
show (of an object that names data, the fallback; of an svg, all but its texts), and a renderer walks the tree: blocks start new lines, paragraphs and headings stand apart,
lists are marked and indented, preformatted text keeps its spaces, and the cells of a table are
aligned in columns.  Building and walking use explicit stacks, so deep nesting is no limit.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import inner

# a tag ends at the first > outside quoted values, or with the page; a quote that nothing closes quotes nothing.  No part is given back once taken
_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)))?+")
_SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript".split())
HIDDEN = frozenset("head script style template noscript title meta link base iframe noembed noframes audio video canvas map datalist param source track annotation annotation-xml".split())
#: Start tags that may stand in a head; any other ends it, as text does.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
#: What of an svg has text to show, and what shows none of its content.
_LABELS, _UNDRAWN = frozenset(["text", "foreignobject"]), frozenset("defs symbol clippath mask pattern marker metadata desc".split())
PARAGRAPH = frozenset("xmp p h1 h2 h3 h4 h5 h6 pre blockquote ul ol dl table figure hr".split())
BLOCK = PARAGRAPH | frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup legend li main menu nav optgroup option section summary tbody td tfoot th thead tr caption search".split())
#: Elements that an opening tag ends, and those beyond which it doesn't look.
_BARRIER = frozenset("table td th caption button body html".split())
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
} | {g: (frozenset(["tr", "td", "th", "caption", "colgroup", "thead", "tbody", "tfoot"]), frozenset(["table"])) for g in ("thead", "tbody", "tfoot")}
_ENDS_P = (BLOCK - frozenset("html body li dd dt td th tr tbody thead tfoot caption option optgroup legend".split())) | frozenset(["li", "dt", "dd"])
_DECLARED = re.compile(r"(?:^|;)\s*+(display|visibility)\s*+:\s*+([a-z-]++)\s*+(!\s*+important)?", re.I)
_RULE = re.compile(r"([^{}]*+)\{([^{}]*+)\}")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SIMPLE = re.compile(r"([a-zA-Z][\w-]*+|\*)?+((?:[.#][\w-]++)*+)\Z")


class Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.items = tag, attrs, []


def parse(html: str) -> Node:
    """The page's tree: nodes hold nodes and strings (entities resolved)."""
    root = Node("#root", {})
    stack, at, low = [root], 0, None
    opened: defaultdict[str, list[int]] = defaultdict(list)  # by tag, its places on the stack

    def add_text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and not _SPACE.fullmatch(s):
                close(frozenset(["head"]), frozenset())
            stack[-1].items.append(unescape(s) if "&" in s else s)

    def last(tags: frozenset[str]) -> int:
        """The highest place of any of the tags, 0 (the root's) without one."""
        return max((opened[t][-1] for t in tags if opened[t]), default=0)

    def close(tags: frozenset[str], barrier: frozenset[str]) -> bool:
        """Ends the innermost of the tags with all within it, unless a barrier stands further in; whether it did."""
        place = last(tags)
        if not place or place < last(barrier):
            return False
        for n in stack[place:]:
            opened[n.tag].pop()
        del stack[place:]
        return True

    while True:
        m = _TOKEN.search(html, at)
        if not m:
            add_text(html[at:])
            return root
        add_text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not opened["p"]:
                stack[-1].items.append(Node("p", {}))
            elif tag == "br":
                stack[-1].items.append(Node("br", {}))
            else:
                # an end tag in a cell doesn't close what lies outside the table
                barrier = frozenset() if tag in ("table", "body", "html", "tr", "tbody", "thead", "tfoot") else frozenset(["td", "th", "caption"]) - {tag}
                close(frozenset([tag]), barrier)
            continue
        attrs = {}
        if m[3] and not m[3].isspace():
            for a in _ATTR.finditer(m[3]):
                value = a[2] if a[2] is not None else a[3] if a[3] is not None else a[4] or ""
                attrs.setdefault(a[1].lower(), unescape(value) if "&" in value else value)
        if tag in ("html", "head", "body") and opened[tag]:
            continue
        if tag in _ENDS_P:
            close(frozenset(["p"]), _BARRIER)
        if tag == "body" or (opened["head"] and not opened["template"] and tag not in _IN_HEAD):
            close(frozenset(["head"]), frozenset())
        if tag in IMPLIED:
            tags, barrier = IMPLIED[tag]
            while close(tags, barrier):
                pass
        node = Node(tag, attrs)
        stack[-1].items.append(node)
        foreign = (opened["svg"] or opened["math"]) and not opened["foreignobject"]
        if tag in VOID or m[3].endswith("/") and (foreign or tag in ("path", "circle", "rect")):
            continue
        if tag in RAW:
            if low is None:
                low = html.lower()
                low = low if len(low) == len(html) else "".join(c.lower() if c.isascii() else c for c in html)
            end = low.find(f"</{tag}", at)
            body = html[at : end if end >= 0 else len(html)]
            if tag in ("textarea", "title"):
                node.items.append(unescape(body))
            elif tag == "style" or tag not in HIDDEN:
                node.items.append(body)
            close_at = html.find(">", end) if end >= 0 else -1
            at = close_at + 1 if close_at >= 0 else len(html)
            continue
        opened[tag].append(len(stack))
        stack.append(node)


class Sheet:
    """Display and visibility rules of a page's style elements, by weight and order.

    Selectors of one compound (tag, classes, id) count; those with combinators, attributes or states, and
    what stands in at-rules, don't.
    """

    def __init__(self, css: str = "") -> None:
        self.rules: dict[str, list[tuple]] = {}
        flat, within, before = [], [], ""  # within: for each open brace, whether an at-rule holds it
        for part in re.split(r"([{}])", _CSS_COMMENT.sub("", css)):
            if part == "{":
                within.append(bool(within and within[-1]) or "@" in before)
                if not within[-1]:
                    flat.append(before + part)
            elif part == "}":
                if within and not within.pop():
                    flat.append(part)
            elif not within:
                before = part.rpartition(";")[2]
            elif not within[-1]:
                flat.append(part)
        for n, m in enumerate(_RULE.finditer("".join(flat))):
            told = [(p.lower(), v.lower(), bool(i)) for p, v, i in _DECLARED.findall(m[2])]
            for selector in m[1].split(",") if told else ():
                s = _SIMPLE.match(selector.strip())
                if s and (s[1] or s[2]):
                    marks = re.findall(r"[.#][\w-]+", s[2])
                    tag = (s[1] or "*").lower()
                    weight = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), tag != "*")
                    for p, v, important in told:
                        self.rules.setdefault(marks[0] if marks else tag, []).append((important, weight, n, tag, frozenset(marks), p, v))

    def of(self, node: Node) -> dict[str, str]:
        """What the rules and the element's own style say."""
        best: dict[str, tuple] = {}
        if self.rules:
            marks = {f".{c}" for c in node.attrs.get("class", "").split()} | ({f"#{node.attrs['id']}"} if node.attrs.get("id") else set())
            for key in (*marks, node.tag, "*"):
                for important, weight, n, tag, need, p, v in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and need <= marks:
                        best[p] = max(best.get(p, ()), (important, weight, n, v))
        style = node.attrs.get("style")
        if style:
            for n, (p, v, important) in enumerate(_DECLARED.findall(style)):
                best[p.lower()] = max(best.get(p.lower(), ()), (bool(important), (1 << 30, 0, 0), n, v.lower()))
        return {p: b[-1] for p, b in best.items()}


def _style(root: Node) -> Sheet:
    """The rules of all style elements of a page."""
    css, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            css.append("".join(c for c in node.items if isinstance(c, str)))
        else:
            todo.extend(c for c in reversed(node.items) if isinstance(c, Node))
    return Sheet("\n".join(css)) if css else Sheet()


def visible(node: Node, told: dict[str, str]) -> bool:
    """Whether an element has a place on the page, going by its tag, attributes and what styles say of it."""
    if node.tag in HIDDEN or told.get("display") == "none":
        return False
    if "hidden" in node.attrs and "display" not in told:
        return False
    if node.tag == "object" and "data" in node.attrs:
        return False
    return not (node.tag == "dialog" and "open" not in node.attrs)


def _labels(svg: Node, sheet: Sheet) -> list[Node | str]:
    """The texts of an svg, in order and apart from one another."""
    out, todo = [], list(reversed(svg.items))
    while todo:
        node = todo.pop()
        if isinstance(node, str) or node.tag in _UNDRAWN or not visible(node, sheet.of(node)):
            continue
        if node.tag in _LABELS:
            out += [" ", node, " "]
        else:
            todo.extend(reversed(node.items))
    return out


class _Box:
    """Lines of a block container: text runs are joined and their white space collapsed."""

    def __init__(self, indent: str = "") -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = 0  # blank lines owed before the next line
        self.indent, self.first = indent, ""

    def text(self, s: str, pre: bool) -> None:
        if not pre:
            self.run.append(s)
            return
        parts = s.split("\n")
        for i, p in enumerate(parts):
            if i:
                self._emit(self._collapsed(True))
            self.run.append("\0" + p)

    def _collapsed(self, keep: bool) -> str:
        run, self.run = self.run, []
        if any(r.startswith("\0") for r in run):
            return "".join(r[1:] if r.startswith("\0") else _SPACE.sub(" ", r) for r in run).rstrip() if keep or any(r.strip("\0 \t") for r in run) else ""
        return _SPACE.sub(" ", "".join(run)).strip(" ")

    def _emit(self, line: str) -> None:
        if line and self.gap and self.lines:
            self.lines.append("")
        if line or self.lines and not self.gap:
            self.gap = 0 if line else self.gap
            self.lines.append((self.indent[: len(self.indent) - len(self.first)] + self.first + line) if line else "")
            if line:
                self.first = ""

    def flush(self) -> None:
        line = self._collapsed(False)
        if line:
            self._emit(line)

    def br(self) -> None:
        line = self._collapsed(False)
        self._emit(line)

    def block(self, apart: bool) -> None:
        self.flush()
        if apart:
            self.gap = 1

    def take(self, lines: list[str], apart: bool) -> None:
        self.block(apart)
        for line in lines:
            if line:
                self._emit(line)
            elif self.lines:
                self.lines.append("")


def _placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[list[str], int, int]]]:
    """(lines, first column, columns) of every row's cells; columns that a cell of a row above still fills are passed over."""
    out: list[list[tuple[list[str], int, int]]] = []
    busy: list[tuple[int, int, int]] = []  # (first column, column after the last, first row that is free again) of cells that reach down
    for r, row in enumerate(rows):
        busy = sorted(x for x in busy if x[2] > r)
        col, placed, k = 0, [], 0
        for lines, span, down in row:
            while k < len(busy) and busy[k][0] <= col:
                col = max(col, busy[k][1])
                k += 1
            placed.append((lines, col, span))
            col += span
        busy += [(c, c + span, r + down) for (_, c, span), (_, _, down) in zip(placed, row, strict=True) if down > 1]
        out.append(placed)
    return out


def _layout(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Aligned columns, two spaces apart; a cell may hold several lines, span columns, and reach down over rows, where its columns stay blank."""
    placed = _placed(rows)
    widths: dict[int, int] = {}
    for row in placed:
        for lines, col, span in row:
            if span == 1:
                widths[col] = max(widths.get(col, 0), max(map(len, lines), default=0))
    out = []
    for row in placed:
        height = max((len(lines) for lines, _, _ in row), default=0)
        for k in range(height):
            at, col, line = 0, 0, ""
            for lines, first, span in row:
                at += sum(widths.get(c, 0) + 2 for c in range(col, first))
                line = line.ljust(at) + (lines[k] if k < len(lines) else "")
                at += sum(widths.get(c, 0) + 2 for c in range(first, first + span))
                col = first + span
                at = max(at, len(line) + 2) if span > 1 else at
            out.append(line.rstrip())
    while out and not out[0]:
        out.pop(0)
    return out


def render(root: Node) -> str:
    """All visible text of a tree, laid out."""
    boxes, tables, lists = [_Box()], [], []
    pre, sheet, unseen = 0, _style(root), [False]  # unseen: visibility, from which an element within can come back
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            if not unseen[-1]:
                boxes[-1].text(node, pre > 0)
            continue
        tag = node.tag
        if not leaving:
            told = sheet.of(node)
            if tag != "#root" and not visible(node, told):
                continue
            shown = {"hidden": True, "collapse": True, "visible": False}.get(told.get("visibility"), unseen[-1])
            if tag == "br":
                boxes[-1].br()
                continue
            if tag == "hr":
                boxes[-1].block(True)
                continue
            if tag in ("wbr", "img", "area", "col", "embed"):
                continue
            if tag == "input":
                if node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "") and node.attrs.get("value") and not shown:
                    boxes[-1].text(f" {node.attrs['value']} ", False)
                continue
            if tag in BLOCK:
                # lists within lists don't stand apart
                boxes[-1].block(tag in PARAGRAPH and not (tag in ("ul", "ol", "dl") and lists))
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "1")
                lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                box = _Box(" " * len(mark))
                box.first = "" if shown else mark
                boxes.append(box)
            elif tag in ("dd", "blockquote"):
                boxes.append(_Box("  "))
            elif tag == "table":
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th", "caption"):
                boxes.append(_Box())
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
            unseen.append(shown)
            todo.append((node, True))
            items = _labels(node, sheet) if tag == "svg" else node.items
            if tag == "pre" and items and isinstance(items[0], str) and items[0].startswith("\n"):
                items = [items[0][1:], *items[1:]]
            if tag == "details" and "open" not in node.attrs:
                items = [c for c in items if isinstance(c, Node) and c.tag == "summary"]
            if tag in ("table", "tr", "tbody", "thead", "tfoot", "ul", "ol"):
                items = [c for c in items if isinstance(c, Node) or not c.isspace()]
            todo.extend((c, False) for c in reversed(items))
            continue
        unseen.pop()
        if tag in BLOCK or tag in ("#root", "textarea"):
            boxes[-1].flush()
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag in ("li", "dd", "blockquote"):
            box = boxes.pop()
            if box.first and box.first.strip() and not box.lines:
                box.lines = []
            boxes[-1].take(box.lines, tag == "blockquote")
        elif tag in ("td", "th", "caption"):
            lines = boxes.pop().lines
            if tag == "caption" or not tables:
                boxes[-1].take(lines, False)
            else:
                if not tables[-1]:
                    tables[-1].append([])
                across, down = (int(v) if v.isascii() and v.isdigit() and len(v) < 6 else 1 for v in (node.attrs.get(a, "1") for a in ("colspan", "rowspan")))
                tables[-1][-1].append((lines, min(max(across, 1), 1000), down or 65_534))  # 0 rows: all that follow
        elif tag == "table":
            lines = _layout(tables.pop())
            box = boxes[-1]
            box.block(True)
            for i, line in enumerate(lines):
                box._emit(line) if line or i == 0 else box.lines.append("")
        elif tag in ("pre", "textarea", "xmp"):
            pre -= 1
        if tag in BLOCK:
            boxes[-1].block(tag in PARAGRAPH and not (tag in ("ul", "ol", "dl") and lists))
    boxes[-1].flush()
    return "\n".join(boxes[-1].lines).strip("\n")


def extract(html: str | None) -> str:
    return render(parse(html)) if html else ""


def _extract(html: str, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [c for c in batch.schema.names if c != html]
            texts = pa.array([extract(h) for h in batch.column(html).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), texts], names=[*same, out])

    return run


def extract_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with its columns but ``html``, and ``out``, the page's visible text.

    Null, empty and invisible pages give the empty text; anything else is read as leniently as a browser does, so no
    input fails.  Rows stay as they are, repeated ones too; a column of the name ``out`` is replaced.
    """
    (body,) = inner(df, "html")
    rows = df.withColumn(body, F.col(html).cast("string")).drop(html, out)
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != body)
    return rows.mapInArrow(_extract(body, out), f"{kinds}`{out}` string")
