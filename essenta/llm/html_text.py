"""Visible text of HTML pages, laid out as a browser would.

A tree builder turns tags into elements, adding the end tags that HTML implies (a new ``li``
ends the last one, a block ends an open ``p``, table parts end each other) and skipping end
tags that close nothing. Visibility rules drop elements that are never shown, hidden by
attribute, by their own style, or by the plain rules of the page's style sheets for screens. The renderer
walks the tree with a stack of its own, so depth is no limit, and emits all remaining text:
white space collapsed except in ``pre``, blocks on lines of their own, a blank line around
paragraphs and the like, list items indented with their marks, table cells padded to columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NEVER = set("script style template noscript head title meta link datalist param iframe audio video canvas select textarea annotation annotation-xml".split())
BLOCK = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul
    caption thead tbody tfoot tr td th""".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
ENDS_P = BLOCK - set("body html li dd dt legend option optgroup caption thead tbody tfoot tr td th".split())
# a start tag of the key ends the open elements of the value, up to the nearest limit
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"td", "th", "tr", "caption"}, {"table"}),
    **dict.fromkeys(["thead", "tbody", "tfoot"], ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}, {"table"})),
}
SCOPE = {"table", "td", "th", "caption", "html", "body"}
_SPACE = re.compile(r"[ \t\n\f\r]+")
# inside a drawing only these show their text, unless one of the others is around them
DRAWN, UNDRAWN = {"text", "foreignobject"}, set("defs symbol clippath mask pattern marker desc metadata".split())
_QUOTED = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_PLAIN = re.compile(r"[.#]?[\w-]+")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.I)


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("html", {})
        self.open = [self.root]
        self.title: list[str] = []
        self.styles: list[Element] = []
        self.drawings = False

    def parse_html_declaration(self, i: int) -> int:
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i)  # doctypes, CDATA and unknown sections say nothing visible
        return len(self.rawdata) if end < 0 else end + 1

    def _end(self, names: set[str], limit: set[str]) -> None:
        """Close the nearest open element in ``names`` (and all inside it) unless ``limit`` is nearer."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in names:
                del self.open[k:]
                return self._end(names, limit)
            if tag in limit:
                return None
        return None

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body"):
            if tag == "body":
                self._end({"head"}, set())
            for k, v in attrs:
                self.root.attrs.setdefault(k, v)
            return
        if tag in ENDS_P:
            self._end({"p"}, SCOPE | {"button"})
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if self.open[-1].tag == "head" and tag not in NEVER and tag not in VOID:
            self.open.pop()
        element = Element(tag, dict(reversed(attrs)))  # the first of repeated attributes counts
        apart = tag == "svg" or (tag == "text" and self._inside("svg") is not None)  # placed, not part of the line
        self.open[-1].children += [" ", element, " "] if apart else [element]
        if tag == "style":
            self.styles.append(element)
        elif tag in ("svg", "math"):
            self.drawings = True
        if tag not in VOID:
            self.open.append(element)

    def _inside(self, name: str) -> list[str] | None:
        """Tags that are open within the nearest open ``name``, None without one."""
        tags = [e.tag for e in self.open] if self.drawings else []
        return tags[len(tags) - tags[::-1].index(name):] if name in tags else None

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML, but ends elements of drawings and formulas
        if tag not in VOID and self.open[-1].tag == tag and (tag in ("svg", "math") or self._inside("svg") is not None or self._inside("math") is not None):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        limit = SCOPE - {tag} if tag not in ("table", "thead", "tbody", "tfoot", "tr") else {"html"}
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in limit:
                return

    def handle_data(self, data: str) -> None:
        tag = self.open[-1].tag
        drawn = self._inside("svg")
        if tag == "style":
            self.open[-1].children.append(data)
        elif drawn is not None and (DRAWN.isdisjoint(drawn) or not UNDRAWN.isdisjoint(drawn)):
            self.open[-1].children.append(" ")
        elif tag == "title" and len(self.open) < 4:
            self.title.append(data)
        else:
            if tag == "head" and data.strip():
                self.open.pop()
            self.open[-1].children.append(data)


def for_screen(media: str) -> bool:
    """Whether a media list holds for any screen; a list with further conditions does not."""
    return any(re.sub(r"^only\s+", "", m.strip().lower()) in ("", "all", "screen") for m in media.split(","))


def declared(body: str) -> dict[str, tuple[bool, bool]]:
    """``property: (important, hides)`` of ``display`` and ``visibility`` in a list of declarations."""
    out: dict[str, tuple[bool, bool]] = {}
    for name, value, important in _DECLARED.findall(body):
        rule = bool(important), value.lower() in (("none",) if name.lower() == "display" else ("hidden", "collapse"))
        if rule[0] >= out.get(name.lower(), rule)[0]:
            out[name.lower()] = rule
    return out


def sheet_rules(styles: list[Element]) -> dict[str, dict]:
    """``selector: property: (important, place, hides)`` for the plain selectors (a tag, a class, an id) of all sheets.

    Blocks of at-rules count only where they hold for every screen; of rules for the same
    selector the last important one wins, else the last one.
    """
    out: dict[str, dict] = {}
    place = 0
    for style in styles:
        if not for_screen(style.attrs.get("media") or ""):
            continue
        sheet = _QUOTED.sub(" ", "".join(x for x in style.children if isinstance(x, str)))
        counted, rule, at = [True], None, 0  # for each open block: does it count; the open rule
        for mark in re.finditer(r"[{};]", sheet):
            text, kind, at = sheet[at:mark.start()].strip(), mark[0], mark.end()
            if rule is not None:  # nested rules are of selectors that are not plain
                depth += (kind == "{") - (kind == "}")
                if depth == 0 or (depth == 1 and kind == ";"):
                    body.append(text)
                if depth == 0:
                    found = declared(";".join(body)) if counted[-1] else {}
                    place += 1
                    for s in {s.strip() for s in rule.split(",")} if found else ():
                        if _PLAIN.fullmatch(s):
                            mine = out.setdefault(s if s[0] in ".#" else s.lower(), {})
                            for name, (important, hides) in found.items():
                                mine[name] = max(mine.get(name, (False, -1, False)), (important, place, hides))
                    rule = None
            elif kind == "{" and text.startswith("@"):
                name, _, media = text[1:].partition(" ")
                counted.append(counted[-1] and (name.lower() == "layer" or (name.lower() == "media" and for_screen(media))))
            elif kind == "{":
                rule, depth, body = text, 1, []
            elif kind == "}" and len(counted) > 1:
                counted.pop()
    return out


def is_hidden(e: Element, rules: dict[str, dict]) -> bool:
    a = e.attrs
    if e.tag in NEVER or "hidden" in a or (e.tag == "dialog" and "open" not in a):
        return True
    # (important, how exact the selector is, place, hides); the element's own style is the most exact
    found = {name: (important, 3, 0, hides) for name, (important, hides) in declared(a.get("style") or "").items()}
    if rules:
        names = [(0, e.tag), *((1, f".{c}") for c in (a.get("class") or "").split()), (2, f"#{a.get('id')}")]
        for exact, selector in names:
            for name, (important, place, hides) in rules.get(selector, {}).items():
                found[name] = max(found.get(name, (False, -1, 0, False)), (important, exact, place, hides))
    return any(x[-1] for x in found.values())


class Page:
    """Lines under construction; inline text waits until a block ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.indent = 0
        self.mark = ""

    def text(self, data: str, pre: bool) -> None:
        if not pre:
            self.inline.append(_SPACE.sub(" ", data))
            return
        first, *more = data.split("\n")
        self.inline.append(first)
        for line in more:
            self.line(True)
            self.inline.append(line)

    def line(self, pre: bool = False) -> None:
        """End the line; outside ``pre`` an empty one is no line."""
        raw = "".join(self.inline)
        self.inline.clear()
        text = raw.rstrip() if pre else re.sub(" +", " ", raw).strip(" ")
        if text or (pre and self.lines):
            pad = " " * self.indent
            if self.mark:
                pad, self.mark = f"{pad[:max(0, len(pad) - len(self.mark))]}{self.mark}", ""
            self.lines.append((pad + text).rstrip())

    def blank(self) -> None:
        self.line()
        if self.lines and self.lines[-1]:
            self.lines.append("")

    def result(self) -> list[str]:
        self.line()
        lines = [x for k, x in enumerate(self.lines) if x or (k and self.lines[k - 1])]
        while lines and not lines[-1]:
            lines.pop()
        return lines


def _number(value, default: int, most: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(most, int(found[1])) if found else default


def table_lines(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of (cell lines, columns) as text in which the cells of a column start together."""
    width: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                width[at] = max([width.get(at, 0), *map(len, lines)])
            at += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            line, at, edge = "", 0, 0
            for lines, span in row:
                line = line.ljust(edge) + (lines[k] if k < len(lines) else "")
                edge = max(edge + sum(width.get(c, 0) + 2 for c in range(at, at + min(span, 1000))), len(line) + 2)
                at += span
            out.append(line.rstrip())
    return out


def render(root: Element, rules: dict[str, dict]) -> str:
    """The visible text of a tree."""
    page = Page()
    pages, tables, lists = [], [], []
    pre = 0
    todo: list = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        if isinstance(node, str):
            page.text(node, pre > 0)
            continue
        tag = node.tag
        if not leaving:
            if is_hidden(node, rules) or (tag == "input" and (node.attrs.get("type") or "").lower() == "hidden"):
                continue
            if tag == "br":
                page.line(True)
                continue
            if tag == "img":
                continue
            if tag == "input" and (node.attrs.get("type") or "").lower() in ("submit", "reset", "button"):
                page.text(node.attrs.get("value") or "", False)
                continue
            if tag in ("td", "th", "caption") and tables:
                pages.append((page, pre))
                page, pre = Page(), 0
            elif tag == "table":
                page.blank()
                tables.append(([], page))
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in BLOCK:
                (page.blank if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists) else page.line)()
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", _number(node.attrs.get("start"), 1, 1 << 30)])
                page.indent += 2 + 2 * (tag == "ol")
            elif tag == "li":
                if lists and lists[-1][0]:
                    number = _number(node.attrs.get("value"), lists[-1][1], 1 << 30)
                    lists[-1][1] = number + 1
                    page.mark = f"{number}. "
                else:
                    page.mark = "- "
            elif tag == "pre":
                pre += 1
            elif tag in ("blockquote", "dd"):
                page.indent += 2
            todo.append((node, True))
            children = node.children
            if tag == "details" and "open" not in node.attrs:  # closed: only the summary shows
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            todo.extend((c, False) for c in reversed(children))
            continue
        if tag in ("td", "th", "caption") and tables:
            lines = page.result()
            page, pre = pages.pop()
            rows = tables[-1][0]
            if tag == "caption" or not rows:
                rows.append([])
            rows[-1].append((lines, max(1, _number(node.attrs.get("colspan"), 1, 1000))))
        elif tag == "table":
            rows, _ = tables.pop()
            page.line()
            pad = " " * page.indent
            page.lines += [pad + x for x in table_lines(rows)]
            page.blank()
        elif tag in BLOCK:
            if tag == "pre":
                page.line(True)
                pre -= 1
            (page.blank if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and len(lists) > 1) else page.line)()
            if tag in ("ul", "ol", "menu", "dir"):
                ordered, _ = lists.pop()
                page.indent -= 2 + 2 * ordered
            elif tag in ("blockquote", "dd"):
                page.indent -= 2
            elif tag == "li":
                page.mark = ""  # an item without text shows nothing
    return "\n".join(page.result())


def extract(html: str | None) -> tuple[str, str]:
    """Title and visible text of a page; both empty for a null or empty one."""
    if not html:
        return "", ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    return _SPACE.sub(" ", "".join(builder.title)).strip(), render(builder.root, sheet_rules(builder.styles))


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its HTML column, with ``title`` and ``text`` (replacing columns of these names).

    Null and empty pages have empty strings; broken markup is read as far as it goes. Each row
    stands for itself: repeated rows, null keys and ties change nothing. No rows give no rows.
    """
    rest = [c for c in pages.columns if c not in (html, "title", "text")]
    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def step(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [extract(x) for x in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())],
                names=[*rest, "title", "text"])

    return pages.select(*rest, html).mapInArrow(step, ", ".join([f"`{c}` {kind[c]}" for c in rest] + ["title string", "text string"]))
