"""HTML extraction: a tree builder with implied tags, visibility rules and a layout-aware renderer.

All visible text of a page comes out: blocks on lines of their own (a blank line around
paragraphs, headings and the like), list items with their marks and depth, table rows with
cells aligned by column, preformatted text as it stands. Not visible: head matter but the
title (a column of its own), scripts, styles, templates, comments, [hidden], inline or
style-sheet display:none or visibility:hidden, hidden inputs, closed dialogs and details.

Work and output are linear in the page, whatever it holds: a tag that is not closed by the
page's end takes the rest with it, as in browsers (a quote that never closes is no quote);
elements nested deeper than DEPTH lend their text to the one at that depth, as in
browsers; lists are indented for INDENTED levels; a column is as wide as its longest line
of up to WIDE code points, longer ones stick out; a run of blanks between the cells of a
line has at most BLANKS.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .exchange import prepare

_OPENING = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_COMMENT_END = re.compile(r"-->|--!>")
_STOP = re.compile(r">|=\s*[\"']")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_GONE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "xmp", "iframe", "noembed", "noframes", "noscript"}
RCDATA = {"title", "textarea"}
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas svg math datalist".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure table menu".split())
BLOCKS = PARAGRAPHS | frozenset("html body address article aside center details dialog dd div dt fieldset figcaption footer form header hgroup hr legend li main nav search section summary tr caption thead tbody tfoot optgroup option".split())
#: Start tags that end an open p.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
#: Start tag -> (open elements that it ends, elements beyond which none is ended).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"tbody", "thead", "tfoot", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
HEAD = frozenset("title meta link base script style template noscript".split())
SCOPES = frozenset("table td th caption button".split())
BULLET = "- "
DEPTH, INDENTED, WIDE, BLANKS = 512, 20, 40, 200


class Node:
    __slots__ = ("tag", "attrs", "items")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.items = tag, attrs, []


@lru_cache(maxsize=64)
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


class _Reader:
    """Places of tags in a page; each search goes over what it skips once."""

    def __init__(self, html: str):
        self.html, self.open_quote = html, set()

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag whose name ends at `at`; -1 where there is none."""
        while True:
            m = _STOP.search(self.html, at)
            if m is None:
                return -1
            quote = m.group()[-1]
            if quote == ">":
                return m.start()
            close = -1 if quote in self.open_quote else self.html.find(quote, m.end())
            if close < 0:
                self.open_quote.add(quote)
            at = m.end() if close < 0 else close + 1

    def raw_end(self, tag: str, at: int) -> tuple[int, int]:
        """Where the text of a raw element ends, and its end tag; both the page's end where it is not closed."""
        n = len(self.html)
        stop = _closing(tag).search(self.html, at)
        close = self.html.find(">", stop.end()) if stop else -1
        return (stop.start() if stop else n), (close + 1 if close >= 0 else n)


def parse(html: str) -> Node:
    """The tree of a page: nodes whose items are nodes and strings; missing and mismatched tags are mended."""
    root, reader = Node("html", {}), _Reader(html)
    stack, at, n = [root], 0, len(html)
    opened: Counter = Counter()
    deeper: Counter = Counter()

    def cut(i: int) -> None:
        opened.subtract(x.tag for x in stack[i:])
        del stack[i:]

    def close(tags: set[str], until: set[str]) -> None:
        i = len(stack) - 1
        while i > 0 and any(opened[t] > 0 for t in tags):
            if stack[i].tag in tags:
                cut(i)
            elif stack[i].tag in until:
                return
            i -= 1

    def text(s: str) -> None:
        if stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
            cut(1)
        stack[-1].items.append(unescape(s) if "&" in s else s)

    def start(tag: str, attrs: dict[str, str]) -> Node | None:
        if tag == "html":
            for k, v in attrs.items():
                root.attrs.setdefault(k, v)
            return None
        if stack[-1].tag == "head" and tag not in HEAD:
            cut(len(stack) - 1)
        if tag in ENDS_P:
            close({"p"}, SCOPES)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag == "a":
            close({"a"}, SCOPES)
        node = Node(tag, attrs)
        stack[-1].items.append(node)
        if tag not in VOID and tag not in RAW and tag not in RCDATA:
            if len(stack) < DEPTH:
                stack.append(node)
                opened[tag] += 1
            else:
                deeper[tag] += 1
        return node

    def end(tag: str) -> None:
        if deeper[tag] > 0:
            deeper[tag] -= 1
        elif tag == "p" and opened["p"] <= 0:
            stack[-1].items.append(Node("p", {}))
        elif tag == "br":
            stack[-1].items.append(Node("br", {}))
        elif tag not in ("html", "body") and opened[tag] > 0:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in ("td", "th", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
                    break

    while at < n:
        m = _OPENING.search(html, at)
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        slash, name = m.groups()
        if name is None and m.group() == "<!--":
            if html.startswith((">", "->"), m.end()):
                at = html.index(">", m.end()) + 1
            else:
                stop = _COMMENT_END.search(html, m.end())
                at = stop.end() if stop else n
            continue
        close_at = reader.tag_end(m.end()) if name and not slash else html.find(">", m.end())
        if close_at < 0:
            break
        at = close_at + 1
        if name is None:
            continue
        tag = name.lower()
        if slash:
            end(tag)
            continue
        attrs: dict[str, str] = {}
        if close_at > m.end():
            for a in _ATTR.finditer(html, m.end(), close_at):
                value = a.group(2) or a.group(3) or a.group(4) or ""
                attrs.setdefault(a.group(1).lower(), unescape(value) if "&" in value else value)
        node = start(tag, attrs)
        if tag in RAW or tag in RCDATA:
            stop, after = reader.raw_end(tag, at)
            raw = html[at:stop]
            node.items.append(unescape(raw) if tag in RCDATA else raw)
            at = after
    return root


def _walk(root: Node):
    todo = [root]
    while todo:
        x = todo.pop()
        yield x
        todo.extend(i for i in reversed(x.items) if isinstance(i, Node))


def _hiding(root: Node) -> tuple[set[str], set[str], set[str]]:
    """Tags, classes and ids that simple rules of the page's style sheets hide."""
    tags, classes, ids = set(), set(), set()
    for x in _walk(root):
        if x.tag == "style" and x.items and _GONE.search(x.items[0].replace("{", ";")):
            for rule in re.sub(r"/\*.*?(?:\*/|\Z)", "", x.items[0], flags=re.S).split("}")[:-1]:
                selectors, brace, body = rule.rpartition("{")
                if brace and _GONE.search(body):
                    for s in selectors.rpartition("{")[2].split(","):
                        s = s.strip()
                        if re.fullmatch(r"[\w-]+", s):
                            tags.add(s.lower())
                        elif re.fullmatch(r"\.[\w-]+", s):
                            classes.add(s[1:])
                        elif re.fullmatch(r"#[\w-]+", s):
                            ids.add(s[1:])
    return tags, classes, ids


def _seen(x: Node, hiding) -> bool:
    if x.tag in UNSEEN or x.tag in hiding[0]:
        return False
    a = x.attrs
    if not a:
        return x.tag != "dialog"
    if "hidden" in a or x.tag == "dialog" and "open" not in a or x.tag == "input" and a.get("type", "").lower() == "hidden":
        return False
    if "style" in a and _GONE.search(a["style"]):
        return False
    return not (hiding[2] and a.get("id") in hiding[2] or hiding[1] and not hiding[1].isdisjoint(a.get("class", "").split()))


class _Out:
    """Lines of rendered text; breaks are remembered until text follows."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.breaks = 0

    def put(self, s: str, pre: bool = False) -> None:
        if pre:
            first, *rest = s.split("\n")
            self._add(first)
            for x in rest:
                self.newline(True)
                self._add(x)
            return
        parts = _SPACE.sub(" ", s)
        if parts == " ":
            self.space = bool(self.line)
        elif parts:
            if parts[0] == " ":
                self.space = bool(self.line)
            words = parts.strip(" ")
            self._add((" " if self.space and self.line else "") + words)
            self.space = parts[-1] == " "

    def _add(self, s: str) -> None:
        if s:
            if self.breaks and (self.lines or self.line):
                self.lines.extend([""] * (self.breaks - 1))
            self.breaks = 0
            self.line.append(s)

    def newline(self, hard: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" \t\r\f"))
            self.line = []
        elif hard and self.lines and not self.breaks:
            self.lines.append("")
        self.space = False

    def block(self, blank: bool) -> None:
        self.newline()
        self.breaks = max(self.breaks, 2 if blank else 1)

    def text(self) -> str:
        self.newline()
        return "\n".join(self.lines)


def _table(node: Node, hiding, depth: int) -> str:
    """Rows with cells padded to their column's width; cells of several lines keep them."""
    rows: list[list[tuple[list[str], int]]] = []
    captions: list[str] = []
    loose: list[Node | str] = []

    def cells(tr: Node) -> None:
        row = []
        for x in tr.items:
            if isinstance(x, Node) and x.tag in ("td", "th"):
                if _seen(x, hiding):
                    span = x.attrs.get("colspan", "")
                    row.append((render(x, hiding, depth + 1).split("\n"), max(1, min(int(span[:4]), 1000)) if span.isdecimal() else 1))
            elif not isinstance(x, str) or x.strip():
                loose.append(x)
        if row:
            rows.append(row)

    def body(x: Node) -> None:
        bare = Node("tr", {})
        for y in x.items:
            if isinstance(y, str):
                if y.strip():
                    loose.append(y)
            elif y.tag in ("td", "th"):
                bare.items.append(y)
            elif y.tag == "caption":
                if _seen(y, hiding):
                    captions.append(render(y, hiding, depth + 1))
            elif y.tag in ("thead", "tbody", "tfoot"):
                if _seen(y, hiding):
                    body(y)
            elif y.tag == "tr":
                if _seen(y, hiding):
                    cells(y)
            elif y.tag not in ("colgroup", "col"):
                loose.append(y)
        if bare.items:
            cells(bare)

    body(node)
    width: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                width[at] = max([width.get(at, 0), *(n for n in map(len, lines) if n <= WIDE)])
            at += span
    # columns that only spanning cells have are 0 wide
    places = [0]
    for i in range(max(width, default=-1) + 1):
        places.append(places[-1] + (width[i] + 2 if i in width else 0))
    out = [c for c in captions if c]
    if loose:
        holder = Node("div", {})
        holder.items = loose
        out.insert(0, render(holder, hiding, depth + 1))
    for row in rows:
        out.extend(_row_lines(row, places))
    return "\n".join(x for x in out if x.strip())


def _row_lines(row: list[tuple[list[str], int]], places: list[int]) -> list[str]:
    """The lines of a row: each cell's at the place of its column, or two blanks after what stands before it there."""
    parts: list[list[str]] = [[] for _ in range(max(len(lines) for lines, _ in row))]
    ends = [0] * len(parts)
    at = 0
    for lines, span in row:
        place = places[min(at, len(places) - 1)]
        for i, x in enumerate(lines):
            if x:
                blank = min(BLANKS, max(place - ends[i], 2 if ends[i] else 0))
                parts[i].append(" " * blank + x)
                ends[i] = max(place, ends[i] + (2 if ends[i] else 0)) + len(x)
        at += span
    return ["".join(x).rstrip(" ") for x in parts]


def render(root: Node, hiding, depth: int = 0) -> str:
    """The visible text below root."""
    out = _Out()
    # a work list instead of recursion: pages may nest thousands deep
    todo: list = [(x, False) for x in reversed(root.items)]
    while todo:
        x, pre = todo.pop()
        if isinstance(x, str):
            out.put(x, pre)
            continue
        if callable(x):
            x()
            continue
        tag = x.tag
        if not _seen(x, hiding):
            continue
        if tag == "br":
            out.newline(True)
        elif tag in ("input", "button") and tag == "input":
            if x.attrs.get("type", "text").lower() not in ("checkbox", "radio", "file", "image", "color", "range", "password"):
                out.put(x.attrs.get("value", ""))
        elif tag == "table":
            out.block(True)
            s = _table(x, hiding, depth)
            if s:
                out.put(s, True)
            out.block(True)
        elif tag in ("ul", "ol", "menu"):
            out.block(depth == 0 and root.tag != "li")
            start = x.attrs.get("start", "1")
            number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            lines = []
            for y in x.items:
                if isinstance(y, str):
                    if y.strip():
                        lines.append(_SPACE.sub(" ", y).strip())
                elif _seen(y, hiding):
                    if y.tag == "li":
                        mark = f"{number}. " if tag == "ol" else BULLET
                        number += 1
                        s = render(y, hiding, depth + 1)
                    else:
                        mark, holder = "", Node("li", {})
                        holder.items = [y]
                        s = render(holder, hiding, depth + 1)
                    if s:
                        lines.append(mark + (s.replace("\n", "\n" + " " * len(mark)) if depth < INDENTED else s))
            if lines:
                out.put("\n".join(lines), True)
            out.block(depth == 0 and root.tag != "li")
        else:
            items = x.items
            if tag == "details" and "open" not in x.attrs:
                items = [y for y in items if isinstance(y, Node) and y.tag == "summary"][:1]
            if tag in BLOCKS or tag in ("td", "th"):
                blank = tag in PARAGRAPHS
                out.block(blank)
                todo.append((lambda b=blank: out.block(b), False))
                if tag == "dd":
                    out.put("  ", True) if items else None
            inside = pre or tag in ("pre", "textarea", "listing", "xmp")
            if tag in ("pre", "textarea") and items and isinstance(items[0], str) and items[0].startswith("\n"):
                items = [items[0][1:], *items[1:]]
            todo.extend((y, inside) for y in reversed(items))
    return out.text()


def extract(html: str | None) -> tuple[str, str]:
    """(title, text) of a page; both empty for null or empty input."""
    if not html:
        return "", ""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))  # nested tables and lists
    html = html.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�")
    root = parse(html)
    title = next((x for x in _walk(root) if x.tag == "title"), None)
    return _SPACE.sub(" ", "".join(i for i in title.items if isinstance(i, str))).strip() if title else "", render(root, _hiding(root))


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages' other columns with title and text of each row; columns of these names are replaced."""
    from pyspark.sql import types as T

    prepare(pages.sparkSession)
    base = pages.select(*[c for c in pages.columns if c not in (column, "title", "text")], column)
    keep = base.columns[:-1]

    def run(batches):
        for b in batches:
            got = [extract(x.as_py()) for x in b.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=[*keep, "title", "text"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
