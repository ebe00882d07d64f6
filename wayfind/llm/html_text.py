"""Layout-aware text of HTML pages.

A small reader makes a tree with the tags that HTML implies (an open paragraph ends before a block, a list item before the
next one, table parts are completed). What is not rendered is taken out of the tree, by tag, by attribute and by inherited
visibility. A renderer emits all that is left: blocks on lines of their own with the spacing of their kind, list items with
marks and indents, table cells in aligned columns on a grid of row and column spans, preformatted text as it stands.
"""

from __future__ import annotations

import html
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the HTML standard: void elements, elements with raw text, elements that are not rendered, block elements,
# and block elements with a blank line around them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
HIDDEN = frozenset("script style template noscript noembed noframes iframe title head datalist object audio video canvas param source track desc metadata defs annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption option tr".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dd dt".split())
# start tag: open elements that it ends, and elements at which the search stops
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dd": ({"dd", "dt"}, {"dl", "table"}),
    "dt": ({"dd", "dt"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
SCOPE = frozenset("table td th caption html body template object".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NUMBER = re.compile(r"\s*([+-]?\d+)")
# Fixed values of the HTML standard: the largest spans of a cell.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: A cell wider than this runs over the end of its column instead of making it wider.
WIDEST = 120
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        """Values by lower-case name; of repeated names the first counts, as in a browser."""
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.attrs):
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
        return found

    def number(self, name: str, default: int) -> int:
        m = _NUMBER.match(self.attributes().get(name, "")) if self.attrs else None
        return int(m[1]) if m and len(m[1]) < 10 else default


def parse(page: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = Node("html")
    stack = [root]
    opened = Counter(["html"])  # of the stack's tags, so that no search goes through it in vain

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    def end(tags: set, stops: set | frozenset) -> None:
        """Ends the innermost open element of the tags, and whatever is open inside it, if no stop comes first."""
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                close(i)
                return
            if stack[i].tag in stops:
                return

    at, n = 0, len(page)
    while at < n:
        m = _MARKUP.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, attrs = m[2].lower(), m[3]
        if m[1]:
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                end({tag}, SCOPE - {tag} if tag not in ("table", "html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption") else {"table"} - {tag})
            continue
        if tag in ("html", "body", "head"):
            if tag == "body":
                end({"head"}, SCOPE)
            if tag != "head":
                stack[0].attrs += attrs
                continue
        if tag in ENDS_P:
            end({"p"}, SCOPE)
        if tag in ENDS:
            if tag in ("td", "th", "tr", "thead", "tbody", "tfoot"):
                end(*ENDS[tag])
                while tag == "tr" and stack[-1].tag in ("tr", "td", "th", "caption"):
                    close(len(stack) - 1)
                while tag in ("thead", "tbody", "tfoot") and stack[-1].tag in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption"):
                    close(len(stack) - 1)
                if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                    row = Node("tr")
                    stack[-1].children.append(row)
                    stack.append(row)
                    opened["tr"] += 1
            else:
                end(*ENDS[tag])
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            close(len(stack) - 1)
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in RAW:
            ended = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            text = page[at : ended.start()]
            node.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
            at = ended.end()
        elif tag not in VOID and not attrs.rstrip().endswith("/") or tag in ("p", "div", "td", "th", "li"):
            stack.append(node)
            opened[tag] += 1
    return root


class _Lines:
    """Finished lines and the one being made, with white space collapsed as in a browser."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.blank = 0

    def text(self, s: str) -> None:
        parts = _BLANK.split(s)
        if parts[0] == "" and len(parts) > 1:
            self.space = True
        words = [p for p in parts if p]
        if words:
            if self.space and self.now:
                self.now.append(" ")
            self.now.append(" ".join(words))
            self.space = parts[-1] == ""

    def line(self) -> None:
        s = "".join(self.now).strip(" ")
        if s:
            self._put(s)
        self.now, self.space = [], False

    def _put(self, s: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.lines.append(s)
        self.blank = 0

    def broke(self) -> None:
        """A br ends the line; one on an empty line leaves a blank one."""
        if "".join(self.now).strip(" "):
            self.line()
        else:
            self.gap()

    def gap(self) -> None:
        self.line()
        self.blank = 1

    def whole(self, lines: list[str]) -> None:
        self.line()
        for s in lines:
            if s:
                self._put(s)
            elif self.lines:
                self.blank = 1


def _state(node: Node, hidden: bool) -> tuple[bool, bool]:
    """Whether an element is rendered at all, and whether its own text is hidden, which its children inherit."""
    if node.tag in HIDDEN:
        return False, hidden
    attrs = node.attributes() if node.attrs else {}
    style = dict(x.lower().replace("!important", "").split(":", 1) for x in attrs.get("style", "").split(";") if ":" in x)
    style = {k.strip(): v.strip() for k, v in style.items()}
    display = style.get("display", "none" if "hidden" in attrs or node.tag == "dialog" and "open" not in attrs else "")
    if display == "none" or node.tag == "input" and attrs.get("type", "").lower() == "hidden":
        return False, hidden
    return True, {"hidden": True, "collapse": True, "visible": False}.get(style.get("visibility", ""), hidden)


def _rendered(root: Node) -> bool:
    """Takes out of a tree what is not rendered; text that is hidden by visibility goes, its element keeps its place."""
    shown, hidden = _state(root, False)
    if not shown:
        return False
    todo = [(root, hidden)]
    while todo:
        node, hidden = todo.pop()
        left = []
        for child in node.children:
            if isinstance(child, str):
                if not hidden:
                    left.append(child)
                continue
            shown, own = _state(child, hidden)
            if shown and not (own and child.tag == "img"):
                left.append(child)
                todo.append((child, own))
        node.children = left
    return True


def _table(node: Node) -> list[str]:
    """The rows on a grid, each cell at the place that earlier spans leave it, columns padded to one width; a caption and
    whatever else is no cell stand above. A row with a cell of several paragraphs is read cell by cell.
    """
    rows: list[list[tuple[int, int, list[str]]]] = []
    above: list[str] = []
    loose = Node("div")
    taken: dict[int, int] = {}  # column: rows that a cell above still covers

    def row(part: Node) -> None:
        cells, at = [], 0
        covered = {c for c, n in taken.items() if n > 0}
        for c in covered:
            taken[c] -= 1
        for cell in part.children:
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                if not isinstance(cell, str) or cell.strip():
                    loose.children.append(cell)
                continue
            while at in covered:
                at += 1
            wide = min(max(1, cell.number("colspan", 1)), MOST_COLUMNS)
            high = cell.number("rowspan", 1)
            high = MOST_ROWS if high == 0 else min(max(1, high), MOST_ROWS)
            cells.append((at, wide, render(cell)))
            if high > 1:
                taken.update(dict.fromkeys(range(at, at + wide), high - 1))
            at += wide
        rows.append(cells)

    def walk(part: Node) -> None:
        for child in part.children:
            if isinstance(child, str):
                if child.strip():
                    loose.children.append(child)
            elif child.tag == "caption":
                above.extend(render(child))
            elif child.tag in ("thead", "tbody", "tfoot"):
                taken.clear()
                walk(child)
                taken.clear()
            elif child.tag == "tr":
                row(child)
            else:
                loose.children.append(child)

    walk(node)
    out = above + render(loose)
    several = [any("" in lines for _, _, lines in r) for r in rows]
    widths: dict[int, int] = {}
    wider: list[tuple[int, int, int]] = []
    for r, apart in zip(rows, several, strict=True):
        for at, wide, lines in r if not apart else ():
            own = min(max(map(len, lines), default=0), WIDEST)
            if wide == 1:
                widths[at] = max(widths.get(at, 0), own)
            else:
                wider.append((wide, at, own))
    for wide, at, own in sorted(wider):
        inner = [widths[c] for c in range(at, at + wide) if widths.get(c)]
        if own > sum(inner) + 2 * (len(inner) - 1):
            last = max((c for c in range(at, at + wide) if widths.get(c)), default=at)
            widths[last] = widths.get(last, 0) + own - sum(inner) - 2 * max(0, len(inner) - 1)
    place, start = {}, 0
    for c in range(max((at for r in rows for at, _, _ in r), default=-1) + 1):
        place[c] = start
        start += widths[c] + 2 if widths.get(c) else 0
    for r, apart in zip(rows, several, strict=True):
        if apart:
            out += [line for _, _, lines in r for line in lines]
            continue
        for k in range(max((len(lines) for _, _, lines in r), default=0)):
            s = ""
            for at, _, lines in r:
                if k < len(lines) and lines[k]:
                    s = (s + "  " if s and len(s) > place[at] - 2 else s.ljust(place[at])) + lines[k]
            out.append(s.rstrip())
    return out


def render(node: Node) -> list[str]:
    """The lines below a node."""
    out = _Lines()
    todo: list = [(c, "in") for c in reversed(node.children)]
    while todo:
        child, way = todo.pop()
        if way == "out":
            out.gap() if child in SPACED else out.line()
            continue
        if isinstance(child, str):
            out.text(child)
            continue
        tag = child.tag
        if tag == "br":
            out.broke()
        elif tag == "hr":
            out.gap()
        elif tag == "img":
            out.text(child.attributes().get("alt", "") if child.attrs else "")
        elif tag in ("pre", "textarea"):
            out.gap()
            out.whole([s.rstrip() for s in _plain(child).strip("\n").split("\n")])
            out.gap()
        elif tag == "table":
            out.gap()
            out.whole(_table(child))
            out.gap()
        elif tag in ("ul", "ol", "menu", "dir"):
            out.gap()
            out.whole(_list(child))
            out.gap()
        elif tag in ("blockquote", "dd"):
            out.gap() if tag == "blockquote" else out.line()
            out.whole([f"  {s}" if s else s for s in render(child)])
            out.gap() if tag == "blockquote" else out.line()
        else:
            if tag in BLOCK:
                out.gap() if tag in SPACED else out.line()
                todo.append((tag, "out"))
            elif tag in ("td", "th", "mtd", "text"):
                out.text(" ")
            todo.extend((c, "in") for c in reversed(child.children))
    out.line()
    return out.lines


def _plain(node: Node) -> str:
    parts, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag == "br":
            parts.append("\n")
        else:
            todo.extend(reversed(x.children))
    return "".join(parts)


def _list(node: Node) -> list[str]:
    out: list[str] = []
    number = node.number("start", 1)
    run = Node("div")
    for child in [*node.children, None]:
        item = child is not None and not isinstance(child, str) and child.tag == "li"
        if item or child is None:
            out += render(run)
            run = Node("div")
        if item:
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            lines = render(child)
            out += [(mark if i == 0 else " " * len(mark)) + s if s else "" for i, s in enumerate(lines)]
        elif not item and child is not None:
            run.children.append(child)
    return out


_NESTS = re.compile(r"<(?:ul|ol|menu|dir|table|blockquote|dd|caption)\b", re.I)


def page_text(page: str) -> str:
    """The visible text of one page."""
    root = parse(page)
    if not _rendered(root):
        return ""
    # a few calls for each list, table or quote that another one may hold; they are plain Python, which needs no C stack
    depth, usual = 6 * len(_NESTS.findall(page)) + 500, sys.getrecursionlimit()
    if depth <= usual:
        return "\n".join(render(root))
    sys.setrecursionlimit(depth + usual)
    try:
        return "\n".join(render(root))
    finally:
        sys.setrecursionlimit(usual)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Adds the visible text of each whole page.

    A null page gives null, an empty one and one without visible text an empty text. Broken markup is read as far as a
    browser would: unknown tags are inline, unclosed elements end with their parent. Lists, tables and quotes may be nested to
    any depth. Hidden is what the hidden attribute, display: none or visibility (inherited) hide, and elements that are not
    rendered. Repeated rows are each read. A column named as `out` is replaced.
    """
    pages = pages.drop(out)
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if v is None else page_text(v) for v in (x.as_py() for x in batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return pages.mapInArrow(run, schema)


def text_table(pages: DataFrame) -> DataFrame:
    """One row per page: its text, the number of characters and of lines."""
    texts = extract_text(pages.select("page_id", "url", "html")).drop("html")
    lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(0)
    return texts.select("page_id", "url", "text", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"), lines.alias("n_lines"))
