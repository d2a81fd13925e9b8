"""Layout-aware rendering of HTML to text (operator 7)."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import ship, table

# Element names of the HTML standard by how they parse or show.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes datalist object audio video canvas desc metadata defs annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table ul caption thead tbody tfoot tr td th option optgroup".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset article section".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: Opening the key ends the nearest open element of the set, unless a barrier stands between.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
P_BARRIERS = frozenset("td th table caption button object html body".split())
SCOPE = frozenset("table td th caption html template".split())
TABLE_PARTS = frozenset("table caption thead tbody tfoot tr td th".split())
TABLE_SCOPE = frozenset("table html template".split())
#: Input types that show no text of their own.
WORDLESS = frozenset("hidden password checkbox radio file image color range".split())
MARKUP = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z]|/(?![a-zA-Z]))")
COMMENT_END = re.compile(r"--!?>")
NAME = re.compile(r"[^\s/>]+")
PLAIN = re.compile(r"[^>=]*")
GAP = re.compile(r"=\s*")
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
BLANK = re.compile(r"[ \t\n\r\f]+")
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)\Z")
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-zA-Z-]+)", re.I)


class Node:
    """An element: name, attributes, and children that are nodes or strings."""

    __slots__ = ("attrs", "kids", "name")

    def __init__(self, name: str, attrs: dict[str, str]) -> None:
        self.name, self.attrs, self.kids = name, attrs, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


class Tags:
    """Reads one tag or comment after another; each sign of the page is looked at a bounded number of times."""

    def __init__(self, source: str) -> None:
        self.source, self.size = source, len(source)
        self.last = {q: source.rfind(q) for q in "\"'>"}

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name (empty: shows nothing) and attributes of the next one."""
        m = MARKUP.search(self.source, at)
        if not m:
            return None
        lead, start, at = m[0], m.start(), m.end()
        if lead == "<!--":
            if self.source.startswith((">", "->"), at):
                return start, self.source.index(">", at) + 1, False, "", ""
            end = COMMENT_END.search(self.source, at)
            return start, end.end() if end else self.size, False, "", ""
        if not lead[-1].isalpha():
            return start, self.after(at), False, "", ""
        closing = lead[1] == "/"
        name = NAME.match(self.source, start + 1 + closing)
        at = name.end()
        while True:
            at = PLAIN.match(self.source, at).end()
            if at >= self.size or self.source[at] == ">":
                break
            at = GAP.match(self.source, at).end()
            quote = self.source[at : at + 1]
            if quote in ("'", '"'):
                if self.last[quote] <= at:  # never closed: the tag ends at the next >, so that text stays text
                    at = self.after(at) - 1
                    break
                at = self.source.index(quote, at + 1) + 1
        at = min(at, self.size)
        return start, min(at + 1, self.size), closing, name[0].lower(), self.source[name.end() : at]

    def after(self, at: int) -> int:
        """Past the next >, or the end."""
        return self.source.index(">", at) + 1 if self.last[">"] >= at else self.size


def build(source: str) -> Node:
    """Tree of a page: implied end tags are added, stray end tags ignored, rows get a table section only if written."""
    root = Node("#page", {})
    stack, at, size = [root], 0, len(source)
    opened: dict[str, int] = {}  # how many elements of a name are on the stack: no search for what isn't

    def text(s: str) -> None:
        if s:
            stack[-1].kids.append(html.unescape(s) if "&" in s else s)

    def end(names: set | frozenset, barriers: set | frozenset) -> None:
        if not any(map(opened.get, names)):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                for n in stack[k:]:
                    opened[n.name] -= 1
                del stack[k:]
                return
            if stack[k].name in barriers:
                return

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.name] = opened.get(node.name, 0) + 1

    tags = Tags(source)
    while at < size:
        found = tags.next(at)
        if not found:
            text(source[at:])
            break
        text(source[at : found[0]])
        _, at, closing, name, rest = found
        if not name:
            continue
        if closing:
            if name == "br":
                stack[-1].kids.append(Node("br", {}))
            elif name == "p" and not opened.get("p"):
                stack[-1].kids.append(Node("p", {}))
            elif name in ("html", "body"):
                continue  # what follows still belongs to the page
            else:
                end({name}, TABLE_SCOPE - {name} if name in TABLE_PARTS else SCOPE - {name})
            continue
        if name in CLOSES_P:
            end({"p"}, P_BARRIERS)
        if name in IMPLIED_ENDS:
            end(*IMPLIED_ENDS[name])
        if name == "tr":
            end({"td", "th"}, {"table"})
            end({"tr"}, {"table"})
        elif name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
            stack[-1].kids.append(row := Node("tr", {}))
            push(row)
        elif name == "body" or (name in BLOCK and name not in ("html", "body")):
            end({"head"}, {"html", "body"})
        node = Node(name, attributes(rest) if rest.strip(" \t\r\n\f/") else {})
        stack[-1].kids.append(node)
        if name in VOID:
            continue
        if name in RAW or name in RCDATA:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(source, at)
            body = source[at : stop.start() if stop else size]
            node.kids.append(body if name in RAW else html.unescape(body))
            at = size if not stop else (source.find(">", stop.end()) + 1 or size)
            continue
        push(node)
    return root


def styles_of(root: Node) -> dict[str, list[tuple]]:
    """Rules of the page's style elements that show or hide, by the last part of a simple selector (``p``, ``.c``, ``#i``, ``p.c``, ``*``).

    A rule is its weight, order, element name or none, classes, ids and declarations. Selectors of several steps and blocks of at-rules are left out.
    """
    out: dict[str, list[tuple]] = {}
    todo, order = [root], 0
    while todo:
        node = todo.pop()
        todo += [k for k in reversed(node.kids) if isinstance(k, Node)]
        if node.name != "style" or not node.kids:
            continue
        css = CSS_COMMENT.sub("", node.kids[0])
        at = depth = 0
        head = ""
        for m in re.finditer(r"[{}]", css):
            if m[0] == "{":
                if not depth:
                    head = css[at : m.start()].rpartition(";")[2]
                depth, at = depth + 1, m.end()
                continue
            depth = max(0, depth - 1)
            said = {k.lower(): v.lower() for k, v in DECLARED.findall(css[at : m.start()])} if not depth else {}
            at = m.end()
            if not said or head.strip().startswith("@"):
                continue
            for one in head.split(","):
                simple = SELECTOR.match(one.strip())
                if not one.strip() or not simple:
                    continue
                parts = re.findall(r"[.#][\w-]+", simple[2])
                classes, ids = {p[1:] for p in parts if p[0] == "."}, {p[1:] for p in parts if p[0] == "#"}
                name = (simple[1] or "*").lower()
                order += 1
                out.setdefault(parts[-1] if parts else name, []).append(((len(ids), len(classes), name != "*"), order, name, classes, ids, said))
    return out


def shown(node: Node, rules: dict[str, list[tuple]], visible: bool) -> tuple[bool, bool]:
    """Whether an element takes part in the layout, and whether its own text is visible (inherited unless said).

    Unseen by name, the hidden attribute, then rules by weight and order, then its own style.
    """
    a = node.attrs
    if node.name in UNSEEN or (node.name == "input" and a.get("type", "").lower() == "hidden"):
        return False, False
    said = {"display": "none"} if "hidden" in a and a["hidden"].lower() != "until-found" else {}
    if rules:
        classes = a.get("class", "").split()
        keys = ["*", node.name, *(f".{c}" for c in classes), *([f"#{a['id']}"] if "id" in a else [])]
        fits = [r for k in keys for r in rules.get(k, ()) if r[2] in ("*", node.name) and r[3] <= set(classes) and r[4] <= {a.get("id")}]
        for r in sorted(fits, key=lambda r: r[:2]):
            said |= r[5]
    if "style" in a:
        said |= {k.lower(): v.lower() for k, v in DECLARED.findall(a["style"])}
    seen = said.get("visibility", "inherit")
    return said.get("display") != "none", visible if seen == "inherit" else seen not in ("hidden", "collapse")


class Page:
    """Lines of one flow of text, with pending blank lines, spaces and the indent of lists and quotes."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.pre = False
        self.gap = 0
        self.indent: list[str] = []
        self.bullet = ""

    def write(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self._put(first)
            for part in rest:
                self.newline(force=True)
                self._put(part)
            return
        words = BLANK.split(s)
        if not words[0] and self.line:
            self.space = True
        for k, w in enumerate(words):
            if w:
                if self.line and (self.space or k):
                    self.line.append(" ") if self.space or k and words[k - 1] else None
                self.space = False
                self._put(w)
                self.space = k < len(words) - 1
        if len(words) > 1 and not words[-1] and self.line:
            self.space = True

    def _put(self, s: str) -> None:
        if not s:
            return
        if not self.line:
            if self.gap and self.lines:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            lead = "".join(self.indent)
            self.line.append(lead[: len(lead) - len(self.bullet)] + self.bullet if self.bullet else lead)
            self.bullet = ""
        self.line.append(s)

    def newline(self, force: bool = False) -> None:
        if self.line or force:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, gap: int) -> None:
        self.newline()
        if self.lines:
            self.gap = max(self.gap, gap)


def span_of(value: str, most: int) -> int:
    """Columns or rows that an attribute says, as the standard reads and bounds it; 1 if it says no number."""
    digits = re.match(r"\s*\+?(\d+)", value, re.A)
    return min(int(digits[1][:9]), most) if digits else 1


def grid(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[int, list[str], int]]]:
    """First column, lines and columns spanned of each row's cells; columns that a cell of an earlier row still covers are passed over."""
    busy: list[int] = []
    out = []
    for row in rows:
        col, placed = 0, []
        for lines, across, down in row:
            while col < len(busy) and busy[col]:
                col += 1
            busy += [0] * (col + across - len(busy))
            busy[col : col + across] = [max(b, down) for b in busy[col : col + across]]
            placed.append((col, lines, across))
            col += across
        busy = [max(0, b - 1) for b in busy]
        out.append(placed)
    return out


def lay_out(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns and rows spanned) as text with aligned columns, two spaces apart."""
    placed = grid(rows)
    width = [0] * max((c[0] + c[2] for row in placed for c in row), default=0)
    for spanning in (False, True):
        for row in placed:
            for col, lines, span in row:
                need = max(map(len, lines), default=0)
                if not spanning and span == 1:
                    width[col] = max(width[col], need)
                elif spanning and span > 1:
                    width[col + span - 1] += max(0, need - sum(width[col : col + span]) - 2 * (span - 1))
    starts = [0]
    for w in width:
        starts.append(starts[-1] + w + 2)
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, lines, _ in row), default=0)):
            line, size = [], 0
            for col, lines, _ in row:
                if k < len(lines) and lines[k]:
                    line += [" " * (starts[col] - size), lines[k]]
                    size = starts[col] + len(lines[k])
            out.append("".join(line))
    return out


def render(source: str) -> str:
    """All visible text of a page.

    Blocks start on lines of their own, paragraphs and the like are set off by a blank line, list
    items bear a dash or their number and are indented by depth, preformatted text keeps its blanks, and
    cells of a table are padded to columns, below the columns that they belong to where others span rows. What is not
    displayed is left out with all it holds; invisible text leaves its place to visible text within. Closed
    details are read as open. No recursion: depth of nesting has no limit.
    """
    page, pages, tables, lists = Page(), [], [], []
    root = build(source)
    rules = styles_of(root) if "<style" in source.lower() else {}
    todo: list[tuple] = [("in", root, False, True)]
    while todo:
        step, node, pre, visible = todo.pop()
        if isinstance(node, str):
            if visible:
                page.write(node, pre)
            continue
        name = node.name
        if step == "in":
            displayed, visible = shown(node, rules, visible)
            if not displayed:
                continue
            if name == "input" and visible and node.attrs.get("type", "").lower() not in WORDLESS:
                page.write(node.attrs.get("value", ""), False)
            if name == "br":
                page.newline(force=True)
                continue
            if name == "hr":
                page.block(0)
                page._put("---" if visible else "")
                page.block(0)
                continue
            if name == "table":
                page.block(1)
                tables.append([])
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                pages.append((page, lists))
                page, lists = Page(), []
            elif name in BLOCK:
                page.block(1 if name in SPACED and not (name in ("ul", "ol", "dl") and lists) else 0)
            if name in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start", "1")
                lists.append([name, int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif name == "li":
                kind = lists[-1] if lists else ["ul", 1]
                if kind[0] == "ol":
                    value = node.attrs.get("value", "")
                    kind[1] = int(value) if re.fullmatch(r"-?\d{1,9}", value) else kind[1]
                    mark = f"{kind[1]}. "
                    kind[1] += 1
                else:
                    mark = "- "
                page.indent.append(" " * len(mark))
                page.bullet = mark
            elif name == "dd":
                page.indent.append("  ")
            elif name == "blockquote":
                page.indent.append("> ")
            todo.append(("out", node, pre, visible))
            inner = pre or name in ("pre", "textarea")
            todo += [("in", kid, inner, visible) for kid in reversed(node.kids)]
            continue
        if name in ("td", "th") and tables:
            page.newline()
            down = span_of(node.attrs.get("rowspan", "1"), 65_534)
            cell = (page.lines, max(1, span_of(node.attrs.get("colspan", "1"), 1000)), down or 65_534)
            page, lists = pages.pop()
            tables[-1][-1].append(cell)
            continue
        if name in ("li", "dd", "blockquote"):
            page.newline()
            page.indent.pop()
            page.bullet = ""
        if name in ("ul", "ol", "menu", "dir"):
            lists.pop()
        if name == "table":
            page.newline()
            for line in lay_out(tables.pop()):
                page._put(line)
                page.newline(force=True)
        if name in BLOCK:
            page.block(1 if name in SPACED and not (name in ("ul", "ol", "dl") and lists) else 0)
    page.newline()
    lines = page.lines
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [render(s) if s else "" for s in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])


def extract_text(pages: DataFrame, page_id: str = "page_id", source: str = "html") -> DataFrame:
    """``page_id, text``: the visible text of each page.

    Null or empty HTML gives an empty text; broken HTML is read as far as it goes. Repeated rows are
    rendered alike; a null id is kept; other columns are not read.
    """
    ship(pages.sparkSession)
    src = pages.select(F.col(page_id).alias("page_id"), F.col(source).cast("string").alias("html"))
    kind = src.schema["page_id"].dataType.simpleString()
    return src.mapInArrow(partial(_render), f"page_id {kind}, text string")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
