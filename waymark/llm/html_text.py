"""Text of web pages as their layout shows it.

A tree builder reads tags and adds those that HTML implies; a renderer keeps
all visible text: blocks stand apart, list items carry marks, table cells are
aligned in columns, over which wider cells reach, preformatted text keeps its
spaces.  Not visible is what the hidden attribute or an own style takes out,
and what browsers do not show by themselves: scripts, heads, closed dialogs,
the body of closed details, and the like.

Cases: null html counts as empty and gives empty text; broken markup is never
an error (stray end tags are passed over, open elements end with the page, a
tag that the page's end cuts off is dropped); nesting of any depth is walked
without recursion; very long pages are rendered whole, in linear time whatever
their markup; repeated rows give equal texts; an empty table gives an empty
result; other columns are untouched, a column named as the output is replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title meta link base object audio video canvas datalist rp".split())
#: Within a drawing or a formula: elements whose text is not shown.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
#: What may stand in a head; all else ends it.
IN_HEAD = frozenset("base link meta title style script template noscript noframes".split())
FOREIGN = frozenset(["svg", "math"])
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p plaintext pre search section summary table ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre plaintext ul ol dl menu dir table figure fieldset article section hr".split())
ENDS_P = BLOCK - frozenset("body html legend option optgroup".split())
LISTS = frozenset("ul ol menu dir".split())
PARTS = frozenset("thead tbody tfoot".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_BETWEEN = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_NUMBER = re.compile(r"\s*([+-]?\d+)")
_REVERSED = re.compile("reversed", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: For a start tag: the elements it ends, and those beyond which it does not look.
_ENDS = {
    "li": (frozenset(["li"]), LISTS | {"table"}),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "thead": (PARTS | {"caption"}, frozenset(["table"])),
    "tbody": (PARTS | {"caption"}, frozenset(["table"])),
    "tfoot": (PARTS | {"caption"}, frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
_P_SCOPE = frozenset("table td th caption button object".split())
_CELL_SCOPE = frozenset(["table", "td", "th", "caption"])
_NOTHING: frozenset[str] = frozenset()
# The most columns and rows that a cell can reach over.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Columns are as wide as their widest cell, but no wider than this.  What stands right of a longer cell goes to a line below, at its column.
MOST_WIDTH = 200


def tag_at(html: str, at: int) -> tuple[dict[str, str], bool, int] | None:
    """(attributes, whether the tag closes itself, where it ends), from after its name on; None if the page ends first.

    Of repeated attributes the first counts.
    """
    found: dict[str, str] = {}
    while at < len(html):
        slash, at = at, _BETWEEN.match(html, at).end()
        if at == len(html):
            return None
        if html[at] == ">":
            return found, html[at - 1] == "/" and at > slash, at + 1
        key = _KEY.match(html, at)
        at, value = key.end(), ""
        if equals := _EQUALS.match(html, at):
            at = equals.end()
            if html[at : at + 1] in ("'", '"') and at < len(html):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return None
                value, at = html[at + 1 : end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        found.setdefault(key[0].lower(), unescape(value) if "&" in value else value)
    return None


def style_of(attributes: dict[str, str]) -> tuple[bool, bool | None]:
    """Whether the element is taken out, by attribute or style; whether it is visible, None as its parent.

    A stated display outweighs the hidden attribute.
    """
    style: dict[str, tuple[bool, str]] = {}
    for part in attributes["style"].split(";") if "style" in attributes else ():
        name, _, value = part.partition(":")
        value, important, _ = value.strip().lower().partition("!")
        name = name.strip().lower()
        if value and (important or not style.get(name, (False, ""))[0]):
            style[name] = important != "", value.strip()
    display = style.get("display", (False, "none" if "hidden" in attributes else ""))[1]
    visibility = style.get("visibility", (False, ""))[1]
    return display == "none", {"hidden": False, "collapse": False, "visible": True}.get(visibility)


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str], bool]]:
    """("text", text), ("start", tag, attributes, closes itself) and ("end", tag); each character is looked at a few times at most."""
    at = 0
    while at < len(html):
        less = html.find("<", at)
        while less >= 0 and not (html[less + 1 : less + 2] in ("!", "?") and less + 1 < len(html) or _NAME.match(html, less + 2 if html.startswith("/", less + 1) else less + 1)):
            less = html.find("<", less + 1)
        if less != at:
            yield "text", unescape(html[at:less] if less >= 0 else html[at:]), {}, False
        if less < 0:
            return
        if html[less + 1] in "!?":
            end = html.find("-->", less + 2) + 2 if html.startswith("<!--", less) else html.find(">", less)
            if end < 2:
                return
            at = end + 1
            continue
        ends = html[less + 1] == "/"
        name = _NAME.match(html, less + 1 + ends)
        rest = tag_at(html, name.end())
        if rest is None:
            return
        tag, (attributes, closed, at) = name[0].lower(), rest
        yield "end" if ends else "start", tag, attributes, closed
        if not ends and tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at) if tag != "plaintext" else None  # which nothing ends
            body = html[at : end.start()] if end else html[at:]
            yield "text", unescape(body) if tag in ("title", "textarea") else body, {}, False
            yield "end", tag, {}, False
            at = end.end() if end else len(html)


def events(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("open", tag, attributes), ("text", text, {}) and ("close", tag, {}), well nested."""
    stack: list[str] = []
    depths: dict[str, list[int]] = {}  # of each tag: where in the stack it stands

    def deepest(tags: frozenset[str]) -> int:
        return max((depths[tag][-1] for tag in tags if depths.get(tag)), default=-1)

    def within(ended: frozenset[str], bound: frozenset[str]) -> int:
        """How many open elements to close, so that the outermost of ``ended`` above all of ``bound`` is; 0 if there is none."""
        low = deepest(bound)
        found = [own[bisect_right(own, low)] for tag in ended if (own := depths.get(tag)) and own[-1] > low]
        return len(stack) - min(found) if found else 0

    def close(n: int) -> Iterator[tuple[str, str, dict[str, str]]]:
        for _ in range(n):
            depths[stack[-1]].pop()
            yield "close", stack.pop(), {}

    def push(tag: str) -> None:
        depths.setdefault(tag, []).append(len(stack))
        stack.append(tag)

    for kind, tag, attributes, closed in tokens(html):
        if kind == "text":
            if stack and stack[-1] == "head" and not tag.isspace():
                yield from close(1)
            yield "text", tag, {}
        elif kind == "end":
            if depths.get(tag):
                bound = _NOTHING if tag in _CELL_SCOPE or tag in PARTS or tag in ("tr", "body", "html") else _CELL_SCOPE
                if depths[tag][-1] > deepest(bound):
                    yield from close(len(stack) - depths[tag][-1])
            elif tag == "p":
                yield "open", "p", {}
                yield "close", "p", {}
            elif tag == "br":
                yield "open", "br", {}
                yield "close", "br", {}
        else:
            if tag in ENDS_P:
                yield from close(within(frozenset(["p"]), _P_SCOPE))
            if tag in _ENDS:
                yield from close(within(*_ENDS[tag]))
            if tag in ("td", "th") and depths.get("table") and not within(frozenset(["tr"]), frozenset(["table"])):
                push("tr")
                yield "open", "tr", {}
            if depths.get("head") and (tag in BLOCK and tag not in ("html", "body") or stack[-1] == "head" and tag not in IN_HEAD):
                yield from close(within(frozenset(["head"]), _NOTHING))
            yield "open", tag, attributes
            if tag in VOID or closed and (tag in ("path", "rect", "circle") or tag in FOREIGN or any(depths.get(t) for t in FOREIGN)):
                yield "close", tag, {}
            else:
                push(tag)
    yield from close(len(stack))


class Sheet:
    """Lines of text; blocks are set apart when the next text comes."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.space, self.mark = "", 0, False, ""

    def text(self, text: str, indent: str, plain: bool) -> None:
        if plain:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self._write(first, indent, keep=True)
            for line in more:
                self.end_line()
                self._write(line, indent, keep=True)
            return
        words = _SPACE.sub(" ", text)
        if words[:1] == " ":
            self.space, words = True, words[1:]
        if words:
            trailing = words[-1] == " "
            self._write(words[:-1] if trailing else words, indent)
            self.space = trailing

    def _write(self, words: str, indent: str, keep: bool = False) -> None:
        if not words:
            return
        if not self.line:
            if self.lines and self.gap > 1:
                self.lines.append("")
            self.gap = 0
            self.line, self.mark = indent[: len(indent) - len(self.mark)] + self.mark, ""
        elif self.space and not keep:
            self.line += " "
        self.space = False
        self.line += words

    def end_line(self) -> None:
        if self.line:
            self.lines.append(self.line.rstrip(" "))
        elif self.lines and not self.gap:
            self.lines.append("")
        self.line, self.space = "", False

    def block(self, gap: int) -> None:
        if self.line:
            self.lines.append(self.line.rstrip(" "))
        self.line, self.space = "", False
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.block(1)
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        return lines


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns and rows that they reach over) as columns two spaces apart at least."""
    placed, below = [], []  # below: (first column, end, rows left) of cells that reach into the next row
    for row in rows:
        at, own, taken = 0, [], sorted(below)
        below = [(a, b, n - 1) for a, b, n in below if n > 1]
        for lines, columns, height in row:
            while taken and taken[0][0] < at + columns:
                at = max(at, taken.pop(0)[1])
            own.append((at, at + columns, lines))
            if height > 1:
                below.append((at, at + columns, height - 1))
            at += columns
        placed.append(own)
    # Columns where no cell begins have no place of their own.
    starts = sorted({a for own in placed for a, _, _ in own})
    width = [0] * len(starts)
    cells = [(bisect_left(starts, a), bisect_left(starts, b), lines) for own in placed for a, b, lines in own]
    for first, end, lines in sorted(cells, key=lambda c: c[1] - c[0]):
        size = min(MOST_WIDTH, max(map(len, lines), default=0))
        width[end - 1] += max(0, size - sum(width[first:end]) - 2 * (end - first - 1))
    offset = [0, *accumulate(w + 2 for w in width)]
    out = []
    for own in placed:
        for n in range(max((len(lines) for _, _, lines in own), default=0)):
            line = ""
            for a, _, lines in own:
                if n < len(lines) and lines[n]:
                    place = offset[bisect_left(starts, a)]
                    if line and len(line) + 2 > place:
                        out.append(line.rstrip(" "))
                        line = ""
                    line = line.ljust(place) + lines[n]
            out.append(line.rstrip(" "))
    return out


def _reach(attributes: dict[str, str], name: str, most: int) -> int:
    """How many columns or rows a cell reaches over; of rows, 0 means all that follow."""
    found = _NUMBER.match(attributes.get(name, ""))
    reach = int(found[1][:9]) if found else 1
    return most if reach == 0 and name == "rowspan" else min(most, max(1, reach))


def render(html: str | None) -> str:
    """The visible text of a page.

    A reversed list counts down from the number of its items, which are known once the page was laid out.
    """
    items: list[int] = []
    text = _laid_out(html or "", items)
    return _laid_out(html or "", items, known=True) if items and _REVERSED.search(html) else text


def _laid_out(html: str, items: list[int], known: bool = False) -> str:
    """The visible text; ``items`` takes up, or tells where ``known``, how many numbered items each list has, in the order of lists."""
    opened = 0
    sheets, tables, lists = [Sheet()], [], []
    # Of each open element: whether it is taken out, whether its text is visible, whether it is closed details.
    states: list[tuple[bool, bool, bool]] = [(False, True, False)]
    plain, indent = 0, ""
    foreign = 0  # open drawings and formulas

    def stray() -> bool:
        """In a table, but in none of its cells: shown before the table, as browsers do."""
        return bool(tables) and len(sheets) == tables[-1]["sheets"]

    for kind, tag, attributes in events(html):
        gone, visible, closed = states[-1]
        if kind == "text":
            if gone or closed or not visible:
                continue
            if stray():
                sheets[-1].text(tag, tables[-1]["indent"] + indent, plain > 0 and not tag.isspace())
            else:
                sheets[-1].text(tag, indent, plain > 0)
            continue
        if kind == "open":
            out, own = style_of(attributes) if attributes else (False, None)
            gone = gone or closed and tag != "summary" or tag in UNSEEN or foreign > 0 and tag in UNDRAWN or out or tag == "dialog" and "open" not in attributes
            visible = visible if own is None else own
            states.append((gone, visible, tag == "details" and "open" not in attributes))
            if gone:
                continue
            if tag in BLOCK:
                sheets[-1].block(2 if tag in SPACED and not (tag in LISTS and lists) else 1)
            if tag == "br":
                sheets[-1].end_line()
            elif tag == "hr" and visible:
                sheets[-1].text("---", indent, False)
                sheets[-1].block(2)
            elif tag in ("pre", "plaintext"):
                plain += 1
            elif tag in FOREIGN:
                foreign += 1
            elif tag == "text" and foreign:
                sheets[-1].block(1)
            elif tag in LISTS:
                start, down = _NUMBER.match(attributes.get("start", "")), known and "reversed" in attributes
                if not known:
                    items.append(0)
                first = int(start[1]) if start else items[opened] if down else 1
                lists.append([tag == "ol", first, indent, -1 if down else 1, opened])
                opened += 1
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    value = _NUMBER.match(attributes.get("value", ""))
                    lists[-1][1] = int(value[1]) if value else lists[-1][1]
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += lists[-1][3]
                    if not known:
                        items[lists[-1][4]] += 1
                sheets[-1].mark = mark if visible else ""
                indent = (lists[-1][2] if lists else "") + " " * len(mark)
            elif tag in ("blockquote", "dd"):
                indent += "  "
            elif tag == "table":
                outer = tables[-1]["indent"] + indent if stray() else indent
                tables.append({"rows": [], "head": [], "lists": lists, "own": indent, "indent": outer, "sheets": len(sheets), "reach": []})
                lists, indent = [], ""
            elif tag == "tr" and tables:
                tables[-1]["rows"].append([])
            elif tag in ("td", "th", "caption") and tables:
                sheets.append(Sheet())
                tables[-1]["reach"].append((_reach(attributes, "colspan", MOST_COLUMNS), _reach(attributes, "rowspan", MOST_ROWS)))
            continue
        states.pop()
        if gone:
            continue
        if tag in ("pre", "plaintext"):
            plain -= 1
        elif tag in FOREIGN:
            foreign -= 1
        elif tag == "text" and foreign:
            sheets[-1].block(1)
        elif tag in LISTS and lists:
            indent = lists.pop()[2]
        elif tag == "li":
            indent = lists[-1][2] if lists else ""
        elif tag in ("blockquote", "dd"):
            indent = indent[:-2]
        elif tag in ("td", "th", "caption") and tables and not stray():
            lines, reach = sheets.pop().done(), tables[-1]["reach"].pop()
            if tag == "caption":
                tables[-1]["head"] += lines
            elif tables[-1]["rows"]:
                tables[-1]["rows"][-1].append((lines, *reach))
        elif tag == "table":
            table = tables.pop()
            lists, indent = table["lists"], table["own"]
            sheets[-1].block(2)
            for line in [*table["head"], *aligned(table["rows"])]:
                if line:
                    sheets[-1].text(line, table["indent"], True)
                sheets[-1].end_line()
        if tag in BLOCK:
            sheets[-1].block(2 if tag in SPACED and not (tag in LISTS and lists) else 1)
    return "\n".join(sheets[0].done())


def with_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``df`` with the rendered text of a column of pages."""

    @F.pandas_udf("string")
    def rendered(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([render(x) for x in part], dtype=object)

    return df.withColumn(out, rendered(F.col(html)))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages").select("page_id", "html")
    return with_text(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))
