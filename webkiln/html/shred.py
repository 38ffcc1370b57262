"""Pages become a node table: one row per element, text and comment.

Nodes carry an interval (``pre``, ``last``): x lies below a if a.pre < x.pre <= a.last
on the same page, and document order is the order of ``pre``.  Everything after this
step is relational; the helper below only splits markup and keeps the stack of open
elements, with the HTML rules for implied tags and for formatting elements that stay
open across paragraphs, and puts declarative shadow trees and streamed slots in place.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*>|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*>"
    r"|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: How a server that streams a page names a boundary and the slot that belongs there.
_STREAMED = re.compile(r"\$RC\(\s*[\"']([^\"']+)[\"']\s*,\s*[\"']([^\"']+)[\"']\s*\)")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes xmp".split())
HEAD = frozenset("base link meta title script style noscript template".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
P_SCOPE = frozenset("button td th caption table html template object marquee applet".split())
#: start tag -> (open elements that it closes, elements that hide them)
IMPLIED_END = {
    "li": (("li",), frozenset({"ul", "ol", "menu", "table"})),
    "dt": (("dt", "dd"), frozenset({"dl", "table"})),
    "dd": (("dt", "dd"), frozenset({"dl", "table"})),
    "option": (("option",), frozenset({"select", "datalist"})),
    "tr": (("tr",), frozenset({"table"})),
    "td": (("td", "th"), frozenset({"tr", "table"})),
    "th": (("td", "th"), frozenset({"tr", "table"})),
    **{t: (("tbody", "thead", "tfoot", "caption", "colgroup"), frozenset({"table"})) for t in ("tbody", "thead", "tfoot")},
}

#: Open elements that take nothing but parts of a table, and what each of those needs around it.
TABLE_PARTS = frozenset("table tbody thead tfoot tr".split())
SECTIONS = ("tbody", "thead", "tfoot")
CELLS = ("td", "th", "caption")
ONLY_IN_TABLES = frozenset("caption colgroup col tbody thead tfoot tr td th".split())

SCHEMA = (
    "page_id long, pre int, last int, parent int, depth int, kind string, tag string, "
    "attrs map<string,string>, text string, parent_tag string"
)


class _Builder:
    def __init__(self):
        self.rows: list[list] = []
        self.open: list[int] = []
        self.open_tags: list[str] = []
        self.active: list[tuple[str, tuple]] = []
        self.marks: list[int] = []  # where the formatting of each open cell begins
        self.fostered: dict[int, int] = {}  # row -> the table that it stands before
        self.element("html", ())
        self.head_open = True
        self.element("head", ())

    def add(self, kind: str, tag: str | None, attrs: tuple, text: str | None) -> int:
        parent = self.open[-1] if self.open else None
        at = len(self.rows)
        if parent is not None and self.open_tags[-1] in TABLE_PARTS and self.strange(kind, tag, text):
            table = max(k for k, t in enumerate(self.open_tags) if t == "table")
            parent, self.fostered[at] = self.open[table - 1], self.open[table]
        parent_tag = self.rows[parent][5] if parent is not None else None
        self.rows.append([at, at, parent, len(self.open), kind, tag, attrs, text, parent_tag])
        return at

    def strange(self, kind: str, tag: str | None, text: str | None) -> bool:
        """Whether a table takes this not, so that it goes before the table."""
        if kind == "text":
            return bool(text.strip())
        return kind == "element" and "table" in self.open_tags and tag not in ONLY_IN_TABLES and tag not in ("style", "script", "template", "form")

    def element(self, tag: str, attrs: tuple) -> None:
        self.open.append(self.add("element", tag, attrs, None))
        self.open_tags.append(tag)

    def pop(self) -> str:
        at = self.open.pop()
        self.rows[at][1] = len(self.rows) - 1
        tag = self.open_tags.pop()
        if tag in CELLS and self.marks:
            del self.active[self.marks.pop() :]
        return tag

    def tags(self) -> list[str]:
        return self.open_tags

    def table_part(self, tag: str) -> bool:
        """Open what the part of a table needs around it; false where it stands in no table and is ignored."""
        if "table" not in self.open_tags:
            return False
        depth = max(k for k, t in enumerate(self.open_tags) if t == "table")
        around = ("tr",) if tag in ("td", "th") else SECTIONS if tag == "tr" else ("colgroup",) if tag == "col" else ()
        while len(self.open) > depth + 1 and self.open_tags[-1] not in around and not (tag in ("td", "th") and self.open_tags[-1] in SECTIONS):
            self.pop()
        if tag in ("tr", "td", "th") and self.open_tags[-1] == "table":
            self.element("tbody", ())
        if tag in ("td", "th") and self.open_tags[-1] != "tr":
            self.element("tr", ())
        return True

    def ordered(self) -> list[list]:
        """The rows in document order, with what was put before a table in its place."""
        if not self.fostered:
            return self.rows
        children: dict = {}
        before: dict[int, list[int]] = {}
        for at, row in enumerate(self.rows):
            if at in self.fostered:
                before.setdefault(self.fostered[at], []).append(at)
            else:
                children.setdefault(row[2], []).append(at)
        place, todo = {}, [("in", 0, None, 0)]
        out: list[list] = []
        while todo:
            kind, at, parent, depth = todo.pop()
            if kind == "out":
                out[place[at]][1] = len(out) - 1
                continue
            place[at] = len(out)
            row = self.rows[at]
            out.append([len(out), len(out), parent, depth, *row[4:8], out[parent][5] if parent is not None else None])
            todo.append(("out", at, None, 0))
            below = [x for child in children.get(at, ()) for x in (*before.get(child, ()), child)]
            todo += [("in", child, place[at], depth + 1) for child in reversed(below)]
        return out

    def close(self, names: tuple[str, ...], hidden_by: frozenset) -> bool:
        """Close up to the innermost open element named so, unless something hides it."""
        tags = self.tags()
        for k in range(len(tags) - 1, 0, -1):
            if tags[k] in names:
                while len(self.open) > k:
                    self.pop()
                return True
            if tags[k] in hidden_by:
                return False
        return False

    def body(self) -> None:
        if self.head_open:
            self.head_open = False
            while len(self.open) > 1:
                self.pop()
            self.element("body", ())

    def reopen(self) -> None:
        """Formatting elements that an implied end tag closed start again."""
        if not self.active:
            return
        tags = [(self.rows[i][5], self.rows[i][6]) for i in self.open]
        at, mark = len(self.active), self.marks[-1] if self.marks else 0
        while at > mark and self.active[at - 1] not in tags:
            at -= 1
        held = sum(1 for t in tags if t in self.active[at:])
        for tag, attrs in self.active[at + held :] if held else self.active[at:]:
            self.element(tag, attrs)

    def start(self, tag: str, attrs: tuple) -> None:
        if tag in ("html", "head", "body"):
            if tag == "body":
                self.body()
            at = {"html": 0, "head": 1}.get(tag, self.open[1] if len(self.open) > 1 else 0)
            known = dict(self.rows[at][6])
            self.rows[at][6] = tuple({**dict(attrs), **known}.items())
            return
        if self.head_open and tag not in HEAD:
            self.body()
        if tag == "table" and self.open_tags[-1] in TABLE_PARTS:
            self.close(("table",), frozenset())  # a table directly in a table ends that one
        if tag in CLOSES_P:
            self.close(("p",), P_SCOPE)
        if tag in IMPLIED_END:
            self.close(*IMPLIED_END[tag])
        if tag in ONLY_IN_TABLES and not self.table_part(tag):
            return
        if tag[0] == "h" and tag[1:] in tuple("123456") and self.tags()[-1] in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.pop()
        if tag not in CLOSES_P and tag not in HEAD and tag not in IMPLIED_END:
            if tag == "a" and any(t == "a" for t, _ in self.active[self.marks[-1] if self.marks else 0 :]):
                self.end("a")
            self.reopen()
        self.element(tag, attrs)
        if tag in CELLS and "table" in self.open_tags:
            self.marks.append(len(self.active))
        if tag in VOID:
            self.pop()
        elif tag in FORMATTING:
            same = [k for k, x in enumerate(self.active) if x == (tag, attrs)]
            if len(same) == 3:
                del self.active[same[0]]
            self.active.append((tag, attrs))

    def end(self, tag: str) -> None:
        if tag in ("html", "body", "head"):
            if tag == "head":
                self.body()
            return
        if tag in FORMATTING:
            for k in range(len(self.active) - 1, (self.marks[-1] if self.marks else 0) - 1, -1):
                if self.active[k][0] == tag:
                    del self.active[k]
                    break
        if not self.close((tag,), P_SCOPE if tag == "p" else frozenset()) and tag == "p":
            self.start("p", ())
            self.pop()

    def text(self, data: str) -> None:
        if self.head_open:
            if not data.strip():
                return
            self.body()
        if data.strip() or self.open:
            if data.strip() or self.open_tags[-1] not in TABLE_PARTS:
                self.reopen()
            self.add("text", None, (), data)


def parse(source: str) -> list[list]:
    """Rows (pre, last, parent, depth, kind, tag, attrs, text, parent_tag) of one page."""
    tree, at = _Builder(), 0
    while at < len(source):
        token = _TOKEN.match(source, at)
        at = token.end()
        if token["text"] is not None:
            tree.text(html.unescape(token["text"]))
        elif token["start"]:
            tag = token["start"].lower()
            attrs: dict[str, str] = {}
            for name, *values in _ATTR.findall(token["attrs"]):
                attrs.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
            tree.start(tag, tuple(attrs.items()))
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
                data = source[at : stop.start()]
                if data:
                    tree.add("text", None, tuple(attrs.items()), html.unescape(data) if tag in ("title", "textarea") else data)
                tree.pop()
                at = stop.end()
        elif token["end"]:
            tree.end(token["end"].lower())
        elif token["comment"] is not None:
            tree.add("comment", None, (), token["comment"])
    tree.body()
    while tree.open:
        tree.pop()
    return grafted(tree.ordered())


def grafted(rows: list[list]) -> list[list]:
    """Rows with declarative shadow trees in place of their templates and streamed slots at their boundaries.

    ``$RC("B", "S")`` in a script puts what stands below the first element with id S in place of templates with id B, and
    S goes.  A slot that is empty or has no boundary stays.  Slots may hold boundaries of others; one that is reached from
    inside itself gives nothing.
    """
    scripts = [r[7] for r in rows if r[4] == "text" and r[8] == "script" and "$RC" in r[7]]
    shadows = {r[0] for r in rows if r[5] == "template" and any(k in ("shadowrootmode", "shadowroot") for k, _ in r[6])}
    if not scripts and not shadows:
        return rows
    below: dict[int | None, list[int]] = {}
    by_id: dict[str, list[int]] = {}
    for r in rows:
        below.setdefault(r[2], []).append(r[0])
        by_id.setdefault(next((v for k, v in r[6] if k == "id"), "") if r[4] == "element" else "", []).append(r[0])
    instead = {at: at for at in shadows}
    gone: set[int] = set()
    for boundary, slot in (m for text in scripts for m in _STREAMED.findall(text)):
        places = [at for at in by_id.get(boundary, ()) if rows[at][5] == "template"]
        found = by_id.get(slot, ())
        if boundary and slot and places and found and found[0] in below:
            instead.update(dict.fromkeys(places, found[0]))
            gone.update(found)
    out: list[list] = []
    inside: set[int] = set()
    todo: list[tuple[int, int | None]] = [(at, None) for at in reversed(below[None])]  # (row, its parent's new row)
    while todo:
        at, parent = todo.pop()
        if at < 0:  # everything below the element or slot ~at is written
            if parent is None:
                inside.discard(~at)
            else:
                out[parent][1] = len(out) - 1
            continue
        if at in instead:
            source = instead[at]
            if source not in inside:
                inside.add(source)
                todo.append((~source, None))
                todo += [(k, parent) for k in reversed(below.get(source, ()))]
            continue
        if at in gone:
            continue
        new, above = len(out), out[parent] if parent is not None else None
        out.append([new, new, parent, above[3] + 1 if above else 0, *rows[at][4:8], above[5] if above else None])
        if at in below:
            todo.append((~at, new))
            todo += [(k, new) for k in reversed(below[at])]
    return out


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "m").split(", ")]
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            rows = []
            for page, source in zip(*(batch.slice(a, 64).column(c).to_pylist() for c in ("page_id", "html")), strict=True):
                rows += [[page, *row] for row in parse(source or "")]
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def shred(pages: DataFrame) -> DataFrame:
    """The node table of ``pages`` (page_id, html).

    A null or empty html gives the implied html, head and body elements.
    """
    return pages.select("page_id", "html").mapInArrow(_shred, SCHEMA)
