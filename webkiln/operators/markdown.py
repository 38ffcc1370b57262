"""Markdown of a node table: tokens as expressions, written by an ordered fold with a stack of line prefixes.

What an element says at its start and end (marks, breaks, prefixes, fences, cells) is decided by
Catalyst expressions over the node table; the fold only keeps what crosses elements: which line
prefixes are open, how many line ends are due, and the cells of the table at hand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webkiln.functions import urls
from webkiln.functions.text import tidy_markdown

TOKENS = "array<struct<op:string,s:string,t:string>>"
HEADINGS = {f"h{n}": "#" * n + " " for n in range(1, 7)}
PARAGRAPHS = ("p", "div", "section", "article", "main", "figure", "figcaption", "header", "footer", "aside", "details", "summary", "dl", "dt", "dd", "address")
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~", "mark": "=="}
KEPT_HTML = ("video", "audio", "svg", "sub", "sup")
SILENT = ("script", "style", "button", "template", "noscript")
ALERTS = ("NOTE", "TIP", "IMPORTANT", "WARNING", "CAUTION")
#: Frames that become images.
YOUTUBE = r"(?:youtube\.com|youtube-nocookie\.com|youtu\.be)/(?:embed/|watch\?v=)?([A-Za-z0-9_-]+)"
TWEET = r"(?:twitter\.com|x\.com)/([^/?#]+)/status/([0-9]+)"
TWEET_FRAME = r"platform\.(?:twitter|x)\.com/.*[?&]id=([0-9]+)"


def _attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _tokens(*tokens: tuple) -> Column:
    made = [F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in zip(("op", "s", "t"), (*t, "", "")[:3], strict=True)]) for t in tokens]
    return F.array(*made) if made else F.array().cast(TOKENS)


def with_context(rows: DataFrame) -> DataFrame:
    """What a node has to know of others: whether it is silent, stands in pre, a list, kept HTML or a plain table, its number and its code's language."""
    before = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy("page_id").orderBy("pre")
    back = Window.partitionBy("page_id").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    inside = lambda c: _true(F.max(F.when(c, F.col("last"))).over(before) >= F.col("pre"))
    tag = F.col("tag")
    math = (tag == "math") | ((tag == "span") & (_attr("data-latex") != "")) | _attr("class").rlike(r"(^|\s)katex(\s|$)")
    reference = (tag == "sup") & _attr("id").startswith("fnref:")
    backref = (tag == "a") & (_attr("class") == "footnote-backref")
    silent = tag.isin(*SILENT) | math | reference | backref
    label = (tag == "p") & F.upper(F.btrim(F.coalesce(F.lead("text").over(order), F.lit("")))).isin(*ALERTS)
    alert = (tag == "div") & _attr("class").contains("markdown-alert")
    spans = F.col("attrs")["colspan"].isNotNull() | F.col("attrs")["rowspan"].isNotNull()
    rows = rows.withColumns({"__math": _true(math), "__ref": _true(reference), "__alert": _true(alert)})
    complex_ = F.min(F.when(tag.isin("td", "th") & spans, F.col("pre"))).over(back) <= F.col("last")  # what looks back comes first, so that the rest shares one order
    language = F.min(F.when(tag == "code", F.struct("pre", F.coalesce(F.nullif(_attr("data-lang"), F.lit("")), F.regexp_extract(_attr("class"), r"(?:^|\s)(?:language|lang)-(\S+)", 1)).alias("s")))).over(back)
    rows = rows.withColumns({
        "__complex": _true((tag == "table") & complex_),
        "__lang": F.when(tag == "pre", F.coalesce(F.when(language["pre"] <= F.col("last"), language["s"]), F.lit(""))),
    })
    rows = rows.withColumns({
        "__silent": inside(silent), "__own_silence": _true(silent & ~math & ~reference), "__raw": inside(tag == "pre"), "__in_list": inside(tag == "li"),
        "__html": inside(tag.isin(*KEPT_HTML)), "__label": inside(alert) & _true(label), "__cell": inside(tag.isin("td", "th")),
        "__start": F.last(F.when(tag == "ol", F.struct("pre", F.col("attrs")["start"].alias("s"))), True).over(before),
    })
    rows = rows.withColumn("__grid", inside((tag == "table") & ~F.col("__complex")))
    rows = rows.withColumns({"__html": F.col("__html") | inside(F.col("__complex")), "__hush": inside(F.col("__label"))})
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy("page_id", "parent", "tag").orderBy("pre")))


def marks(html_open: Column, html_close: Column) -> tuple[Column, Column]:
    """The tokens at a node's start and end; ``html_open`` and ``html_close`` are for what stays HTML."""
    tag, none = F.col("tag"), _tokens()
    url = lambda a: urls.resolve(_attr(a), F.col("__url"))
    title = lambda: F.when(_attr("title") != "", F.concat(F.lit(' "'), _attr("title"), F.lit('"'))).otherwise("")
    simple = {
        **{t: (_tokens(("break", "2"), ("text", mark)), _tokens(("break", "2"))) for t, mark in HEADINGS.items()},
        **{t: (_tokens(("break", "2")),) * 2 for t in PARAGRAPHS},
        **{t: (_tokens(("open", m)), _tokens(("close", m))) for t, m in MARKS.items()},
        "br": (_tokens(("br",)), none), "hr": (_tokens(("break", "2"), ("text", "* * *"), ("break", "2")), none),
    }
    table = F.create_map(*[x for t, (a, _) in simple.items() for x in (F.lit(t), a)])
    ends = F.create_map(*[x for t, (_, b) in simple.items() for x in (F.lit(t), b)])
    kept = tag.isin(*KEPT_HTML) | F.col("__complex")
    latex = F.coalesce(*[F.nullif(_attr(a), F.lit("")) for a in ("data-latex", "alttext")], F.lit(""))
    display = (_attr("display") == "block") & ~F.col("__grid")
    number = F.col("__n") + F.coalesce(F.when(F.col("__start.pre") == F.col("parent"), F.expr("try_cast(__start.s AS int)") - 1), F.lit(0))
    note = F.regexp_extract(_attr("id"), r"^fn:(.+)$", 1)
    marker = F.when(note != "", F.concat(F.lit("[^"), note, F.lit("]: "))).when(F.col("parent_tag") == "ol", F.concat(number.cast("string"), F.lit(". "))).otherwise("- ")
    callout, alert = _attr("data-callout"), F.upper(F.coalesce(F.nullif(F.regexp_extract(_attr("class"), r"markdown-alert-(\S+)", 1), F.lit("")), F.lit("note")))
    video, tweet, frame = F.regexp_extract(_attr("src"), YOUTUBE, 1), F.regexp_extract(_attr("src"), TWEET, 2), F.regexp_extract(_attr("src"), TWEET_FRAME, 1)
    shown = (
        F.when(video != "", F.concat(F.lit("![](https://www.youtube.com/watch?v="), video, F.lit(")")))
        .when(tweet != "", F.concat(F.lit("![](https://x.com/"), F.regexp_extract(_attr("src"), TWEET, 1), F.lit("/status/"), tweet, F.lit(")")))
        .when(frame != "", F.concat(F.lit("![](https://x.com/i/status/"), frame, F.lit(")")))
        .otherwise(F.concat(html_open, html_close))
    )
    listed = F.when(F.col("__in_list"), "1").otherwise("2")
    opening = (
        F.when(F.col("__silent") | F.col("__own_silence") | F.col("__label") | F.col("__hush"), none)
        .when(F.col("__math") & (latex == ""), none)
        .when(F.col("__math") & display, _tokens(("break", "2"), ("raw", F.concat(F.lit("$$\n"), latex, F.lit("\n$$"))), ("break", "2")))
        .when(F.col("__math"), _tokens(("glue", F.concat(F.lit("$"), latex, F.lit("$")))))
        .when(F.col("__ref"), _tokens(("glue", F.concat(F.lit("[^"), F.regexp_extract(_attr("id"), r"^fnref:([^-]+)", 1), F.lit("]")))))
        .when(F.col("__html") & ~F.col("__raw"), _tokens(("text", html_open)))
        .when(F.col("kind") == "text", F.when(F.col("__raw"), _tokens(("raw", F.col("text")))).otherwise(_tokens(("text", F.regexp_replace("text", r"\s+", " ")))))
        .when(F.col("__raw"), none)
        .when(tag.isin("video", "audio") | F.col("__complex"), _tokens(("break", "2"), ("text", html_open)))
        .when(tag == "svg", _tokens(("glue", html_open)))
        .when(kept, _tokens(("text", html_open)))
        .when(F.col("__alert"), _tokens(("break", "2"), ("push", "> ", "> "), ("text", F.concat(F.lit("[!"), alert, F.lit("]"))), ("break", "1"), ("hold",)))
        .when((tag == "blockquote") & (callout != ""), _tokens(("break", "2"), ("push", "> ", "> "), ("text", F.concat(F.lit("[!"), callout, F.lit("] "), F.upper(F.substr(callout, F.lit(1), F.lit(1))), F.substr(callout, F.lit(2)))), ("break", "1"), ("hold",)))
        .when(tag == "blockquote", _tokens(("break", "2"), ("push", "> ", "> ")))
        .when(tag.isin("ul", "ol"), _tokens(("break", listed)))
        .when(tag == "li", _tokens(("break", "1"), ("push", marker, F.repeat(F.lit(" "), F.when(note != "", 4).otherwise(F.char_length(marker))))))
        .when(tag == "pre", _tokens(("break", "2"), ("fence", F.col("__lang"))))
        .when((tag == "code"), _tokens(("open", "`")))
        .when(tag == "a", _tokens(("open", "[")))
        .when(tag == "img", _tokens(("text", F.concat(F.lit("!["), _attr("alt"), F.lit("]("), url("src"), title(), F.lit(")")))))
        .when(tag == "iframe", _tokens(("break", "2"), ("text", shown), ("break", "2")))
        .when(tag == "table", _tokens(("table",)))
        .when((tag == "tr") & F.col("__grid"), _tokens(("row",)))
        .when(tag.isin("td", "th") & F.col("__grid"), _tokens(("cell", tag)))
        .when(F.col("__cell") & tag.isin(*PARAGRAPHS), _tokens(("text", " ")))
        .otherwise(F.coalesce(F.try_element_at(table, tag), none))
    )
    closing = (
        F.when(F.col("__silent") | F.col("__own_silence") | F.col("__label") | F.col("__hush") | F.col("__math") | F.col("__ref") | (F.col("kind") == "text"), none)
        .when(F.col("__html") & ~F.col("__raw"), _tokens(("text", html_close)))
        .when(F.col("__raw"), none)
        .when(tag.isin("video", "audio") | F.col("__complex"), _tokens(("text", html_close), ("break", "2")))
        .when(kept, _tokens(("text", html_close)))
        .when(F.col("__alert") | (tag == "blockquote"), _tokens(("pop",), ("break", "2")))
        .when(tag.isin("ul", "ol"), _tokens(("break", listed)))
        .when(tag == "li", _tokens(("pop",), ("break", "1")))
        .when(tag == "pre", _tokens(("unfence",), ("break", "2")))
        .when(tag == "code", _tokens(("close", "`")))
        .when(tag == "a", _tokens(("close", F.concat(F.lit("]("), url("href"), title(), F.lit(")")))))
        .when(tag.isin("img", "iframe"), none)
        .when(tag == "table", _tokens(("end",)))
        .when(tag.isin("td", "th") & F.col("__grid"), _tokens(("uncell",)))
        .when(F.col("__cell") & tag.isin(*PARAGRAPHS), _tokens(("text", " ")))
        .otherwise(F.coalesce(F.try_element_at(ends, tag), none))
    )
    return opening, closing


class Writer:
    """Lines under open prefixes; ``break`` asks for line ends, which are written before the next text."""

    def __init__(self):
        self.parts: list[str] = []
        self.prefixes: list[list] = []  # first line, other lines, whether the first was written
        self.due, self.hard, self.space, self.hold = 0, False, False, False
        self.opened: list[str] = []
        self.empty = True

    def line_start(self) -> bool:
        return self.empty or self.due > 0

    def lines(self) -> None:
        """Write the line ends that are due and the prefixes of the line that begins."""
        if self.due and not self.empty:
            while self.parts and self.parts[-1].strip(" ") == "":
                self.parts.pop()
            if self.parts:
                self.parts[-1] = self.parts[-1].rstrip(" ")
            self.parts.append(("  " if self.hard and self.due == 1 else "") + "\n")
            for _ in range(self.due - 1):
                self.parts.append("".join(rest for _, rest, used in self.prefixes if used).rstrip(" ") + "\n")
        if self.line_start():
            self.parts.append("".join(rest if used else first for first, rest, used in self.prefixes))
            for prefix in self.prefixes:
                prefix[2] = True
        self.due, self.hard, self.empty, self.space, self.hold = 0, False, False, False, False

    def ask(self, n: int) -> None:
        if self.hold or (self.prefixes and not self.prefixes[-1][2] and self.due):
            n = 1  # nothing stands in the quote or item yet
        self.due = max(self.due, n)

    def text(self, s: str) -> None:
        if self.line_start() or self.space or (self.parts and self.parts[-1].endswith(" ") and not self.parts[-1].endswith("- ")):
            stripped = s.lstrip(" ")
            self.space = self.space and bool(not stripped)
            lead = "" if self.line_start() or not (s != stripped or self.space) or self.parts[-1].endswith(" ") else " "
            s = lead + stripped if stripped else s
        if not s.strip(" "):
            if not self.line_start() and not self.parts[-1].endswith(" "):
                self.parts.append(" ")
            return
        if self.line_start():
            self.lines()
        lead = len(s) - len(s.lstrip(" ")) if self.opened else 0
        self.parts += [s[:lead], *self.opened, s[lead:]]
        self.opened.clear()

    def glue(self, s: str) -> None:
        if not self.line_start():
            while self.parts[-1].strip(" ") == "" and len(self.parts) > 1:
                self.parts.pop()
            self.parts[-1] = self.parts[-1].rstrip(" ")
        self.text(s)

    def raw(self, s: str) -> None:
        for k, line in enumerate(s.split("\n")):
            if k:
                self.due = max(self.due, 1)
                if not line:
                    self.parts.append("\n" + "".join(rest for _, rest, used in self.prefixes if used).rstrip(" "))
                    self.due = 0
                    continue
            if self.line_start():
                self.lines()
            self.parts.append(line)
            self.empty = False

    def close(self, mark: str) -> None:
        if self.opened:  # nothing stood between
            self.opened.pop()
            return
        tail = self.parts[-1] if self.parts else ""
        self.parts[-1:] = [tail.rstrip(" "), mark]
        if tail.endswith(" "):
            self.parts.append(" ")

    def done(self) -> str:
        return "".join(self.parts)


def _grid(rows: list[list[tuple[str, str]]]) -> str:
    """Cells as a table with aligned columns; without a row of headings the heading is empty."""
    rows = [r for r in rows if r]
    if not rows:
        return ""
    n = max(map(len, rows))
    head, body = (rows[0], rows[1:]) if all(kind == "th" for kind, _ in rows[0]) else ([], rows)
    cells = [[text for _, text in r] + [""] * (n - len(r)) for r in (head, *body)]
    widths = [max(1, *(len(r[k]) for r in cells)) for k in range(n)]
    lines = ["| " + " | ".join(t.ljust(w) for t, w in zip(r, widths, strict=True)) + " |" for r in cells]
    return "\n".join([lines[0], "|" + "|".join("-" * (w + 2) for w in widths) + "|", *lines[1:]])


def write(tokens: Iterator[tuple[str, str, str]]) -> str:
    """The text of one page's tokens."""
    out, outer, tables, fence = Writer(), [], [], None
    for op, s, t in tokens:
        if fence is not None and op != "unfence":
            fence[1].append(s if op in ("raw", "text") else "\n" if op == "br" else "")
        elif op == "text":
            out.text(s)
        elif op == "raw":
            out.raw(s)
        elif op == "glue":
            out.glue(s)
        elif op == "break":
            out.ask(int(s))
        elif op == "br":
            out.hard = out.due == 0
            out.due = max(out.due, 1)
        elif op == "open":
            out.opened.append(s)
        elif op == "close":
            out.close(s)
        elif op == "push":
            out.prefixes.append([s, t, False])
        elif op == "hold":
            out.hold = True
        elif op == "pop":
            out.hold = False
            out.prefixes.pop()
        elif op == "fence":
            fence = (s, [])
        elif op == "unfence":
            code = "".join(fence[1]).strip("\n")
            ticks = "`" * max(3, 1 + max((len(r) for r in re.findall("`+", code)), default=0))
            out.raw(f"{ticks}{fence[0]}\n{code}\n{ticks}")
            fence = None
        elif op == "table":
            tables.append([])
        elif op == "row" and tables:
            tables[-1].append([])
        elif op == "cell" and tables:
            outer.append(out)
            out = Writer()
            tables[-1] = tables[-1] or [[]]
            tables[-1][-1].append([s, ""])
        elif op == "uncell" and outer:
            tables[-1][-1][-1][1] = re.sub(r"\s*\n\s*", " ", out.done()).strip().replace("|", "\\|")
            out = outer.pop()
        elif op == "end" and tables:
            grid = _grid([[tuple(c) for c in r] for r in tables.pop()])
            out.ask(2)
            if grid:
                out.raw(grid)
            out.ask(2)
    return out.done()


def folded(rows: DataFrame, tokens: str, name: str) -> DataFrame:
    """``rows`` with ``tokens`` (an array per page) written out as the column ``name``."""
    kept = [c for c in rows.columns if c != tokens]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for lists in (batch.column(tokens).slice(i, 1) for i in range(batch.num_rows)):
                flat = lists.flatten()
                texts.append(write(zip(*(flat.field(k).to_pylist() for k in range(3)), strict=True)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != tokens)
    out = rows.select(*kept, tokens).mapInArrow(run, f"{schema}, `{name}` string")
    return out.withColumn(name, tidy_markdown(F.col(name)))
