"""Standardisation of the main content: level-wise rewriting of its node table.

A node that is unwrapped only loses its row: intervals stay nested, so its children belong to
whatever encloses them.  Positions are spread by ``ROOM`` so that a wrapper, an inner link
or a space finds a place of its own.  Windows are by page; empty elements leave and wrappers are flattened
over all pages of a batch at once.  What a node holds is asked by counts up to its place and up to its
end, so emptiness spreads upwards without a fixpoint; only wrappers, which do need one, run rounds over their children.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webkiln.operators.content import classes
from webkiln.operators.removals import remove

#: Positions from one node to the next.
ROOM = 8
# Kinds of elements.
BLOCK = ("div", "section", "article", "main", "aside", "header", "footer", "nav", "content")
PRESERVED = (
    "pre", "code", "table", "thead", "tbody", "tr", "td", "th", "ul", "ol", "li", "dl", "dt", "dd", "figure", "figcaption", "picture",
    "details", "summary", "blockquote", "form", "fieldset",
)
PRESERVED_ROLES = ("article", "main", "navigation", "banner", "contentinfo")
INLINE = (
    "a", "span", "strong", "em", "i", "b", "u", "code", "br", "small", "sub", "sup", "mark", "date", "del", "ins", "q", "abbr", "cite",
    "relative-time", "time", "font",
)
MAY_BE_EMPTY = (
    "area", "audio", "base", "br", "circle", "col", "defs", "ellipse", "embed", "figure", "g", "hr", "iframe", "img", "input", "line", "link",
    "mask", "meta", "object", "param", "path", "pattern", "picture", "polygon", "polyline", "rect", "source", "stop", "svg", "td", "th",
    "track", "use", "video", "wbr",
)
NO_SPACES_BETWEEN = (*BLOCK, "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "pre", "blockquote", "figure")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
OBSOLETE = ("object", "embed", "applet", "frame", "frameset")
PERMALINK_SYMBOLS = ("#", "¶", "§", "🔗")
#: Attributes that survive; tests of whole values are in ``kept_attrs``.
ALLOWED = (
    "alt", "allow", "allowfullscreen", "aria-label", "checked", "colspan", "controls", "data-latex", "data-src", "data-srcset",
    "data-callout", "data-lang", "dir", "display", "frameborder", "headers", "height", "href", "kind", "label", "lang", "role", "rowspan",
    "src", "srclang", "srcset", "title", "type", "width", "accent", "accentunder", "align", "columnalign", "columnlines", "columnspacing",
    "columnspan", "data-mjx-texclass", "depth", "displaystyle", "fence", "frame", "framespacing", "linethickness", "lspace", "mathsize",
    "mathvariant", "maxsize", "minsize", "movablelimits", "notation", "rowalign", "rowlines", "rowspacing", "rspace", "scriptlevel",
    "separator", "stretchy", "symmetric", "voffset", "xmlns",
)
_ZERO_WIDTH = "\\u200C\\u200B\\u200D\\u200E\\u200F\\uFEFF"
_BLANK = rf"^[{_ZERO_WIDTH}\u00A0\s]*$"


def _here() -> Window:
    return Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)


def _before() -> Window:
    return Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)


def _after() -> Window:
    """What follows a row, as a running frame from the end; a frame that reaches the end would cost the page's square."""
    return Window.partitionBy("page_id").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)


def _attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def _true(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _inside(condition: Column) -> Column:
    """Whether a node for which ``condition`` holds encloses the row."""
    return _true(F.max(F.when(condition, F.col("last"))).over(_before()) >= F.col("pre"))


def _filled() -> Column:
    """Text that is more than white space; a no-break space counts."""
    return (F.col("kind") == "text") & _true(F.col("text").rlike(r"[^\s]"))


def _folded(text: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(text, r"[\s\u00A0]+", " ")))


def kept_attrs(debug: bool = False) -> Column:
    """The attributes that survive: allowed ones, ids of footnotes, classes of code languages, back links and callouts."""

    def kept(name: Column, value: Column) -> Column:
        note = (name == "id") & (value.startswith("fnref:") | value.startswith("fn:") | (value == "footnotes"))
        callout = F.exists(F.split(value, r"\s+"), lambda c: (c == "callout") | c.startswith("callout-"))
        classed = (name == "class") & (((F.col("tag") == "code") & value.startswith("language-")) | (value == "footnote-backref") | callout)
        extra = name.isin("class", "id") | name.startswith("data-") if debug else F.lit(False)
        return name.isin(*ALLOWED) | note | classed | (F.col("tag") == "svg") | extra

    return F.map_filter(F.coalesce("attrs", F.expr("map()").cast("map<string,string>")), kept)


def _spread(nodes: DataFrame) -> DataFrame:
    """Positions with room between them; a node's end lies behind all that stands in it."""
    return nodes.select(
        "page_id",
        (F.col("pre") * ROOM + ROOM // 2).alias("pre"),
        (F.col("last") * ROOM + ROOM - 1).alias("last"),
        *[c for c in ("kind", "tag", "attrs", "text", "parent_tag")],
    )


def headings_and_spaces(nodes: DataFrame, titles: DataFrame) -> DataFrame:
    """Comments, obsolete elements, permalinks in headings and the heading that repeats the title leave; h1 is h2.

    Each no-break space outside pre and code becomes two spaces.
    """
    rows = nodes.filter("kind <> 'comment'").join(titles.select("page_id", _folded(F.col("title")).alias("__title")), "page_id", "left")
    rows = rows.withColumn("__code", _inside(F.col("tag").isin("pre", "code")) | _true(F.col("tag").isin("pre", "code")))
    rows = rows.withColumn("__heading", _inside(F.col("tag").isin(*HEADINGS)))
    page = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.min(F.when(F.col("tag").isin("h1", "h2"), F.struct("pre", "last"))).over(page)
    rows = rows.withColumn("__first", first)
    said = F.when((F.col("kind") == "text") & F.col("pre").between(F.col("__first.pre"), F.col("__first.last")), F.col("text"))
    rows = rows.withColumn("__said", F.collect_list(said).over(page))
    order = Window.partitionBy("page_id").orderBy("pre")
    texts = [F.btrim(F.coalesce(F.lead("text", k).over(order), F.lit(""))) for k in (1, 2)]
    symbol = (F.col("last") - F.col("pre") < 3 * ROOM) & (texts[0].isin(*PERMALINK_SYMBOLS) | texts[1].isin(*PERMALINK_SYMBOLS))
    named = F.lower(_attr("title")).contains("permalink") | F.lower(_attr("class")).rlike("permalink|heading-anchor|anchor-link")
    anchor = (F.col("tag") == "a") & F.col("__heading") & (_attr("href").contains("#") | named | symbol)
    repeats = (F.col("pre") == F.col("__first.pre")) & (F.col("__title") != "") & (F.col("__title") == _folded(F.array_join("__said", "")))
    reason = F.when(_true(anchor) | _true(repeats) | _true(F.col("tag").isin(*OBSOLETE)), F.lit("standardise"))
    text = F.when(F.col("__code"), F.col("text")).otherwise(F.replace("text", F.lit("\u00a0"), F.lit("  ")))
    tag = F.when(F.col("tag") == "h1", "h2").otherwise(F.col("tag"))
    rows = rows.withColumn("reason", reason).withColumn("text", text).withColumn("tag", tag)
    return remove(rows.drop("__title", "__heading", "__first", "__said"))


def roles_and_links(nodes: DataFrame) -> DataFrame:
    """Callouts are quotes, roles of lists and paragraphs their elements; links that wrap headings or stand in code, and
    preformatted code, are put right.

    ``nodes`` have the mark ``__code`` of what stands in pre or code.
    """
    item = (F.col("tag") == "div") & (_attr("role") == "listitem")
    list_ = (F.col("tag") == "div") & (_attr("role") == "list")
    callout = (F.col("tag") == "aside") & _attr("class").contains("callout")
    has = lambda name: _attr("class").contains(name) & F.array_contains(classes(F.col("attrs")), name)
    heading = F.col("tag").isin(*HEADINGS)
    link = F.struct("pre", "last", _attr("href").alias("href"))
    order = Window.partitionBy("page_id").orderBy("pre")
    label = F.when(has("label"), F.struct("pre", F.btrim(F.coalesce(F.lead("text").over(order), F.lit(""))).alias("text")))
    rows = nodes.withColumn("__label", label)
    rows = rows.select(
        "*",
        _inside(item).alias("__item"),
        _inside(F.col("tag") == "pre").alias("__pre"),
        F.last(F.when(callout, F.struct("pre", "last")), True).over(_before()).alias("__aside"),
        F.last(F.when(F.col("tag") == "a", link), True).over(_before()).alias("__link"),
    )
    rows = rows.select(
        "*",
        F.min("__label").over(_after()).alias("__next_label"),
        F.min(F.when(has("callout-content"), F.struct("pre", "last"))).over(_after()).alias("__inner"),
        F.min(F.when(heading, F.struct("pre", "parent_tag"))).over(_after()).alias("__next_heading"),
    )
    body = F.when(callout & (F.col("__inner.pre") <= F.col("last")), F.struct(F.col("__inner.pre").alias("pre"), F.col("__inner.last").alias("last")))
    rows = rows.withColumn("__body", F.last(F.when(callout, F.coalesce(body, F.struct(F.lit(-1).alias("pre"), F.lit(-1).alias("last")))), True).over(_before()))
    in_aside = _true(F.col("pre") <= F.col("__aside.last")) & _true(F.col("__body.pre") >= 0)
    outside = in_aside & ~F.col("pre").between(F.col("__body.pre"), F.col("__body.last")) & ~((F.col("pre") < F.col("__body.pre")) & (F.col("last") >= F.col("__body.last")))
    rows = remove(rows.withColumn("reason", F.when(_true(outside) | _true(F.col("__item") & has("label")), F.lit("standardise"))))

    kind = F.coalesce(F.nullif(F.regexp_extract(_attr("class"), r"(?:^|\s)callout-(\S+)", 1), F.lit("")), F.lit("note"))
    ordered = (F.col("__next_label.pre") <= F.col("last")) & F.col("__next_label.text").rlike(r"^\d+\)")
    paragraph = (F.col("tag") == "div") & ((_attr("role") == "paragraph") | _attr("data-testid").startswith("paragraph"))
    video = (F.col("tag") == "lite-youtube") & (_attr("videoid") != "")
    in_link = heading & (F.col("parent_tag") == "a") & _true(F.col("__link.last") >= F.col("pre")) & (F.col("__link.href") != "") & ~F.col("__link.href").startswith("#")
    next_in = _true((F.col("__next_heading.pre") <= F.col("last")))
    wraps = (F.col("tag") == "a") & next_in & (_attr("href").startswith("#") | ((_attr("href") != "") & (F.col("__next_heading.parent_tag") == "a")))
    bad_link = (F.col("tag") == "a") & (F.col("__code") | _attr("href").startswith("javascript:"))
    unwrap = _true(wraps) | _true(bad_link) | _true(F.col("__item") & has("content")) | _true(in_aside & (F.col("pre") == F.col("__body.pre")))
    wrapped = _true((F.col("tag") == "code") & ~F.col("__pre") & _attr("style").rlike(r"white-space\s*:\s*pre"))
    iframe = {
        "width": F.lit("560"), "height": F.lit("315"), "src": F.concat(F.lit("https://www.youtube.com/embed/"), _attr("videoid")),
        "title": F.coalesce(F.nullif(_attr("videotitle"), F.lit("")), F.lit("YouTube video player")), "frameborder": F.lit("0"),
        "allow": F.lit("accelerometer; autoplay; clipboard-write; encrypted-media; gyroscope; picture-in-picture; web-share"), "allowfullscreen": F.lit(""),
    }
    attrs = (
        F.when(callout, F.create_map(F.lit("data-callout"), kind))
        .when(video, F.create_map(*[x for k, v in iframe.items() for x in (F.lit(k), v)]))
        .when(paragraph | list_ | item, F.map_filter("attrs", lambda k, v: ~k.isin("role", "class", "id")))
        .otherwise(F.col("attrs"))
    )
    tag = (
        F.when(callout, "blockquote").when(video, "iframe").when(paragraph, "p").when(list_ & _true(ordered), "ol").when(list_, "ul").when(item, "li")
        .otherwise(F.col("tag"))
    )
    no_attrs = F.expr("map()").cast("map<string,string>")
    itself = F.struct("pre", "last", "kind", tag.alias("tag"), attrs.alias("attrs"), "text", F.col("__code").alias("code"))
    new = lambda at, last, name, with_, code: F.struct(at.alias("pre"), last.alias("last"), F.lit("element").alias("kind"), F.lit(name).alias("tag"), with_.alias("attrs"), F.lit(None).cast("string").alias("text"), F.lit(code).alias("code"))
    around = new(F.col("pre") - 2, F.col("last"), "pre", no_attrs, True)
    below = new(F.col("pre") + 1, F.col("last"), "a", F.create_map(F.lit("href"), F.coalesce("__link.href", F.lit(""))), False)
    made = F.when(unwrap, F.array().cast("array<struct<pre:int,last:int,kind:string,tag:string,attrs:map<string,string>,text:string,code:boolean>>"))
    made = made.when(wrapped, F.array(around, itself)).when(_true(in_link), F.array(itself, below)).otherwise(F.array(itself))
    return rows.select("page_id", F.explode(made).alias("n")).select("page_id", "n.*")


def without_last_headings(nodes: DataFrame) -> DataFrame:
    """Headings that no text follows leave; the page's first node stays."""
    rows = nodes.withColumn("__text", _filled()).withColumn("__heading", _inside(F.col("tag").isin(*HEADINGS)))
    page = Window.partitionBy("page_id")
    end = F.max(F.when(F.col("__text") & ~F.col("__heading"), F.col("pre"))).over(page)
    rows = rows.withColumn("__first", F.min("pre").over(page)).withColumn("__end", end)
    gone = _true(F.col("tag").isin(*HEADINGS) & (F.coalesce("__end", F.lit(-1)) < F.col("pre"))) & (F.col("pre") != F.col("__first"))
    return remove(rows.withColumn("reason", F.when(gone, F.lit("empty"))).drop("__heading", "__end", "__text", "__first"))


def whole_pages(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.Table]:
    """Rows sorted by page in tables of whole pages, of ``least`` rows or more but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < least:
            continue
        table = pa.Table.from_batches(held)
        page = table.column("page_id").to_numpy()
        cut = int(np.flatnonzero(page != page[-1])[-1]) + 1 if page[0] != page[-1] else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def parents(page: np.ndarray, pre: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The row of each node's parent, its own for roots; nodes are sorted by page and position."""
    out, open_ = np.arange(len(pre)), []
    for i, (p, at, end) in enumerate(zip(page.tolist(), pre.tolist(), last.tolist(), strict=True)):
        while open_ and (open_[-1][0] != p or open_[-1][1] < at):
            open_.pop()
        if open_:
            out[i] = open_[-1][2]
        open_.append((p, end, i))
    return out


#: Bits of a node's kind.
ELEMENT, IS_BLOCK, IS_INLINE, IS_P, KEEPS, TEXT, IS_SPAN, BARE, COMMA, MAY_LACK, HEADING, IS_DIV = (1 << k for k in range(12))


def holding(page: np.ndarray, pre: np.ndarray, last: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which nodes stay: bare spans are unwrapped; divs of commas, what holds nothing and headings at the end leave with what stands in them.

    Nodes are sorted by page and position; the first one of a page stays.
    """
    at = np.flatnonzero(kind & BARE == 0)

    def numbered() -> tuple[np.ndarray, np.ndarray]:
        """Of the nodes ``at``: the number of its page, and the place behind the last node in it."""
        number = np.cumsum(np.diff(page[at], prepend=page[at][:1]) != 0)
        key = number.astype(np.int64) << 32
        return number, np.searchsorted(key + pre[at], key + last[at], side="right")

    def depth(marked: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """How many marked nodes enclose a node, itself included."""
        steps = np.zeros(len(marked) + 1, np.int64)
        steps[:-1] += marked
        np.subtract.at(steps, behind[marked], 1)
        return np.cumsum(steps)[:-1]

    def holds(marked: np.ndarray, behind: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(marked)])
        return upto[behind] > upto[1:]

    number, behind = numbered()
    has = lambda bit: kind[at] & bit > 0
    commas = has(IS_DIV) & holds(has(IS_SPAN), behind)
    if commas.any():
        commas &= ~holds(has(ELEMENT) & ~has(IS_SPAN), behind) & ~holds(has(TEXT) & ~has(COMMA), behind)
        at = at[depth(commas, behind) == 0]
        number, behind = numbered()
    substance, heading = has(TEXT) | has(MAY_LACK), has(HEADING)
    said = np.full(int(number[-1]) + 1 if len(at) else 0, -1, np.int64)
    spoken = has(TEXT) & (depth(heading, behind) == 0)
    np.maximum.at(said, number[spoken], pre[at][spoken])
    gone = (has(ELEMENT) & ~substance & ~holds(substance, behind)) | (heading & (said[number] < pre[at]))
    gone &= np.diff(number, prepend=-1) == 0
    stays = np.zeros(len(page), bool)
    stays[at[depth(gone, behind) == 0]] = True
    return stays


def flatten_wrappers(parent: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which nodes stay, which become paragraphs, and the parents of those that stay.

    All wrappers of all pages take a step at once, judged by the children that they have: one without
    content leaves, one without inline content of its own (or, at the top, without inline children; or with
    nothing but paragraphs) is unwrapped, one of text and inline children is a paragraph.  One that
    has a single block child gives way to it, with its text, once child and parent rest.
    """
    parent, kind, n = parent.copy(), kind.copy(), len(parent)
    alive, paragraph = np.ones(n, bool), np.zeros(n, bool)
    root = parent == np.arange(n)
    while True:
        child = alive & ~root
        count = lambda bit: np.bincount(parent[child & (kind & bit > 0)], minlength=n)  # noqa: B023, E731
        kids, inline, paragraphs, texts = count(ELEMENT), count(IS_INLINE), count(IS_P), count(TEXT)
        wrapper = child & (kind & IS_BLOCK > 0)
        free = wrapper & (kind & KEEPS == 0) & (count(KEEPS) == 0)
        empty = free & (kids == 0) & (texts == 0)
        plain = free & (texts > 0) & (inline == kids)
        loose = free & ~empty & ~plain & (((inline == 0) & (texts == 0)) | (root[parent] & (kids > 0) & (inline == 0)))
        loose |= wrapper & (kids > 0) & (paragraphs == kids)
        acts = empty | plain | loose
        only = child & free & ~acts  # a single free block child that rests
        single = free & ~acts & (kids == 1) & ~acts[parent] & (np.bincount(parent[only], minlength=n) == 1)
        if not (acts.any() or single.any()):
            return alive, paragraph, parent
        alive &= ~(child & single[parent] & (kind & TEXT > 0))
        gone = loose | single | empty
        paragraph |= plain & ~loose
        kind[plain & ~loose] = ELEMENT | IS_P
        alive &= ~gone
        while (moved := gone[parent] & alive).any():
            parent[moved] = parent[parent[moved]]


def flattened(nodes: DataFrame) -> DataFrame:
    """``nodes`` (with ``code``) after empty ones left and wrappers are flattened, with the position and tag of each node's parent.

    Attributes are stripped.  A root, which is the first node of its page, stays.
    """
    nodes, bits = nodes.withColumn("attrs", kept_attrs()), F.lit(0)
    element, span = F.col("kind") == "element", F.col("tag") == "span"
    for bit, condition in (
        (ELEMENT, element), (IS_BLOCK, F.col("tag").isin(*BLOCK)), (IS_INLINE, F.col("tag").isin(*INLINE)), (IS_P, F.col("tag") == "p"),
        (KEEPS, F.col("tag").isin(*PRESERVED) | F.coalesce(F.col("attrs")["role"], F.lit("")).isin(*PRESERVED_ROLES)), (TEXT, _filled()),
        (IS_SPAN, span), (BARE, span & (F.size("attrs") == 0)), (COMMA, (F.col("kind") == "text") & (F.btrim("text") == ",")),
        (MAY_LACK, F.col("tag").isin(*MAY_BE_EMPTY)), (HEADING, F.col("tag").isin(*HEADINGS)), (IS_DIV, F.col("tag") == "div"),
    ):
        bits = bits + F.when(_true(condition), bit).otherwise(0)
    rows = nodes.withColumn("bits", bits).repartition("page_id").sortWithinPartitions("page_id", "pre")
    names = [c for c in rows.columns if c != "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_pages(batches):
            stays = holding(*(table.column(c).to_numpy() for c in ("page_id", "pre", "last", "bits")))
            table = table.filter(pa.array(stays))
            page, pre, last, kind = (table.column(c).to_numpy() for c in ("page_id", "pre", "last", "bits"))
            alive, paragraph, parent = flatten_wrappers(parents(page, pre, last), kind)
            tag = pa.compute.if_else(pa.array(paragraph), "p", table.column("tag"))
            table = table.set_column(table.column_names.index("tag"), "tag", tag).select(names)
            root = parent == np.arange(len(parent))
            table = table.append_column("parent", pa.array(pre[parent], pa.int32(), mask=root)).append_column("made", pa.array(paragraph))
            table = table.append_column("parent_tag", pa.compute.take(table.column("tag"), pa.array(parent, mask=root)))
            yield from table.filter(pa.array(alive)).to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "bits")
    out = rows.mapInArrow(run, f"{kinds}, parent int, made boolean, parent_tag string")
    return out.withColumn("attrs", F.when(F.col("made"), F.expr("map()").cast("map<string,string>")).otherwise(F.col("attrs"))).drop("made")


def _tidy_text(given: Column) -> Column:
    """White space in order; a text in which no pattern can find anything is looked at once."""
    text = given
    for pattern, to in (
        (r"\n{3,}", "\n\n"), (r"^[\n\r\t]+", ""), (r"[\n\r\t]+$", ""), (r"[ \t]*\n[ \t]*", "\n"), (r"[ \t]{3,}", " "), (r"\s+([,.!?:;])", "$1"),
        (f"[{_ZERO_WIDTH}]+", ""), (r"\u00A0{2,}", "\u00a0"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return F.when(given.rlike(rf"[\n\r\t{_ZERO_WIDTH}\u00A0]| {{3}}|\s[,.!?:;]"), text).otherwise(given)


def _without_dividers(rows: DataFrame, solid: Column) -> DataFrame:
    """Dividers at the top that nothing else precedes or nothing else follows leave."""
    inner = solid & (_true(F.col("tag") != "hr") | F.col("tag").isNull()) & F.col("parent").isNotNull()  # all but the root
    at_top = (F.col("tag") == "hr") & (F.col("parent") == F.first("pre").over(_here()))
    led, all_ = F.count(F.when(inner, 1)).over(_before()), F.count(F.when(inner, 1)).over(Window.partitionBy("page_id"))
    rows = rows.withColumn("__led", led).withColumn("__all", all_).withColumn("__top", at_top)
    return rows.filter(~_true(F.col("__top") & ((F.col("__led") == 0) | (F.col("__led") == F.col("__all"))))).drop("__led", "__all", "__top")


def lines_and_breaks(nodes: DataFrame, tidy: bool = True) -> DataFrame:
    """Dividers at both ends and line breaks beyond two in a row leave; white space is tidied.

    ``nodes`` have ``parent``, ``parent_tag`` and ``code``.  Blank texts leave; between other children of an element that is
    no block a space is put, unless one is there or a mark stands at the joint.
    """
    rows = nodes
    if tidy:
        text = (F.col("kind") == "text") & ~F.col("code")
        rows = rows.filter(~_true(text & ((F.col("text") == "") | F.col("text").rlike(_BLANK))))  # no other text becomes blank
        rows = rows.withColumn("text", F.when(text, _tidy_text(F.col("text"))).otherwise(F.col("text")))
    solid = _true((F.col("kind") == "element") | _filled())
    if tidy:
        rows = _without_dividers(rows, solid)
    last_solid = F.last(F.when(solid, F.struct("tag", "parent", "kind", "text")), True).over(_before())
    rows = rows.withColumn("__prev", last_solid)
    br = F.col("tag") == "br"
    follows = br & _true((F.col("__prev.tag") == "br") & (F.col("__prev.parent") == F.col("parent")))
    rows = rows.withColumn("__run", F.sum(F.when(solid & ~_true(follows), 1).otherwise(0)).over(_here()))
    place = F.row_number().over(Window.partitionBy("page_id", "__run", br).orderBy("pre"))
    rows = rows.withColumn("__place", place).filter(~_true(br & (F.col("__place") > 2)))
    if not tidy:
        return rows.drop("__prev", "__run", "__place")
    siblings = Window.partitionBy("page_id", "parent").orderBy("pre")
    rows = rows.withColumn("__left", F.lag(F.struct("kind", "text")).over(siblings))
    both = (F.col("kind") == "element") | (F.col("__left.kind") == "element")
    marks = _true(F.col("text").rlike(r"^[,.!?:;)\]]")) | _true(F.col("__left.text").rlike(r"[,.!?:;(\[]\s*$"))
    spaced = _true(F.col("text").startswith(" ")) | _true(F.col("__left.text").endswith(" "))
    apart = F.col("__left").isNotNull() & both & ~F.col("code") & ~_true(F.col("parent_tag").isin(*NO_SPACES_BETWEEN)) & F.col("parent_tag").isNotNull() & ~marks & ~spaced
    columns = ["pre", "last", "parent", "kind", "tag", "attrs", "text", "parent_tag", "code"]
    space = F.struct(
        (F.col("pre") - 3).alias("pre"), (F.col("pre") - 3).alias("last"), F.col("parent"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("tag"),
        F.lit(None).cast("map<string,string>").alias("attrs"), F.lit(" ").alias("text"), F.col("parent_tag"), F.col("code"),
    )
    made = F.when(_true(apart), F.array(space, F.struct(*columns))).otherwise(F.array(F.struct(*columns)))
    return rows.select("page_id", F.explode(made).alias("n")).select("page_id", "n.*")


def standardise(nodes: DataFrame, titles: DataFrame, debug: bool = False) -> DataFrame:
    """The main content's nodes (page_id, pre, last, parent, kind, tag, attrs, text, parent_tag) in standard form.

    ``nodes`` are one subtree per page, ``titles`` (page_id, title).  In debug mode structure and debugging attributes
    stay.  Null titles remove no heading.
    """
    rows = roles_and_links(headings_and_spaces(_spread(nodes), titles))
    if debug:
        return lines_and_breaks(_with_parents(without_last_headings(rows.withColumn("attrs", kept_attrs(debug)))), tidy=False)
    return lines_and_breaks(flattened(rows))


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the position of each one's parent, nothing flattened."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_pages(batches):
            page, pre, last = (table.column(c).to_numpy() for c in ("page_id", "pre", "last"))
            parent = parents(page, pre, last)
            root = parent == np.arange(len(parent))
            yield from table.append_column("parent", pa.array(pre[parent], pa.int32(), mask=root)).to_batches()

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.repartition("page_id").sortWithinPartitions("page_id", "pre").mapInArrow(run, f"{kinds}, parent int")
