"""Text, clean HTML and Markdown of a node table, as ordered aggregations of marks.

Every node gives one mark at its start and one at its end; sorting the marks of a page
by position writes the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webkiln.functions import urls
from webkiln.html.shred import VOID
from webkiln.operators import markdown

def escape_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def safe_attrs(attrs: Column, url: Column) -> Column:
    """Attributes without handlers and dangerous urls; links are resolved against ``url``."""
    kept = F.map_filter(attrs, lambda k, v: ~k.startswith("on") & ~(k.isin("href", "src", "action") & urls.is_dangerous(v)))
    return F.transform_values(
        kept,
        lambda k, v: F.when(k.isin("href", "src", "poster", "data-src", "action"), urls.resolve(v, url))
        .when(k.isin("srcset", "data-srcset"), urls.resolve_srcset(v, url))
        .otherwise(v),
    )


def _written(nodes: DataFrame, tokens: tuple[Column, Column] | None = None, **marks: tuple[Column, Column]) -> DataFrame:
    """(page_id, and a column for each of ``marks``): (opening, closing) marks in document order.

    ``tokens`` are arrays instead of texts; they are strung together as the column ``tokens``.

    Starts come before ends, inner ends before outer ones.  All columns are written by
    one sort of the page's nodes.
    """
    start = [opening.alias(name) for name, (opening, _) in marks.items()]
    end = [closing.alias(name) for name, (_, closing) in marks.items()]
    if tokens is not None:
        start, end = [*start, tokens[0].alias("tokens")], [*end, tokens[1].alias("tokens")]
    place = lambda at, side, inner: [at.alias("at"), F.lit(side).alias("side"), inner.alias("inner")]
    both = F.array(F.struct(*place(F.col("pre"), 0, F.lit(0)), *start), F.struct(*place(F.col("last"), 1, -F.col("pre")), *end))
    says = [*(f"m.{name} <> ''" for name in marks), *(["size(m.tokens) > 0"] if tokens is not None else [])]
    rows = nodes.select("page_id", F.explode(both).alias("m")).filter(" OR ".join(says))
    order = F.sort_array(F.collect_list("m"))
    rows = rows.groupBy("page_id").agg(order.alias("ms"))
    flat = [F.flatten("ms.tokens").alias("tokens")] if tokens is not None else []
    return rows.select("page_id", *[F.array_join(F.col("ms").getField(name), "").alias(name) for name in marks], *flat)


def _text_marks() -> tuple[Column, Column]:
    return F.coalesce("text", F.lit("")), F.lit("")


def to_text(nodes: DataFrame) -> DataFrame:
    return _written(nodes, content_text=_text_marks())


def _with_url(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    return nodes.join(pages.select("page_id", F.coalesce("url", F.lit("")).alias("__url")), "page_id")


def _html_marks() -> tuple[Column, Column]:
    attrs = F.map_entries(safe_attrs(F.coalesce("attrs", F.expr("map()").cast("map<string,string>")), F.col("__url")))
    quoted = F.array_join(
        F.transform(attrs, lambda a: F.concat(F.lit(" "), a["key"], F.lit('="'), F.replace(escape_text(a["value"]), F.lit('"'), F.lit("&quot;")), F.lit('"'))),
        "",
    )
    element = F.col("kind") == "element"
    opening = F.when(element, F.concat(F.lit("<"), F.col("tag"), quoted, F.lit(">"))).otherwise(escape_text(F.coalesce("text", F.lit(""))))
    closing = F.when(element & ~F.col("tag").isin(*VOID), F.concat(F.lit("</"), F.col("tag"), F.lit(">"))).otherwise("")
    return opening, closing


def to_html(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, content): sanitised HTML of what is left."""
    return _written(_with_url(nodes, pages), content=_html_marks())


def to_markdown(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, content_markdown): what ``markdown`` writes of the nodes."""
    rows = markdown.with_context(_with_url(nodes, pages))
    return markdown.folded(_written(rows, markdown.marks(*_html_marks())), "tokens", "content_markdown")


def to_all(nodes: DataFrame, pages: DataFrame, as_markdown: bool) -> DataFrame:
    """(page_id, content, content_text, content_markdown if asked for) by one aggregation."""
    rows = _with_url(nodes, pages)
    marks = {"content": _html_marks(), "content_text": _text_marks()}
    if not as_markdown:
        return _written(rows, **marks)
    rows = markdown.with_context(rows)
    return markdown.folded(_written(rows, markdown.marks(*_html_marks()), **marks), "tokens", "content_markdown")
