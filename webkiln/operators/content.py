"""Main content: candidates, scores and the choice, by joins and windows over the node table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webkiln.functions.text import count_words, in_run

#: The entry points in order of preference, as (kind, value).
ENTRY_POINTS = (
    ("id", "post"), ("class", "post-content"), ("class", "post-body"), ("class", "article-content"), ("id", "article-content"),
    ("class", "article_post"), ("class", "article-wrapper"), ("class", "entry-content"), ("class", "content-article"),
    ("class", "instapaper_body"), ("class", "post"), ("class", "markdown-body"), ("tag", "article"), ("role", "article"),
    ("tag", "main"), ("role", "main"), ("class", "article-body"), ("id", "content"), ("tag", "body"),
)
#: The blocks that compete where no entry point is found.
BLOCKS = ("div", "section", "article", "main", "aside", "header", "footer", "nav", "content")
#: What a date and a byline look like.
DATE = r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"
BYLINE = r"(?i)\b(?:by|written by|author:)\s+[A-Za-z\s]+\b"


def classes(attrs: Column) -> Column:
    return F.filter(F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+"), lambda c: c != "")


def measured(nodes: DataFrame) -> DataFrame:
    """The node table with running totals; a subtree's total is a difference of two rows.

    ``chars`` to ``tables`` count what stands up to and including the row, so that for
    an element the difference between its ``last`` row and itself is its subtree's.
    ``counted`` and ``mid_word`` are those of ``with_words``.  A table that has been measured comes back as it is.
    """
    if set(MEASURED) <= set(nodes.columns):
        return nodes
    order = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.when(F.col("kind") == "text", F.col("text"))
    upto = lambda value, name: F.sum(F.coalesce(value, F.lit(0))).over(order).alias(name)
    is_ = lambda tag: (F.col("tag") == tag).cast("int")
    return with_words(nodes).select(
        "*",
        upto(F.char_length(text), "chars"),
        upto(is_("p"), "paragraphs"),
        upto(is_("img"), "images"),
        upto(is_("table"), "tables"),
        upto(is_("article"), "articles"),
    )


TOTALS = ("chars", "paragraphs", "images", "tables", "articles")
#: What ``measured`` adds; true of a page's whole node table only.
MEASURED = (*TOTALS, "counted", "mid_word")


def with_words(nodes: DataFrame) -> DataFrame:
    """The node table with ``counted``, the words up to and including the row, and ``mid_word``: whether they end inside a run.

    Each text is counted once; a run that goes on from one text to the next counts where it begins.
    """
    page = Window.partitionBy("page_id").orderBy("pre")
    upto, before = page.rowsBetween(Window.unboundedPreceding, Window.currentRow), page.rowsBetween(Window.unboundedPreceding, -1)
    says = F.when((F.col("kind") == "text") & (F.col("text") != ""), F.col("text"))
    ends = F.when(says.isNotNull(), in_run(F.right(says, F.lit(1))))
    rows = nodes.withColumns({"mid_word": F.coalesce(F.last(ends, True).over(upto), F.lit(False)), "__open": F.last(ends, True).over(before)})
    goes_on = F.when(F.col("__open") & in_run(F.left(says, F.lit(1))), 1).otherwise(0)
    return rows.withColumn("counted", F.sum(F.coalesce(count_words(says), F.lit(0)) - goes_on).over(upto)).drop("__open")


def words_between(content: Column) -> Column:
    """The words of ``content``, the text of the rows after one with ``counted`` and ``mid_word`` up to one with ``end_counted``."""
    cut = F.col("mid_word") & in_run(F.left(content, F.lit(1)))
    return (F.col("end_counted") - F.col("counted") + F.when(cut, 1).otherwise(0)).cast("int")


def page_texts(nodes: DataFrame) -> DataFrame:
    """(page_id, page_text): all text of a page in document order, nothing between."""
    parts = F.sort_array(F.collect_list(F.when(F.col("kind") == "text", F.struct("pre", "text"))))
    return nodes.groupBy("page_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("page_text"))


def subtree_totals(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """``elements`` (rows of ``measured``) with text, words and totals of their subtrees.

    One equi-join on (page_id, last) fetches the totals at the subtree's end, one on
    page_id the page's text, of which the subtree's text is a slice.
    """
    ends = nodes.select("page_id", F.col("pre").alias("last"), *[F.col(c).alias(f"end_{c}") for c in (*TOTALS, "counted")])
    rows = elements.join(ends, ["page_id", "last"]).join(page_texts(nodes), "page_id")
    piece = F.substr("page_text", F.col("chars") + 1, F.col("end_chars") - F.col("chars"))
    rows = rows.withColumn("content_text", piece).drop("page_text")
    for c in TOTALS:
        rows = rows.withColumn(f"n_{c}", F.col(f"end_{c}") - F.col(c)).drop(f"end_{c}")
    return rows.withColumn("words", words_between(F.col("content_text"))).drop("counted", "end_counted", "mid_word")


def link_bytes(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """(page_id, pre, link_bytes): bytes of trimmed link text below each element."""
    links = nodes.filter("tag = 'a'")
    anchored = subtree_totals(nodes, links).select(
        "page_id", F.col("pre").alias("at"), F.octet_length(F.btrim("content_text", F.lit(" \t\r\n"))).alias("bytes")
    )
    inside = elements.select("page_id", "pre", "last").distinct().join(anchored, "page_id").filter("at > pre AND at <= last")
    return inside.groupBy("page_id", "pre").agg(F.sum("bytes").alias("link_bytes"))


def scored(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """``elements`` with their content score; a column ``bonus`` counts as points."""
    rows = subtree_totals(nodes, elements).join(link_bytes(nodes, elements), ["page_id", "pre"], "left")
    attrs, text = F.col("attrs"), F.btrim("content_text", F.lit(" \t\r\n"))
    style = F.coalesce(attrs["style"], F.lit(""))
    name = F.lower(F.coalesce(attrs["class"], F.lit("")))
    flag = lambda condition, points: F.when(condition, F.lit(float(points))).otherwise(0.0)
    commas = F.char_length("content_text") - F.char_length(F.replace("content_text", F.lit(","), F.lit("")))
    base = (
        F.col("words")
        + F.col("n_paragraphs") * 10.0
        + commas
        - F.col("n_images") / F.greatest("words", F.lit(1)) * 3.0
        + flag(style.contains("float: right") | style.contains("text-align: right") | (F.coalesce(attrs["align"], F.lit("")) == "right"), 5)
        + flag(text.rlike(DATE), 10)
        + flag(text.rlike(BYLINE), 10)
        + flag(name.contains("content") | name.contains("article") | name.contains("post"), 15)
        - F.col("n_tables") * 5.0
        + (F.coalesce("bonus", F.lit(0.0)) if "bonus" in elements.columns else F.lit(0.0))
    )
    density = F.least(F.coalesce("link_bytes", F.lit(0)) / F.greatest(F.octet_length(text), F.lit(1)), F.lit(0.5))
    return rows.withColumn("content_score", base * (1 - density)).drop("link_bytes")


def candidates(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, last, tag, sel_idx, words, n_articles, score): every entry-point match."""
    attrs = F.col("attrs")
    tests = []
    for i, (kind, value) in enumerate(ENTRY_POINTS):
        has = F.array_contains(classes(attrs), value) if kind == "class" else (F.col("tag") if kind == "tag" else attrs[kind]) == value
        tests.append(F.when(has, F.lit(i)))
    measured_ = measured(nodes)
    may_hit = (F.size("attrs") > 0) | F.col("tag").isin(*[value for kind, value in ENTRY_POINTS if kind == "tag"])
    hits = measured_.filter("kind = 'element'").withColumn("hits", F.when(may_hit, F.array_compact(F.array(*tests)))).filter(F.size("hits") > 0)
    rows = scored(measured_, hits)
    return rows.select("*", F.explode("hits").alias("sel_idx")).select(
        "page_id", "pre", "last", "tag", "sel_idx", "words", "n_articles",
        (F.col("content_score") + (len(ENTRY_POINTS) - F.col("sel_idx")) * 40.0).alias("score"),
    )


def best_cells(nodes: DataFrame, least: float = 50.0) -> DataFrame:
    """(page_id, cell): the first best-scored td above ``least`` of every page with a layout table.

    A layout table is wider than 400, centred or named for content.  Cells of one get
    a bonus unless they are the first or last of their nearest table.
    """
    attrs = F.col("attrs")
    width, align, name = attrs["width"], F.coalesce(attrs["align"], F.lit("")), F.lower(F.coalesce(attrs["class"], F.lit("")))
    wide = F.coalesce(F.when(width.rlike(r"^[+-]?[0-9]+$"), width.try_cast("long")) > 400, F.lit(False))
    named = name.contains("content") | name.contains("article")
    tables = nodes.filter("tag = 'table'").select(
        "page_id", F.col("pre").alias("t"), F.col("last").alias("t_last"),
        (wide | named | (F.lower(align) == "center")).alias("layout"), (wide | named | (align == "center")).alias("favoured"),
    )
    own = nodes.join(tables.filter("layout").select("page_id").distinct(), "page_id", "left_semi")
    of_table = Window.partitionBy("page_id", "t")
    cells = own.filter("tag = 'td'").select("page_id", "pre").join(tables, "page_id").filter("pre > t AND pre <= t_last")
    inner = (F.col("pre") > F.min("pre").over(of_table)) & (F.col("pre") < F.max("pre").over(of_table))
    cells = cells.withColumn("points", F.when(F.col("favoured") & inner, 10.0).otherwise(0.0))
    bonus = cells.groupBy("page_id", "pre").agg(F.max_by("points", "t").alias("bonus"))
    measured_ = measured(own)
    rows = scored(measured_, measured_.filter("tag = 'td'").join(bonus, ["page_id", "pre"])).filter(F.col("content_score") > least)
    best = F.struct("pre", "last", "tag", F.lit(None).cast("int").alias("sel_idx"), F.col("content_score").alias("score"), "words")
    return rows.groupBy("page_id").agg(F.max_by(best, F.struct("content_score", -F.col("pre"))).alias("cell"))


def main_content(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, last, tag, sel_idx, score, words): the node that holds the page's content.

    The best-scored candidate, ties by selector and document order; unless it holds
    three articles or more, contained candidates of a better selector with more than
    fifty words take its place, in the order of their scores.  Where body is the only
    candidate the best cell of a table layout takes its place; its sel_idx is null.
    """
    order = F.struct(-F.col("score"), "sel_idx", "pre", "last", "tag", "words", "n_articles", "score")
    ranked = candidates(nodes).groupBy("page_id").agg(F.sort_array(F.collect_list(order)).alias("c"))

    def step(best: Column, child: Column) -> Column:
        inside = (child["pre"] >= best["pre"]) & (child["last"] <= best["last"])
        better = (F.get("c", 0)["n_articles"] < 3) & (child["sel_idx"] < best["sel_idx"]) & inside & (child["words"] > 50)
        return F.when(better, child).otherwise(best)

    chosen = F.aggregate(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(1))), F.get("c", 0), step)
    only_body = (F.size("c") == 1) & (F.get("c", 0)["tag"] == "body")
    rows = ranked.select("page_id", chosen.alias("best"), only_body.alias("only_body")).join(best_cells(nodes), "page_id", "left")
    instead = F.col("only_body") & F.col("cell").isNotNull()
    return rows.select(
        "page_id", *[F.when(instead, F.col(f"cell.{c}")).otherwise(F.col(f"best.{c}")).alias(c) for c in ("pre", "last", "tag", "sel_idx", "score", "words")]
    )


def best_block(nodes: DataFrame, least: float = 50.0) -> DataFrame:
    """The first best-scored block element above ``least``, for pages without an entry point."""
    measured_ = measured(nodes)
    rows = scored(measured_, measured_.filter(F.col("tag").isin(*BLOCKS)))
    first = Window.partitionBy("page_id").orderBy(F.desc("content_score"), "pre")
    return (
        rows.filter(F.col("content_score") > least)
        .withColumn("rank", F.row_number().over(first))
        .filter("rank = 1")
        .select("page_id", "pre", "last", "tag", F.col("content_score").alias("score"))
    )
