"""Discussion threads and chat transcripts as rows: declarative rules over the node table.

A site's rule says which elements are entries, where author and body are found below
them and what gives the depth.  All sites share one plan: entries are filtered by
their site's rule, author and body are the first matching elements inside an entry
(an interval join within a page), and text comes from the page's text by offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webkiln.operators.content import classes, measured, subtree_totals


@dataclass(frozen=True)
class Test:
    """An element test: tag, class, and an attribute that equals, starts with or holds a value."""

    tag: str | None = None
    name: str | None = None
    attr: str | None = None
    value: str | None = None
    how: str = "="

    def column(self) -> Column:
        out = F.col("kind") == "element"
        if self.tag:
            out &= F.col("tag") == self.tag
        if self.name:
            out &= F.array_contains(classes(F.col("attrs")), self.name)
        if self.attr:
            held = F.coalesce(F.col("attrs")[self.attr], F.lit(""))
            if self.value is None:
                out &= F.col("attrs")[self.attr].isNotNull()
            else:
                out &= {"=": held == self.value, "^": F.startswith(held, F.lit(self.value)), "*": held.contains(self.value)}[self.how]
        return out


@dataclass(frozen=True)
class Rule:
    """How a site marks its entries; ``depth`` is an attribute, ``indent`` a class of a sized image, else nesting counts."""

    site: str
    entry: tuple[Test, ...]
    body: tuple[Test, ...] = ()
    author: tuple[Test, ...] = ()
    author_attr: str | None = None
    fixed_author: tuple[tuple[Test, str], ...] = ()
    depth_attr: str | None = None
    indent_width: int | None = None


#: The marks that sites put on comments and messages.
RULES = (
    Rule("hackernews", (Test("tr", "comtr"),), (Test("div", "commtext"), Test("span", "commtext")), (Test("a", "hnuser"),), indent_width=40),
    Rule("reddit", (Test("shreddit-comment"),), (Test("div", attr="slot", value="comment"),), author_attr="author", depth_attr="depth"),
    Rule("lwn", (Test("details", "CommentBox"),), (Test("div", "FormattedComment"),), (Test("p", "CommentPoster"),)),
    Rule("chatgpt", (Test("article", attr="data-testid", value="conversation-turn-", how="^"),), (Test("div", "markdown"),), author_attr="data-turn"),
    Rule("claude", (Test(attr="data-testid", value="user-message"), Test(name="font-claude-response")),
         fixed_author=((Test(attr="data-testid", value="user-message"), "You"), (Test(name="font-claude-response"), "Claude"))),
    Rule("gemini", (Test("user-query"), Test("model-response")), (Test("div", "query-text"), Test("div", "markdown")),
         fixed_author=((Test("user-query"), "You"), (Test("model-response"), "Gemini"))),
    Rule("discourse", (Test(name="topic-post"),), (Test("div", "cooked"),), (Test("span", "username"),)),
)


def _any(tests: tuple[Test, ...]) -> Column:
    out = F.lit(False)
    for test in tests:
        out |= test.column()
    return out


def _first_inside(entries: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(page_id, entry, name): text of the first found element in each entry, not in an entry nested in it."""
    inside = found.select("page_id", F.col("pre").alias("at"), F.col("content_text").alias(name)).join(
        entries.select("page_id", F.col("pre").alias("entry"), F.col("last").alias("entry_last")), "page_id"
    )
    inside = inside.filter("at >= entry AND at <= entry_last")
    own = inside.groupBy("page_id", "at").agg(F.max("entry").alias("entry"), F.first(name).alias(name))
    return own.groupBy("page_id", "entry").agg(F.min_by(name, "at").alias(name))


def entries(nodes: DataFrame, sites: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, site, entry, place, depth, author, body) of all pages whose extractor has a rule.

    ``sites`` is (page_id, extractor).  Entries keep document order; a depth is the
    site's attribute, the indent divided by its width, or the number of entries
    around the entry.
    """
    rows = measured(nodes).join(sites.select("page_id", F.col("extractor").alias("site")), "page_id")
    is_ = {k: F.lit(False) for k in ("entry", "body", "author")}
    fixed = attr_author = depth = F.lit(None).cast("string")
    width = F.lit(None).cast("int")
    for rule in rules:
        here = F.col("site") == rule.site
        for k in is_:
            is_[k] |= here & _any(getattr(rule, k))
        for test, name in rule.fixed_author:
            fixed = F.coalesce(fixed, F.when(here & test.column(), F.lit(name)))
        if rule.author_attr:
            attr_author = F.coalesce(attr_author, F.when(here, F.col("attrs")[rule.author_attr]))
        if rule.depth_attr:
            depth = F.coalesce(depth, F.when(here, F.col("attrs")[rule.depth_attr]))
        if rule.indent_width:
            width = F.coalesce(width, F.when(here, F.lit(rule.indent_width)))
    rows = rows.select("*", *[v.alias(f"is_{k}") for k, v in is_.items()], width.alias("indent_width"))
    marked = rows.filter("is_entry").select("*", F.coalesce(fixed, attr_author).alias("said_by"))
    found = subtree_totals(measured(nodes), rows.filter("is_entry OR is_body OR is_author"))
    marked = marked.select("page_id", "pre", "last", "site", "said_by", F.try_to_number(F.coalesce(depth, F.lit("")), F.lit("999")).cast("int").alias("given_depth"))
    whole = found.filter("is_entry").select("page_id", F.col("pre"), F.col("content_text").alias("whole"))
    body = _first_inside(marked, found.filter("is_body"), "body").withColumnRenamed("entry", "pre")
    author = _first_inside(marked, found.filter("is_author"), "author").withColumnRenamed("entry", "pre")
    indents = rows.filter("indent_width IS NOT NULL AND tag = 'img'").select(
        "page_id", "pre", (F.expr("try_cast(attrs['width'] AS int)") / F.col("indent_width")).cast("int").cast("string").alias("content_text")
    )
    indent = _first_inside(marked, indents, "indent").withColumnRenamed("entry", "pre")
    order = Window.partitionBy("page_id").orderBy("pre")
    around = F.collect_list("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    nested = F.size(F.filter(around, lambda end: end >= F.col("last")))
    out = marked.withColumn("nested", nested).withColumn("place", F.row_number().over(order))
    for extra in (whole, body, author, indent):
        out = out.join(extra, ["page_id", "pre"], "left")
    return out.select(
        "page_id",
        "site",
        F.col("pre").alias("entry"),
        "place",
        F.coalesce("given_depth", F.col("indent").cast("int"), "nested").alias("depth"),
        F.coalesce(F.trim("author"), "said_by", F.lit("")).alias("author"),
        F.btrim(F.coalesce("body", "whole", F.lit("")), F.lit(" \t\r\n")).alias("body"),
    )
