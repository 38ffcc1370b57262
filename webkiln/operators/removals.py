"""Clutter removal: victims are found by predicates and leave with their subtrees.

A node is gone if the furthest end of the victims before it in document order
reaches it, so a removal is one running maximum per page and needs no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webkiln.operators.blocks import low_blocks
from webkiln.operators.content import ENTRY_POINTS, MEASURED, classes

# Exact removal rules, by what they test.
TAGS = (
    "noscript", "style", "meta", "link", "ads-breadcrumbs", "nav", "footer", "button", "canvas", "date", "dialog", "fieldset",
    "form", "label", "option", "select", "textarea", "time", "relative-time", "instaread-player",
)
CLASSES = (
    "promo", "Promo", "alert", "navigation", "menu", "previous", "author", "Author", "contributor", "date", "entry-meta", "meta",
    "tags", "toc", "Toc", "headline", "aside", "hidden", "invisible", "subscribe", "noprint", "sidebar", "Sidebar", "copyright",
    "licensebox", "gutter", "gh-header-sticky",
)
IDS = (
    "barrier-page", "header", "Header", "banner", "Banner", "navigation", "siteSub", "categories", "date", "tags", "toc", "headline",
    "title", "Title", "articleTag", "logo", "Logo", "newsletter", "Newsletter", "sidebar", "Sidebar", "side-bar", "sitesub",
    "copyright", "page-info", "rss", "feed", "primaryaudio", "NYT_ABOVE_MAIN_CONTENT_REGION",
)
IMAGES = ("img", "svg", "picture", "video", "canvas")
ROLES = ("banner", "navigation", "dialog", "listbox", "option")
HREF_PARTS = ("/tag/", "/tags/", "/author/", "/author?", "#toc")
HREFS = ("#top", "#Top", "#page-header", "#content", "#site-content", "#main-content")
TESTED = ("class", "id", "data-component", "data-test", "data-testid", "data-test-id", "data-qa", "data-cy")
#: Words that name clutter when they are a whole part of a class, id or data name (parts end at
#: marks, digits and capitals).  A rule of this module, not a list of known sites' names; pass another.
CLUTTER_WORDS = (
    "ad", "ads", "advert", "advertisement", "advertising", "badge", "banner", "breadcrumb", "breadcrumbs", "btn", "byline", "captcha",
    "comments", "consent", "cookie", "cookies", "cta", "dateline", "disclaimer", "disqus", "donate", "donation", "dropdown", "eyebrow",
    "facebook", "feedback", "footer", "instagram", "kicker", "lightbox", "login", "masthead", "menu", "metadata", "modal", "nav",
    "navbar", "navigation", "newsletter", "outbrain", "overlay", "pagination", "paywall", "pinterest", "popular", "popup", "print",
    "profile", "promo", "promoted", "pubdate", "rating", "recirc", "recommended", "register", "related", "share", "sharing", "sidebar",
    "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "taboola", "tags", "taxonomy", "teaser",
    "timestamp", "toc", "toolbar", "tooltip", "topbar", "trending", "twitter", "upsell", "whatsapp", "widget",
)
#: Pairs of neighbouring parts that name clutter though neither does alone.
CLUTTER_PAIRS = (
    ("author", "bio"), ("author", "box"), ("author", "info"), ("author", "name"), ("entry", "meta"), ("post", "meta"), ("article", "meta"),
    ("post", "date"), ("publish", "date"), ("read", "more"), ("read", "next"), ("further", "reading"), ("keep", "reading"), ("most", "read"),
    ("screen", "reader"), ("sr", "only"), ("visually", "hidden"), ("up", "next"), ("you", "may"), ("site", "header"), ("page", "header"),
    ("side", "bar"), ("sign", "up"), ("sign", "in"), ("pull", "quote"),
)


def clutter_pattern(words: tuple[str, ...] = CLUTTER_WORDS, pairs: tuple[tuple[str, str], ...] = CLUTTER_PAIRS) -> str:
    """A pattern for names whose parts were separated by blanks and lower-cased."""
    both = [f"{a} {b}" for a, b in pairs]
    return r"(^| )(" + "|".join([*words, *both]) + r")( |$)"


def name_parts(name: Column) -> Column:
    """``siteHeader-top_2`` as ``site header top``."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(name, r"(?<=[a-z])(?=[A-Z])", " "), r"[^A-Za-z]+", " ")))


def _attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def _attributed(rule: Column) -> Column:
    """``rule`` where the element has attributes; most have none."""
    return F.when(F.size("attrs") > 0, rule).otherwise(False)


def exact_victim() -> Column:
    tag, low = F.col("tag"), F.lower(_attr("class"))
    by_tag = (
        tag.isin(*TAGS)
        | ((tag == "script") & ~F.startswith(_attr("type"), F.lit("math/")))
        | ((tag == "audio") & F.col("attrs")["src"].isNull())
        | ((tag == "aside") & ~_attr("class").contains("callout"))
        | ((tag == "input") & (_attr("type") != "checkbox"))
        | ((tag == "iframe") & ~_attr("src").rlike(r"youtube|youtu\.be|vimeo|twitter|x\.com|datawrapper"))
        | ((tag == "header") & ~F.coalesce(F.col("has_p"), F.lit(True)))
    )
    by_attrs = (
        F.arrays_overlap(classes(F.col("attrs")), F.array(*[F.lit(c) for c in CLASSES]))
        | _attr("id").isin(*IDS)
        | F.lower(_attr("role")).isin(*ROLES)
        | F.lower(_attr("role")).contains("complementary")
        | (F.array_contains(classes(F.col("attrs")), "ad") & ~_attr("class").contains("gradient"))
        | (F.array_contains(classes(F.col("attrs")), "header") & ~F.array_contains(classes(F.col("attrs")), "banner"))
        | low.rlike(r"^ad-|-ad$|pagination|^logo$")
        | F.lower(_attr("alt")).contains("advert")
        | F.lower(_attr("id")).rlike(r"^ad-|-ad$|^comments?$")
        | ((tag == "div") & F.concat(_attr("class"), F.lit(" "), _attr("id")).contains("cover-"))
        | F.col("attrs")["hidden"].isNotNull()
        | ((_attr("aria-hidden") == "true") & ~_attr("class").contains("math"))
        | (_attr("rel") == "tag")
        | _attr("href").isin(*HREFS)
        | F.startswith(_attr("href"), F.lit("#main"))
        | _attr("href").rlike("|".join(p.replace("?", r"\?") for p in HREF_PARTS) + "|/author$")
        | _attr("src").contains("author")
        | F.lower(F.concat(_attr("data-link-name"), F.lit(" "), _attr("aria-label"))).contains("skip")
    )
    return by_tag | _attributed(by_attrs)


def partial_victim(pattern: str | None = None) -> Column:
    """Elements whose class, id or data names say clutter, but for headings and what an entry point names."""
    tested = F.concat_ws(" | ", *[F.col("attrs")[a] for a in TESTED])
    named = classes(F.col("attrs"))
    entry = F.arrays_overlap(named, F.array(*[F.lit(v) for kind, v in ENTRY_POINTS if kind == "class"])) | _attr("id").isin(
        *[v for kind, v in ENTRY_POINTS if kind == "id"]
    )
    return _attributed(name_parts(tested).rlike(pattern or clutter_pattern()) & ~entry & ~F.col("tag").isin("h1", "h2", "h3", "h4", "h5", "h6"))


def hidden_victim() -> Column:
    style = F.lower(_attr("style"))
    hidden = style.rlike(r"display:\s?none|visibility:\s?hidden|opacity:\s?0")
    named = F.exists(classes(F.col("attrs")), lambda c: c.rlike(r"^(hidden|invisible)$|:(hidden|invisible)$"))
    math = (F.col("tag") == "math") | F.col("attrs")["data-mathml"].isNotNull() | _attr("class").rlike("katex-mathml|MathJax")
    return _attributed((hidden | named) & ~math)


def image_victim() -> Column:
    """Pictures of any kind and size."""
    return F.col("tag").isin(*IMAGES)


def image_key() -> Column:
    """What tells images apart: the first filled of their source attributes, id, viewbox or class."""
    return F.coalesce(*[F.nullif(F.col("attrs")[a], F.lit("")) for a in ("data-src", "src", "srcset", "data-srcset", "id", "viewbox", "class")])


def small_images(nodes: DataFrame) -> DataFrame:
    """(page_id, key): images whose width or height is a number from 1 to 32."""
    size = lambda a: F.expr(f"try_cast(attrs['{a}'] AS int)")
    small = size("width").between(1, 32) | size("height").between(1, 32)
    return nodes.filter(F.col("tag").isin("img", "svg") & small).select("page_id", image_key().alias("key")).filter("key IS NOT NULL").distinct()


REASONS = {"images": image_victim, "hidden": hidden_victim, "exact": exact_victim, "partial": partial_victim}


#: Removal steps that are on by default, and all of them in the order in which they name a victim.
STEPS = ("small", "hidden", "low", "exact", "partial")
ORDER = ("small", "images", "hidden", "low", "exact", "partial")
NAMES = {"small": "small_image", "images": "image", "low": "low_score"}


def mark_steps(nodes: DataFrame, main: DataFrame, steps: tuple[str, ...] = STEPS, low: DataFrame | None = None) -> DataFrame:
    """The node table with a boolean column per step: whether the element itself is one of the step's victims.

    What ``content.measured`` added is left behind, since it is not true of what a removal leaves.
    ``low`` are the low-scoring blocks where they are at hand already.

    Elements that are or hold the main content are kept from all steps but hidden,
    what stands in pre or code from the exact and partial ones.
    """
    order = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("page_id").orderBy(F.desc("pre")).rowsBetween(Window.unboundedPreceding, -1)
    held = main.select("page_id", F.col("pre").alias("main_pre"), F.col("last").alias("main_last"))
    rows = nodes.join(held, "page_id", "left")
    code_end = F.max(F.when(F.col("tag").isin("pre", "code"), F.col("last"))).over(order)
    next_p = F.min(F.when(F.col("tag") == "p", F.col("pre"))).over(back)
    rows = rows.withColumns({
        "in_code": F.coalesce(code_end >= F.col("pre"), F.lit(False)) | F.coalesce(F.col("tag").isin("pre", "code"), F.lit(False)),
        "has_p": F.coalesce(next_p <= F.col("last"), F.lit(False)),
    })
    holds = F.coalesce((F.col("pre") <= F.col("main_pre")) & (F.col("last") >= F.col("main_last")), F.lit(False))
    # What was found goes to a page's rows as one list, so that all joins are by page and the nodes are dealt once.
    if "small" in steps:
        rows = rows.join(small_images(nodes).groupBy("page_id").agg(F.collect_set("key").alias("small")), "page_id", "left")
    if "low" in steps:
        low = low_blocks(nodes) if low is None else low
        rows = rows.join(low.groupBy("page_id").agg(F.collect_set("pre").alias("low")), "page_id", "left")
    tests = {"small": lambda: F.array_contains("small", image_key()), "low": lambda: F.array_contains("low", F.col("pre")), **REASONS}
    element, free = F.col("kind") == "element", ~holds & ~F.col("in_code")
    allowed = {"small": F.col("tag").isin("img", "svg"), "images": element, "hidden": element, "low": element & free, "exact": element & free, "partial": element & free}
    found = [F.coalesce(F.when(allowed[step], tests[step]()), F.lit(False)).alias(f"is_{step}") for step in ORDER if step in steps]
    return rows.select(*[c for c in nodes.columns if c not in MEASURED], *found)


def reason(steps: tuple[str, ...], unless: dict[str, Column] | None = None) -> Column:
    """The first step that found the element, else null; ``unless`` says where a step does not count."""
    unless = unless or {}
    return F.coalesce(*[F.when(F.col(f"is_{s}") & ~unless.get(s, F.lit(False)), F.lit(NAMES.get(s, s))) for s in ORDER if s in steps], F.lit(None).cast("string"))


def mark_victims(nodes: DataFrame, main: DataFrame, steps: tuple[str, ...] = STEPS, low: DataFrame | None = None) -> DataFrame:
    """The node table with ``reason``: why the element itself is to go, else null."""
    marked = mark_steps(nodes, main, steps, low)
    return marked.select(*[c for c in marked.columns if not c.startswith("is_")], reason(steps).alias("reason"))


def remove(marked: DataFrame) -> DataFrame:
    """What is left after every node with a reason left with its subtree."""
    order = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gone = F.max(F.when(F.col("reason").isNotNull(), F.col("last"))).over(order)
    kept = marked.withColumn("__gone", F.coalesce(gone >= F.col("pre"), F.lit(False))).filter("NOT __gone")
    return kept.drop("__gone", "reason")


def subtree(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """The nodes below and including one root per page; roots are few, so the join is on page_id."""
    span = roots.select("page_id", F.col("pre").alias("root_pre"), F.col("last").alias("root_last"))
    return nodes.join(span, "page_id").filter("pre >= root_pre AND pre <= root_last").drop("root_pre", "root_last")
