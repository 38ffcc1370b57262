"""Page metadata: native chains over the node table, one aggregation per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webkiln.functions import jsonld, text, urls

FIELDS = (
    "title", "description", "domain", "favicon", "image", "language",
    "published", "author", "site", "schema_org", "word_count",
)
#: What the chains read from JSON-LD.
SCHEMA_PATHS = (
    "url", "mainEntityOfPage.url", "mainEntity.url", "WebSite.url", "publisher.name", "WebSite.name",
    "sourceOrganization.name", "copyrightHolder.name", "isPartOf.name", "headline", "author.name", "description",
    "image.url", "image", "inLanguage", "datePublished",
)


def meta_tags(nodes: DataFrame) -> DataFrame:
    """(page_id, pos, name, property, content): every meta element with content, in order."""
    return nodes.filter((F.col("tag") == "meta") & (F.coalesce(F.col("attrs")["content"], F.lit("")) != "")).select(
        "page_id",
        F.col("pre").alias("pos"),
        F.col("attrs")["name"].alias("name"),
        F.col("attrs")["property"].alias("property"),
        F.col("attrs")["content"].alias("content"),
    )


def schema_items(nodes: DataFrame) -> DataFrame:
    """(page_id, pre, items): the valid JSON-LD items of every script that has some."""
    ld = nodes.filter((F.col("parent_tag") == "script") & (F.col("kind") == "text"))
    ld = ld.filter(F.lower(F.coalesce(F.col("attrs")["type"], F.lit(""))) == "application/ld+json")
    found = ld.select("page_id", "pre", F.filter(jsonld.items(F.col("text")), jsonld.is_valid).alias("items"))
    return found.filter(F.size("items") > 0)


def _first(condition: Column, value: Column) -> Column:
    """Of all nodes that meet the condition, the value of the first in document order."""
    return F.min_by(F.when(condition, value), F.when(condition, F.col("pre")))


def page_heads(nodes: DataFrame) -> DataFrame:
    """One row per page with what the metadata chains read."""
    attrs, tag = F.col("attrs"), F.col("tag")
    meta = (tag == "meta") & (F.coalesce(attrs["content"], F.lit("")) != "")
    entry = F.struct("pre", F.lower(attrs["name"]).alias("name"), F.lower(attrs["property"]).alias("property"), attrs["content"].alias("content"))
    rel = F.lower(F.coalesce(attrs["rel"], F.lit("")))
    is_author = F.lower(F.coalesce(attrs["itemprop"], F.lit(""))) == "author"
    has_class = F.array_contains(F.split(F.coalesce(attrs["class"], F.lit("")), r"\s+"), "author")
    text_node = F.col("kind") == "text"
    return nodes.groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.when(meta, entry))).alias("metas"),
        _first(text_node & (F.col("parent_tag") == "title"), F.col("text")).alias("title_text"),
        _first(tag == "html", attrs["lang"]).alias("lang"),
        _first((tag == "link") & (rel == "canonical"), attrs["href"]).alias("canonical"),
        _first((tag == "base") & attrs["href"].isNotNull(), attrs["href"]).alias("base"),
        _first((tag == "link") & rel.contains("icon"), attrs["href"]).alias("icon"),
        _first((tag == "time") & attrs["datetime"].isNotNull(), attrs["datetime"]).alias("time"),
        _first((tag == "abbr") & (attrs["itemprop"] == "datePublished"), attrs["title"]).alias("abbr"),
        _first((tag == "meta") & (F.lower(attrs["http-equiv"]) == "content-language"), attrs["content"]).alias("http_language"),
        _first((F.col("kind") == "element") & (is_author | has_class), F.col("last")).alias("author_last"),
        _first((F.col("kind") == "element") & (is_author | has_class), F.col("pre")).alias("author_pre"),
    )


def _meta(kind: str, name: str) -> Column:
    found = F.filter("metas", lambda m: m[kind] == name)
    return F.coalesce(F.get(found, 0)["content"], F.lit(""))


def _byline(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """The text of the first element that marks an author: a range of the node table."""
    spans = heads.filter("author_pre IS NOT NULL").select("page_id", "author_pre", "author_last")
    inside = nodes.filter("kind = 'text'").join(spans, "page_id").filter("pre > author_pre AND pre <= author_last")
    parts = F.sort_array(F.collect_list(F.struct("pre", "text")))
    return inside.groupBy("page_id").agg(F.trim(F.array_join(F.transform(parts, lambda p: p["text"]), "")).alias("byline"))


def names(listed: Column) -> Column:
    """Names of a comma list: trimmed, without ``author``, distinct, at most ten."""
    parts = F.transform(F.split(listed, ","), lambda p: F.trim(p))
    good = F.filter(parts, lambda p: (p != "") & ~F.lower(p).isin("author", "authors"))
    return F.array_join(F.slice(F.array_distinct(good), 1, 10), ", ")


def page_metadata(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per page: title, description, domain, favicon, image, language, published, author, site, schema_org.

    Every field is the first filled entry of its chain and empty where all are.
    """
    heads = page_heads(nodes)
    ld = schema_items(nodes).groupBy("page_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pre", F.transform("items", lambda i: F.to_json(i)).alias("j")))), lambda s: s["j"])).alias("ld")
    )
    items = F.col("items")  # read before the join, so that each path is planned once however many chains name it
    ld = ld.withColumn("items", F.transform("ld", lambda j: F.try_parse_json(j)))
    ld = ld.select("page_id", "ld", F.struct(*[jsonld.joined(items, path).alias(path) for path in SCHEMA_PATHS]).alias("schema"))
    rows = pages.select("page_id", "url").join(heads, "page_id").join(ld, "page_id", "left").join(_byline(nodes, heads), "page_id", "left")
    schema = lambda path: F.coalesce(F.col("schema")[path], F.lit(""))
    name, prop = (lambda n: _meta("name", n)), (lambda n: _meta("property", n))
    last_first = lambda a: F.regexp_replace(a, r"^\s*([^,]+),\s*(.+?)\s*$", "$2 $1")
    cited = F.transform(
        F.filter("metas", lambda m: (m["name"] == "citation_author") | (m["property"] == "dc.creator")), lambda m: last_first(m["content"])
    )
    document_url = text.first_filled(
        F.col("url"), prop("og:url"), prop("twitter:url"), schema("url"), schema("mainEntityOfPage.url"), schema("mainEntity.url"),
        schema("WebSite.url"), F.col("canonical"), F.col("base"),
    )
    site = text.first_filled(
        schema("publisher.name"), prop("og:site_name"), schema("WebSite.name"), schema("sourceOrganization.name"), name("copyright"),
        schema("copyrightHolder.name"), schema("isPartOf.name"), name("application-name"),
    )
    title = text.first_filled(
        prop("og:title"), name("twitter:title"), schema("headline"), name("title"), name("sailthru.title"), F.trim("title_text")
    )
    author = text.first_filled(
        F.array_join(F.array_distinct(cited), ", "), name("sailthru.author"), prop("author"), name("author"), name("byl"),
        name("authorlist"), names(schema("author.name")), names(F.coalesce("byline", F.lit(""))), name("copyright"),
        schema("copyrightHolder.name"), prop("og:site_name"), schema("publisher.name"),
        schema("sourceOrganization.name"), schema("isPartOf.name"), name("twitter:creator"), name("application-name"),
    )
    rows = rows.select("*", document_url.alias("document_url"), site.alias("site"), title.alias("title"), author.alias("author"))
    document_url, site, title, author = (F.col(c) for c in ("document_url", "site", "title", "author"))  # each chain is written once
    icon = text.first_filled(prop("og:image:favicon"), F.col("icon"), name("msapplication-tileimage"), F.when(document_url != "", F.lit("/favicon.ico")))
    rows = rows.withColumn("favicon", icon)
    icon = F.col("favicon")
    return rows.select(
        "page_id",
        text.clean_title(title, site).alias("title"),
        text.first_filled(
            name("description"), prop("description"), prop("og:description"), schema("description"), name("twitter:description"),
            name("sailthru.description"),
        ).alias("description"),
        urls.domain(document_url).alias("domain"),
        F.when(F.startswith(icon, F.lit("http")), icon).otherwise(urls.resolve(icon, document_url)).alias("favicon"),
        text.first_filled(
            prop("og:image"), name("twitter:image"), schema("image.url"), schema("image"), name("sailthru.image.full"), name("sailthru.image.thumb")
        ).alias("image"),
        text.language_code(
            text.first_filled(F.trim("lang"), name("content-language"), prop("og:locale"), F.col("http_language"), schema("inLanguage"))
        ).alias("language"),
        text.first_filled(
            schema("datePublished"), name("publishdate"), prop("article:published_time"), F.col("abbr"), F.col("time"),
            name("sailthru.date"), name("date"),
        ).alias("published"),
        author.alias("author"),
        text.first_filled(site, author).alias("site"),
        F.when(F.col("ld").isNotNull(), F.concat(F.lit("["), F.array_join("ld", ","), F.lit("]"))).otherwise("").alias("schema_org"),
    )
