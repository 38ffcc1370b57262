"""The registered queries of the page operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webkiln.functions import media, text, urls
from webkiln.html.shred import shred
from webkiln.operators import blocks, content, dispatch, metadata, patterns, removals, render, selectors, standardise
from webkiln.plans import extract as plan
from webkiln.sources.shared import materialise
from webkiln.streaming import pages as streams


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _nodes(spark, sf_dir):
    """The node table, parsed once for plans that read it several times."""
    return materialise(shred(_pages(spark, sf_dir)), "nodes")


def page_extract(spark, sf_dir):
    return plan.extract(_pages(spark, sf_dir), plan.Options(markdown=True))


def page_extract_ladder(spark, sf_dir):
    return plan.extract(_pages(spark, sf_dir), plan.Options(markdown=True), retry_step=True)


def page_metadata(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return metadata.page_metadata(pages, _nodes(spark, sf_dir))


def meta_tags(spark, sf_dir):
    return metadata.meta_tags(shred(_pages(spark, sf_dir))).select("page_id", "name", "property", "content")


def element_counts(spark, sf_dir):
    nodes = shred(_pages(spark, sf_dir)).filter("kind = 'element'")
    tags = nodes.filter(F.col("tag").isin("p", "h1", "nav", "ul", "li", "a", "footer", "article", "div"))
    return tags.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


#: What ``selector_matches`` counts: every combinator, attributes, positions, :not and :has.
SELECTORS = (
    "nav > ul > li > a[href^='/']", "nav a", "article > h1 + p", "div.ad ~ article", "li:first-child", "ul > li:last-child",
    "li:nth-child(odd)", "li + li", "article > p:has(br)", "article > p:not(:has(br))", "ul:has(> li > a)", "body > :not(nav, article)",
)


def selector_matches(spark, sf_dir):
    """How many elements of each page every selector finds, all in one scan."""
    named = {f"s{i}": s for i, s in enumerate(SELECTORS)}
    found = selectors.match(shred(_pages(spark, sf_dir)), named)
    counts = found.groupBy("page_id").agg(*[F.count_if(name).alias(name) for name in named])
    return counts.unpivot("page_id", list(named), "name", "n").select("page_id", "name", "n").filter("n > 0")


def content_patterns(spark, sf_dir):
    """How many elements each content pattern finds in the main contents."""
    nodes = _nodes(spark, sf_dir)
    main = materialise(content.main_content(nodes), "main")
    inside = materialise(removals.subtree(nodes, main), "inside")
    return patterns.pattern_victims(inside, main).groupBy("page_id", "reason").agg(F.count("*").alias("n"))


def article_text(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    main = content.main_content(nodes)
    words = render.to_text(removals.subtree(nodes, main))
    return words.select(
        "page_id", F.sha2(F.col("content_text").cast("binary"), 256).alias("text_sha256"), text.count_words("content_text").alias("words")
    )


def article_markdown(spark, sf_dir):
    """Markdown of the whole main contents, as a digest of its words and the number of its blocks."""
    nodes = _nodes(spark, sf_dir)
    main = content.main_content(nodes)
    rows = render.to_markdown(removals.subtree(nodes, main), _pages(spark, sf_dir))
    plain = F.trim(F.regexp_replace("content_markdown", r"[*\s]+", " "))
    blocks_ = F.size(F.split("content_markdown", "\n\n"))
    return rows.select("page_id", F.sha2(plain.cast("binary"), 256).alias("plain_sha256"), blocks_.cast("long").alias("blocks"))


def standard_form(spark, sf_dir):
    """The main contents in standard form: elements by tag, and characters that are no white space."""
    nodes = _nodes(spark, sf_dir)
    main = content.main_content(nodes)
    titles = metadata.page_metadata(_pages(spark, sf_dir), nodes).select("page_id", "title")
    rows = standardise.standardise(removals.subtree(nodes, main), titles)
    counts = [F.count_if(F.col("tag") == t).alias(f"n_{t}") for t in ("p", "h1", "h2", "br", "div")]
    return rows.groupBy("page_id").agg(*counts, F.sum(F.char_length(F.regexp_replace("text", r"\s", ""))).alias("chars"))


def main_content(spark, sf_dir):
    return content.main_content(_nodes(spark, sf_dir)).select("page_id", "tag", "sel_idx")


def candidate_rank(spark, sf_dir):
    rows = content.candidates(_nodes(spark, sf_dir))
    order = Window.partitionBy("page_id").orderBy(F.desc("score"), "sel_idx", "pre")
    return rows.withColumn("place", F.row_number().over(order)).select("page_id", "place", "tag", "sel_idx", "score")


def best_block(spark, sf_dir):
    return content.best_block(_nodes(spark, sf_dir)).select("page_id", "tag", "score")


def removal_counts(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    marked = removals.mark_victims(nodes, content.main_content(nodes), ("small", "hidden", "exact", "partial"))
    return marked.filter("reason IS NOT NULL").groupBy("page_id", "tag", "reason").agg(F.count("*").alias("n"))


def low_score_blocks(spark, sf_dir):
    return blocks.block_scores(_nodes(spark, sf_dir)).select("page_id", "tag", "words", "likely", "score")


def page_links(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    links = shred(pages).filter("tag = 'a'").select("page_id", "pre", F.coalesce(F.col("attrs")["href"], F.lit("")).alias("href"))
    links = links.join(pages.select("page_id", "url"), "page_id")
    order = Window.partitionBy("page_id").orderBy("pre")
    return links.select("page_id", F.row_number().over(order).alias("link"), "href", urls.resolve(F.col("href"), F.col("url")).alias("target"))


def extractor_dispatch(spark, sf_dir):
    return dispatch.dispatch(_pages(spark, sf_dir))


def url_parts(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    url = F.col("url")
    return pages.select(
        "page_id", urls.domain(url).alias("domain"), urls.canonical(url).alias("canonical"), urls.is_dangerous(url).alias("dangerous")
    )


def url_marks(spark, sf_dir):
    url = F.col("url")
    return _pages(spark, sf_dir).select(
        "page_id",
        urls.citation_domain(url).alias("citation_domain"),
        urls.fragment_text(url).alias("fragment_text"),
        urls.unwrap_redirect(url).alias("target"),
        urls.large_image(url).alias("large_image"),
        urls.is_tracking_pixel(url).alias("tracking"),
        media.is_image_url(url).alias("image"),
    )


def text_marks(spark, sf_dir):
    body = F.col("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        F.sha2(media.tidy_code(body), 256).alias("code_sha256"),
        media.looks_like_latex(body).alias("latex"),
        media.is_caption(body).alias("caption"),
        text.is_word_char(body).alias("word_char"),
        F.size(media.class_tokens(body)).cast("long").alias("n_tokens"),
    )


def url_dedupe(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", urls.canonical(F.col("url")).alias("canonical"))
    return pages.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


def host_rollup(spark, sf_dir):
    pages = _pages(spark, sf_dir).select(
        urls.domain(F.col("url")).alias("domain"), F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme"), F.octet_length("html").alias("bytes")
    )
    return pages.cube("domain", "scheme").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


def host_sets(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    side = lambda scheme: pages.filter(F.col("url").startswith(scheme + ":")).select(urls.domain(F.col("url")).alias("domain"))
    http, https = side("http"), side("https")
    parts = {"both": http.intersect(https), "only_http": http.exceptAll(https).distinct().subtract(https), "any": http.union(https).distinct()}
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("part"), "domain")
        out = rows if out is None else out.unionByName(rows)
    return out


def document_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.count_words("text").alias("words"), text.truncate(F.col("text"), 140).alias("short"))


def language_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", text.count_words("text").alias("words"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("n"), F.sum("words").alias("words"), F.max("words").alias("longest"), F.percentile("words", F.lit(0.5)).alias("median")
    )


def conversation_threads(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("depth", F.when(F.col("role") == "assistant", 1).otherwise(0))
    out = dispatch.comment_threads(turns, "conv_id", "turn", "depth", "role", "text")
    return out.select("conv_id", F.sha2(F.col("thread_html").cast("binary"), 256).alias("html_sha256"))


def event_properties(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("v", F.try_parse_json("props"))
    keys = F.expr("map_keys(cast(v AS map<string, variant>))")
    return events.select("event_id", F.array_join(F.array_sort(keys), ",").alias("keys"))


def event_windows(spark, sf_dir):
    return streams.event_windows(table(spark, sf_dir, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, sf_dir):
    return streams.event_sessions(table(spark, sf_dir, "events"))


def longest_by_host(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", urls.domain(F.col("url")).alias("domain"), F.char_length("html").alias("chars"))
    return dispatch.best_of(pages, ["domain"], "chars", ["page_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        page_extract, page_extract_ladder, page_metadata, meta_tags, element_counts, selector_matches, article_text, article_markdown, standard_form, content_patterns, main_content, candidate_rank, best_block,
        removal_counts, low_score_blocks, page_links, extractor_dispatch, url_parts, url_marks, text_marks, url_dedupe, host_rollup, host_sets, document_words, language_words,
        conversation_threads, event_properties, event_windows, event_sessions, longest_by_host,
    ]
    return {f.__name__: f for f in found}


_TEXT = r"regexp_replace({0}, '<[^>]*>', '', 'g')"
for _entity, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&#39;", "''"), ("&lt;", "<"), ("&gt;", ">")):
    _TEXT = f"replace({_TEXT}, '{_entity}', '{_char}')"
_TEXT = f"regexp_replace({_TEXT}, '&amp;?', '&', 'g')"  # the closing mark may be missing
_ARTICLE = r"regexp_extract(html, '(?s)<article>(.*)</article>', 1)"
_HOST = r"lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1))"
_DOMAIN = rf"regexp_replace({_HOST}, '^www\.', '')"
_CANONICAL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z]+://', ''), '[?#].*$', ''), "
    r"'^(www|m|blog)\.', ''), '(\.html)?/*$', '')"
)


def oracle_sql() -> dict[str, str]:
    return {
        "page_metadata": rf"""
SELECT page_id, trim({_TEXT.format("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title, '' AS description,
  {_DOMAIN} AS domain, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || '/favicon.ico' AS favicon, '' AS image,
  regexp_extract(html, '<html lang="([^"]*)"', 1) AS language, '' AS published, '' AS author, '' AS site, '' AS schema_org
FROM pages""",
        "meta_tags": r"""
SELECT page_id, NULL::VARCHAR AS name, NULL::VARCHAR AS property, NULL::VARCHAR AS content FROM pages WHERE html LIKE '%<meta %content=%'""",
        "element_counts": r"""
WITH c AS (
  SELECT page_id, unnest(['p', 'h1', 'nav', 'ul', 'li', 'a', 'footer', 'article', 'div']) AS tag, html FROM pages)
SELECT page_id, tag, len(regexp_extract_all(html, '<' || tag || '[ >]')) AS n FROM c
WHERE len(regexp_extract_all(html, '<' || tag || '[ >]')) > 0""",
        "selector_matches": r"""
WITH h AS (
  SELECT page_id, html, len(regexp_extract_all(html, '<li>')) AS li, string_split(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<p>')[2:] AS p
  FROM pages),
c AS (
  SELECT page_id, unnest([
    {'name': 's0', 'n': len(regexp_extract_all(html, '<li><a href="/'))},
    {'name': 's1', 'n': len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*)</nav>', 1), '<a '))},
    {'name': 's2', 'n': len(regexp_extract_all(html, '</h1><p>'))},
    {'name': 's3', 'n': len(regexp_extract_all(html, '(?s)<div class="ad">.*<article>'))},
    {'name': 's4', 'n': len(regexp_extract_all(html, '<ul><li>'))},
    {'name': 's5', 'n': len(regexp_extract_all(html, '</li></ul>'))},
    {'name': 's6', 'n': (li + 1) // 2},
    {'name': 's7', 'n': greatest(li - 1, 0)},
    {'name': 's8', 'n': len(list_filter(p, lambda x: contains(x, '<br>')))},
    {'name': 's9', 'n': len(list_filter(p, lambda x: NOT contains(x, '<br>')))},
    {'name': 's10', 'n': len(regexp_extract_all(html, '<ul><li><a '))},
    {'name': 's11', 'n': len(regexp_extract_all(html, '<(div|footer)[ >]'))}]) AS f
  FROM h)
SELECT page_id, f.name AS name, f.n AS n FROM c WHERE f.n > 0""",
        "article_text": rf"""
WITH a AS (SELECT page_id, {_TEXT.format(_ARTICLE)} AS t FROM pages)
SELECT page_id, sha256(t) AS text_sha256, len(regexp_extract_all(t, '\S+')) AS words FROM a""",
        "article_markdown": rf"""
WITH a AS (SELECT page_id, regexp_replace({_ARTICLE}, '(?s)<h1>.*?</h1>', '') AS t FROM pages),
b AS (
  SELECT page_id, {_TEXT.format("regexp_replace(t, '<(p|br)[^>]*>', ' ', 'g')")} AS plain,
    len(list_filter(string_split(t, '<p>'), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'), ' ' || chr(10)) <> '')) AS blocks FROM a)
SELECT page_id, sha256(trim(regexp_replace(plain, '[*\s]+', ' ', 'g'))) AS plain_sha256, blocks FROM b""",
        "standard_form": rf"""
WITH a AS (SELECT page_id, regexp_replace({_ARTICLE}, '(?s)<h1>.*?</h1>', '') AS t FROM pages)
SELECT page_id,
  len(list_filter(string_split(t, '<p>'), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'), ' ' || chr(10)) <> '')) AS n_p,
  0 AS n_h1, 0 AS n_h2, len(regexp_extract_all(t, '<br>')) AS n_br, 0 AS n_div,
  length(regexp_replace({_TEXT.format("t")}, '\s', '', 'g')) AS chars FROM a""",
        "main_content": "SELECT page_id, 'article' AS tag, 12 AS sel_idx FROM pages",
        "removal_counts": r"""
WITH c AS (SELECT page_id, unnest(['nav', 'footer', 'script', 'style', 'meta']) AS tag, 'exact' AS reason, html FROM pages
  UNION ALL SELECT page_id, 'div', 'exact', html FROM pages)
SELECT page_id, tag, reason, len(regexp_extract_all(html, '<' || tag || CASE tag WHEN 'div' THEN ' class="ad"' ELSE '[ >]' END)) AS n
FROM c WHERE n > 0""",
        "page_links": r"""
WITH l AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
    generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS link FROM pages)
SELECT page_id, link, replace(href, '&amp;', '&') AS href,
  regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || replace(href, '&amp;', '&') AS target FROM l""",
        "extractor_dispatch": "SELECT page_id, url, 'generic' AS extractor FROM pages",
        "url_parts": rf"SELECT page_id, {_DOMAIN} AS domain, {_CANONICAL} AS canonical, false AS dangerous FROM pages",
        "url_marks": r"""
SELECT page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1), '^www\.', '') AS citation_domain,
  CASE WHEN position('#:~:text=' IN url) > 0 THEN ' — ' || split_part(url, '#:~:text=', 2) ELSE '' END AS fragment_text,
  coalesce(nullif(regexp_extract(url, '[?&]u=([^&#;]*)', 1), ''), url) AS target,
  CASE WHEN contains(url, '&name=') THEN regexp_replace(url, '&name=\w+', '&name=large', 'g')
    WHEN contains(url, '?') THEN url || '&name=large' ELSE url || '?name=large' END AS large_image,
  regexp_matches(lower(url), '(pixel|1x1|tracking)\.gif|analytics|metrics|beacon') AS tracking,
  regexp_matches(url, '(?i:\.(jpg|jpeg|png|webp|gif|avif)(\?.*)?$)|image|img|photo') AND NOT starts_with(url, 'data:') AS image
FROM pages""",
        "text_marks": r"""
WITH t AS (SELECT doc_id, text, regexp_replace(text, '^[\s\x0b\x{85}\pZ]+|[\s\x0b\x{85}\pZ]+$', '', 'g') AS plain FROM documents)
SELECT doc_id, sha256(regexp_replace(replace(replace(plain, chr(9), '    '), chr(160), ' '), '\n{3,}', chr(10) || chr(10), 'g')) AS code_sha256,
  regexp_matches(text, '(?-s)\$.*\$|\\\w|\{.*\}|\^|_') AS latex,
  strlen(plain) >= 10 AND NOT regexp_matches(plain,
    '^https?://|(?i:^[\w\-./\\]+\.(jpg|jpeg|png|gif|webp|svg)$)|^\d+$|^\d{4}-\d{2}-\d{2}$') AS caption,
  regexp_matches(text, '^[0-9A-Za-z_]') AS word_char,
  CASE WHEN plain = '' THEN 0 ELSE 1 + len(regexp_extract_all(plain, '[\s\x0b\x{85}\pZ]+')) END AS n_tokens
FROM t""",
        "url_dedupe": rf"SELECT {_CANONICAL} AS canonical, min(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1",
        "host_rollup": rf"""
WITH p AS (SELECT {_DOMAIN} AS domain, regexp_extract(url, '^([a-z]+):', 1) AS scheme, strlen(html) AS bytes FROM pages)
SELECT domain, scheme, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM p GROUP BY CUBE (domain, scheme)""",
        "host_sets": rf"""
WITH p AS (SELECT {_DOMAIN} AS domain, regexp_extract(url, '^([a-z]+):', 1) AS scheme FROM pages),
h AS (SELECT DISTINCT domain FROM p WHERE scheme = 'http'), s AS (SELECT DISTINCT domain FROM p WHERE scheme = 'https')
SELECT 'both' AS part, domain FROM (FROM h INTERSECT FROM s)
UNION ALL SELECT 'only_http', domain FROM (FROM h EXCEPT FROM s)
UNION ALL SELECT 'any', domain FROM (FROM h UNION FROM s)""",
        "document_words": r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS INTEGER) AS words,
  CASE WHEN length(text) > 140 THEN substr(text, 1, 140) || '...' ELSE text END AS short FROM documents""",
        "language_words": r"""
WITH d AS (SELECT lang, len(regexp_extract_all(text, '[^\s]+')) AS words FROM documents)
SELECT lang, count(*) AS n, CAST(sum(words) AS BIGINT) AS words, CAST(max(words) AS INTEGER) AS longest,
  CAST(quantile_cont(words, 0.5) AS DOUBLE) AS median FROM d GROUP BY lang""",
        "conversation_threads": r"""
WITH t AS (SELECT *, CASE WHEN role = 'assistant' THEN 1 ELSE 0 END AS depth FROM conversations),
l AS (SELECT *, coalesce(lag(depth) OVER w, 0) AS prev, lead(turn) OVER w IS NULL AS final FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, sha256(string_agg(repeat('</blockquote>', greatest(prev - depth, 0)) || repeat('<blockquote>', greatest(depth - prev, 0))
  || '<div class="comment"><strong>' || role || '</strong>: ' || text || '</div>'
  || CASE WHEN final THEN repeat('</blockquote>', depth) ELSE '' END, '' ORDER BY turn)) AS html_sha256
FROM l GROUP BY conv_id""",
        "event_properties": "SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS keys FROM events",
        "event_windows": r"""
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM events GROUP BY 1, 2""",
        "event_sessions": r"""
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, k""",
        "longest_by_host": rf"""
SELECT page_id, domain, chars FROM (
  SELECT page_id, {_DOMAIN} AS domain, CAST(length(html) AS INTEGER) AS chars,
    row_number() OVER (PARTITION BY {_DOMAIN} ORDER BY length(html) DESC, page_id) AS r FROM pages) WHERE r = 1""",
    }
