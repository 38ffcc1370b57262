"""Which site extractor a url belongs to: one ordered chain of conditions made from a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webkiln.functions import urls

#: Extractors in order of priority with host patterns and ``re:`` url patterns.
EXTRACTORS = (
    ("twitter", ("x.com", "twitter.com", r"re:x\.com/.*/article/.*", r"re:twitter\.com/.*/article/.*")),
    ("bluesky", ("bsky.app",)), ("threads", ("threads.com", "threads.net")), ("linkedin", ("linkedin.com",)),
    ("xoembed", ("publish.twitter.com", "publish.x.com")), ("substack", ("substack.com", r"re:\.substack\.com")),
    ("medium", ("medium.com", r"re:\.medium\.com")), ("nytimes", ("nytimes.com",)), ("lwn", ("lwn.net", r"re:(?i)\.lwn\.net")),
    ("youtube", ("youtube.com", "youtu.be")), ("reddit", ("reddit.com", "old.reddit.com", "new.reddit.com")),
    ("hackernews", (r"re:news\.ycombinator\.com/item\?id=.*",)), ("github", ("github.com",)),
    ("wikipedia", (r"re:(?i)[a-z-]+\.wikipedia\.org",)), ("c2wiki", (r"re:(?i)c2\.com/(cgi/wiki|wiki/)",)),
    ("leetcode", ("leetcode.com",)), ("chatgpt", (r"re:^https?://chatgpt\.com/(c|share)/.*",)),
    ("claude", (r"re:^https?://claude\.ai/(chat|share)/.*",)), ("grok", ("grok.com", "grok.x.ai", "x.ai")),
    ("gemini", ("gemini.google.com",)), ("generic", ("re:.*",)),
)


class Registry:
    """An ordered list of (name, patterns) that may be added to."""

    def __init__(self, mappings=EXTRACTORS):
        self.mappings = list(mappings)

    def register(self, name: str, patterns: tuple[str, ...]) -> Registry:
        self.mappings.append((name, tuple(patterns)))
        return self

    def of(self, url: Column) -> Column:
        """Name of the first mapping whose host or url pattern fits; null if none does.

        Hosts fit if they equal, end in or contain the pattern.
        """
        url = F.coalesce(url, F.lit(""))
        host, out = F.coalesce(urls.host(url), F.lit("")), None
        for name, patterns in self.mappings:
            fits = F.lit(False)
            for p in patterns:
                fits = fits | (url.rlike(p[3:]) if p.startswith("re:") else host.contains(p))
            out = F.when(fits, F.lit(name)) if out is None else out.when(fits, F.lit(name))
        return F.lit(None).cast("string") if out is None else out

    def names(self) -> list[str]:
        return [name for name, _ in self.mappings]


def dispatch(pages: DataFrame, registry: Registry | None = None) -> DataFrame:
    """(page_id, url, extractor) of every page, without a join or a shuffle."""
    url = F.coalesce("url", F.lit(""))
    return pages.select("page_id", url.alias("url"), (registry or Registry()).of(url).alias("extractor")).filter("extractor IS NOT NULL")


def comment_threads(turns: DataFrame, group: str, order: str, depth: str, author: str, body: str) -> DataFrame:
    """(group, thread_html): ordered comments as nested quotes, by a fold that keeps the open depth."""
    rows = turns.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.col(depth).alias("depth"), F.col(author).alias("author"), F.col(body).alias("body")))).alias("rows")
    )

    def step(done, row):
        up = F.repeat(F.lit("</blockquote>"), F.greatest(done["open"] - row["depth"], F.lit(0)))
        down = F.repeat(F.lit("<blockquote>"), F.greatest(row["depth"] - done["open"], F.lit(0)))
        entry = F.concat(F.lit('<div class="comment"><strong>'), row["author"], F.lit("</strong>: "), row["body"], F.lit("</div>"))
        return F.struct(F.concat(done["out"], up, down, entry).alias("out"), row["depth"].alias("open"))

    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("open"))
    end = lambda done: F.concat(done["out"], F.repeat(F.lit("</blockquote>"), done["open"]))
    return rows.select(group, F.aggregate("rows", first, step, end).alias("thread_html"))


def best_of(rows: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The best row of each group."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return rows.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")
