"""Streams of pages and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webkiln.functions import urls
from webkiln.html.shred import shred

PAGES = "page_id long, url string, html string"


def read_pages(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def node_stream(pages: DataFrame) -> DataFrame:
    """The node table of a stream; shredding keeps no state."""
    return shred(pages)


def titles(pages: DataFrame) -> DataFrame:
    """(page_id, domain, title) of a stream of pages, without any state."""
    found = node_stream(pages.select("page_id", "html")).filter("kind = 'text' AND parent_tag = 'title'")
    return found.select("page_id", F.trim("text").alias("title"))


def host_counts(pages: DataFrame, at: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Pages per host and tumbling window; rows later than ``late`` are dropped by the watermark."""
    rows = pages.withWatermark(at, late).withColumn("domain", urls.domain(F.col("url")))
    return rows.groupBy(F.window(at, window), "domain").count()


def fresh_urls(pages: DataFrame, at: str, late: str = "1 day") -> DataFrame:
    """Each canonical url once within the watermark."""
    rows = pages.withColumn("canonical", urls.canonical(F.col("url")))
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark(["canonical"])


def event_windows(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Counts and sums per tumbling window and type; batch or stream (with a watermark before)."""
    rows = events.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    rows = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select(F.col("session_window.start").alias("session_start"), "user_id", "n")
