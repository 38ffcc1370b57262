"""URL filters by Bloom filter cascades.

A cascade answers "is this key listed?" exactly for every key of the universe it
was built over.  Level 0 encodes the listed keys.  The universe keys that pass it
wrongly go into level 1, the listed keys that pass level 1 wrongly into level 2,
and so on until a level has no false positive.  A key is listed if the first level
that refuses it has an odd number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webkiln.llm.bloom import Bloom, bloom_of, n_bits_for
from webkiln.llm.staging import stage

#: (action, host, path prefix)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def page_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every (host suffix, path prefix of a rule's length) of a page as host + path keys."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    prefixes = F.array(*[F.when(F.char_length(path) >= n, F.substr(path, F.lit(1), F.lit(n))) for n in lengths])
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))


def cascade_hits(levels: list[Bloom], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact membership: refused first at an odd level, or passing all of an odd number of levels."""
    verdict = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.arange(len(h1))
    for k, level in enumerate(levels):
        passed = level.hits(h1[open_], h2[open_])
        verdict[open_[~passed]] = k % 2 == 1
        open_ = open_[passed]
    return verdict


def _passing(keys: DataFrame, level: Bloom) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[shared.value.hits(*(frame[c].to_numpy().view(np.uint64) for c in ("h1", "h2")))]

    return keys.mapInPandas(keep, keys.schema)


def hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(11), "key").alias("h2"))


def build_cascade(universe: DataFrame, listed: DataFrame) -> list[Bloom]:
    """Levels over ``universe`` (key, h1, h2; distinct) that are exact for ``listed``.

    Level 0 gets the false-positive rate |listed| / |universe|, so that about as
    many keys as are listed pass it wrongly whatever the corpus holds; the later
    levels use 1/2.  Listed keys need not occur in the corpus.  The universe is only
    filtered by level 0; the keys that pass it are then told from the listed ones.
    """
    n_listed, n_universe = listed.count(), universe.count()
    if not n_listed:
        return []
    include, n_include, exclude = listed, n_listed, universe
    levels: list[Bloom] = []
    rate = min(0.5, n_listed / max(n_universe, 1))
    while True:
        levels.append(bloom_of(include, n_include, rate, len(levels)))
        wrong = _passing(exclude, levels[-1])
        if len(levels) == 1:
            wrong = wrong.join(listed.select("key"), "key", "left_anti")
        wrong = stage(wrong, "cascade")
        n_wrong = wrong.count()
        if not n_wrong:
            return levels
        include, n_include, exclude, rate = wrong, n_wrong, include, 0.5


def n_shards(n_listed: int, n_universe: int, most_bytes: int) -> int:
    """Parts that the keys are dealt to so that no filter is larger than ``most_bytes``."""
    rate = min(0.5, max(n_listed, 1) / max(n_universe, 1))
    return max(1, -(-n_bits_for(max(n_listed, 1), rate) // (8 * most_bytes)))


def rule_frame(spark: SparkSession, rules) -> DataFrame:
    """(action, key) of rules (action, host, path) that are given as a table or as tuples."""
    rows = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "action string, host string, path string")
    return rows.select("action", F.concat("host", F.lit("\n"), "path").alias("key"))


def _member(levels, shard: int, shards: int):
    """Which keys of an array (by their hashes) are listed in this shard; null for keys of other shards."""

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def listed_keys(h1: pd.Series, h2: pd.Series) -> pd.Series:
        sizes = h1.map(len).to_numpy()
        flat = [np.concatenate([np.asarray(x, np.int64) for x in h] or [np.zeros(0, np.int64)]).view(np.uint64) for h in (h1, h2)]
        found = np.zeros(len(flat[0]), bool)
        mine = np.flatnonzero(flat[1] % np.uint64(shards) == shard)
        found[mine] = cascade_hits(levels.value, flat[0][mine], flat[1][mine])
        return pd.Series([x.tolist() for x in np.split(found, np.cumsum(sizes)[:-1])] if len(sizes) else [])

    return listed_keys


def filter_urls(
    pages: DataFrame,
    rules: DataFrame | tuple = RULES,
    default: str = "allow",
    url_col: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    most_bytes: int = 64 << 20,
) -> DataFrame:
    """Judge every url: the ``keep`` columns, host, path, rule and verdict.

    A rule (action, host, path prefix; a tuple, or a table for long lists) fits its host
    and all subdomains if the url's path starts with the rule's; the longest fitting rule
    wins (ties: block before allow).  One cascade per action tells which of a page's keys
    are listed.  Lists whose first filter would be larger than ``most_bytes`` are split
    by the keys' hashes into shards, each with a cascade of its own, which the rows pass
    one after the other.  Urls that are null or lack ``://`` have empty host and path, no
    rule and the default verdict; so do all urls without a fitting rule.  Urls of any
    length are read whole.  Repeated rows each get their row; other columns of ``pages``,
    whatever their names, are not read; an empty table gives none.
    """
    spark = pages.sparkSession
    listed = rule_frame(spark, rules)
    lengths = sorted(r[0] for r in listed.select(F.char_length(F.substring_index("key", "\n", -1))).distinct().collect())
    judged = pages.select(*keep, F.col(url_col).alias("url")).select(
        *keep, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    keys = judged.select(F.explode(page_keys(F.col("host"), F.col("path"), lengths)).alias("key")).distinct()
    universe = stage(hashed(keys), "url-keys")
    n_universe = universe.count()
    judged = judged.withColumn("keys", page_keys(F.col("host"), F.col("path"), lengths))
    judged = judged.withColumn("k1", F.transform("keys", lambda k: F.xxhash64(k)))
    judged = judged.withColumn("k2", F.transform("keys", lambda k: F.xxhash64(F.lit(11), k)))
    for action in ("block", "allow"):
        mine = hashed(listed.filter(F.col("action") == action).select("key").distinct())
        shards = n_shards(mine.count(), n_universe, most_bytes)
        for shard in range(shards):
            part = F.expr(f"h2 % {shards}") + F.when(F.expr("h2 < 0"), F.lit((2**64) % shards)).otherwise(0)
            part = F.pmod(part, F.lit(shards)) == shard  # h2 as an unsigned number
            levels = spark.sparkContext.broadcast(build_cascade(universe.filter(part), mine.filter(part)))
            found = _member(levels, shard, shards)("k1", "k2")
            if shard:
                found = F.zip_with(action, found, lambda x, y: x | y)
            judged = judged.withColumn(action, found)
            if shards > 1:  # one shard's filters at a time
                judged = stage(judged, "judged")
                levels.unpersist()
    marked = F.transform(
        "keys",
        lambda k, i: F.struct(
            F.char_length(k).alias("size"),
            F.when(F.get("block", i), F.lit("block")).when(F.get("allow", i), F.lit("allow")).alias("action"),
            k.alias("key"),
        ),
    )
    judged = judged.withColumn("best", F.array_max(F.filter(marked, lambda m: m["action"].isNotNull())))
    return judged.select(
        *keep,
        "host",
        "path",
        F.replace(F.col("best.key"), F.lit("\n"), F.lit("")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
