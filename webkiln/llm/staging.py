"""Intermediate tables, keys of rows, and joins that no hot key or small side can spoil."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webkiln.sources.shared import materialise as stage

__all__ = ["stage"]

#: Rows that a small side may have to be broadcast; the longs of so many ids are 8 MB.
MOST_BROADCAST = 1_000_000


def heavy_keys(counts: DataFrame, keys: list[str], count: str = "count", least: int = 512, most: int = 10_000) -> DataFrame:
    """(keys, salts) of the keys that hold more than a ``most``-th part of all rows, and ``least`` rows.

    There are at most ``most`` such keys, so the table can be broadcast; ``salts`` is how
    many parts a key's rows are dealt to.
    """
    total = counts.agg(F.sum(count)).first()[0] or 0
    part = max(least, total // most)
    parts = F.ceil(F.col(count) / part).cast("int").alias("salts")
    return counts.filter(F.col(count) > part).select(*keys, parts)


def salted(rows: DataFrame, heavy: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """``rows`` with a ``salt``: rows of a heavy key are dealt to its parts by the hash of ``by``."""
    rows = rows.join(F.broadcast(heavy), keys, "left")
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*by), F.col("salts")))
    return rows.withColumn("salt", salt.cast("int")).drop("salts")


def for_each_salt(rows: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` once for every salt that ``salted`` gives their key."""
    rows = rows.join(F.broadcast(heavy), keys, "left")
    salts = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    return rows.withColumn("salt", F.explode(salts)).drop("salts")


def join_hot(many: DataFrame, one: DataFrame, keys: list[str], count: str, by: list[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, whose rows have a key each and in ``count`` the key's rows in ``many``.

    ``one`` is read three times, so it should be a staged table.
    """
    heavy = heavy_keys(one, keys, count)
    return salted(many, heavy, keys, by).join(for_each_salt(one, heavy, keys), [*keys, "salt"], how).drop("salt")


def drop_rows(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose ``key`` is in ``gone``; few keys travel to the rows, not the rows to them."""
    gone = stage(gone.select(key).distinct(), "gone")
    return rows.join(F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone, key, "left_anti")


#: Keys of rows without an id count up from here.
NO_ID = -(2**63)
#: The column that ``keyed`` adds.
KEY = "__key"


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``docs`` with a long KEY that is never null, and what turns a key into the id again.

    The key is the id; every row without one gets a key of its own below all ids.
    Those rows are written once, so that they keep their keys however often the
    result is read.
    """
    id_ = F.col(id_col).cast("long")
    nulls = docs.filter(id_.isNull())
    if nulls.isEmpty():
        return docs.withColumn(KEY, id_), lambda key: key
    at = F.col(KEY)
    nulls = stage(nulls.withColumn(KEY, F.monotonically_increasing_id()), "null-ids").withColumn("__part", F.shiftright(KEY, 33))
    first, n = [], 0
    for part, count in sorted(nulls.groupBy("__part").count().collect()):
        first.append((part, n))
        n += count
    lowest = docs.agg(F.min(id_)).first()[0]
    if lowest is not None and lowest < NO_ID + n:
        raise ValueError(f"ids below {NO_ID + n} are taken by the keys of rows without an id: {lowest}")
    first = docs.sparkSession.createDataFrame(first, "__part long, __first long")
    number = at.bitwiseAND((1 << 33) - 1) + F.col("__first")
    nulls = nulls.join(F.broadcast(first), "__part").withColumn(KEY, F.lit(NO_ID) + number)
    rows = docs.filter(id_.isNotNull()).withColumn(KEY, id_).unionByName(nulls.drop("__part", "__first"))
    return rows, lambda key: F.when(key >= NO_ID + n, key)


#: Catalyst answers with exabytes where it knows nothing of a table's size.
_UNKNOWN = 1 << 50


def input_bytes(df: DataFrame, text_col: str) -> int:
    """Catalyst's estimate of the bytes of a text column (for file scans from the files' sizes).

    Where Catalyst has none the texts' bytes are added up.
    """
    texts = df.select(text_col)
    known = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return known if known < _UNKNOWN else int(texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
