"""Exact dedup: a tree merge of sorted digest runs.

Every input partition turns its texts into one sorted run of digests.  Runs then
meet in rounds up a tree (binomial for ``fan_in`` 2; a larger fan-in makes the same
tree flatter): in round r the runs whose numbers agree after dropping r digits (base
``fan_in``) are exchanged by digest, sorted and merged, each digest keeping the
smallest identifier seen and the number of rows.  A round is a sort aggregation of
Spark, which is a multiway merge of sorted shuffle files, so a copy group of any size
reaches a task as at most ``fan_in`` partial rows and no task ever holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webkiln.llm.staging import join_hot, stage

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest_runs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, digest and the checks that verify a digest match."""
    text = normalised(F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), F.spark_partition_id().alias("run")).select(
        "id",
        "run",
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
        F.xxhash64("text").alias("check"),
        F.octet_length("text").alias("bytes"),
    )


def merge_round(runs: DataFrame, fan_in: int) -> DataFrame:
    """Merge each group of ``fan_in`` runs into one.

    Digest, byte length and an independent hash must all agree before two entries
    count as one text; the smallest identifier survives.
    """
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .groupBy("digest", "check", "bytes", "run")
        .agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 2) -> DataFrame:
    """Return one row per input row: id, keep_id, group_size, kept, digest.

    Null and empty texts are equal to each other.  A null id sorts before all ids,
    as Spark orders it.  Rows that repeat an id are rows of their own: they share
    keep_id, and each counts in group_size; where they are the smallest of their group
    all of them are kept.  A text of any length is digested whole, inside the JVM.
    Other columns of ``docs`` are not read, whatever their names.  An empty table gives
    no rows.
    """
    rows = stage(digest_runs(docs, id_col, text_col), "digests")
    n_runs = (rows.agg(F.max("run")).first()[0] or 0) + 1  # as written, whatever plan dealt them
    key = ["digest", "check", "bytes"]
    runs = rows.select(*key, "run", F.struct(F.col("id")).alias("keep"), F.lit(1).cast("long").alias("n"))
    runs = runs.groupBy(*key, "run").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    while n_runs > 1:
        runs = merge_round(runs, fan_in)
        n_runs = -(-n_runs // fan_in)
    groups = runs.filter("n > 1").select(*key, F.col("keep.id").alias("keep_id"), "n", F.lit(True).alias("met"))
    joined = join_hot(rows.drop("run"), stage(groups, "digest-groups"), key, "n", ["id"], "left")
    keep_id = F.when(F.col("met"), F.col("keep_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
