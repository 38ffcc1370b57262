"""The corpus pipeline: five stages from raw documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webkiln.llm import decontaminate, line_dedup, minhash_dedup, packing, quality
from webkiln.llm.queries import byte_bpe, pieces
from webkiln.llm.staging import KEY, drop_rows, keyed, stage, table
from webkiln.sources.shared import discard, written


def others(docs: DataFrame, *own: str) -> list[str]:
    return [c for c in docs.columns if c not in own]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (predicted 0).

    Null and empty texts have the score of a text without features.  Repeated rows and
    rows with null ids are judged each by itself, texts of any length whole.  All columns
    pass unchanged, also those that are named like the classifier's own.
    """
    rest = others(docs, "doc_id", "text")
    rows = docs.select("doc_id", "text", F.struct(*rest).alias("rest")) if rest else docs
    kept = quality.score_quality(rows, table(spark, sf_dir, "labels")).filter("predicted = 1")
    return kept.select("doc_id", "text", *[F.col("rest").getField(c).alias(c) for c in rest]).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents repeat; texts and n_chars are those of the kept lines.

    Every row stays.  A null text becomes an empty one; rows with null ids keep their
    text; rows that repeat an id are one document for the counts.  A repeated line stays
    in the largest id that holds it.  Other columns pass unchanged.
    """
    rest = others(docs, "doc_id", "text", "n_chars")
    kept = line_dedup.line_dedup(docs, carry=rest)
    text = F.col("kept_text")
    return kept.select(
        "doc_id",
        text.alias("text"),
        F.char_length(text).cast("long").alias("n_chars"),
        *[F.col("carried").getField(c).alias(c) for c in rest],
    ).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest id, of each group of near duplicates.

    Documents without words stay.  Rows with null ids are documents of their own, smaller
    than all others; rows that repeat an id share its fate.  All columns pass unchanged.
    """
    rows = keyed(docs, "doc_id")[0].withColumnRenamed(KEY, "__row")
    gone = minhash_dedup.minhash_dedup(rows, id_col="__row", shingle=5, percent=80).filter("NOT kept")
    return drop_rows(rows, gone, "__row").select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage.

    Null and empty texts stay.  Rows with null ids are documents of their own; rows that
    repeat an id go if one of its texts holds a passage.  All columns pass unchanged.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2048 tokens; one row per piece.

    Null and empty texts are the end id alone, repeated rows documents of their own.
    """
    return pieces(packing.pack_documents(docs, byte_bpe(), end_id=1, size=2048))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The classifier, MinHash and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage wrote goes once the next one's result is written."""
    docs = table(spark, sf_dir, "documents")
    before = len(written(spark))
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        discard(spark, written(spark)[before:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
