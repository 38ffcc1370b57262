"""Line dedup over levelled sorted runs of line hashes, native DataFrame code only.

Documents arrive in batches of descending identifier.  A batch's line keys are
merge-anti-joined with the runs of all earlier batches: keys that no run holds
name their keeper (the largest document, since larger ones came first), keys that
some run holds only add their document count.  The batch's rows become a new run
of level 0; when a level has ``fan_in`` runs they are compacted into one sorted
run of the next level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webkiln.llm.staging import input_bytes, join_hot, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, other letters unchanged; pure ASCII takes the fast path."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_table(docs: DataFrame, min_chars: int, batch: Column) -> DataFrame:
    """(batch, id, same, pos, h1, h2) of every line whose key has min_chars code points."""
    lines = docs.select("id", "same", batch.alias("batch"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    lines = lines.select("batch", "id", "same", "pos", F.btrim("line", F.lit(" \t\n\x0b\x0c\r")).alias("line"))
    lines = lines.filter(F.char_length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return lines.select("batch", "id", "same", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), key).alias("h2"))


def batch_run(lines: DataFrame) -> DataFrame:
    """A batch's own run: per key its document count and largest document."""
    return lines.groupBy(*KEY).agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper"))


def merge_anti_join(new: DataFrame, runs: DataFrame | None) -> DataFrame:
    """Keys that the runs lack keep their keeper; for the others only the count is new."""
    if runs is None:
        return new
    fresh = new.join(runs, KEY, "left_anti")
    seen = new.join(runs.select(*KEY), KEY, "left_semi").withColumn("keeper", F.lit(None).cast("long"))
    return fresh.unionByName(seen)


def compact(runs: list[DataFrame]) -> DataFrame:
    """Several runs as one run sorted by key: counts add up, one keeper remains."""
    merged = runs[0]
    for run in runs[1:]:
        merged = merged.unionByName(run)
    merged = merged.groupBy(*KEY).agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))
    return stage(merged.sortWithinPartitions(*KEY), "line-run")


def build_runs(lines: DataFrame, n_batches: int, fan_in: int) -> DataFrame:
    levels: list[list[DataFrame]] = [[]]
    for b in range(n_batches):
        held = [run for level in levels for run in level]
        known = None
        for run in held:
            known = run.select(*KEY) if known is None else known.unionByName(run.select(*KEY))
        levels[0].append(compact([merge_anti_join(batch_run(lines.filter(F.col("batch") == b)), known)]))
        at = 0
        while len(levels[at]) >= fan_in:
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1].append(compact(levels[at]))
            levels[at] = []
            at += 1
    held = [run for level in levels for run in level]
    return held[0] if len(held) == 1 else compact(held)


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    n_batches: int | None = None,
    fan_in: int = 2,
    batch_bytes: int = 1 << 40,
    carry: list[str] | None = None,
) -> DataFrame:
    """Return one row per input row: id, n_lines, n_dropped and kept_text.

    ``carry`` names columns to bring along; they come in the struct ``carried``.

    A line's key is the line without ASCII white space at both ends and with A-Z
    lower-cased.  Keys of ``min_chars`` code points or more that ``min_docs``
    documents hold lose all their lines except in the largest id.  A null or empty
    text is one empty line.  Rows that repeat an id are one document for the counts
    and each keeps its row (``same``, a hash of the text, tells their lines apart).
    Rows with a null id keep their text unchanged and count for nothing.  A text of any
    length is split whole; a document that repeats a line loses or keeps all of them.
    Columns of ``docs`` that are not carried are not read, whatever their names.  An
    empty table gives no rows.  There are ``n_batches`` batches, by default one for every
    ``batch_bytes`` of text and three at least.  Two keys count as one if two independent
    64-bit hashes agree.
    """
    if n_batches is None:
        n_batches = max(3, -(-input_bytes(docs, text_col) // batch_bytes))
    extra = (F.struct(*carry) if carry else F.lit(None)).alias("carried")
    docs = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("same"), extra
    )
    known = docs.filter("id IS NOT NULL")
    shares = [i / n_batches for i in range(1, n_batches)]
    cuts = known.select("id").approxQuantile("id", shares, 0.01) if shares else []
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("id") <= F.lit(int(cut))).cast("int")
    lines = stage(line_table(known, min_chars, batch), "lines", ["batch"])
    runs = build_runs(lines, n_batches, fan_in)
    repeated = stage(runs.filter(F.col("n") >= min_docs).select(*KEY, "keeper", "n"), "repeated")
    dropped = (
        join_hot(lines, repeated, KEY, "n", ["id", "pos"])
        .filter("id <> keeper")
        .groupBy("id", "same")
        .agg(F.collect_set("pos").alias("drop"))
    )
    rows = docs.join(dropped, ["id", "same"], "left").select(
        "id", lines_of(F.col("text")).alias("lines"), "drop", "carried"
    )
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    rows = rows.withColumn("stay", F.when(F.col("drop").isNotNull(), F.array_except(every, F.col("drop"))))
    text = F.when(F.col("stay").isNull(), F.array_join("lines", "\n")).otherwise(
        F.array_join(F.transform("stay", lambda i: F.element_at("lines", i + 1)), "\n")
    )
    n_lines = F.size("lines").cast("long")
    return rows.select(
        F.col("id").alias(id_col),
        n_lines.alias("n_lines"),
        F.coalesce(n_lines - F.size("stay"), F.lit(0)).cast("long").alias("n_dropped"),
        text.alias("kept_text"),
        *(["carried"] if carry else []),
    )
