"""License scans by diagonal voting.

Every rolling word k-gram hash of every document is joined with the positions that
it has in the templates; the template table is a constant of this module, so its
broadcast has a fixed size.  A match at document word i and template word j votes
for the diagonal i - j.  Votes are counted by (document, template, diagonal);
diagonals that lie within ``max_shift`` words of each other (less than half of the
template's words), as an inserted or lost word makes them, are merged; a merged span
counts as found only if its votes cover enough distinct words of the template.  A
chain of diagonals that reaches over two lengths of the template is verified in
overlapping windows of one length, so no chain hides what stands in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from webkiln.llm import words
from webkiln.llm.staging import KEY, keyed

#: Phrases whose consecutive words name a license, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Characteristic sentences of public license notices, and their labels.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction",
    "apache": "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
    "with the license",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation",
    "lgpl": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser "
    "general public license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "all rights reserved",
}


def templates(short: int, long_: int) -> list[tuple[int, str, bool, int, int]]:
    """(template, label, base, words, k): phrases of few words take the short k-gram."""
    out = []
    for base, table in ((True, PHRASES), (False, {v: k for k, v in NOTICES.items()})):
        for text, label in table.items():
            n = len(text.split())
            out.append((len(out), label, base, n, short if n <= long_ else long_))
    return out


#: Stands in the hash column of the one row a document has for its number of words.
COUNT = 0


def template_grams(spark: SparkSession, short: int, long_: int) -> DataFrame:
    """(h, template, j): where each k-gram stands in the templates; k is part of the hash."""
    rows = [(COUNT, None, None)]
    for (t, _, _, _, k), text in zip(templates(short, long_), [*PHRASES, *NOTICES.values()], strict=True):
        grams = words.ngrams(words.hash_words(pa.array([text]), "alnum").hashes, k).view(np.int64)
        rows += [(int(h), t, j) for j, h in enumerate(grams.tolist())]
    return spark.createDataFrame(rows, "h long, template int, j int")


def _grams(sizes: tuple[int, ...]):
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "i", "h"]
        for batch in words.slices(batches, "text", 1 << 20):
            ids = batch.column("id").to_numpy()
            hashed = words.hash_words(batch.column("text"), "alnum")
            text = hashed.text_of
            at = (np.arange(len(text)) - hashed.first[text]).astype(np.int32)
            for k in sizes:
                h = words.ngrams(hashed.hashes, k).view(np.int64)
                inside = np.flatnonzero(text[: len(h)] == text[k - 1 :]) if len(h) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x[inside]) for x in (ids[text], at, h)], names)
            counts = np.diff(hashed.first).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(counts), pa.array(np.full(len(ids), COUNT))], names)

    return grams


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    short: int = 2,
    long_: int = 4,
    max_shift: int = 3,
    min_cover: float = 0.6,
    whole: int = 8,
) -> DataFrame:
    """Return one row per document: id, n_words, spans, base_labels, labels, score.

    Words are what remains of a text after A-Z are lower-cased and cut at ASCII
    characters that are no letters or digits.  ``spans`` lists what was found:
    label, base, first, last (words), cover.  Base spans are complete phrases, and so
    are those of templates of less than ``whole`` words, which a part would not tell from other prose; the
    other templates count from ``min_cover`` of their words on; spans of one label
    may overlap where shuffled parts of its notice follow each other.  ``score`` is the
    best cover, 0 without a span.  Null and empty texts have no words.  Rows that
    repeat an id (null among them) share a row: the largest word count, and spans
    once.  Texts without an id are scanned each by itself before they share theirs.
    An empty table gives no rows.
    """
    rows, id_of = keyed(docs, id_col)
    rows = rows.select(F.col(KEY).alias("id"), F.col(text_col).alias("text"))
    grams = rows.mapInArrow(_grams((short, long_)), "id long, i int, h long")
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession, short, long_)), "h")
    return spans_of(hits, short, long_, max_shift, min_cover, id_of, whole).withColumnRenamed("id", id_col)


def spans_of(
    hits: DataFrame, short: int, long_: int, max_shift: int, min_cover: float, id_of: Callable[[Column], Column] = lambda key: key, whole: int = 8
) -> DataFrame:
    """Count votes by diagonal, merge neighbours, verify spans, gather them by the id of their document."""
    spark = hits.sparkSession
    known = F.broadcast(spark.createDataFrame(templates(short, long_), "template int, label string, base boolean, n int, k int"))
    votes = hits.groupBy("id", "template", (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.collect_set("j").alias("js"), F.min("i").alias("low"), F.max("i").alias("high")
    )
    votes = votes.join(known, "template", "left")
    along = Window.partitionBy("id", "template").orderBy("diagonal")
    complete = F.col("base") | (F.col("n") < whole)
    shift = F.least(F.lit(max_shift), F.ceil(F.col("n") / 2) - 1)
    chain = Window.partitionBy("id", "template", "group")
    half = F.ceil(F.col("n") / 2)
    window = F.floor(F.col("diagonal") / half)
    too_long = F.max("high").over(chain) - F.min("low").over(chain) >= 2 * F.col("n")
    merged = (
        votes.withColumn("new", (complete | (F.col("diagonal") - F.lag("diagonal").over(along) > shift)).cast("int"))
        .withColumn("group", F.sum(F.coalesce("new", F.lit(0))).over(along))
        .withColumn("too_long", too_long)
        .withColumn("window", F.explode(F.when(F.col("too_long"), F.array(window - 1, window)).otherwise(F.array(F.lit(None).cast("long")))))
        .groupBy("id", "template", "group", "window", "label", "base", "n", "k")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("js"))).alias("js"),
            F.min("low").alias("first"),
            F.max("high").alias("high"),
        )
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j, j + F.col("k") - 1)))))
    least = F.when(complete, F.lit(1.0)).otherwise(F.lit(min_cover))
    cover = covered / F.col("n")
    span = F.struct(
        F.col("first").cast("long").alias("first"),
        (F.col("high") + F.col("k") - 1).cast("long").alias("last"),
        "label",
        "base",
        cover.alias("cover"),
    )
    good = cover >= least
    out = (
        merged.groupBy(id_of(F.col("id")).alias("id"))
        .agg(
            F.max(F.when(F.col("template").isNull(), F.col("high"))).cast("long").alias("n_words"),
            F.sort_array(F.array_distinct(F.collect_list(F.when(F.col("template").isNotNull() & good, span)))).alias("spans"),
        )
    )

    def joined(spans_: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans_, lambda s: s["label"]))), ",")

    return out.select(
        "id",
        "n_words",
        "spans",
        joined(F.filter("spans", lambda s: s["base"])).alias("base_labels"),
        joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
