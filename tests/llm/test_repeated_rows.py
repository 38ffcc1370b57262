"""Rows that repeat an id with other texts, and inputs whose partitions the planner changes."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from webkiln.llm import decontaminate, exact_dedup, license_scan, line_dedup, minhash_dedup, substring_dedup

_rng = random.Random(8)


def prose(n):
    return " ".join("".join(_rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def twice(spark):
    passage, near = prose(40), prose(80)
    rows = [(1, prose(5) + " " + passage + " " + prose(30)), (1, prose(3)), (1, passage), (2, passage + " x"), (2, near), (3, near + " end"), (2, passage + " x")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache(), rows


def test_substring_dedup(twice):
    docs, rows = twice
    got = substring_dedup.substring_dedup(docs).collect()
    assert len(got) == len(rows)
    by_text = {(r.doc_id, r.n_words): r for r in got}
    # of the two texts of document 1 that hold the passage one loses it, as does document 2, whose two equal rows are one document
    assert sorted((by_text[1, 75].n_removed, by_text[1, 40].n_removed)) == [0, 40]
    assert by_text[2, 41].kept_text == "x" and sum(r.n_removed == 40 and r.doc_id == 2 for r in got) == 2
    assert by_text[1, 3].n_removed == 0


def test_near_duplicates(twice):
    docs, rows = twice
    got = minhash_dedup.minhash_dedup(docs, shingle=2).collect()
    assert len(got) == len(rows)
    # document 1 holds the passage, document 2 a near copy of it and of document 3's text
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1)}
    assert all(r.kept == (r.doc_id == 1) for r in got)


def test_decontaminate(twice, spark):
    docs, rows = twice
    item = spark.createDataFrame([(9, rows[2][1]), (9, prose(9))], "item_id long, text string")
    got = decontaminate.overlaps(docs, item).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage) for r in got) == [(1, 9, 1.0), (2, 9, 1.0)]
    assert [r.doc_id for r in decontaminate.decontaminate(docs, item).collect()] == [3]


def test_licenses_and_lines(twice, spark):
    docs = spark.createDataFrame([(1, "mit license"), (1, "a b cc by"), (2, "x")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.labels) for r in license_scan.scan_licenses(docs).collect()}
    assert got == {1: (4, "cc-by,mit"), 2: (1, "")}
    assert line_dedup.line_dedup(twice[0]).count() == len(twice[1])


def test_exact_dedup_of_coalesced_input(spark):
    """The planner reads a shuffled input in fewer tasks for narrow columns than for wide ones."""
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("k"), F.repeat(F.lit("w"), 200).alias("wide"))
    text = F.concat(F.lit("text "), F.col("k").cast("string"))
    docs = rows.repartition(19, "id").groupBy("id", "k").agg(F.max("wide").alias("wide")).select(F.col("id").alias("doc_id"), text.alias("text"), "wide")
    for fan_in in (2, 16):
        out = exact_dedup.exact_dedup(docs, fan_in=fan_in)
        assert out.count() == 3000
        assert sorted((r.doc_id, r.group_size) for r in out.filter("kept").collect()) == [(0, 1000), (1, 1000), (2, 1000)]


def test_recall_against_all_pairs(spark):
    """Every link between an id that 20 divides and any other row must be found; families of copies with edits."""
    texts, n = [], 0
    for family in range(12):
        base = prose(60 + 7 * family).split()
        for k in range(25):
            words = list(base)
            for at in _rng.sample(range(len(words)), k % 6):
                words[at] = f"edit{n}"
            texts.append((n := n + 1, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    label = {r.doc_id: r.component_id for r in minhash_dedup.minhash_dedup(docs, shingle=2).collect()}
    sets = {d: set(zip(t.split(), t.split()[1:])) for d, t in texts}
    links = [(a, b) for a in sets if a % 20 == 0 for b in sets if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    found = np.mean([label[a] == label[b] for a, b in links])
    assert len(links) > 100 and found == 1.0
    assert label == {d: c for d, (_, c, _) in brute.near_components(texts, 2, 80).items()}
