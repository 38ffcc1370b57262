"""Rows without an id are documents of their own."""

import random

import brute
import corpus_pipeline
import pytest

from webkiln.llm import decontaminate, license_scan, minhash_dedup, substring_dedup

_rng = random.Random(11)


def prose(n):
    return " ".join("".join(_rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


PASSAGE, CLEAN = prose(30), prose(60)
REPEATS = " ".join([prose(15), PASSAGE, prose(9), PASSAGE, prose(200)])
NEAR = [prose(119) + " end", ""]
NEAR[1] = NEAR[0].replace(" end", " stop")
TEXTS = [(None, CLEAN), (None, REPEATS), (None, prose(5)), (None, NEAR[0]), (None, NEAR[1]), (None, NEAR[0]), (7, prose(3) + " " + CLEAN), (-9, NEAR[0])]


@pytest.fixture(scope="module")
def some(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3).cache()


def test_substring_dedup(spark):
    texts = [TEXTS[i] for i in (0, 1, 2, 6)]
    rows = substring_dedup.substring_dedup(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    want = brute.repeated_windows([(i if i is not None else -100 + k, t) for k, (i, t) in enumerate(texts)], 20)
    assert sorted((r.doc_id is None, r.n_words, r.n_removed, r.kept_text) for r in rows) == sorted((i < 0, *w) for i, w in want.items())
    assert [f.ref_doc for r in rows if r.doc_id == 7 for f in r.factors] == [None]
    assert sorted(r.n_removed for r in rows) == [0, 0, 30, 60]


def test_near_duplicates(spark, some):
    rows = minhash_dedup.minhash_dedup(some).collect()
    assert len(rows) == len(TEXTS) and sum(r.kept for r in rows if r.n_shingles == 116) == 1
    assert all(r.component_id is None and r.doc_id is None for r in rows if r.n_shingles == 116 and r.kept)
    left = corpus_pipeline.near_duplicate_stage(spark, some, "")
    assert left.columns == some.columns
    got = [r.text for r in left.collect()]
    assert sum(t in NEAR for t in got) == 1 and {t for t in got if t not in NEAR} >= {CLEAN, REPEATS, TEXTS[2][1]}


def test_decontaminate(spark, some):
    bench = spark.createDataFrame([(None, PASSAGE), (None, "words that no text holds " + prose(20))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.coverage) for r in decontaminate.overlaps(some, bench).collect()] == [(None, None, 1.0)]
    left = decontaminate.decontaminate(some, bench)
    assert left.columns == some.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted((x for x in TEXTS if x[1] != REPEATS), key=str)


def test_licenses(spark):
    notice = license_scan.NOTICES["bsd"].split()
    halves = [(None, " ".join(notice[:9])), (None, "x " * 9 + " ".join(notice[9:])), (None, "mit license"), (None, "mit license")]
    row = license_scan.scan_licenses(spark.createDataFrame(halves, "doc_id long, text string")).collect()
    assert [(r.doc_id, r.labels, len(r.spans)) for r in row] == [(None, "mit", 1)]
