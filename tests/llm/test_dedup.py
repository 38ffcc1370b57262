"""Exact, near, line and substring dedup against brute force."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from webkiln.llm import components, exact_dedup, line_dedup, minhash_dedup, substring_dedup, words


@pytest.mark.parametrize(("bucket_bytes", "most_postings"), [(8 << 20, 200_000), (2000, 8)])
def test_substring_dedup(docs, pairs, bucket_bytes, most_postings, monkeypatch):
    """With few postings allowed, anchors of the sample are hot and their windows meet in two levels."""
    monkeypatch.setattr(substring_dedup, "MOST_POSTINGS", most_postings)
    monkeypatch.setattr(substring_dedup, "HOT", 2)
    rows = substring_dedup.substring_dedup(docs, bucket_bytes=bucket_bytes).collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows}
    assert got == brute.repeated_windows(pairs, 20)
    assert sum(n for _, n, _ in got.values()) > 200
    by_id = dict(pairs)
    for r in rows:
        for f in r.factors:
            mine = brute.raw_words(by_id[r.doc_id])[f.start : f.start + f.length]
            assert mine == brute.raw_words(by_id[f.ref_doc])[f.ref_start : f.ref_start + f.length]
            assert (f.ref_doc, f.ref_start) < (r.doc_id, f.start)


def test_substring_dedup_batches_inside_a_text(spark):
    """A text's runs fill several Arrow batches; those behind the first hold no row with a text."""
    rng = random.Random(8)
    passages = [" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(24)]
    texts = [*passages, " x ".join(passages), " y ".join(reversed(passages)), " x ".join(passages), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most)
    spark.conf.set(most, "4")
    try:
        rows = substring_dedup.substring_dedup(docs).collect()
    finally:
        spark.conf.set(most, before)
    expect = brute.repeated_windows([(i, t or "") for i, t in enumerate(texts)], 20)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in rows} == expect


def test_substring_dedup_edges(odd_docs, empty_docs):
    rows = substring_dedup.substring_dedup(odd_docs).collect()
    assert len(rows) == 6 and all(r.n_removed == 0 for r in rows)
    assert sum(r.doc_id is None for r in rows) == 2
    assert substring_dedup.substring_dedup(empty_docs).count() == 0


@pytest.mark.parametrize(("shingle", "block"), [(2, 512), (2, 3), (5, 512)])
def test_minhash_dedup(docs, pairs, shingle, block):
    rows = minhash_dedup.minhash_dedup(docs, shingle=shingle, block=block).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}
    assert got == brute.near_components(pairs, shingle, 80)
    assert sum(not k for _, _, k in got.values()) > 10


def test_minhash_dedup_edges(odd_docs, empty_docs):
    rows = minhash_dedup.minhash_dedup(odd_docs, shingle=2).collect()
    assert len(rows) == 6
    assert all(r.component_id == r.doc_id and r.kept for r in rows)
    assert minhash_dedup.minhash_dedup(empty_docs).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 103), (103, 101), (7, 7), (101, 100)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("fan_in", [2, 16])
def test_exact_dedup(docs, pairs, fan_in):
    rows = exact_dedup.exact_dedup(docs, fan_in=fan_in).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows} == brute.exact_groups(pairs)


def test_exact_dedup_edges(odd_docs, empty_docs):
    rows = exact_dedup.exact_dedup(odd_docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in rows) == [
        ("2", "None", 3), ("2", "None", 3), ("4", "4", 2), ("4", "4", 2), ("None", "None", 1), ("None", "None", 3),
    ]
    assert exact_dedup.exact_dedup(empty_docs).count() == 0


@pytest.mark.parametrize("n_batches", [1, 4])
def test_line_dedup(docs, pairs, n_batches):
    rows = line_dedup.line_dedup(docs, n_batches=n_batches, carry=["lang", "kept_text"]).collect()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in rows}
    assert got == brute.repeated_lines(pairs, 40, 5)
    assert sum(n for _, n, _ in got.values()) == 8
    assert {r.carried.kept_text for r in rows} == {"clash"}


def test_line_dedup_edges(spark, odd_docs, empty_docs):
    rows = line_dedup.line_dedup(odd_docs, min_chars=3, min_docs=1).collect()
    assert len(rows) == 6 and all(r.n_dropped == 0 and r.n_lines == 1 for r in rows)
    assert line_dedup.line_dedup(empty_docs).count() == 0
    line = "a line of more than forty characters, truly so"
    same = spark.createDataFrame([(1, line + "\nx\n" + line), (1, "y\n" + line), (2, line)], "doc_id long, text string")
    got = sorted(tuple(r) for r in line_dedup.line_dedup(same, min_docs=2).collect())
    assert got == [(1, 2, 1, "y"), (1, 3, 2, "x"), (2, 1, 0, line)]


def test_word_hashes(texts):
    import pyarrow as pa

    for style, twin in (("raw", brute.raw_words), ("alnum", brute.alnum_words)):
        hashed = words.hash_words(pa.array(texts), style)
        flat = [w for t in texts for w in twin(t)]
        assert len(flat) == len(hashed.hashes)
        assert [len(twin(t)) for t in texts] == list(hashed.first[1:] - hashed.first[:-1])
        assert len(set(flat)) == len(set(hashed.hashes.tolist())) == len(set(zip(flat, hashed.hashes.tolist())))
        for k in (1, 2, 3, 5, 7, 20):
            grams = words.ngrams(hashed.hashes, k).tolist()
            want = [tuple(flat[i : i + k]) for i in range(len(flat) - k + 1)]
            assert len(grams) == len(want) and len(set(zip(grams, want))) == len(set(want)) == len(set(grams))


def test_ids_are_not_changed(docs):
    kept = exact_dedup.exact_dedup(docs).filter("kept").select("doc_id")
    assert kept.join(docs.select("doc_id"), "doc_id", "left_anti").isEmpty()
    assert kept.filter(F.col("doc_id").isNull()).isEmpty()


@pytest.mark.parametrize("texts", [1, 6])
def test_minhash_dedup_hot_families(spark, monkeypatch, texts):
    """Families of edited copies larger than a block: all links, and each posting handled about twice."""
    rng = random.Random(5)
    words_ = [f"w{i}" for i in range(400)]
    rows = []
    for t in range(texts):
        base = [rng.choice(words_) for _ in range(120)]
        for _ in range(600 // texts):
            edit = list(base)
            edit[rng.randrange(120)] = "edited"
            rows.append((len(rows), " ".join(edit)))
    handled = []
    whole = minhash_dedup._by_pair

    def counted(blocks, group):
        if group == "key":
            handled.append(blocks.count())
        return whole(blocks, group)

    monkeypatch.setattr(minhash_dedup, "_by_pair", counted)
    got = minhash_dedup.minhash_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block=32).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute.near_components(rows, 5, 80)
    assert sum(handled) <= 2 * handled[0]


def test_lists_of_rows_that_do_not_belong_together(spark):
    """One list of many unlike signatures in several blocks: only the like ones are joined, across blocks too."""
    rng = random.Random(9)
    unlike = [bytes(rng.randrange(256) for _ in range(minhash_dedup.N_MINIMA)) for _ in range(40)]
    rows = [(7, i, 100 + i % 3, bytearray(unlike[i % 40])) for i in range(120)] + [(8, 1000, 5, bytearray(unlike[0]))]
    postings = spark.createDataFrame(rows, "key long, id long, n long, minima binary")
    for block in (4, 512):
        found = components.components(minhash_dedup.candidates(postings, block, 80, 33)).collect()
        assert {r.node: r.component for r in found} == {i: i % 40 for i in range(120)}
