"""The pipeline's stages against brute force, each on its own input."""

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from webkiln.llm import quality


@pytest.fixture(scope="module")
def sf_dir(spark, docs, pairs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{folder}/documents.parquet")
    junk = [(d, 0 if d % 5 == 0 else 1, 0) for d, _ in pairs]
    spark.createDataFrame(junk, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    passage = " ".join(next(t for _, t in sorted(pairs) if t and 100 < len(t.split()) < 150).split()[10:60])
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages(spark, docs, sf_dir):
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "line_dedup", "near_duplicates", "benchmark_decontamination", "packing"]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]

    out = steps["quality_classifier"](spark, docs, sf_dir)
    scored = quality.score_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in scored.filter("predicted = 1").collect()}

    out = steps["line_dedup"](spark, docs, sf_dir)
    got = {r.doc_id: (r.text, r.n_chars, r.score) for r in out.collect()}
    assert out.columns == docs.columns
    assert got == {d: (t, len(t), "clash") for d, (_, _, t) in brute.repeated_lines(rows, 40, 5).items()}

    out = steps["near_duplicates"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {d for d, (_, _, kept) in brute.near_components(rows, 5, 80).items() if kept}

    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    out = steps["benchmark_decontamination"](spark, docs, sf_dir)
    assert out.columns == docs.columns
    leaks = {d for d, t in rows if brute.tiles((t or ""), bench, 5) >= 0.5}
    assert leaks and {r.doc_id for r in out.collect()} == {d for d, _ in rows} - leaks

    out = steps["packing"](spark, docs, sf_dir)
    totals = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("want")).collect()
    assert len(totals) == len(rows) and all(r.n == r.want for r in totals)


def test_run_and_registry(spark, sf_dir):
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert names["pipeline"](spark, sf_dir).count() > 0


@pytest.mark.parametrize("n", [0, 6])
def test_stages_on_awkward_tables(spark, odd_docs, sf_dir, n):
    docs = odd_docs.limit(n).select("*", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert out.count() <= n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).filter("start = 0").count() == n
