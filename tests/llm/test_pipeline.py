"""The pipeline's stages against the operators they call, and on nulls, repeated rows, clashing columns and empty tables."""

import os
import random

import pytest

import corpus_pipeline
from pricewell.llm import common, mixing, ngram_join, quality_rules

DIR = "/root/testdata/sf0.001"
there = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@there
def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    good = corpus_pipeline.quality(spark, docs, DIR).cache()
    assert good.columns == corpus_pipeline.COLUMNS
    assert ids(good) == ids(quality_rules.quality_rules(docs, labels).where("kept"))
    once = corpus_pipeline.near_copies(spark, good, DIR).cache()
    assert ids(once) == ids(ngram_join.similar_components(good).where("doc_id = component_id"))
    clean = corpus_pipeline.decontaminated(spark, once, DIR).cache()
    assert set(ids(clean)) <= set(ids(once)) and clean.columns == corpus_pipeline.COLUMNS
    taken = corpus_pipeline.mixed(spark, clean, DIR).cache()
    assert ids(taken) == ids(mixing.mix(clean, fraction=0.8, max_epochs=1)) and taken.columns == corpus_pipeline.COLUMNS
    assert ids(corpus_pipeline.sharded(spark, taken, DIR)) == ids(taken)


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with every case, labels and a benchmark item that one of them holds."""
    path = str(tmp_path_factory.mktemp("tables"))
    item = prose("item", 30)
    copy = prose("copy").split()
    copy[40] = "changed"
    rows = [(1, prose(1)), (2, prose("copy")), (3, prose("copy")), (4, " ".join(copy)), (5, None), (6, ""), (7, "too short"), (8, prose(8) + " " + item), (9, prose(9)), (9, prose(9)), (None, prose("null")), (None, prose("copy")), (10, prose(10, 6000))]
    spark.createDataFrame([(i, t, "en", "src1", len(t or ""), 0.5, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, draw double, row string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_nulls_repeated_rows_and_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)
    good = corpus_pipeline.quality(spark, docs, folder)
    assert ids(good) == [1, 10, 2, 3, 4, 8, 9, 9, None, None] and good.columns == corpus_pipeline.COLUMNS
    once = corpus_pipeline.near_copies(spark, docs, folder)
    assert ids(once) == [1, 10, 2, 5, 6, 7, 8, 9, 9, None, None]
    clean = corpus_pipeline.decontaminated(spark, docs, folder)
    assert ids(clean) == [1, 10, 2, 3, 4, 5, 6, 7, 9, 9, None, None]
    taken = corpus_pipeline.mixed(spark, docs, folder)
    assert taken.count() == mixing.mix(docs, fraction=0.8, max_epochs=1).count() and taken.columns == corpus_pipeline.COLUMNS
    assert ids(corpus_pipeline.sharded(spark, docs, folder)) == ids(docs)
    kept = len(common._kept)
    out = corpus_pipeline.run(spark, folder)
    assert set(ids(out)) <= {1, 10, 2, 9, None} and out.count() >= 3
    assert len(common._kept) - kept < 12  # the stages' results and what the last one keeps, not their intermediates


def test_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
