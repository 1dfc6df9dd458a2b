import os

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quillstone.llm.queries import ORACLES, QUERIES
from tests.llm.test_similar import components_by_pairs
from tests.oracle import assert_same, tables


@pytest.mark.parametrize("name", ORACLES)
def test_query_matches_sql(name, spark, sf_dir):
    assert_same(QUERIES[name](spark, sf_dir), tables(sf_dir), ORACLES[name])


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and 0.8 * docs.count() < clean.count() < docs.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    last = {}
    for doc_id in sorted(texts):
        last[texts[doc_id]] = doc_id
    distinct = stages["exact_dedup"](spark, clean, sf_dir)
    assert {r["doc_id"] for r in distinct.collect()} == set(last.values())
    label = components_by_pairs({i: texts[i] for i in last.values()})  # pairs at 0.8 or more of five-word shingles
    single = stages["near_dedup"](spark, distinct, sf_dir)
    kept = {r["doc_id"] for r in single.collect()}
    assert kept == set(label.values()) and single.columns == docs.columns
    mixed = stages["mixing"](spark, single, sf_dir)
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} <= kept


def test_whole_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 100 and found.where(F.size("ids") != F.col("n_tokens")).count() == 0


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls, empty texts and repeated rows pass; an empty table gives an empty result."""
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "a text", "en", "s", 6), (2, "a text", "en", "s", 6), (3, "you idiot, you moron, you scum", "en", "s", 9)]
    for k, some in enumerate((rows, [])):
        folder = str(tmp_path / str(k))
        os.makedirs(folder)
        spark.createDataFrame(some, kind).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(2, 1, 0)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        ids = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
        assert ids <= {1, None, 2, 3}  # one label is too little to learn a lexicon from
