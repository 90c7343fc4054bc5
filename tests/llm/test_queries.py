"""Corpus queries beside their SQL, and the pipeline stage by stage."""

import os

import pytest

import __spark_entry__ as registry
import corpus_pipeline
from checks.compare import spark_rows, sql_rows
from gleanframe.llm import pii, queries
from gleanframe.llm.decontamination import contaminated
from gleanframe.session import durable
from tests.llm.helpers import docs
from tests.llm.test_odd_sketch import brute

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    df = registry.queries()[name](spark, FOLDER)
    columns, expected = sql_rows(FOLDER, registry.oracle_sql()[name])
    assert sorted(df.columns) == columns and spark_rows(df) == expected and expected


def test_one_query_for_each_operator():
    names = set(queries.registered())
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 14)), "pipeline"}
    assert names <= set(registry.queries())


def test_pipeline_stage_by_stage(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = durable(corpus_pipeline.language(spark, rows, FOLDER))
    assert kept.columns == rows.columns and kept.count() >= 0.98 * rows.count()
    single = durable(corpus_pipeline.near_duplicate(spark, kept, FOLDER))
    want = brute([(r.doc_id, r.text) for r in kept.collect()], percent=80)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, _, stays) in want.items() if stays}
    clean = durable(corpus_pipeline.decontamination(spark, single, FOLDER))
    leaks = {r.doc_id for r in contaminated(single, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaks
    masked = durable(corpus_pipeline.personal_data(spark, clean, FOLDER))
    assert masked.columns == rows.columns and masked.count() == clean.count()
    assert not any(pii.base_spans(r.text) for r in masked.collect())
    packed = corpus_pipeline.packing(spark, masked, FOLDER).collect()
    assert sum(r.n_words for r in packed) == sum(len(r.text.split()) for r in masked.collect())
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(str, whole)) == sorted(map(str, packed))


def test_pipeline_keeps_other_columns_and_odd_rows(spark):
    same = "these are words that are said again and again in here"
    rows = docs(spark, [(1, same), (1, same), (2, same), (None, "a text without an id"), (3, None), (4, "")], "lang_found", "cosine", "kept_id", "nth", "leak_id", "leak_hash")
    stage = rows
    for _, function in corpus_pipeline.STAGES[:-1]:
        stage = durable(function(spark, stage, FOLDER))
        assert stage.columns == rows.columns
    assert sorted((r.doc_id or -1) for r in stage.collect()) == [-1, 1]
    empty = rows.where("false")
    for _, function in corpus_pipeline.STAGES:
        empty = durable(function(spark, empty, FOLDER))
    assert empty.count() == 0


def test_near_duplicate_stage_keeps_unique_texts_of_repeated_ids(spark):
    a = "one two three four five six seven eight nine ten eleven twelve"
    u = "an entirely different text with words of its own and nothing shared"
    rows = docs(spark, [(1, a), (5, a), (5, u), (5, u), (7, None), (7, None)], "kept_id", "kept_hash")
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.near_duplicate(spark, rows, FOLDER).collect())
    assert got == [(1, a), (5, u), (7, None)]
