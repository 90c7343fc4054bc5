import numpy as np

from gleanframe.llm import toxicity
from gleanframe.llm.batches import bucket_of
from tests.llm.helpers import docs

FOLDER = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    table, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    held = bucket_of("doc_id", 1, 3)
    model = toxicity.learn(table, labels, ~held)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score(table, model, held).collect() if r.held_out and r.doc_id in truth]
    caught = sum(r.predicted and truth[r.doc_id] for r in rows)
    assert caught / sum(truth[r.doc_id] for r in rows) > 0.8
    assert sum(r.predicted and not truth[r.doc_id] for r in rows) <= 0.01 * len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_label_model_knows_copies_of_a_voter():
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.3
    votes = [np.where(rng.random(3000) < a, truth, ~truth) for a in (0.9, 0.85, 0.6)]
    given = np.where(rng.random(3000) < 0.9, truth, ~truth).astype(int)
    p = toxicity.WeakSupervision()
    plain = toxicity.label_model(np.array(votes).T, given, p)
    copied = toxicity.label_model(np.array([*votes, votes[2], votes[2], votes[2]]).T, given, p)
    for posterior in (plain, copied):
        assert ((posterior > 0.5) == truth).mean() > 0.93


def test_nulls_one_class_and_empty_tables(spark):
    rows = [(1, "you idiot"), (2, None), (3, ""), (3, ""), (4, "good day"), (None, "idiot idiot")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(4, 1, 0), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")):
        held = bucket_of("doc_id", 1, 3)
        model = toxicity.learn(docs(spark, rows), labels, ~held)
        got = {r.doc_id: r for r in toxicity.score(docs(spark, rows), model, held).collect()}
        assert got[1].predicted == 1 and got[4].predicted == 0 and got[2].score == got[3].score == got[4].score
        assert toxicity.score(docs(spark, []), model, held).count() == 0
