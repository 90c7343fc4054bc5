"""Stages of the corpus pipeline on planted rows."""

import os
import random

import pytest

import corpus_pipeline
from tests.llm.helpers import DOCS, docs
from tests.llm.test_odd_sketch import sets_of


def similarity(a, b):
    x, y = sets_of(a), sets_of(b)
    return len(x & y) / len(x | y)


def test_near_copies_between_80_and_85_percent_go(spark):
    rng = random.Random(2)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(204)]
    changed = lambda *places: " ".join(f"e{i}" if i in places else w for i, w in enumerate(base))
    # Each changed word takes five of 200 shingles.
    rows = [(1, " ".join(base)), (2, changed(30, 90, 150, 170)), (3, changed(30, 90, 110, 150, 170, 190))]
    rows += [(9, " ".join(f"x{rng.randint(0, 10**6)}" for _ in range(60)))]
    assert 0.80 <= similarity(rows[0][1], rows[1][1]) < 0.85 and similarity(rows[0][1], rows[2][1]) < 0.80
    assert similarity(rows[1][1], rows[2][1]) >= 0.85
    kept = corpus_pipeline.near_duplicate(spark, docs(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 9]
    kept = corpus_pipeline.near_duplicate(spark, docs(spark, [rows[0], rows[2]]), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_texts_in_no_learned_language_go_and_all_others_stay(spark):
    rng = random.Random(4)
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scripts = ("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыьэюя")
    strange = [
        " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(length))
        for letters in scripts for length in (40, 400) for _ in range(20)
    ]
    rows = [(-1 - i, text, None, "s", len(text)) for i, text in enumerate(strange)]
    kept = corpus_pipeline.language(spark, table.union(spark.createDataFrame(rows, DOCS)), "")
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    lettered = {r.doc_id for r in table.collect() if any(c.isalpha() for c in r.text or "")}
    assert lettered - ids == set() and sorted(i for i in ids if i < 0) == []
