import re

from gleanframe.llm.decontamination import Templates, contaminated
from tests.llm.helpers import docs

FOLDER = "/root/testdata/sf0.01"


def bench(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, words string")


def pairs(df):
    return sorted((r.doc_id, r.item_id) for r in df.collect())


def test_tables_against_brute_force(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    cut = lambda t: re.findall(r"[^\W_]+", t.lower())
    windows = {}
    for item in benchmark.collect():
        w = cut(item.text)
        for i in range(len(w) - 7):
            windows.setdefault(tuple(w[i : i + 8]), set()).add(item.item_id)
    want = set()
    for d in documents.collect():
        w = cut(d.text)
        for i in range(len(w) - 7):
            want |= {(d.doc_id, item) for item in windows.get(tuple(w[i : i + 8]), ())}
    assert set(pairs(contaminated(documents, benchmark))) == want and want


ITEM = "If a train travels 60 km in 2 hours and then another 60 km in 3 hours how fast is Alice going"


def test_parameters_may_differ_but_consistently(spark):
    b = bench(spark, ITEM)
    told = "So: if a train travels 75 miles in 4 hours and then another 75 miles in 9 hours how fast is Robert going, he asked"
    twisted = told.replace("another 75", "another 80")
    rows = [(1, ITEM.upper()), (2, told), (3, twisted), (4, "nothing of the kind is asked in this text at all here")]
    got = {r.doc_id: r for r in contaminated(docs(spark, rows), b).collect()}
    assert 2 in got and got[2].n_slots > 0 and 1 in got and 4 not in got
    assert 3 not in got or got[3].n_slots == 0


def test_numbers_alone_do_not_match(spark):
    assert pairs(contaminated(docs(spark, [(1, "1 2 3 4 5 6 7 8 9 10 11 12")]), bench(spark, "9 8 7 6 5 4 3 2 1 0 1 2"))) == []


def test_short_items_nulls_repeats_long_texts_and_empty_tables(spark):
    b = bench(spark, "one short question for you", "too short", None, "")
    rows = [(1, "here is one short question for you today"), (1, "here is one short question for you today"), (2, None), (3, ""), (None, "one short question for you"), (4, "so " * 100_000 + "one short question for you")]
    got = contaminated(docs(spark, rows), b).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.item_id, r.n_windows) for r in got) == [(-1, 0, 1), (1, 0, 1), (4, 0, 1)]
    assert contaminated(docs(spark, []), b).count() == 0
    assert contaminated(docs(spark, rows), b.where("false")).count() == 0


def test_broadcast_blocks_change_nothing(spark):
    b = bench(spark, *(f"alpha{i} beta gamma delta{i} epsilon zeta eta theta{i} iota" for i in range(5)))
    rows = [(i, f"see alpha{i} beta gamma delta{i} epsilon zeta eta theta{i} iota") for i in range(5)]
    small = Templates(rows_per_broadcast=2)
    assert pairs(contaminated(docs(spark, rows), b, small)) == pairs(contaminated(docs(spark, rows), b)) == [(i, i) for i in range(5)]


def test_verbatim_items_of_numbers_and_names_match(spark):
    sums = "12 + 7 = 19; 15 + 8 = 23; 4 x 6 = 24"
    names = "Anna, Berta, Clara, Dora, Emma, Frieda, Greta, Hanna, Ida"
    rows = [(1, f"see: {sums} and so on"), (2, "12 + 7 = 19; 15 + 9 = 24; 4 x 6 = 24"), (3, f"they are {names} here"), (4, names.replace("Dora", "Dina").replace("Greta", "Gerda"))]
    assert pairs(contaminated(docs(spark, rows), bench(spark, sums, names))) == [(1, 0), (3, 1)]


def test_layouts_of_function_words_do_not_match(spark):
    whole = "in der Stadt und der Kirche von Bonn"
    b = bench(spark, whole, f"Wir fragen heute, wer {whole} damals wohnte, und wie viele Menschen dort nach dem Krieg noch lebten.")
    rows = [(1, "Er war in der Schule und der Lehre von Kant bekannt"), (2, "Sie blieb in der Firma und der Leitung von Siemens"), (3, f"Das Haus steht {whole} noch heute")]
    assert pairs(contaminated(docs(spark, rows), b)) == [(3, 0), (3, 1)]


def test_numbers_with_separators_and_glued_units_are_parameters(spark):
    b = bench(spark, "How many hours are there in 3 full days", "a bag holds 5kg of rice and costs 3.5 euros at most", "it takes 800 steps from 3 gates to 12 towers")
    rows = [(1, "How many hours are there in 1,000 full days"), (2, "a bag holds 7kg of rice and costs 1,200.75 euros at most"), (3, "it takes 1,200 steps from 3.5 gates to 4 towers"), (4, "a bag holds 7 kg of rice and costs 12 euros at most")]
    assert pairs(contaminated(docs(spark, rows), b)) == [(1, 0), (2, 1), (3, 2), (4, 1)]


def test_names_at_the_start_of_sentences_are_parameters(spark):
    b = bench(spark, "Tom has 5 apples. Sam has 3 apples.")
    rows = [(1, "Ann has 7 apples. Bob has 2 apples."), (2, "We know that Ann has 7 apples. Bob has 2 apples."), (3, "Ann has 7 apples. Bob has 2 pears.")]
    assert pairs(contaminated(docs(spark, rows), b)) == [(1, 0), (2, 0)]
