import numpy as np
from pyspark.sql import functions as F

from gleanframe.llm.batches import bucket_of
from gleanframe.llm.language import Binder, Profiles, identify, learn, ngram_counts
from tests.llm.helpers import docs

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = bucket_of("doc_id", 2, 4)
    found = identify(table.select("doc_id", "text", "lang", held.alias("held")), learn(table, ~held), ["lang", "held"]).where("held").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def test_bundle_is_the_sum_of_bound_ngrams():
    p = Profiles(dimensions=64)
    binder = Binder(p)
    keys, counts = ngram_counts("Abba!  ab", 3)
    total = sum(c * binder._bound(np.array([k]))[0].astype(float) for k, c in zip(keys, counts))
    assert np.allclose(binder.bundles(["Abba!  ab"])[0], total / np.linalg.norm(total), atol=1e-6)


def test_texts_without_letters_nulls_and_empty_tables(spark):
    rows = [(1, "hello there friend", "en"), (2, "bonjour mon ami", "fr"), (3, None, "en"), (4, "123 !!", "fr"), (5, "", None), (5, "", None), (6, "there hello", None)]
    prototypes = learn(docs(spark, rows), bucket_of("doc_id", 9, 8) | True)
    assert list(prototypes) == ["en", "fr"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs(spark, rows), prototypes, ["doc_id"]).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[1][0] == got[6][0] == "en" and got[2][0] == "fr"
    nothing = learn(docs(spark, []), bucket_of("doc_id", 0, 2))
    assert nothing == {} and identify(docs(spark, rows), nothing, ["doc_id"]).where("lang_pred != 'und'").count() == 0


def _plain_codes(text):
    """Lower-cased letters; every run of other characters, and both ends, one 0."""
    out = [0]
    for ch in text.lower():
        code = ord(ch) if ch.isalpha() else 0
        if code or out[-1]:
            out.append(code)
    if out[-1]:
        out.append(0)
    return out


def _plain_unit(text, p):
    """All trigrams one by one, bound from letter vectors rotated by place, added up."""
    vector = {}

    def of(code):
        if code not in vector:
            vector[code] = np.random.default_rng((p.seed, code)).integers(0, 2, p.dimensions, dtype=np.int8) * 2 - 1
        return vector[code].astype(np.float64)

    codes = _plain_codes(text or "")
    total = np.zeros(p.dimensions)
    if len(codes) >= 3:
        for i in range(len(codes) - 2):
            a, b, c = codes[i : i + 3]
            total += of(c) * np.roll(of(b), 1) * np.roll(of(a), 2)
    size = np.linalg.norm(total)
    return total / size if size else total


def test_predictions_against_a_plain_loop(spark):
    p = Profiles(dimensions=256)
    rows = [
        (1, "the cat sat on the mat and looked at the birds", "en"), (2, "where are the children going this evening", "en"),
        (3, "der hund schläft unter dem tisch in der küche", "de"), (4, "die kinder spielen heute im garten hinter dem haus", "de"),
        (5, "el perro duerme debajo de la mesa en la cocina", "es"), (6, "los niños juegan hoy en el jardín de la casa", "es"),
        (7, "the birds sing in the garden", None), (8, "im garten singen die vögel", None), (9, "en el jardín cantan los pájaros", None),
        (10, "x", None), (11, None, None), (12, "A-B", None),
    ]
    training = F.col("doc_id") <= 6
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs(spark, rows), learn(docs(spark, rows), training, p), ["doc_id"], p).collect()}
    sums = {}
    for _, text, lang in rows[:6]:
        sums[lang] = sums.get(lang, 0) + np.rint(_plain_unit(text, p) * p.scale)
    names = sorted(sums)
    protos = np.array([sums[n] / np.linalg.norm(sums[n]) for n in names])
    for doc_id, text, _ in rows:
        unit = _plain_unit(text, p)
        if not unit.any():
            assert got[doc_id] == ("und", 0.0)
            continue
        cosines = protos @ unit
        assert got[doc_id][0] == names[int(np.argmax(cosines))]
        assert abs(got[doc_id][1] - min(1.0, max(0.0, float(cosines.max())))) < 1e-4
