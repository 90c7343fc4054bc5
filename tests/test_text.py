from decimal import Decimal

from pyspark.sql import functions as F

from gleanframe.functions import text as tx
from tests.helpers import evaluate, utc


def test_clean_text_collapses_unicode_whitespace(spark):
    given = ["  a \t b\n", None, "", "x  y", "\u001ca\u0085b　", "​a"]
    assert evaluate(spark, tx.clean_text, given) == ["a b", "", "", "x y", "a b", "​a"]


def test_parse_decimal(spark):
    cases = {
        "2 345 678,90 ₽": "2345678.90",
        "17.25 EUR": "17.25",
        "2.345,60": "2.345",
        "2,345.60": "2.345",
        "300 400 шт": "300400",
        "7\t8": None,
        "7 8": None,
        "78\n": "78",
        "-4,5": "-4.5",
        "10-20": "10",
        "٣٤,5": "34.5",
        "цена по запросу": None,
        "": None,
        "0": "0",
    }
    got = evaluate(spark, tx.parse_decimal, [*cases, None])
    assert got[-1] is None
    assert got[:-1] == [None if v is None else Decimal(v) for v in cases.values()]


def test_money_rounds_half_away_from_zero_and_rejects_overflow(spark):
    got = evaluate(
        spark, lambda x: tx.to_money(tx.parse_decimal(x)), ["12.345", "-12.345", "99999999999999999"]
    )
    assert got == [Decimal("12.35"), Decimal("-12.35"), None]


def test_parse_datetime(spark):
    cases = {
        "05.03.2027 07:45": utc(2027, 3, 5, 7, 45),
        "5.3.2027 7:5:9": utc(2027, 3, 5, 7, 5, 9),
        " 05.03.2027  07:45:10 ": utc(2027, 3, 5, 7, 45, 10),
        "05.03.2027": utc(2027, 3, 5),
        "2027-03-05": utc(2027, 3, 5),
        "2027-03-05T07": utc(2027, 3, 5, 7),
        "2027-03-05T07:45Z": utc(2027, 3, 5, 7, 45),
        "2027-03-05 07:45:10.123": utc(2027, 3, 5, 7, 45, 10, 123000),
        "2027-03-05T07:45:10.123456+03:00": utc(2027, 3, 5, 4, 45, 10, 123456),
        "2027-3-5 7:45": utc(2027, 3, 5, 7, 45),
        "31.02.2027": None,
        "05.03.27": None,
        "05.03.2027 07:45 MSK": None,
        "2027": None,
        "2027-03": None,
        "20270305": None,
        "07:45": None,
        "05.03.2027 25:00": None,
        "": None,
    }
    got = evaluate(spark, tx.parse_datetime, [*cases, None])
    assert got == [*cases.values(), None]


def test_parse_datetime_does_not_depend_on_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = evaluate(spark, lambda x: F.unix_seconds(tx.parse_datetime(x)), ["01.01.1970 00:01"])
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [60]


def test_labelled_date_hides_the_date_in_the_text(spark):
    df = spark.createDataFrame(
        [("скоро", "с 01.02.2027"), (None, "с 01.02.2027 10:00 по 03.02.2027"), ("", "1.2.2027")],
        "label string, text string",
    )
    got = df.select(tx.date_or_first_in_text(F.col("label"), F.col("text")).alias("y")).collect()
    assert [r.y for r in got] == [None, utc(2027, 2, 1, 10), None]


def test_flat_labeled_value(spark):
    text = "Извещение Заказчик: АО Вектор Статус: открыта НМЦК 12,5 руб. Артикул - 77;"

    def one(*labels):
        return evaluate(spark, lambda x: tx.flat_labeled_value(x, labels), [text])[0]

    assert one("Заказчик") == "АО Вектор"
    assert one("заказчик") == "АО Вектор"
    # Only a label followed by a mark ends a value.
    assert one("Нет такого", "Статус") == "открыта НМЦК 12,5 руб."
    assert one("НМЦК") == "12,5 руб."
    assert one("Артикул") == "77"
    assert one("Срок") is None


def test_flat_labeled_value_is_limited_and_tries_later_occurrences(spark):
    long = "Статус: " + "я" * 300 + " Статус: готово"
    assert evaluate(spark, lambda x: tx.flat_labeled_value(x, ["Статус"]), [long]) == ["готово"]


def test_flat_label_with_pattern_characters(spark):
    text = "Начальная (максимальная) цена контракта: 5 Размещено: вчера"
    labels = ["Начальная (максимальная) цена контракта"]
    assert evaluate(spark, lambda x: tx.flat_labeled_value(x, labels), [text]) == ["5"]


def test_small_scalars(spark):
    assert evaluate(spark, tx.strip_number_sign, ["№ № 12", " 5", "7 №"]) == ["12", "5", "7 №"]
    unique = evaluate(spark, tx.unique_strings, [["b", "", "a", "b", None]], "array<string>")
    assert unique == [["b", "a"]]
    zero = F.lit("0").cast(tx.PARSE_DECIMAL_TYPE)
    four = F.lit("4").cast(tx.PARSE_DECIMAL_TYPE)
    none = F.lit(None).cast(tx.PARSE_DECIMAL_TYPE)
    row = spark.range(1).select(
        tx.first_non_zero(zero, four, none).alias("a"),
        tx.first_non_zero(zero, none, zero).alias("b"),
        tx.first_non_empty(F.lit(""), F.lit(None), F.lit("x")).alias("c"),
    ).first()
    assert (row.a, row.b, row.c) == (4, 0, "x")


def _optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_value_tested_for_blank_is_planned_once(spark):
    given = spark.createDataFrame([(["a1", "", None],)], "xs array<string>")
    inner = lambda x: tx.blank_to_null(F.upper(tx.blank_to_null(F.regexp_extract(x, "mark[0-9]", 0))))
    df = given.select(F.transform("xs", inner).alias("ys"))
    assert df.first().ys == [None, None, None]
    assert _optimised(df).count("mark[0-9]") == 1


def test_flat_labeled_values_cleans_the_text_once_for_all_groups(spark):
    groups = [["Заказчик", "Организация"], ["Статус", "Состояние"], ["Срок"]]
    lines = ["Организация - Рога и  копыта; СТАТУС:  открыт Заказчик № ", "Заказчик: а Статус:б", "", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    found = df.select("i", tx.flat_labeled_values(F.col("x"), groups).alias("found"))
    each = df.select("i", F.array(*[tx.flat_labeled_value(F.col("x"), g) for g in groups]).alias("found"))
    rows = {r.i: r.found for r in found.collect()}
    assert rows == {r.i: r.found for r in each.collect()}
    assert rows[0][1] == "открыт" and rows[1] == ["а", "б", None] and rows[2] == rows[3] == [None] * 3
    assert _optimised(found).count("regexp_replace") == 1
