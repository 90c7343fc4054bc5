"""Charset of page bytes by mark, header and meta, and their text."""

from pyspark.sql import functions as F

from gleanframe.functions.charset import TABLES, page_charset, page_text

TEXT = "<p>Закупка № 7: цена 1 200,50 руб. — Ёлка, ёж</p>"


def decoded(spark, rows):
    df = spark.createDataFrame(rows, "i int, content binary, headers map<string,string>")
    out = df.select("i", page_charset(F.col("content"), F.col("headers")).alias("c"), page_text(F.col("content"), F.col("headers")).alias("t"))
    return {r.i: (r.c, r.t) for r in out.collect()}


def test_three_ways_and_two_charsets(spark):
    meta = '<html><head><meta charset="Windows-1251"></head>'
    equiv = "<html><head><META http-equiv='Content-Type' content='text/html; charset=cp1251'></head>"
    rows = [
        (0, TEXT.encode("utf-8"), {"Content-Type": "text/html; charset=UTF-8"}),
        (1, b"\xef\xbb\xbf" + TEXT.encode("utf-8"), {"content-type": "text/html"}),
        (2, ('<meta charset="utf-8">' + TEXT).encode("utf-8"), {}),
        (3, TEXT.encode("cp1251"), {"CONTENT-TYPE": "text/html;charset=\"windows-1251\""}),
        (4, (meta + TEXT).encode("cp1251"), None),
        (5, (equiv + TEXT).encode("cp1251"), {"Content-Type": "text/html"}),
        (6, TEXT.encode("utf-8"), None),
        (7, b"\xff\xfe" + TEXT.encode("utf-16-le"), {"Content-Type": "text/html; charset=windows-1251"}),
        (8, TEXT.replace("№", "N").replace("—", "-").encode("koi8-r"), {"Content-Type": "text/html; charset=KOI8-R"}),
        (9, TEXT.encode("utf-8"), {"Content-Type": "text/html; charset=gb-unknown"}),
        (10, None, None),
        (11, b"", {}),
    ]
    got = decoded(spark, rows)
    want = {0: "utf-8", 1: "utf-8", 2: "utf-8", 3: "windows-1251", 4: "windows-1251", 5: "windows-1251", 6: "utf-8", 7: "utf-16le", 8: "koi8-r", 9: "utf-8", 11: "utf-8"}
    assert {i: c for i, (c, _) in got.items() if i != 10} == want
    assert got[2][1] == '<meta charset="utf-8">' + TEXT and got[4][1] == meta + TEXT and got[5][1] == equiv + TEXT
    assert all(got[i][1] == TEXT for i in (0, 1, 3, 6, 7, 9)) and got[8][1] == TEXT.replace("№", "N").replace("—", "-")
    assert got[10][1] is None and got[11][1] == ""


def test_every_byte_of_single_byte_charsets(spark):
    raw = bytes(range(256))
    rows = [(i, raw, {"Content-Type": f"text/html; charset={name}"}) for i, name in enumerate(TABLES)]
    got = decoded(spark, rows)
    for i, name in enumerate(TABLES):
        assert got[i][0] == name and len(got[i][1]) == 256 and got[i][1][:128] == raw[:128].decode("ascii")
    assert got[0][1][128:].startswith("ЂЃ")


def test_rendered_pages_use_all_six_ways(spark):
    from checks import render

    pages = render.notice_pages(render.orders(spark, "/root/testdata/sf0.001"))
    fetched = render.page_bytes(pages).select("content", F.col("headers")["Content-Type"].alias("h")).collect()
    kinds = set()
    for r in fetched:
        raw = bytes(r.content)
        try:
            raw.decode("utf-8")
            utf8 = True
        except UnicodeDecodeError:
            utf8 = False
        kinds.add((utf8, raw.startswith(b"\xef\xbb\xbf"), "charset" in r.h, b"<meta charset" in raw[:300] or b"http-equiv" in raw[:300]))
    assert kinds == {(True, False, True, False), (True, True, False, False), (True, False, False, True), (False, False, True, False), (False, False, False, True)}


def test_malformed_utf8_is_replaced(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "content binary")
    assert df.select(page_text(F.col("content")).alias("t")).first().t == "a�b"
