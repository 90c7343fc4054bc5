import hashlib
from urllib.parse import unquote, urljoin

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanframe.functions import urls
from tests.helpers import evaluate

BASE = "https://h.example/a/b/c?x=1"


def joined(spark, links, base=BASE):
    return evaluate(spark, lambda x: urls.absolute_url(F.lit(base), x), links)


def test_links_that_lead_nowhere(spark):
    skipped = [None, "", "  ", "#top", " #top", "javascript:void(0)", "mailto:a@b", "tel:1"]
    assert joined(spark, skipped) == [None] * len(skipped)


def test_joins_like_the_standard(spark):
    links = [
        "?page=2", "../../x", "../../../x", "/abs", "//o.example/p?q#f", "rel/./d/", "data:abc", "HTTP://X",
        "https://Z.example", "..", ".", "a//b", "/a/../b", "https:foo", "Mailto:x", "x;p?y", "/", "?", "ftp://f/x",
        "a/../../b/./c", " /trim \n", "/кат/ё?я=1", "g;x=1/../y",
    ]
    assert joined(spark, links) == [urljoin(BASE, link.strip()) for link in links]
    assert joined(spark, ["d", "?q", "../d"], "https://h.example") == [
        "https://h.example/d", "https://h.example?q", "https://h.example/d",
    ]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["a", "b.c", ".", "..", "/", "?", "q=1"]), min_size=1, max_size=6).map("".join), min_size=20, max_size=40))
def test_random_relative_links(spark, links):
    links = [x for x in links if not x.startswith("//")]
    assert joined(spark, links) == [urljoin(BASE, x) for x in links]


def test_file_names(spark):
    cases = {
        "https://h/docs/%D0%A2%D0%97%201.pdf?x=1": "ТЗ 1.pdf",
        "https://h/a/b/": "b",
        "https://h/": "fb",
        "https://h": "fb",
        "https://h/.": "fb",
        "https://h/a%2Fb.txt": "b.txt",
        "https://h/a+b%zz.txt": "a+b%zz.txt",
        "https://h/x.pdf;v=1": "x.pdf",
    }
    assert evaluate(spark, lambda x: urls.filename_from_url(x, "fb"), list(cases)) == list(cases.values())


def test_safe_names(spark):
    cases = {
        "../../etc/passwd": "passwd",
        "..\\..\\boot.ini": "boot.ini",
        "Смета № 1 (копия).xlsx": "Смета-1-копия-.xlsx",
        "%2E%2E%2Fx": "x",
        "...": "fb",
        "": "fb",
        "a" * 200: "a" * 160,
        "-.x.-": "x",
    }
    assert evaluate(spark, lambda x: urls.safe_filename(x, "fb"), list(cases)) == list(cases.values())
    assert evaluate(spark, urls.safe_component, ["shop.example", "", "b" * 120]) == ["shop_example", "item", "b" * 100]


def test_ids_and_types(spark):
    assert evaluate(spark, urls.id_from_url, ["https://h/a/b//?x", "https://h/", "https://h/a/c.html"]) == [
        "b", "https://h/", "c.html",
    ]
    types = {
        "a.PDF": "application/pdf", "a.docx": urls.PINNED_CONTENT_TYPES[".docx"], "a.rar": "application/vnd.rar",
        "x.tar.gz": "application/x-tar", "x.tgz": "application/x-tar", "x.gz": None, ".pdf": None, "none": None,
        "x.unknown": None, "x.jpeg": "image/jpeg", "a.b.txt": "text/plain",
    }
    assert evaluate(spark, urls.content_type_for, list(types)) == list(types.values())


def test_attachment_path(spark):
    url = "https://h.example/f/%D1%8F 1.pdf"
    got = evaluate(
        spark,
        lambda x: urls.attachment_path(F.lit("root"), F.lit("shop.example"), F.lit("a/7"), x, F.lit(None).cast("string")),
        [url],
    )
    token = hashlib.sha1(url.encode()).hexdigest()[:12]
    assert got == [f"root/shop_example/7/{token}-я-1.pdf"]


def test_percent_decoding_keeps_what_is_malformed(spark):
    texts = ["a%20b", "a+b", "%zz", "100%", "%D1%8F", "plain"]
    assert evaluate(spark, urls.percent_decode, texts) == [unquote(t) for t in texts]


def test_cursor_query(spark):
    since = F.lit("2027-03-05 22:30:00").cast("timestamp")
    cases = {
        "https://h/r.html": "https://h/r.html?publishDateFrom=05.03.2027&publishDateTo=",
        "https://h/r.html?a=1&publishDateFrom=x&b=#f": (
            "https://h/r.html?a=1&publishDateFrom=05.03.2027&b=&publishDateTo=#f"
        ),
        "https://h/r.html?a=1&a=2&publishDateTo=01.01.2030&s=x+y%2A~": (
            "https://h/r.html?a=2&publishDateTo=01.01.2030&s=x+y%2A~&publishDateFrom=05.03.2027"
        ),
    }
    assert evaluate(spark, lambda x: urls.cursor_query_url(x, since), list(cases)) == list(cases.values())
    none = F.lit(None).cast("timestamp")
    assert evaluate(spark, lambda x: urls.cursor_query_url(x, none), ["https://h/?a=1"]) == ["https://h/?a=1"]
