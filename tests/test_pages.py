"""Node arrays and the labelled-value rules, each phase on its own."""

import json

from pyspark.sql import functions as F

from gleanframe.functions import dom
from gleanframe.functions.dom import Page, by_attr, by_class, by_tag
from gleanframe.sources.markup import INLINE_TEXT_MAX, page_nodes
from tests.helpers import pages


def nodes_of(spark, html):
    row = pages(spark, ("u", html)).select(page_nodes(F.col("html")).alias("d")).first()
    return row.d.texts, row.d.nodes


def opened(spark, *htmls):
    parsed = pages(spark, *[(f"{i:03d}", h) for i, h in enumerate(htmls)]).select(
        "url", page_nodes(F.col("html")).alias("d")
    )
    split = parsed.select("url", F.col("d.texts").alias("texts"), F.col("d.nodes").alias("nodes"))
    return split, Page(F.col("texts"), F.col("nodes"))


def read(spark, rule, *htmls):
    split, page = opened(spark, *htmls)
    return [r.y for r in split.select("url", rule(page).alias("y")).orderBy("url").collect()]


def labelled(spark, labels, *htmls):
    return read(spark, lambda p: p.labeled_value(p.label_hits(labels), labels), *htmls)


def test_tree_rules(spark):
    texts, nodes = nodes_of(
        spark, "<p class='a  b' id=1 id=2>x &amp; <b>y</b><br>z<p>w</i></p><script>if (a<b) {}</script><!-- c -->"
    )
    assert texts == ["x &", "y", "z", "w"]
    outer, inner = [n for n in nodes if n.tag == "p"]
    assert outer.attrs == {"class": "a b", "id": "2"}
    # An unclosed paragraph holds the next one; a stray end tag changes nothing.
    assert inner.parent == outer.i and (inner.t0, inner.t1) == (3, 4)
    assert outer.text == "x & y z w" and not outer.leaf and inner.leaf
    line = next(n for n in nodes if n.tag == "br")
    assert line.last == line.i and line.leaf
    hidden = [n.text for n in nodes if n.kind == "x"]
    assert hidden == ["if (a<b) {}", "c"]
    assert nodes[0].kind == "d" and nodes[0].last == len(nodes) - 1


def test_equal_siblings_point_at_the_first(spark):
    _, nodes = nodes_of(spark, "<div><b x=1 y=2>a</b><i>q</i><b y=2 x=1>a</b><b>a</b></div>")
    bold = [n for n in nodes if n.tag == "b"]
    assert [n.eq for n in bold] == [bold[0].i, bold[0].i, bold[2].i]


def test_deep_nesting_stays_linear(spark):
    html = "<p>" + "<p>".join(f"строка {i} " + "я" * 40 for i in range(800))
    texts, nodes = nodes_of(spark, html)
    assert len(texts) == 800
    assert sum(len(n.text or "") for n in nodes) <= INLINE_TEXT_MAX * len(nodes)
    whole = read(spark, lambda p: p.page_text(), html)[0]
    assert whole == " ".join(texts)


def test_stray_and_void_end_tags(spark):
    texts, nodes = nodes_of(spark, "<div>a<br></br><img/>b</br></span><i>c</div>d</i>")
    assert [n.tag for n in nodes if n.kind == "e"] == ["div", "br", "img", "i"]
    assert texts == ["a", "b", "c", "d"]
    assert next(n for n in nodes if n.kind == "s" and n.t0 == 3).parent == 0
    many = "<br>" * 3000 + "<p>x" * 3000 + "</b>" * 3000
    assert len(nodes_of(spark, many)[1]) == 1 + 3000 + 6000


def test_text_of_hidden_and_missing(spark):
    rule = lambda p: F.array(
        p.page_text(), p.first_text(p.marks((by_tag("style"),)), (by_tag("style"),)),
        p.first_text(p.marks((by_tag("h1"),)), (by_tag("h1"),)),
    )
    assert read(spark, rule, "<style>a  b</style>t<template>x</template>", None) == [["t", "a b", ""], ["", "", ""]]


def test_selectors_go_by_priority_then_order(spark):
    selectors = (by_class("first"), by_attr("class", part="sec"), by_tag("h1"))
    rule = lambda p: p.first_text(p.marks(selectors), selectors)
    assert read(
        spark, rule,
        "<h1>c</h1><b class='x second'>b</b><i class='x first y'>a</i>",
        "<h1>c</h1><b class=firsts>n</b><b class=seconds>b</b>",
        # The first matching node counts even if it is empty.
        "<h1>c</h1><b class=first></b><b class=first>later</b>",
    ) == ["a", "b", ""]


def test_label_in_table_rows(spark):
    assert labelled(
        spark, ["Цена"],
        "<table><tr><td>Имя</td><td>n</td></tr><tr><th> цена : </th><td> 5 <b>руб</b></td></tr></table>",
        # An empty cell does not count, a label in the last cell has no value.
        "<table><tr><td>Цена</td><td></td></tr><tr><td>x</td><td>Цена</td></tr><tr><td>Цена</td><td>7</td></tr></table>",
        # Outer rows come before the rows nested in their cells.
        "<table><tr><td><table><tr><td>Цена</td><td>in</td></tr></table></td><td>Цена</td><td>out</td></tr></table>",
    ) == ["5 руб", "7", "out"]


def test_label_in_definition_lists(spark):
    assert labelled(
        spark, ["Цена"],
        "<dl><dt>Имя</dt><dd>n</dd><dt>Цена:</dt><i>note</i><dd>5</dd></dl>",
        "<dl><dt>Цена</dt><dd></dd></dl><div><span>Цена</span><span>9</span></div>",
    ) == ["5", "9"]


def test_label_next_to_elements(spark):
    assert labelled(
        spark, ["Цена", "Стоимость"],
        "<div><span>Цена</span><b> </b><span>5</span></div>",
        "<div>Цена: 6</div>",
        # No word boundary after a label.
        "<div>Ценарий</div>",
        # Another label of the same field is no value; the text after it is.
        "<p><span>Цена</span><span>Стоимость</span><span>7</span></p>",
        "<div><p><span>Цена</span></p> 8</div>",
        # The rest of the parent's text, when every sibling is a label.
        "<p><span>Цена</span><i>Цена</i><i>Стоимость</i></p>",
        # Document order beats label order.
        "<div>Стоимость: 1</div><div>Цена: 2</div>",
        # A label with siblings around it that equal each other: the first one's place counts.
        "<div><span>Цена</span><i>9</i><span>Цена</span><i>10</i></div>",
        "<div>Цены нет</div>",
    ) == ["5", "6", "рий", "7", "8", "Цена Стоимость", "1", "9", None]


def test_label_in_bare_strings_and_comments(spark):
    assert labelled(
        spark, ["Цена"],
        "<section>Цена<b>5</b></section>",
        "<section><b>x</b>Цена - 6</section>",
        "<!-- Цена: 7 -->",
        "<section><!-- Цена --><b>8</b></section>",
        "<section><b>Цена</b> 9</section>",
    ) == ["5", "6", "7", "8", None]


def test_labels_of_several_fields_at_once(spark):
    groups = [["Цена"], ["Статус", "Состояние"], ["Срок"]]
    rule = lambda p: p.labeled_values(p.label_hits(x for g in groups for x in g), groups)
    assert read(spark, rule, "<div>Состояние: да</div><table><tr><td>Цена</td><td>5</td></tr></table>") == [
        ["5", "да", None]
    ]


def test_scope_limits_labels_to_a_subtree(spark):
    html = "<div id=a><p>Цена: 1</p></div><div id=b><p>Цена: 2</p></div>"
    split, page = opened(spark, html)
    entry = F.get(page.marks((by_attr("id", value="b"),)), F.lit(0))
    value = page.labeled_value(page.label_hits(["Цена"]), ["Цена"], entry)
    assert split.select(value.alias("y")).first().y == "2"


def test_json_ld(spark):
    def script(value):
        return f'<script type="Application/LD+json">{value}</script>'

    product = json.dumps({"@type": "Product", "name": "p"})
    rule = lambda p: F.try_variant_get(
        dom.json_ld_of_type(dom.json_ld_objects(p.nodes), "Product"), "$.name", "string"
    )
    assert read(
        spark, rule,
        script("{bad") + script(product),
        script(json.dumps([1, "x", {"@type": ["Thing", "Product"], "name": "list"}])),
        script(json.dumps({"@graph": [7, {"@type": ["Product"], "name": "no"}, {"@type": "Product", "name": "graph"}]})),
        script('{"@type": "Product", "name": "a", "name": "last"}'),
        script(json.dumps({"@type": "Offer"})),
        "<script>" + product + "</script>",
    ) == ["p", "list", "graph", "last", None, None]


def test_page_is_parsed_once(spark):
    from gleanframe.operators.records import extract_products, extract_purchases
    from gleanframe.plans.spec import ProductSpec, PurchaseSpec

    given = pages(spark, ("u", "<h1>x</h1>"))
    for df in (
        extract_purchases(given, PurchaseSpec(name="n")), extract_products(given, ProductSpec(name="s"))
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1


def test_plain_pages_are_read_without_the_parser_to_the_same_nodes():
    import random

    from gleanframe.sources.markup import _PageReader

    class ByParser(_PageReader):
        def _read_plain(self, page):
            return False

    bits = [
        "<p>", "</p>", "<div class='a  b'>", "</div>", "<br>", "</br>", "<br/>", '<img src="x" alt=\'y z\'/>', "text ", "a &amp; b", "&lt",
        "  \n", '<b x="1" X=\'2\' y>', "</b>", '<script type="application/ld+json">', '{"a": 1}', "</script>", "<SPAN >", "</span>", "<i/>",
        "<!-- c -->", "<a href='?a=1&b'>", "</a>", "<", "<title>", "</title>", "&", "<p id=1>", "</ p>", "<style>", "</style>", "<o:p>",
        "<!DOCTYPE html>",
    ]
    draw = random.Random(3)
    plain = 0
    for i in range(4000):
        page = "".join(draw.choice(bits if i % 3 == 0 else bits[:20]) for _ in range(draw.randint(0, 14)))
        fast, slow = _PageReader(), ByParser()
        fast.read(page)
        slow.read(page)
        assert fast.to_arrow().equals(slow.to_arrow()), page
        plain += _PageReader()._read_plain(page)
    assert plain > 1000  # most pages of such pieces need no parser
