import json
from decimal import Decimal

from gleanframe.operators.records import (
    build_listings,
    complete_purchases,
    extract_products,
    extract_purchases,
    numbered_attachments,
    with_own_references,
)
from gleanframe.plans.spec import ProductSpec, PurchaseSpec
from tests.helpers import pages, utc

NOTICES = PurchaseSpec(name="tenders.example")
SHOP = ProductSpec(name="optics.example", customer_name="Optics")
NOTICE = "https://tenders.example/epz/order/notice/ea44/view/common.html"
CARD = "https://optics.example/products/tube-5/"


def listing(spark, spec, html, url, hint=None, external_id="ref-1"):
    refs = spark.createDataFrame([(url, external_id, hint)], "url string, external_id string, title_hint string")
    return build_listings(pages(spark, (url, html)), refs, spec).first()


def test_purchase_from_a_table(spark):
    html = """<html><body><h1>Закупка труб</h1><table>
      <tr><th>Номер закупки</th><td>№ 5544</td></tr><tr><th>Заказчик</th><td>АО Вектор</td></tr>
      <tr><th>Статус закупки</th><td>Приём заявок</td></tr><tr><th>НМЦК</th><td>2 500,75 руб.</td></tr>
      <tr><th>Размещено</th><td>05.03.2027 07:45</td></tr>
      <tr><th>Окончание подачи заявок</th><td>12.03.2027 09:00</td></tr></table>
      <a href="../files/plan.pdf">План</a><a href="/get?id=1">Скачать документ</a><a href="/about">О портале</a>
      <span data-href="//cdn.example/x.ZIP">архив</span><a href="../files/plan.pdf#p2">План ещё раз</a>
      <a href="javascript:open()">Файл</a></body></html>"""
    row = listing(spark, NOTICES, html, NOTICE)
    assert (row.source, row.kind, row.external_id, row.number) == ("tenders.example", "purchase", "5544", "5544")
    assert (row.title, row.customer_name, row.status) == ("Закупка труб", "АО Вектор", "Приём заявок")
    assert (row.price, row.currency) == (Decimal("2500.75"), "RUB")
    assert (row.published_at, row.deadline_at) == (utc(2027, 3, 5, 7, 45), utc(2027, 3, 12, 9))
    assert [(a.url, a.filename, a.content_type) for a in row.attachments] == [
        ("https://tenders.example/epz/order/notice/ea44/files/plan.pdf", "plan.pdf", "application/pdf"),
        ("https://tenders.example/get?id=1", "get", None),
        ("https://cdn.example/x.ZIP", "x.ZIP", "application/zip"),
        ("https://tenders.example/epz/order/notice/ea44/files/plan.pdf#p2", "plan.pdf", "application/pdf"),
    ]
    assert json.loads(row.raw_payload) == {
        "source": "tenders.example", "number": "5544", "title": "Закупка труб", "customer": "АО Вектор",
        "status": "Приём заявок",
    }


def test_purchase_fallbacks(spark):
    bare = listing(spark, NOTICES, "<p>пусто 01.02.2027 10:00</p>", NOTICE, external_id="№ 77")
    assert (bare.number, bare.title, bare.price, bare.currency) == ("77", "Закупка 77", None, None)
    assert bare.published_at == utc(2027, 2, 1, 10) and bare.deadline_at is None
    assert json.loads(bare.raw_payload)["customer"] is None
    hinted = listing(spark, NOTICES, "<p>оплата в рублях</p>", NOTICE, hint="Подсказка")
    assert (hinted.title, hinted.currency) == ("Подсказка", "RUB")
    # A labelled date that cannot be read hides the date in the text.
    unread = listing(spark, NOTICES, "<div>Размещено: скоро</div><p>с 01.02.2027</p>", NOTICE)
    assert unread.published_at is None
    described = listing(
        spark, NOTICES, '<meta name=description content=" a  b "><div class="notice-number">№ 9</div>'
        '<div class="x-description">c</div>', NOTICE,
    )
    assert (described.description, described.number) == ("a b", "9")


def test_product_from_labels_and_selectors(spark):
    html = """<html><head><meta property="og:image" content="/up/a.jpg"></head><body><h1>Труба 5</h1>
      <div><span>Артикул</span><span>77-5</span></div><div class="price">7 890 ₽</div>
      <div>Наличие</div><div>В наличии</div><div class="product-detail"><p><img data-src="b.png" src="c.png">
      <img src="https://other.example/d.png"></p></div><img src="/e.png">
      <a href="/up/manual.pdf">Инструкция (PDF)</a><a href="/x">Фотографии</a><a href="/y">ещё</a></body></html>"""
    row = listing(spark, SHOP, html, CARD)
    assert (row.kind, row.external_id, row.number, row.title) == ("product", "77-5", "77-5", "Труба 5")
    assert (row.price, row.currency, row.status) == (Decimal("7890"), "RUB", "in_stock")
    assert (row.customer_name, row.deadline_at, row.published_at) == ("Optics", None, None)
    assert [a.url for a in row.attachments] == [
        "https://optics.example/up/a.jpg", CARD + "b.png", "https://optics.example/up/manual.pdf",
        "https://optics.example/x",
    ]
    assert json.loads(row.raw_payload) == {"source": "optics.example", "json_ld": {}, "discovered_id": "ref-1"}


def product(spark, item, rest=""):
    html = f'<script type="application/ld+json">{json.dumps(item)}</script>{rest}'
    return listing(spark, SHOP, html, CARD)


def test_product_from_json_ld(spark):
    row = product(
        spark,
        {"@type": "Product", "name": " Труба  6", "sku": 66, "description": "d", "datePublished": "2027-03-05",
         "offers": {"price": 12.5, "priceCurrency": "EUR", "availability": "https://schema.org/InStock"}},
        "<h1>другое</h1><div>Цена: 1</div>",
    )
    assert (row.title, row.external_id, row.description) == ("Труба 6", "66", "d")
    assert (row.price, row.currency, row.status) == (Decimal("12.5"), "EUR", "https://schema.org/InStock")
    assert row.published_at == utc(2027, 3, 5)
    assert json.loads(row.raw_payload)["json_ld"]["sku"] == 66


def test_product_offer_rules(spark):
    # A list of offers is ignored, and so is an empty object: labels are read instead.
    for offers in ([{"price": 1}], {}):
        row = product(spark, {"@type": "Product", "offers": offers}, "<div>Цена: 2</div><div>Статус: под заказ</div>")
        assert (row.price, row.status) == (Decimal(2), "on_order")
    # A zero price falls through to the next source of a price; the last one keeps its zero.
    row = product(spark, {"@type": "Product", "offers": {"price": 0}}, "<div>Цена: 3</div>")
    assert row.price == 3
    row = product(spark, {"@type": "Product", "offers": {"price": 0}}, '<b itemprop="price">0</b>')
    assert (row.price, row.currency) == (0, "RUB")
    # With an offer there is no label for the availability; JSON null counts as absent.
    row = product(spark, {"@type": "Product", "sku": None, "offers": {"price": 4}}, "<div>Наличие: скоро</div>")
    assert (row.status, row.external_id) == (None, "ref-1")


def test_availability_order(spark):
    texts = {"Нет в наличии": "out_of_stock", "есть В НАЛИЧИИ": "in_stock", "под заказ": "on_order", "Статус: ждём": "ждём"}
    got = extract_products(pages(spark, *[(t, f"<p>{t}</p>") for t in texts]), SHOP).select("url", "status").collect()
    assert {r.url: r.status for r in got} == texts


def test_empty_and_missing_pages(spark):
    rows = extract_purchases(pages(spark, ("a", None), ("b", "")), NOTICES).collect()
    assert [(r.page_number, r.page_title, r.price, r.attachments) for r in rows] == [(None, None, None, [])] * 2


def test_numbered_attachments_are_those_of_the_records(spark):
    """Only the number's labels are looked for; a label of another field beside it changes nothing."""
    link = '<a href="/f/plan.pdf">План</a><span data-href="/get?id=1">Скачать файл</span>'
    bodies = [
        "<table><tr><th>Номер закупки</th><td>№ 5544</td></tr><tr><th>Статус закупки</th><td>x</td></tr></table>" + link,
        "<dl><dt>Номер закупки:</dt><dd></dd><dt>Заказчик:</dt><dd>АО</dd></dl>" + link,
        "<div><span>Номер закупки</span><b>Статус</b><span>7</span></div>",
        "<p>Номер закупки: 8 Статус: новый</p>" + link,
        '<div class="notice-number">№ 9</div><p>Номер закупки: 10</p>',
        "<p>НМЦК 5</p><a href='a.zip'>1</a><a href='a.zip'>2</a>",
        "",
        None,
    ]
    urls = [f"https://tenders.example/n/{i}" for i in range(len(bodies))]
    read = pages(spark, *zip(urls, bodies), (urls[0], bodies[0]), (None, bodies[0]))
    whole = complete_purchases(with_own_references(extract_purchases(read, NOTICES)), NOTICES)
    columns = ["source", "external_id", "attachments", "page_no", "pos"]
    got = numbered_attachments(read, NOTICES)
    assert got.columns == columns
    assert sorted(map(str, got.collect())) == sorted(map(str, whole.select(columns).collect()))
