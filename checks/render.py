"""Pages rendered from the given tables, so that extraction has a known answer.

Layouts alternate with the key, so that every way of labelling a value is read: table
rows, definition lists, neighbouring elements, and running text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOTICES = "notices"
SHOP = "shop"
NOTICE_HOST = "https://n.example"
SHOP_HOST = "https://s.example"
NOTICE_LIST = f"{NOTICE_HOST}/epz/order/extendedsearch/results.html"
SHOP_LIST = f"{SHOP_HOST}/katalog/"
PER_PAGE = 50


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores if their table has fewer files than that.

    Rendering turns a small file into many pages, and reading those is the work. A table
    with enough files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def money_text(x: Column) -> Column:
    """Grouped by no-break spaces, with a comma, as the portal prints it."""
    return F.translate(F.format_number(x.cast("decimal(18,2)"), 2), ",.", "\u00a0,")


def key_minute(day: Column, key: Column) -> Column:
    """The day plus a minute that follows from the key."""
    return F.timestamp_micros(
        F.unix_micros(day.cast("timestamp")) + F.pmod(key, F.lit(1440)) * 60_000_000
    )


def day_first(at: Column) -> Column:
    return F.date_format(at, "dd.MM.yyyy H:mm")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer, a publication minute and a deadline a week later."""
    rows = spread(table(spark, folder, "orders")).join(
        table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"),
        "o_custkey",
    )
    at = key_minute(F.col("o_orderdate"), F.col("o_orderkey"))
    return rows.withColumn("published", at).withColumn(
        "deadline", at + F.expr("interval 7 days")
    )


def notice_url(key: Column) -> Column:
    return text(f"{NOTICE_HOST}/epz/order/notice/", key, "?print=1")


def notice_pages(rows: DataFrame) -> DataFrame:
    """``url, html`` of one notice per order."""
    fields = {
        "Номер извещения": text("№ ", F.col("o_orderkey")),
        "Заказчик": F.col("c_name"),
        "Статус закупки": F.col("o_orderstatus"),
        "Начальная цена": text(money_text(F.col("o_totalprice")), " руб."),
        "Дата размещения": day_first(F.col("published")),
        "Окончание подачи заявок": day_first(F.col("deadline")),
    }
    cells = [text(f"<tr><th>{k}</th><td>", v, "</td></tr>") for k, v in fields.items()]
    terms = [text(f"<dt>{k}:</dt><dd>", v, "</dd>") for k, v in fields.items()]
    spans = [text(f"<div><span>{k}</span><b> </b><span>", v, "</span></div>") for k, v in fields.items()]
    running = [text(f"{k}: ", v, " ") for k, v in fields.items()]
    layout = F.pmod(F.col("o_orderkey"), F.lit(4))
    body = (
        F.when(layout == 0, text("<table>", *cells, "</table>"))
        .when(layout == 1, text("<dl>", *terms, "</dl>"))
        .when(layout == 2, text(*spans))
        .otherwise(text("<p>Сведения о закупке. ", *running, "Код товара: 1</p>"))
    )
    links = text(
        '<a href="javascript:print()">Печать</a>'
        '<a href="../../../../docs/%D0%A2%D0%97%20', F.col("o_orderkey"), '.PDF">смета</a>'
        '<span data-href="/files?id=', F.col("o_orderkey"), '">Скачать файл</span>'
    )
    html = text(
        '<!DOCTYPE html><html><head><meta name="description" content="', F.col("o_orderpriority"),
        '"></head><body><h1>Закупка&nbsp;', F.col("o_orderkey"), "</h1>", body, links, "<br></body></html>",
    )
    return rows.select(notice_url(F.col("o_orderkey")).alias("url"), html.alias("html"))


def page_bytes(pages: DataFrame) -> DataFrame:
    """Pages (url, html) as fetched bytes: six ways by a hash of the URL, UTF-8 or windows-1251,
    declared in the Content-Type header, by a byte order mark, or in a meta element."""
    from gleanframe.functions.charset import HIGH, TABLES

    way = F.pmod(F.crc32(F.col("url")), F.lit(6))
    html = F.col("html")
    meta = F.when(way == 2, '<meta charset="utf-8">').when(way == 4, '<meta charset="Windows-1251">').when(
        way == 5, "<meta http-equiv='Content-Type' content='text/html; charset=cp1251'>"
    )
    html = F.when(meta.isNotNull(), F.replace(html, F.lit("<head>"), F.concat(F.lit("<head>"), meta))).otherwise(html)
    utf8 = F.encode(html, "UTF-8")
    cyrillic = F.encode(F.translate(html, TABLES["windows-1251"], HIGH), "ISO-8859-1")
    content = (
        F.when(way == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .when(way >= 3, cyrillic)
        .otherwise(utf8)
    )
    header = F.when(way == 0, "text/html; charset=UTF-8").when(way == 3, "text/html; charset=windows-1251").otherwise("text/html")
    return pages.select(
        F.lit("notices").alias("source"), F.lit("detail").alias("role"), "url", F.lit(200).alias("status_code"),
        content.alias("content"), F.create_map(F.lit("Content-Type"), header).alias("headers"),
        F.lit(None).cast("timestamp").alias("fetched_at"),
    )


def list_pages(entries: DataFrame, page_url: Column, next_link: Column, endless: bool = False) -> DataFrame:
    """``url, html`` of list pages from ``page, pos, entry`` rows; a page holds few entries.

    The last page has no next link unless ``endless``.
    """
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda e: e["entry"]), "")
    pages = entries.groupBy("page").agg(body.alias("body"))
    if not endless:
        last = entries.agg(F.max("page")).scalar()
        next_link = F.when(F.col("page") < last, next_link).otherwise(F.lit(""))
    return pages.select(
        page_url.alias("url"),
        text("<html><body><main>", F.col("body"), "</main>", next_link, "</body></html>").alias("html"),
    )


def notice_entry(number: Column, url: Column, published: Column, hint: Column) -> Column:
    return text(
        '<div class="block registry-entry__form"><div class="registry-entry__header-mid__number">№ ', number,
        '</div><a href="', url, '" class="registry-entry__header-mid__title">', hint,
        "</a><div>Дата размещения: ", day_first(published), "</div></div>",
    )


def notice_lists(rows: DataFrame, number: Column) -> DataFrame:
    """List pages over all orders in key order, fifty a page, each linking to the next."""
    key = F.col("o_orderkey")
    entries = rows.select(
        F.floor(key / PER_PAGE).alias("page"),
        F.pmod(key, F.lit(PER_PAGE)).alias("pos"),
        notice_entry(
            number, text("/epz/order/notice/", key, "?print=1"), F.col("published"), F.col("o_orderpriority")
        ).alias("entry"),
    )
    return list_pages(
        entries, notice_list_url(F.col("page")),
        text('<a rel="next" href="?pageNumber=', F.col("page") + 1, '">Следующая</a>'),
    )


def notice_list_url(page: Column) -> Column:
    return F.when(page == 0, F.lit(NOTICE_LIST)).otherwise(text(f"{NOTICE_LIST}?pageNumber=", page))


# --- products ------------------------------------------------------------------------


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "part"))


AVAILABILITY_TEXT = ("В наличии", "Нет в наличии", "Под заказ")


def availability(size: Column) -> Column:
    which = F.pmod(size, F.lit(3))
    return (
        F.when(which == 0, F.lit(AVAILABILITY_TEXT[0]))
        .when(which == 1, F.lit(AVAILABILITY_TEXT[1]))
        .otherwise(F.lit(AVAILABILITY_TEXT[2]))
    )


def product_day(key: Column) -> Column:
    return F.date_add(F.lit("2020-01-01").cast("date"), F.pmod(key, F.lit(1000)).cast("int"))


def product_url(key: Column) -> Column:
    return text(f"{SHOP_HOST}/products/item-", key, "/")


def product_pages(rows: DataFrame) -> DataFrame:
    """``url, html`` of one product page per part: JSON-LD, graph, markup, or labels."""
    key = F.col("p_partkey")
    sku = text("P-", key)
    price = F.col("p_retailprice").cast("decimal(18,2)")
    item = text(
        '{"@type": "Product", "name": "', F.col("p_name"), '", "sku": "', sku, '", "description": "',
        F.col("p_type"), '", "datePublished": "', F.date_format(product_day(key), "yyyy-MM-dd"),
        '", "offers": {"price": "', price, '", "priceCurrency": "RUB", "availability": "',
        availability(F.col("p_size")), '"}}',
    )
    script = '<script type="application/ld+json">'
    labelled = text(
        "<table><tr><td>Артикул</td><td>", sku, "</td></tr><tr><td>Цена</td><td>", money_text(price),
        " ₽</td></tr><tr><td>Наличие</td><td>", availability(F.col("p_size")),
        "</td></tr><tr><td>Дата публикации</td><td>", F.date_format(product_day(key), "dd.MM.yyyy"),
        '</td></tr></table><div class="description">', F.col("p_type"), "</div>",
    )
    marked = text(
        '<span itemprop="sku">', sku, '</span><div itemprop="description">', F.col("p_type"),
        '</div><span itemprop="price">', money_text(price), '</span><meta itemprop="priceCurrency" content="RUB">'
        '<meta property="article:published_time" content="', F.date_format(product_day(key), "yyyy-MM-dd"),
        '"><i>', availability(F.col("p_size")), "</i>",
    )
    layout = F.pmod(key, F.lit(4))
    body = (
        F.when(layout == 0, text(script, "{broken</script>", script, item, "</script>"))
        .when(layout == 1, text(script, '[{"@graph": [{"@type": "WebPage"}, ', item, "]}]</script>"))
        .when(layout == 2, marked)
        .otherwise(labelled)
    )
    html = text(
        '<html><head><meta property="og:image" content="/img/', key, '.jpg"></head><body><h1>', F.col("p_name"),
        "</h1>", body, '<div class="product-detail"><img data-src="//cdn.example/x.png" src="/img/', key,
        '-big.png"></div><a href="/manual/', key, '.pdf">Руководство (PDF)</a></body></html>',
    )
    return rows.select(product_url(key).alias("url"), html.alias("html"))


def product_lists(rows: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    link = text('<a href="/products/item-', key, '/">', F.col("p_name"), "</a>")
    entries = rows.select(
        F.floor(key / PER_PAGE).alias("page"),
        F.pmod(key, F.lit(PER_PAGE)).alias("pos"),
        # The same card links twice, and the section link is on it too.
        text(link, link, '<a href="/products/">Каталог</a>').alias("entry"),
    )
    return list_pages(
        entries,
        F.when(F.col("page") == 0, F.lit(SHOP_LIST)).otherwise(text(f"{SHOP_LIST}?page=", F.col("page"))),
        text('<a class="pagination-next" href="?page=', F.col("page") + 1, '">2</a>'),
    )


def as_landed(pages: DataFrame, source: str, role: str) -> DataFrame:
    """Rendered pages in the landed-page schema."""
    return pages.select(
        F.lit(source).alias("source"), F.lit(role).alias("role"), "url", F.lit(200).alias("status_code"), "html",
        F.create_map().cast("map<string,string>").alias("headers"),
        F.lit("2026-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )
