"""The registered queries. Each runs one or more operators over whole given tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks import render
from checks.render import table, text
from gleanframe.functions import text as tx
from gleanframe.functions import urls
from gleanframe.functions.dom import Page, attr, by_attr, by_tag
from gleanframe.operators import (
    attachments,
    constraints,
    discovery,
    fetchlog,
    merge,
    records,
    references,
    reports,
    summary,
)
from gleanframe.plans.harvest import harvest
from gleanframe.plans.spec import ProductSpec, PurchaseSpec
from gleanframe.schemas import LISTING_KEYS, LISTING_PAYLOAD
from gleanframe.session import durable, prepare, shared_folder
from gleanframe.sources.markup import page_nodes
from gleanframe.sources.pages import page_texts, stream_pages
from gleanframe.sources.state import initialise
from gleanframe.streaming.ingest import ingest_pages

NOTICES = PurchaseSpec(name=render.NOTICES, list_url=render.NOTICE_LIST)
SHOP = ProductSpec(name=render.SHOP, list_url=render.SHOP_LIST)
NOW = datetime(2026, 3, 1, 12, 0, 0)


def ntz(x: Column) -> Column:
    return x.cast("timestamp_ntz")


# --- scalars -------------------------------------------------------------------------


def money_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts of all orders printed in four ways and read back."""
    rows = table(spark, folder, "orders")
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    way = F.pmod(F.col("o_orderkey"), F.lit(4))
    printed = (
        F.when(way == 0, text(render.money_text(amount), " ₽"))
        .when(way == 1, text("от ", amount, " руб."))
        .when(way == 2, F.replace(render.money_text(amount), F.lit("\u00a0"), F.lit(" ")))
        .otherwise(text("цена: -", amount))
    )
    return rows.select("o_orderkey", tx.to_money(tx.parse_decimal(printed)).alias("amount"))


def date_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Dates of all orders printed in six ways and read back; two ways are no dates."""
    at = render.key_minute(F.col("o_orderdate"), F.col("o_orderkey"))
    way = F.pmod(F.col("o_orderkey"), F.lit(6))
    printed = (
        F.when(way == 0, F.date_format(at, "d.M.yyyy H:mm"))
        .when(way == 1, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(way == 2, text(" ", F.date_format(at + F.expr("interval 3 hours"), "yyyy-MM-dd HH:mm:ss"), "+03:00 "))
        .when(way == 3, F.date_format(at, "dd.MM.yyyy  HH:mm:ss"))
        .when(way == 4, F.date_format(at, "dd.MM.yyyy HH:mm 'MSK'"))
        .otherwise(F.date_format(at, "yyyy-MM"))
    )
    rows = table(spark, folder, "orders")
    return rows.select("o_orderkey", ntz(tx.parse_datetime(printed)).alias("at"))


def flat_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled values in running text over all orders."""
    rows = render.orders(spark, folder)
    line = text(
        "Закупка Организация, осуществляющая закупку - ", F.col("c_name"), "; Состояние: ", F.col("o_orderstatus"),
        "  НМЦК № ", F.col("o_orderpriority"), " Размещено ", F.col("o_orderkey"),
    )
    groups = {
        "customer": NOTICES.customer_labels,
        "status": NOTICES.status_labels,
        "price": NOTICES.price_labels,
        "published": NOTICES.published_labels,
        "deadline": NOTICES.deadline_labels,
    }
    read = rows.select("o_orderkey", tx.flat_labeled_values(line, groups.values()).alias("found"))
    return read.select("o_orderkey", *[F.get("found", F.lit(i)).alias(name) for i, name in enumerate(groups)])


def clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whitespace-collapsed text of all documents."""
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", F.md5(tx.clean_text(F.col("text")).cast("binary")).alias("text_md5"))


def cursor_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Page URLs with a publication filter in their query."""
    rows = table(spark, folder, "pages")
    since = F.lit("2024-02-29 21:30:00").cast("timestamp")
    return rows.select("page_id", urls.cursor_query_url(F.col("url"), since).alias("list_url"))


# --- pages ---------------------------------------------------------------------------


def page_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Title, heading, text and number of links of all pages."""
    nodes = render.spread(table(spark, folder, "pages")).select("page_id", "url", page_nodes(F.col("html")).alias("doc"))
    split = nodes.select("page_id", F.col("doc.texts").alias("texts"), F.col("doc.nodes").alias("nodes"))
    page = Page(F.col("texts"), F.col("nodes"))
    marked = split.select("*", page.marks((by_tag("title"), by_tag("h1"), by_attr("href", tag="a"))).alias("marks"))
    marks = F.col("marks")
    return marked.select(
        "page_id",
        page.first_text(marks, (by_tag("title"),)).alias("title"),
        page.first_text(marks, (by_tag("h1"),)).alias("heading"),
        F.md5(page.page_text().cast("binary")).alias("text_md5"),
        F.size(page.select(marks, by_attr("href", tag="a"))).alias("links"),
    )


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Every link of every page: absolute URL, id, file name and content type."""
    nodes = render.spread(table(spark, folder, "pages")).select("page_id", "url", page_nodes(F.col("html")).alias("doc"))
    split = nodes.select(
        "page_id", "url", F.col("doc.texts").alias("texts"), F.col("doc.nodes").alias("nodes"),
        urls.url_base(F.col("url")).alias("base"),
    )
    page = Page(F.col("texts"), F.col("nodes"))
    links = F.transform(
        page.marks((by_attr("href", tag="a"),)),
        lambda n: F.struct(urls.join_url(F.col("base"), attr(n, "href")).alias("link"), page.text_of(n).alias("text")),
    )
    found = split.select("page_id", F.posexplode(links).alias("pos", "l")).select("page_id", "pos", "l.*")
    return found.select(
        "page_id", "pos", "link", "text",
        urls.id_from_url(F.col("link")).alias("link_id"),
        urls.safe_filename(urls.filename_from_url(F.col("link"))).alias("file_name"),
        urls.url_netloc(F.col("link")).alias("host"),
    )


def purchase_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Notice pages of all orders read back to records."""
    pages = render.notice_pages(render.orders(spark, folder))
    listed = records.complete_purchases(
        records.with_own_references(records.extract_purchases(pages, NOTICES)), NOTICES
    )
    return listed.select(
        "source", "kind", "external_id", "number", "title", "description", "customer_name", "status",
        ntz(F.col("published_at")).alias("published_at"), ntz(F.col("deadline_at")).alias("deadline_at"),
        tx.to_money(F.col("price")).alias("price"), "currency", "url", "raw_payload",
        F.size("attachments").alias("attachment_count"),
    )


def product_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Product pages of all parts read back to records."""
    pages = render.product_pages(render.parts(spark, folder))
    listed = records.complete_products(
        records.with_own_references(records.extract_products(pages, SHOP)), SHOP
    )
    return listed.select(
        "source", "kind", "external_id", "title", "description", "customer_name", "status",
        ntz(F.col("published_at")).alias("published_at"), tx.to_money(F.col("price")).alias("price"),
        "currency", "url", F.array_join(F.transform("attachments", lambda a: a["url"]), " ").alias("files"),
    )


def attachment_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Attachments of all notices with file names, types and paths."""
    pages = render.notice_pages(render.orders(spark, folder))
    planned = attachments.plan_attachments(records.numbered_attachments(pages, NOTICES), "data/files")
    return planned.select(
        "external_id", "item", "source_url", "page_filename", "page_type", "filename", "local_path"
    )


# --- discovery -----------------------------------------------------------------------


def purchase_refs(spark: SparkSession, folder: str) -> DataFrame:
    """References of all order list pages, numbered by customer: first occurrence only."""
    pages = render.notice_lists(render.orders(spark, folder), F.col("o_custkey"))
    extracted = references.extract_references(pages, NOTICES)
    refs = references.explode_references(extracted).withColumn(
        "page_no", F.coalesce(F.regexp_substr("page_url", F.lit(r"\d+$")).cast("int"), F.lit(0))
    )
    return discovery.first_occurrence(refs).select(
        "external_id", "page_no", "url", ntz(F.col("published_at")).alias("published_at"), "title_hint"
    )


def product_refs(spark: SparkSession, folder: str) -> DataFrame:
    """References of all part list pages."""
    extracted = references.extract_references(render.product_lists(render.parts(spark, folder)), SHOP)
    refs = references.explode_references(extracted)
    return refs.select("page_url", "pos", "external_id", "url", ntz(F.col("published_at")).alias("published_at"), "title_hint")


CHAIN_SOURCE = 25
CHAIN_BACK_TO = 10


def page_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Chains of order list pages, 25 to a catalogue, whose last page links back to the tenth."""
    rows = render.orders(spark, folder)
    key = F.col("o_orderkey")
    entries = rows.select(
        F.floor(key / render.PER_PAGE).alias("page"), F.pmod(key, F.lit(render.PER_PAGE)).alias("pos"),
        render.notice_entry(key, text("/epz/order/notice/", key), F.col("published"), F.col("c_name")).alias("entry"),
    )
    catalogue = F.floor(F.col("page") / CHAIN_SOURCE)
    place = F.pmod(F.col("page"), F.lit(CHAIN_SOURCE))
    following = F.when(place == CHAIN_SOURCE - 1, F.lit(CHAIN_BACK_TO)).otherwise(place + 1)
    way = F.pmod(F.col("page"), F.lit(3))
    link = (
        F.when(way == 0, text('<a href="/help">?</a><a rel="next" href="?page=', following, '">2</a>'))
        .when(way == 1, text('<a href="?page=', place, '">Далее</a><a href="?page=', following, '"> далее </a>'))
        .otherwise(text('<a href="/other?page=1">1</a><a href="?page=', following, '">2</a>'))
    )
    pages = render.list_pages(entries, text("https://n.example/list/", catalogue, "?page=", place), link, endless=True)
    extracted = references.extract_references(pages, NOTICES)
    named = extracted.select(
        F.regexp_extract("page_url", r"/list/(\d+)", 1).alias("source"), "page_url", "next_url"
    )
    edges = discovery.durable(named)
    starts = edges.where(F.col("page_url").endswith("?page=0")).select("source", "page_url")
    chain = discovery.page_chain(edges, starts, max_pages=100).drop("cut")
    return chain.select("source", "page_url", "page_no")


def incremental_refs(spark: SparkSession, folder: str) -> DataFrame:
    """Every customer as a catalogue with a page per month, newest first: stop rule, cutoff,
    first occurrence, limit of three."""
    source = text("c", F.col("o_custkey"))
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    place = Window.partitionBy("o_custkey", month).orderBy(F.desc("o_orderdate"), "o_orderkey")
    rows = table(spark, folder, "orders").select(
        source.alias("source"), (F.lit(30_000) - month).alias("page_no"),
        (F.row_number().over(place) - 1).alias("pos"),
        text(F.col("o_orderpriority"), F.col("o_orderstatus")).alias("external_id"),
        text("/o/", F.col("o_orderkey")).alias("url"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.col("o_orderstatus").alias("title_hint"),
    )
    ref = F.struct("pos", "external_id", "url", "published_at", "title_hint")
    pages = (
        rows.groupBy("source", "page_no")
        .agg(F.array_sort(F.collect_list(ref)).alias("refs"))
        .withColumn("page_url", text("/", F.col("page_no")))
    )
    # One copy per id and page: the first one.
    first = F.filter("refs", lambda r, i: F.array_position(F.col("refs.external_id"), r["external_id"]) == i + 1)
    pages = pages.withColumn("refs", first)
    customers = table(spark, folder, "customer")
    checkpoints = customers.select(
        text("c", F.col("c_custkey")).alias("source"),
        F.date_add(F.lit("1996-01-01").cast("date"), F.col("c_nationkey") * 60).cast("timestamp").alias("cursor_at"),
    )
    since = discovery.effective_since(checkpoints, pages.select("source").distinct())
    chosen = discovery.select_references(pages, since, NOTICES, limit=3)
    return chosen.select("source", "page_no", "pos", "external_id", "url", ntz(F.col("published_at")).alias("published_at"))


# --- merges --------------------------------------------------------------------------


def _empty_listing(df: DataFrame, **columns: Column) -> DataFrame:
    """Listing columns; those not named are null."""
    types = {"published_at": "timestamp", "deadline_at": "timestamp", "price": "decimal(18,2)"}
    return df.select(
        *[
            columns.get(c, F.lit(None)).cast(types.get(c, "string")).alias(c)
            for c in (*LISTING_KEYS, *LISTING_PAYLOAD)
        ]
    )


def _customer_listings(spark: SparkSession, folder: str) -> DataFrame:
    first = F.lit("2025-01-01 00:00:00").cast("timestamp")
    return _empty_listing(
        table(spark, folder, "customer"),
        source=F.lit("customers"), external_id=F.col("c_custkey"), kind=F.lit("purchase"),
        number=F.col("c_custkey"), title=F.col("c_name"), description=F.col("c_mktsegment"),
        price=F.col("c_acctbal"), url=text("/c/", F.col("c_custkey")), raw_payload=F.lit("{}"),
    ).select("*", first.alias("first_seen_at"), first.alias("updated_at"))


def _document_listings(spark: SparkSession, folder: str) -> DataFrame:
    first = F.lit("2025-02-02 00:00:00").cast("timestamp")
    return _empty_listing(
        table(spark, folder, "labels"),
        source=F.lit("documents"), external_id=F.col("doc_id"), kind=F.lit("product"), title=F.lit("labelled"),
        status=F.col("quality"), url=text("/d/", F.col("doc_id")), raw_payload=F.lit("{}"),
    ).select("*", first.alias("first_seen_at"), first.alias("updated_at"))


def _stored_listings(spark: SparkSession, folder: str) -> DataFrame:
    return _customer_listings(spark, folder).unionByName(_document_listings(spark, folder))


def _incoming_listings(spark: SparkSession, folder: str) -> DataFrame:
    by_order = _empty_listing(
        table(spark, folder, "orders"),
        source=F.lit("customers"), external_id=F.col("o_custkey"), kind=F.lit("purchase"),
        number=F.col("o_orderkey"), title=F.col("o_orderpriority"),
        description=F.nullif(F.col("o_orderstatus"), F.lit("P")), price=F.col("o_totalprice"),
        published_at=F.col("o_orderdate"), url=text("/o/", F.col("o_orderkey")), raw_payload=F.lit("{}"),
    ).withColumn("pos", F.col("number").cast("bigint"))
    by_document = _empty_listing(
        table(spark, folder, "documents"),
        source=F.lit("documents"), external_id=F.col("doc_id"), kind=F.lit("product"), title=F.col("lang"),
        description=F.col("source"), price=F.col("n_chars"), url=text("/d/", F.col("doc_id")),
        raw_payload=F.to_json(F.struct("doc_id", F.struct("lang").alias("text"))),
    ).withColumn("pos", F.col("external_id").cast("bigint"))
    return by_order.unionByName(by_document)


def _merged_listings(spark: SparkSession, folder: str) -> DataFrame:
    return merge.upsert_listings(
        _stored_listings(spark, folder), _incoming_listings(spark, folder), NOW, order=("pos",)
    )


def listing_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Stored customers and labelled documents, merged with all orders (several per customer)
    and all documents (some new)."""
    return _merged_listings(spark, folder).select(
        "source", "external_id", "kind", "number", "title", "description", "status",
        ntz(F.col("published_at")).alias("published_at"), "price", "url",
        ntz(F.col("first_seen_at")).alias("first_seen_at"), ntz(F.col("updated_at")).alias("updated_at"),
        "change", "batch_rows",
    )


def upsert_counts(spark: SparkSession, folder: str) -> DataFrame:
    return merge.change_counts(_merged_listings(spark, folder))


def counts_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    return reports.counts_by_kind(_merged_listings(spark, folder))


def newest_listings(spark: SparkSession, folder: str) -> DataFrame:
    newest = reports.newest_listings(_merged_listings(spark, folder))
    return newest.withColumns(
        {c: ntz(F.col(c)) for c in ("published_at", "first_seen_at")}
    )


def newest_payload(spark: SparkSession, folder: str) -> DataFrame:
    return reports.newest_payload(_merged_listings(spark, folder))


def _stored_attachments(spark: SparkSession, folder: str) -> DataFrame:
    labelled = table(spark, folder, "labels")
    return labelled.select(
        F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("external_id"),
        text("/f/", F.col("doc_id")).alias("source_url"), F.lit("old.txt").alias("filename"),
        F.lit("text/plain").alias("content_type"), F.col("quality").cast("bigint").alias("size"),
        F.lit("old").alias("sha256"), F.lit("files/old.txt").alias("local_path"),
        F.lit("downloaded").alias("status"), F.lit(None).cast("string").alias("error"),
        F.lit("2025-01-01 00:00:00").cast("timestamp").alias("downloaded_at"),
    )


def _attachment_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    failed = F.col("lang") == "en"
    key = [
        F.lit("documents").alias("source"), F.col("doc_id").cast("string").alias("external_id"),
        text("/f/", F.col("doc_id")).alias("source_url"),
    ]
    first = documents.select(
        *key, text("doc-", F.col("doc_id"), ".txt").alias("filename"), F.col("lang").alias("content_type"),
        F.when(~failed, F.col("n_chars")).alias("size"), F.when(~failed, F.lit("first")).alias("sha256"),
        F.when(~failed, F.lit("files/first.txt")).alias("local_path"),
        F.when(failed, F.lit("failed")).otherwise(F.lit("downloaded")).alias("status"),
        F.when(failed, F.repeat(F.lit("no answer "), 300)).alias("error"), F.lit(0).alias("item"),
    )
    bad = F.col("toxic") == 1
    second = table(spark, folder, "labels").select(
        *key, text("lab-", F.col("doc_id"), ".txt").alias("filename"), F.lit(None).cast("string").alias("content_type"),
        F.when(~bad, F.col("doc_id") * 2).alias("size"), F.when(~bad, F.lit("second")).alias("sha256"),
        F.when(~bad, F.lit("files/second.txt")).alias("local_path"),
        F.when(bad, F.lit("failed")).otherwise(F.lit("downloaded")).alias("status"),
        F.when(bad, F.lit("gone")).alias("error"), F.lit(1).alias("item"),
    )
    return first.unionByName(second)


def _merged_attachments(spark: SparkSession, folder: str) -> DataFrame:
    return merge.merge_attachments(
        _stored_attachments(spark, folder), _attachment_outcomes(spark, folder), NOW, order=("item",)
    )


def attachment_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Stored files of labelled documents, merged with one or two outcomes per document."""
    return _merged_attachments(spark, folder).withColumn("downloaded_at", ntz(F.col("downloaded_at")))


def newest_attachments(spark: SparkSession, folder: str) -> DataFrame:
    return reports.newest_attachments(_merged_attachments(spark, folder))


def attachment_count(spark: SparkSession, folder: str) -> DataFrame:
    """Attachments whose listing is stored, counted over the join."""
    return reports.attachments_of_source(
        _merged_attachments(spark, folder), _stored_listings(spark, folder), "documents"
    )


def digest_audit(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as downloads: sizes, limits and digests; labelled ones are in place already."""
    documents = table(spark, folder, "documents")
    body = F.col("text").cast("binary")
    url = text("/f/", F.col("doc_id"), ".txt")
    downloads = documents.select(
        url.alias("source_url"), F.col("lang").alias("content_type"), F.col("n_chars").alias("reported_size"),
        F.octet_length(body).cast("bigint").alias("length"), F.sha2(body, 256).alias("sha256"),
        F.lit(None).cast("string").alias("error"),
    )
    listed = documents.select(
        F.lit("docs.example").alias("source"), F.col("doc_id").cast("string").alias("external_id"),
        F.array(
            F.struct(
                url.alias("url"), text("doc ", F.col("doc_id"), ".txt").alias("filename"),
                F.when(F.col("lang") == "de", F.lit("text/plain")).alias("content_type"),
            )
        ).alias("attachments"),
    )
    planned = attachments.plan_attachments(listed, "files")
    stored = (
        table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("external_id"), "quality", "toxic")
        .join(planned.select("external_id", "local_path"), "external_id")
        .select(
            F.col("local_path").alias("path"), (F.col("quality") + 7).cast("bigint").alias("length"),
            F.sha2(F.col("external_id"), 256).alias("sha256"),
        )
    )
    settled = attachments.settle_attachments(planned, stored, downloads, max_bytes=20_000)
    return settled.drop("item")


def cursor_advance(spark: SparkSession, folder: str) -> DataFrame:
    """Cursors of every user and day from events, only where nothing failed; older ones stay."""
    cursors = summary.new_cursors(_event_outcomes(spark, folder, daily=True))
    stored = (
        table(spark, folder, "events")
        .select(text(F.col("user_id"), "/", F.to_date("ts")).alias("source")).distinct()
        .select(
            "source", F.lit("2030-01-01 00:00:00").cast("timestamp").alias("cursor_at"),
            F.lit("2025-01-01 00:00:00").cast("timestamp").alias("saved_at"),
        )
    )
    merged = reports.cursors_by_source(merge.merge_checkpoints(stored, cursors, NOW))
    return merged.withColumns({c: ntz(F.col(c)) for c in ("cursor_at", "saved_at")})


# --- roll-ups ------------------------------------------------------------------------


def _event_outcomes(spark: SparkSession, folder: str, daily: bool = False) -> DataFrame:
    """Every event as one thing that happened in a run of its user."""
    source = text(F.col("user_id"), "/", F.to_date("ts")) if daily else text("user ", F.col("user_id"))
    kind = F.col("event_type")
    step = (
        F.when(kind == "view", F.lit("discovered")).when(kind == "click", F.lit("inserted"))
        .when(kind == "signup", F.lit("updated")).when(kind == "purchase", F.lit("attachment"))
        .otherwise(F.lit("error"))
    )
    stage = F.when(F.col("value") > 60, F.lit("discover")).when(F.col("value") > 10, F.lit("detail")).otherwise(F.lit("database"))
    return table(spark, folder, "events").select(
        source.alias("source"), step.alias("step"), F.col("event_id").cast("string").alias("external_id"),
        F.when(kind == "error", stage).alias("stage"), F.col("props").alias("message"),
        F.lit(0).alias("page_no"), F.col("event_id").cast("int").alias("pos"), F.lit(0).alias("item"),
        F.col("ts").cast("timestamp").alias("published_at"), F.lit(1).cast("bigint").alias("n"),
    )


def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    return summary.run_summary(_event_outcomes(spark, folder))


def run_errors(spark: SparkSession, folder: str) -> DataFrame:
    return summary.run_errors(_event_outcomes(spark, folder))


def all_totals(spark: SparkSession, folder: str) -> DataFrame:
    return summary.all_totals(summary.run_summary(_event_outcomes(spark, folder)))


def exit_code(spark: SparkSession, folder: str) -> DataFrame:
    return summary.exit_code(summary.run_summary(_event_outcomes(spark, folder)))


# --- constraints ---------------------------------------------------------------------


def constraint_check(spark: SparkSession, folder: str) -> DataFrame:
    """All orders as listings, some of which break a constraint."""
    status = F.col("o_orderstatus")
    rows = table(spark, folder, "orders").select(
        "o_orderkey", F.lit("orders").alias("source"),
        F.when(status == "F", F.lit("purchase")).when(status == "O", F.lit("product")).otherwise(status).alias("kind"),
        F.col("o_orderkey").cast("string").alias("external_id"),
        F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("title"), text("/o/", F.col("o_orderkey")).alias("url"),
        F.lit("{}").alias("raw_payload"),
        (F.col("o_totalprice").cast("decimal(18,2)") * F.lit(40_000_000_000)).cast("decimal(38,10)").alias("price"),
    )
    return constraints.check_listings(rows).select("o_orderkey", "violation", "price")


def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return constraints.duplicate_keys(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


def ambiguous_ids(spark: SparkSession, folder: str) -> DataFrame:
    return constraints.ambiguous_ids(_incoming_listings(spark, folder))


def orphans_and_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without orders, and what stays after pending orders are deleted."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "key")
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "key")
    customers = table(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    lonely = constraints.orphans(customers, orders, ["o_custkey"])
    parents, children = constraints.delete_cascade(
        orders, lines, orders.where(F.col("o_orderstatus") == "P"), ["key"]
    )

    def counted(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.agg(F.lit(name).alias("part"), F.count("*").alias("rows"), F.sum(key).alias("key_sum"))

    return (
        counted(lonely, "customers without orders", "o_custkey")
        .unionByName(counted(parents, "orders kept", "key"))
        .unionByName(counted(children, "lines kept", "key"))
    )


# --- fetch log -----------------------------------------------------------------------


def _fetch_log(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as one fetch attempt of its user's page of the day."""
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", F.lit(200)).when(kind == "click", F.lit(503)).when(kind == "signup", F.lit(403))
        .when(kind == "purchase", F.lit(408))
    )
    rows = table(spark, folder, "events").select(
        text("https://H", F.col("user_id"), ".example/", F.to_date("ts")).alias("url"),
        F.when(F.col("value") > 20, F.lit("browser")).otherwise(F.lit("http")).alias("transport"),
        F.col("ts").cast("timestamp").alias("requested_at"), status.alias("status_code"),
        F.when(kind == "error", F.col("props")).alias("error"), "event_id",
    )
    tries = Window.partitionBy("transport", "url").orderBy("requested_at")
    return rows.withColumn("attempt_no", F.row_number().over(tries))


def fetch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return fetchlog.fetch_outcomes(_fetch_log(spark, folder))


def fetch_classes(spark: SparkSession, folder: str) -> DataFrame:
    """All orders' keys as status codes, and their classes."""
    code = (F.pmod(F.col("o_orderkey"), F.lit(400)) + 200).cast("int")
    return table(spark, folder, "orders").select("o_orderkey", fetchlog.status_class(code).alias("class"))


def retry_due(spark: SparkSession, folder: str) -> DataFrame:
    due = fetchlog.retry_due(_fetch_log(spark, folder))
    return due.withColumn("due_at", ntz(F.col("due_at")))


def refetch(spark: SparkSession, folder: str) -> DataFrame:
    return fetchlog.refetch_candidates(fetchlog.fetch_outcomes(_fetch_log(spark, folder)))


def url_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return fetchlog.url_outcomes(fetchlog.fetch_outcomes(_fetch_log(spark, folder)))


SLOT_GAP_MS = 36_000_000


def host_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Polite start times of all events, one host per user, about ten hours apart."""
    rows = table(spark, folder, "events").select(
        "event_id", fetchlog.host_key(text("https://H", F.col("user_id"), ".example/x")).alias("host"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("arrival_ms"),
        (F.lit(SLOT_GAP_MS) + F.pmod(F.col("event_id"), F.lit(750))).alias("gap_ms"),
    )
    slots = fetchlog.host_slots(rows, order=("arrival_ms", "event_id"))
    return slots.select("event_id", "host", "slot_ms")


def size_gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents")
    actual = F.octet_length(F.col("text")).cast("bigint")
    return rows.select("doc_id", fetchlog.size_violation(F.col("n_chars"), actual, 5_000).alias("violation"))


# --- whole runs ----------------------------------------------------------------------


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/check-{uuid.uuid4().hex[:12]}"


def harvest_run(spark: SparkSession, folder: str) -> DataFrame:
    """Both catalogues over all orders and parts: list pages to state tables to totals."""
    orders = render.orders(spark, folder)
    parts = render.parts(spark, folder)
    root = _run_folder(spark)
    landed = [
        render.as_landed(render.notice_lists(orders, F.col("o_orderkey")), render.NOTICES, "list"),
        render.as_landed(render.notice_pages(orders), render.NOTICES, "detail"),
        render.as_landed(render.product_lists(parts), render.SHOP, "list"),
        render.as_landed(render.product_pages(parts), render.SHOP, "detail"),
    ]
    for pages in landed:
        pages.write.mode("append").partitionBy("source", "role").parquet(f"{root}/pages")
    tables = initialise(spark, f"{root}/state", buckets=8)
    result = harvest(
        spark, spark.read.parquet(f"{root}/pages"), [NOTICES, SHOP], tables, NOW
    )
    stored = tables["listings"].read(spark).groupBy("source").agg(
        F.count("*").alias("stored"), F.sum("price").cast("decimal(28,2)").alias("price_sum")
    )
    return result.summary.join(stored, "source").select(
        "source", "discovered", "processed", "inserted", "updated", "errors", "stored", "price_sum"
    )


def stream_run(spark: SparkSession, folder: str) -> DataFrame:
    """Product pages of all parts through the streaming ingest."""
    root = _run_folder(spark)
    pages = render.as_landed(render.product_pages(render.parts(spark, folder)), render.SHOP, "detail")
    pages.write.parquet(f"{root}/pages")
    tables = initialise(spark, f"{root}/state", buckets=8)
    query = ingest_pages(
        stream_pages(spark, f"{root}/pages"), [SHOP], tables, f"{root}/progress", clock=lambda: NOW, availableNow=True
    )
    query.awaitTermination()
    return tables["listings"].read(spark).select(
        "source", "external_id", "title", "price", "status", ntz(F.col("first_seen_at")).alias("first_seen_at")
    )


def _fetched(pages: DataFrame, day: int, status: int = 200) -> DataFrame:
    return pages.withColumn("fetched_at", F.lit(f"2026-01-{day:02d} 00:00:00").cast("timestamp")).withColumn(
        "status_code", F.lit(status)
    )


def _dearer(rows: DataFrame, column: str, by: int) -> DataFrame:
    return rows.withColumn(column, F.col(column) + by)


def rerun_newest_fetch(spark: SparkSession, folder: str) -> DataFrame:
    """Notices of all orders in several fetches, run twice: the newest fetch decides, also a failed one.

    Every page was fetched at a higher price first, every third again at the right one, every
    fifth failed after that; before the second run every tenth was fetched once more.
    """
    orders = render.orders(spark, folder)
    root = _run_folder(spark)

    def details(every: int) -> DataFrame:
        some = orders.where(F.pmod(F.col("o_orderkey"), F.lit(every)) == 0)
        return render.as_landed(render.notice_pages(some), render.NOTICES, "detail")

    first = render.as_landed(render.notice_pages(_dearer(orders, "o_totalprice", 1000)), render.NOTICES, "detail")
    lists = render.as_landed(render.notice_lists(orders, F.col("o_orderkey")), render.NOTICES, "list")
    for pages in (lists, _fetched(first, 2), _fetched(details(3), 3), _fetched(details(5), 4, 503)):
        pages.write.mode("append").partitionBy("source", "role").parquet(f"{root}/pages")
    tables = initialise(spark, f"{root}/state", buckets=8)
    harvest(spark, spark.read.parquet(f"{root}/pages"), [NOTICES], tables, NOW)
    _fetched(details(10), 5).write.mode("append").partitionBy("source", "role").parquet(f"{root}/pages")
    result = harvest(spark, spark.read.parquet(f"{root}/pages"), [NOTICES], tables, NOW)
    moved = tables["checkpoints"].read(spark).where("cursor_at is not null").count() > 0
    stored = tables["listings"].read(spark).select("external_id", "price")
    errors = result.errors.select("external_id", "stage")
    return stored.join(errors, "external_id", "full").select(
        F.col("external_id").cast("long").alias("o_orderkey"), "price", "stage", F.lit(moved).alias("cursor_moved")
    )


def stream_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Product pages of all parts through two streams into the same tables.

    The first stream sees the right prices and then older fetches; the second, with a progress
    folder of its own, sees newer fetches of every second part and failed ones of every seventh.
    """
    parts = render.parts(spark, folder)
    root = _run_folder(spark)
    tables = initialise(spark, f"{root}/state", buckets=8)

    def landed(rows: DataFrame, by: int, day: int, status: int = 200) -> DataFrame:
        pages = render.product_pages(_dearer(rows, "p_retailprice", by))
        return _fetched(render.as_landed(pages, render.SHOP, "detail"), day, status)

    def drain(name: str) -> None:
        ingest_pages(
            stream_pages(spark, f"{root}/{name}"), [SHOP], tables, f"{root}/{name}-progress", clock=lambda: NOW, availableNow=True
        ).awaitTermination()

    def every(n: int) -> DataFrame:
        return parts.where(F.pmod(F.col("p_partkey"), F.lit(n)) == 0)

    landed(parts, 0, 2).write.mode("append").parquet(f"{root}/one")
    drain("one")
    landed(parts, 5, 1).write.mode("append").parquet(f"{root}/one")
    drain("one")
    landed(every(2), 7, 3).write.mode("append").parquet(f"{root}/two")
    landed(every(7), 9, 4, 503).write.mode("append").parquet(f"{root}/two")
    drain("two")
    failed = tables["errors"].read(spark).select("url", "stage")
    return tables["listings"].read(spark).join(failed, "url", "left").select("external_id", "price", "stage")


def registered() -> dict:
    queries = (
        money_texts, date_texts, flat_labels, clean_documents, cursor_urls,
        page_facts, page_links, purchase_extract, product_extract, attachment_plan,
        purchase_refs, product_refs, page_chains, incremental_refs,
        listing_upsert, upsert_counts, counts_by_kind, newest_listings, newest_payload,
        attachment_merge, newest_attachments, attachment_count, digest_audit, cursor_advance,
        run_summary, run_errors, all_totals, exit_code,
        constraint_check, duplicate_keys, ambiguous_ids, orphans_and_cascade,
        fetch_outcomes, fetch_classes, retry_due, refetch, url_outcomes, host_slots, size_gate,
        harvest_run, stream_run, rerun_newest_fetch, stream_replay, charset_extract, detail_causes, harvest_attachments, run_document,
    )

    def prepared(query):
        return lambda spark, folder: query(prepare(spark), folder)

    return {query.__name__: prepared(query) for query in queries}


# --- pages as bytes ------------------------------------------------------------------


def charset_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Notice pages of all orders as bytes in UTF-8 or windows-1251, declared by header, mark or meta,
    landed as a table, read back through the charset decoder and extracted to records."""
    spark = prepare(spark)
    fetched = render.page_bytes(render.notice_pages(render.orders(spark, folder)))
    pages = page_texts(durable(fetched))
    listed = records.complete_purchases(
        records.with_own_references(records.extract_purchases(pages.select("url", "html"), NOTICES)), NOTICES
    )
    return listed.select(
        "source", "kind", "external_id", "number", "title", "description", "customer_name", "status",
        ntz(F.col("published_at")).alias("published_at"), ntz(F.col("deadline_at")).alias("deadline_at"),
        tx.to_money(F.col("price")).alias("price"), "currency", "url", "raw_payload",
        F.size("attachments").alias("attachment_count"),
    )


def detail_causes(spark: SparkSession, folder: str) -> DataFrame:
    """Notices of all orders; every fifth newest fetch failed. The fetch log of all orders has an
    old success of each, an attempt on the fifth ones (blocked, not found or timed out by key),
    and a later success of every second order after the run, which the run must not see."""
    spark = prepare(spark)
    orders = render.orders(spark, folder)
    root = _run_folder(spark)
    lists = render.as_landed(render.notice_lists(orders, F.col("o_orderkey")), render.NOTICES, "list")
    fine = render.as_landed(render.notice_pages(orders), render.NOTICES, "detail")
    failed = render.as_landed(render.notice_pages(orders.where(F.pmod("o_orderkey", F.lit(5)) == 0)), render.NOTICES, "detail")
    for pages in (lists, _fetched(fine, 2), _fetched(failed, 4, 503)):
        pages.write.mode("append").partitionBy("source", "role").parquet(f"{root}/pages")
    key, url = F.col("o_orderkey"), render.notice_url(F.col("o_orderkey"))

    def attempts(rows: DataFrame, at: str, status: Column, error: Column) -> DataFrame:
        return rows.select(
            url.alias("url"), F.lit(1).alias("attempt_no"), F.lit("http").alias("transport"),
            F.lit(at).cast("timestamp").alias("requested_at"), status.cast("int").alias("status_code"),
            error.alias("error"), F.lit(None).cast("bigint").alias("content_length"), F.lit(None).cast("bigint").alias("bytes"),
        )

    fifth = orders.where(F.pmod(key, F.lit(5)) == 0)
    way = F.pmod(key, F.lit(3))
    log = (
        attempts(orders, "2026-01-02 00:00:00", F.lit(200), F.lit(None).cast("string"))
        .unionByName(attempts(fifth, "2026-01-04 00:00:00", F.when(way == 0, 403).when(way == 1, 404), F.when(way == 2, "timed out")))
        .unionByName(attempts(orders.where(F.pmod(key, F.lit(2)) == 0), "2026-06-01 00:00:00", F.lit(200), F.lit(None).cast("string")))
    )
    tables = initialise(spark, f"{root}/state", buckets=8)
    result = harvest(spark, spark.read.parquet(f"{root}/pages"), [NOTICES], tables, NOW, fetch_log=log)
    return result.errors.select(F.col("external_id").cast("long").alias("o_orderkey"), "stage", "message")


def harvest_attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Notices of all orders with their two files through one run, read back from the attachments
    table. The first file of an order is in place already, downloaded, of another size than
    reported, or failed (by key modulo 4); the second is missing, over the size limit or
    downloaded (by key modulo 3)."""
    from gleanframe.functions.urls import attachment_path
    from gleanframe.operators.fetchlog import MAX_ATTACHMENT_BYTES
    from gleanframe.plans.harvest import Landed

    spark = prepare(spark)
    orders = render.orders(spark, folder)
    root = _run_folder(spark)
    lists = render.as_landed(render.notice_lists(orders, F.col("o_orderkey")), render.NOTICES, "list")
    details = render.as_landed(render.notice_pages(orders), render.NOTICES, "detail")
    for pages in (lists, _fetched(details, 2)):
        pages.write.mode("append").partitionBy("source", "role").parquet(f"{root}/pages")
    key = F.col("o_orderkey")
    first = F.concat(F.lit("https://n.example/docs/%D0%A2%D0%97%20"), key.cast("string"), F.lit(".PDF"))
    second = F.concat(F.lit("https://n.example/files?id="), key.cast("string"))
    files = f"{root}/files"
    stored = orders.where(F.pmod(key, F.lit(4)) == 0).select(
        attachment_path(F.lit(files), F.lit(render.NOTICES), key.cast("string"), first, F.concat(F.lit("ТЗ "), key.cast("string"), F.lit(".PDF"))).alias("path"),
        (F.lit(1000) + key).cast("bigint").alias("length"),
        F.sha2(F.concat(F.lit("stored "), key.cast("string")), 256).alias("sha256"),
    )

    def sent(rows: DataFrame, url: Column, reported: Column, length: Column, error: Column) -> DataFrame:
        return rows.select(
            url.alias("source_url"), F.lit("application/pdf").alias("content_type"), reported.cast("bigint").alias("reported_size"),
            length.cast("bigint").alias("length"), F.when(error.isNull(), F.sha2(url, 256)).alias("sha256"), error.cast("string").alias("error"),
        )

    way, other = F.pmod(key, F.lit(4)), F.pmod(key, F.lit(3))
    no_error = F.lit(None).cast("string")
    downloads = sent(
        orders.where(way != 0), first, F.lit(2000) + key, F.when(way == 2, F.lit(1999) + key).otherwise(F.lit(2000) + key),
        F.when(way == 3, F.lit("HTTP 500")),
    ).unionByName(
        sent(
            orders.where(other != 0), second,
            F.when(other == 1, F.lit(MAX_ATTACHMENT_BYTES + 1)).otherwise(F.lit(3000) + key),
            F.when(other == 1, F.lit(MAX_ATTACHMENT_BYTES + 1)).otherwise(F.lit(3000) + key), no_error,
        )
    )
    tables = initialise(spark, f"{root}/state", buckets=8)
    harvest(spark, spark.read.parquet(f"{root}/pages"), [NOTICES], tables, NOW, landed=Landed(downloads, stored, files))
    return tables["attachments"].read(spark).select(
        F.col("external_id").cast("long").alias("o_orderkey"), "source_url", "status", "size", "sha256", "error",
        (F.col("local_path").isNotNull()).alias("has_path"),
    )


def run_document(spark: SparkSession, folder: str) -> DataFrame:
    """The run report of all event users, with non-ASCII error messages, written as sorted lines
    and read back as one JSON document: per source and for ``all``, the counts, the number of
    errors and an MD5 of their messages in report order."""
    spark = prepare(spark)
    outcomes = _event_outcomes(spark, folder).withColumn("message", F.concat(F.lit("ошибка: "), F.col("message")))
    runs, errors = summary.run_summary(outcomes), summary.run_errors(outcomes)
    path = f"{_run_folder(spark)}/run-report"
    summary.summary_lines(runs, errors).orderBy(*summary.LINE_ORDER).select("line").write.text(path)
    return summary.read_lines(spark, path)
