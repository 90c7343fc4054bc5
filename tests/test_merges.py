from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from gleanframe import schemas
from gleanframe.operators import constraints, merge, reports
from tests.helpers import utc

NOW = datetime(2027, 3, 5, 12, tzinfo=timezone.utc)
OLD = datetime(2026, 1, 1, tzinfo=timezone.utc)
BATCH = ", ".join(["source string, external_id string", "kind string, number string, title string",
                   "description string, customer_name string, status string, published_at timestamp",
                   "deadline_at timestamp, price decimal(18,2), currency string, url string",
                   "raw_payload string, page_no int, pos int"])


def stored(spark, *keys):
    rows = [
        ("s", k, "purchase", k, f"old {k}", "old", "c", "open", OLD, OLD, Decimal("1.00"), "RUB", "/old", "{}", OLD, OLD)
        for k in keys
    ]
    return spark.createDataFrame(rows, schemas.LISTINGS)


def incoming(spark, *rows):
    full = [
        ("s", k, "purchase", None, title, None, None, None, None, None, None, None, "/new", "{}", page_no, pos)
        for k, title, page_no, pos in rows
    ]
    return spark.createDataFrame(full, BATCH)


def test_upsert(spark):
    merged = merge.upsert_listings(stored(spark, "a", "b"), incoming(spark, ("a", "A", 0, 0), ("c", "C", 0, 1)), NOW)
    rows = {r.external_id: r for r in merged.collect()}
    a, b, c = rows["a"], rows["b"], rows["c"]
    # Payload is overwritten with null too; the first date stays.
    assert (a.title, a.description, a.price, a.change) == ("A", None, None, "updated")
    assert (a.first_seen_at, a.updated_at) == (utc(2026, 1, 1), utc(2027, 3, 5, 12))
    assert (b.title, b.change, b.updated_at, b.batch_rows) == ("old b", None, utc(2026, 1, 1), 0)
    assert (c.title, c.change, c.first_seen_at) == ("C", "inserted", utc(2027, 3, 5, 12))


def test_upsert_collisions_keep_crawl_order(spark):
    batch = incoming(spark, ("a", "2nd", 1, 0), ("a", "1st", 0, 5), ("n", "1st", 0, 1), ("n", "3rd", 2, 0), ("n", "2nd", 1, 9))
    merged = merge.upsert_listings(stored(spark, "a"), batch, NOW)
    assert {r.external_id: r.title for r in merged.collect()} == {"a": "2nd", "n": "3rd"}
    counts = merge.change_counts(merged).first()
    assert (counts.inserted, counts.updated) == (1, 4)


FILE = schemas.ATTACHMENTS.replace(", downloaded_at timestamp", ", page_no int, pos int, item int")


def outcome(key, status, order, size=None, error=None, name="new"):
    good = status == "downloaded"
    return ("s", key, "/f", name, None, size, "sha" if good else None, "p" if good else None, status, error, order, 0, 0)


def test_attachment_merge(spark):
    old = spark.createDataFrame(
        [("s", k, "/f", "old", "t", 5, "oldsha", "oldpath", "downloaded", None, OLD) for k in "abc"], schemas.ATTACHMENTS
    )
    batch = spark.createDataFrame(
        [
            outcome("a", "failed", 0, error="x" * 3000),
            outcome("b", "downloaded", 0, size=9),
            outcome("d", "failed", 0, error="never"),
            outcome("e", "downloaded", 0, size=7), outcome("e", "failed", 1, error="later"),
            outcome("f", "failed", 0, error="first"), outcome("f", "downloaded", 1, size=8),
        ],
        FILE,
    )
    rows = {r.external_id: r for r in merge.merge_attachments(old, batch, NOW).collect()}
    a, b, c, d, e, f = (rows[k] for k in "abcdef")
    assert (a.status, a.size, a.sha256, a.local_path, a.downloaded_at) == ("failed", 5, "oldsha", "oldpath", utc(2026, 1, 1))
    assert (a.filename, a.content_type, len(a.error)) == ("new", None, 2000)
    assert (b.status, b.size, b.sha256, b.error, b.downloaded_at) == ("downloaded", 9, "sha", None, utc(2027, 3, 5, 12))
    assert (c.filename, c.size) == ("old", 5)
    assert (d.status, d.size, d.downloaded_at) == ("failed", None, None)
    assert (e.status, e.size, e.error, e.downloaded_at) == ("failed", 7, "later", utc(2027, 3, 5, 12))
    assert (f.status, f.size, f.error) == ("downloaded", 8, None)


def test_checkpoints_can_move_back(spark):
    old = spark.createDataFrame([("a", NOW, OLD), ("b", OLD, OLD)], schemas.CHECKPOINTS)
    new = spark.createDataFrame([("a", OLD), ("c", NOW)], "source string, cursor_at timestamp")
    got = {r.source: (r.cursor_at, r.saved_at) for r in merge.merge_checkpoints(old, new, NOW).collect()}
    assert got == {
        "a": (utc(2026, 1, 1), utc(2027, 3, 5, 12)), "b": (utc(2026, 1, 1), utc(2026, 1, 1)),
        "c": (utc(2027, 3, 5, 12), utc(2027, 3, 5, 12)),
    }
    kept = merge.merge_checkpoints(old, new, NOW, monotonic=True).where("source = 'a'").first()
    assert kept.cursor_at == utc(2027, 3, 5, 12)


def test_constraints(spark):
    rows = incoming(spark, ("a", "A", 0, 0), ("b", None, 0, 1), ("c", "C", 0, 2), ("d", "D", 0, 3)).withColumns(
        {
            "kind": F.when(F.col("external_id") == "c", F.lit("other")).otherwise(F.col("kind")),
            "price": F.when(F.col("external_id") == "d", F.lit("1e17")).otherwise(F.lit("1.005")).cast("decimal(38,10)"),
        }
    )
    checked = constraints.check_listings(rows)
    assert {r.external_id: r.price for r in constraints.valid_rows(checked).collect()} == {"a": Decimal("1.01")}
    bad = {r.external_id: r.violation for r in constraints.violations(checked).collect()}
    assert bad["b"] == "title must not be null" and bad["c"] == "unknown kind: other"
    assert bad["d"].startswith("price out of range")


def test_keys_orphans_and_cascade(spark):
    parents = stored(spark, "a", "b")
    children = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", "z", 3)], "source string, external_id string, n int")
    keys = ["source", "external_id"]
    assert [r.n for r in constraints.orphans(children, parents, keys).collect()] == [3]
    left, kept = constraints.delete_cascade(parents, children, parents.where("external_id = 'a'"), keys)
    assert [r.external_id for r in left.collect()] == ["b"] and sorted(r.n for r in kept.collect()) == [2, 3]
    doubled = parents.unionByName(stored(spark, "b"))
    assert [(r.external_id, r.rows) for r in constraints.duplicate_keys(doubled, keys).collect()] == [("b", 2)]


def test_reports(spark):
    listings = stored(spark, "b", "a").unionByName(
        stored(spark, "c").withColumns({"first_seen_at": F.lit(NOW), "raw_payload": F.lit('{"é": null, "k": [1]}')})
    )
    assert [r.external_id for r in reports.newest_listings(listings, 2).collect()] == ["c", "a"]
    assert reports.newest_payload(listings).first().payload == '{\n  "k" : [ 1 ],\n  "é" : null\n}'
    assert reports.newest_payload(listings.limit(0)).collect() == []
    assert [tuple(r) for r in reports.counts_by_kind(listings).collect()] == [("s", "purchase", 3)]


def test_reading_touched_buckets_lists_only_their_files(spark, tmp_path):
    from gleanframe.sources.state import StateTable

    table = StateTable(str(tmp_path / "fetches"), "source string, external_id string, fetched_at timestamp", ("source", "external_id"), ("source",), 8)
    table.create(spark)
    rows = spark.createDataFrame([("s", str(i), None) for i in range(400)], table.schema)
    table.merge(spark, rows, lambda old, new: old.unionByName(new))
    few = rows.where("external_id in ('1', '2')")
    buckets = table.touched(few)
    read = table.read_touched(spark, few)
    assert 1 <= len(buckets) <= 2 and all(any(f"bucket={b}" in f for b in buckets) for f in read.inputFiles())
    assert {r.external_id for r in few.collect()} <= {r.external_id for r in read.collect()} and read.count() < 400
