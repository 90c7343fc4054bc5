"""Continuous ingest of landed detail pages into the state tables.

Extraction is stateless and the same code as in batch; every micro-batch is merged by key,
so a replayed one changes nothing and is also recognised by its batch id. Whatever the order
in which files arrive, the newest fetch of a page and of a listing counts: an older one that
comes later is left out. Pages that fail are kept in the errors table until a newer fetch of
them succeeds, and a source with such pages keeps its cursor.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql import functions as F

from gleanframe.operators import constraints, records
from gleanframe.plans.harvest import outcome_rows, settle
from gleanframe.plans.spec import SourceSpec
from gleanframe.session import durable
from gleanframe.sources.pages import failed, newest_fetches, newest_pages, pages_of
from gleanframe.sources.state import StateTable

# Several pages may hold one listing: the newest fetch wins, then the last URL.
NEWEST = ("fetched_at", "url", "raw_payload")


def stream_records(details: DataFrame, spec: SourceSpec) -> DataFrame:
    """Listing records of one source's detail pages; works on batch and streaming frames."""
    extracted = records.extract_details(details, spec, keep=("fetched_at",))
    return records.complete_details(records.with_own_references(extracted), spec, keep=("fetched_at",))


def batch_records(pages: DataFrame, specs: list[SourceSpec]) -> DataFrame:
    """Checked records of a batch's pages, each in its newest fetch within the batch."""
    found = [stream_records(newest_pages(pages_of(pages, s.name, "detail")), s) for s in specs]
    return constraints.check_listings(reduce(DataFrame.unionByName, found))


def failed_pages(pages: DataFrame, specs: list[SourceSpec]) -> DataFrame:
    """Pages of a batch whose newest fetch failed, as rows of the errors table."""
    found = [
        newest_fetches(pages_of(pages, s.name, "detail"))
        .where(failed(F.col("status_code")))
        .select(
            F.lit(s.name).alias("source"),
            "url",
            F.lit("detail").alias("stage"),
            F.concat(F.lit("HTTP "), F.col("status_code")).alias("message"),
            "fetched_at",
        )
        for s in specs
    ]
    return reduce(DataFrame.unionByName, found)


def page_states(checked: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per page of the batch: what went wrong, or null for stage and message."""
    fine = constraints.valid_rows(checked).select(
        "source", "url", F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("message"), "fetched_at"
    )
    broken = constraints.violations(checked).select(
        "source", "url", F.lit("database").alias("stage"), F.col("violation").alias("message"), "fetched_at"
    )
    return failures.unionByName(fine).unionByName(broken)


def merge_errors(stored: DataFrame, states: DataFrame) -> DataFrame:
    """Open errors after the batch: the newest state of each page, if it is an error."""
    newest = F.max_by(
        F.struct("stage", "message", "fetched_at"), F.struct("fetched_at", F.coalesce("message", F.lit("")))
    )
    return (
        stored.unionByName(states)
        .groupBy("source", "url")
        .agg(newest.alias("s"))
        .select("source", "url", "s.*")
        .where("message is not null")
    )


def merge_fetches(stored: DataFrame, rows: DataFrame) -> DataFrame:
    return stored.unionByName(rows).groupBy("source", "external_id").agg(F.max("fetched_at").alias("fetched_at"))


def not_older(rows: DataFrame, fetches: DataFrame) -> DataFrame:
    """Rows that do not come from an older fetch than the stored listing."""
    known = fetches.select("source", "external_id", F.col("fetched_at").alias("stored_at"))
    joined = rows.join(known, ["source", "external_id"], "left")
    older = F.coalesce(F.col("fetched_at") < F.col("stored_at"), F.col("stored_at").isNotNull() & F.col("fetched_at").isNull())
    return joined.where(~older).drop("stored_at")


def _stream_id(spark: SparkSession) -> str:
    """Id of the running streaming query: kept in its checkpoint folder, new with a new folder.

    Raises outside a stream's batch, where the property is not set: batch ids would not be unique.
    """
    found = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if found is None:
        raise RuntimeError("no streaming query id here: merge_batch runs only inside a stream's batch")
    return found


def ingest_pages(
    pages: DataFrame,
    specs: list[SourceSpec],
    tables: dict[str, StateTable],
    checkpoint: str,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    query_name: str = "ingest",
    **trigger,
) -> StreamingQuery:
    """Start a query that merges each micro-batch and moves the cursors of clean sources.

    ``trigger`` is passed on, e.g. ``availableNow=True``.
    """

    def merge_batch(batch: DataFrame, batch_number: int) -> None:
        spark = batch.sparkSession
        batch_id = f"{_stream_id(spark)}-{batch_number}"
        if tables["checkpoints"].has_batch(spark, batch_id):
            return
        checked = durable(batch_records(batch, specs))
        states = durable(page_states(checked, failed_pages(batch, specs)))
        valid = constraints.valid_rows(checked)
        # Only the buckets of the batch's keys are read of the stored fetches.
        rows = durable(not_older(valid, tables["fetches"].read_touched(spark, valid)))
        # Both are merged before the listings: a batch that is repeated finds its own fetches, which are not newer.
        tables["errors"].merge(spark, states, merge_errors, batch_id)
        tables["fetches"].merge(spark, rows.select("source", "external_id", "fetched_at"), merge_fetches, batch_id)
        still_open = outcome_rows(
            tables["errors"].read(spark), "error", external_id=F.col("url"), published_at=F.lit(None)
        )
        settle(spark, rows, [still_open], tables, clock(), batch_id=batch_id, monotonic=True, order=NEWEST)

    writer = pages.writeStream.queryName(query_name).option("checkpointLocation", checkpoint)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.foreachBatch(merge_batch).start()
