"""Keyed merges. DataFrames in, DataFrames out; storage is in ``gleanframe.sources.state``."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanframe.schemas import ATTACHMENT_KEYS, LISTING_KEYS, LISTING_PAYLOAD

ERROR_TEXT_MAX = 2000
FAILED = "failed"
DOWNLOADED = "downloaded"


def latest_per_key(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Last row per key in ``order`` and the number of rows it stands for.

    An aggregate rather than a window: rows of a hot key are combined before the shuffle.
    """
    row = F.struct(*columns)
    return (
        df.groupBy(*keys)
        .agg(F.max_by(row, F.struct(*order)).alias("row"), F.count("*").alias("batch_rows"))
        .select(*keys, "row.*", "batch_rows")
    )


def upsert_listings(
    stored: DataFrame,
    incoming: DataFrame,
    now: datetime | Column,
    order: Sequence[str] = ("page_no", "pos"),
) -> DataFrame:
    """Stored listings after the batch, one row per key.

    Every payload column is overwritten, also with null; ``first_seen_at`` is kept and
    ``updated_at`` set even if nothing changed. Two extra columns say what happened:
    ``change`` ('inserted', 'updated' or null) and ``batch_rows``.
    """
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    new = latest_per_key(incoming, LISTING_KEYS, LISTING_PAYLOAD, order).alias("n")
    old = stored.withColumn("stored", F.lit(True)).alias("o")
    joined = old.join(new, list(LISTING_KEYS), "full_outer")
    is_new = F.col("n.batch_rows").isNotNull()
    was_stored = F.coalesce(F.col("o.stored"), F.lit(False))

    return joined.select(
        *LISTING_KEYS,
        *[
            F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
            for c in LISTING_PAYLOAD
        ],
        F.when(was_stored, F.col("o.first_seen_at")).otherwise(now).alias("first_seen_at"),
        F.when(is_new, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
        F.when(is_new & was_stored, F.lit("updated"))
        .when(is_new, F.lit("inserted"))
        .alias("change"),
        F.coalesce(F.col("n.batch_rows"), F.lit(0)).alias("batch_rows"),
    )


def change_counts(merged: DataFrame) -> DataFrame:
    """Rows inserted and updated per source.

    Of several batch rows with one new key the first inserts and the others update it.
    """
    inserted = F.when(F.col("change") == "inserted", 1).otherwise(0)
    return (
        merged.where("change is not null")
        .groupBy("source")
        .agg(
            F.sum(inserted).alias("inserted"),
            F.sum(F.col("batch_rows") - inserted).alias("updated"),
        )
    )


_ATTACHMENT_FIELDS = (
    "filename", "content_type", "size", "sha256", "local_path", "status", "error"
)
_KEPT_ON_FAILURE = ("size", "sha256", "local_path")


def merge_attachments(
    stored: DataFrame,
    outcomes: DataFrame,
    now: datetime | Column,
    order: Sequence[str] = ("page_no", "pos", "item"),
) -> DataFrame:
    """Stored attachment rows after the batch.

    A success overwrites everything. A failure sets name, type, status and error and keeps
    what an earlier success left, be it stored or earlier in the same batch.
    """
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    rank = F.struct(*order)
    row = F.struct(*_ATTACHMENT_FIELDS)
    success = F.col("status") != FAILED
    new = (
        outcomes.groupBy(*ATTACHMENT_KEYS)
        .agg(
            F.max_by(row, rank).alias("last"),
            F.max_by(F.when(success, row), F.when(success, rank)).alias("good"),
        )
        .alias("n")
    )
    joined = stored.withColumn("stored", F.lit(True)).alias("o").join(
        new, list(ATTACHMENT_KEYS), "full_outer"
    )
    is_new = F.col("n.last").isNotNull()
    has_good = F.col("n.good").isNotNull()

    def taken(name: str) -> Column:
        value = F.col(f"n.last.{name}")
        if name in _KEPT_ON_FAILURE:
            value = F.when(has_good, F.col(f"n.good.{name}")).otherwise(F.col(f"o.{name}"))
        elif name == "error":
            failed = F.col("n.last.status") == FAILED
            value = F.when(failed, F.left(value, F.lit(ERROR_TEXT_MAX))).otherwise(value)
        return F.when(is_new, value).otherwise(F.col(f"o.{name}")).alias(name)

    return joined.select(
        *ATTACHMENT_KEYS,
        *[taken(c) for c in _ATTACHMENT_FIELDS],
        F.when(has_good, now).otherwise(F.col("o.downloaded_at")).alias("downloaded_at"),
    )


def merge_checkpoints(
    stored: DataFrame, cursors: DataFrame, now: datetime | Column, monotonic: bool = False
) -> DataFrame:
    """Stored cursors overwritten by new ones, which may move back unless ``monotonic``."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    joined = stored.alias("o").join(
        cursors.select("source", "cursor_at").alias("n"), "source", "full_outer"
    )
    new = F.col("n.cursor_at")
    if monotonic:
        new = F.when(new.isNotNull(), F.greatest(new, F.col("o.cursor_at")))
    return joined.select(
        "source",
        F.coalesce(new, F.col("o.cursor_at")).alias("cursor_at"),
        F.when(F.col("n.cursor_at").isNotNull(), now).otherwise(F.col("o.saved_at")).alias("saved_at"),
    )
