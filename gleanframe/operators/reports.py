"""Inspection queries over the stored tables.

Tables have natural keys, so "newest" is by ``first_seen_at`` with the key as tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEWEST = 20


def newest_listings(listings: DataFrame, count: int = NEWEST) -> DataFrame:
    return (
        listings.orderBy(F.desc("first_seen_at"), "source", "external_id")
        .limit(count)
        .select(
            "source", "kind", "external_id", "title", "price", "currency", "published_at", "url",
            "first_seen_at",
        )
    )


def newest_payload(listings: DataFrame) -> DataFrame:
    """Pretty JSON of the newest record's payload, which has its own shape."""
    newest = listings.orderBy(F.desc("first_seen_at"), "source", "external_id").limit(1)
    row = newest.select("raw_payload").first()
    shape = F.schema_of_json(F.lit(row.raw_payload if row else "{}"))
    pretty = F.to_json(
        F.from_json("raw_payload", shape), {"pretty": "true", "ignoreNullFields": "false"}
    )
    return newest.select("source", "external_id", pretty.alias("payload"))


def newest_attachments(attachments: DataFrame, count: int = NEWEST) -> DataFrame:
    return (
        attachments.orderBy(F.desc_nulls_last("downloaded_at"), "source", "external_id", "source_url")
        .limit(count)
        .select(
            "source", "external_id", "source_url", "filename", "status", "size", "sha256",
            "local_path", "error",
        )
    )


def counts_by_kind(listings: DataFrame) -> DataFrame:
    return (
        listings.groupBy("source", "kind").agg(F.count("*").alias("listings")).orderBy("source", "kind")
    )


def cursors_by_source(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.select("source", "cursor_at", "saved_at").orderBy("source")


def attachments_of_source(attachments: DataFrame, listings: DataFrame, source: str) -> DataFrame:
    """Number of one source's attachments whose listing is stored."""
    kept = listings.where(F.col("source") == source).select("source", "external_id")
    return attachments.join(kept, ["source", "external_id"]).agg(F.count("*").alias("attachments"))
