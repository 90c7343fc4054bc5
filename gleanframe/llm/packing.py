"""Conflict-constrained best-fit packing of documents into training sequences.

Documents are cut into pieces of at most ``capacity`` words and packed, longest first. Open
bins are ordered by what they have left; each carries bitmaps of the sources and duplicate
clusters inside. The search starts at the first bin with just enough room and goes on to its
successors until the tightest compatible bin is found; only if none is, a bin is opened. No bin
holds two pieces of one cluster, nor more than ``per_source`` pieces of one source.

Bins never cross shards. Pieces are dealt to shards by hash of document and piece, so sources
and groups of copies spread evenly, and the number of shards follows the number of pieces:
a shard has about ``pieces_per_shard`` of them, whatever the input. Only five narrow columns
are shuffled.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.session import durable


@dataclass(frozen=True)
class Packing:
    capacity: int = 2048
    per_source: int = 8
    pieces_per_shard: int = 4000


def word_count(text: Column) -> Column:
    """Whitespace-separated words; 0 for null or blank texts."""
    # Each word begins at a character that follows whitespace or the start.
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def cluster_key(text: Column) -> Column:
    """Equal for texts that differ in case and whitespace only."""
    return F.xxhash64(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


class Bins:
    """Open bins of one shard, ordered by what is left in them."""

    def __init__(self, p: Packing):
        self.p = p
        self.order: list[tuple[int, int]] = []  # (left, bin)
        self.sources: list[list[int]] = []  # per bin: bitmap of sources present 1, 2, ... times
        self.clusters: list[int] = []
        self.next_place: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int, int]:
        """Puts a piece away; bin, its place there, and the words before it."""
        at = bisect.bisect_left(self.order, (size, -1))
        while at < len(self.order):
            left, bin_no = self.order[at]
            if not self.clusters[bin_no] & cluster and not self.sources[bin_no][-1] & source:
                del self.order[at]
                break
            at += 1
        else:
            left, bin_no = self.p.capacity, len(self.clusters)
            self.sources.append([0] * self.p.per_source)
            self.clusters.append(0)
            self.next_place.append(0)
        self.clusters[bin_no] |= cluster
        for k, present in enumerate(self.sources[bin_no]):
            if not present & source:
                self.sources[bin_no][k] |= source
                break
        bisect.insort(self.order, (left - size, bin_no))
        place = self.next_place[bin_no]
        self.next_place[bin_no] += 1
        return bin_no, place, self.p.capacity - left


def pack_shard(pieces: list[tuple], p: Packing) -> list[tuple]:
    """(doc_id, piece, first_word, size, source, cluster) -> with bin, place, words before.

    Clusters that occur once in the shard need no bit.
    """
    pieces = sorted(pieces, key=lambda x: (-x[3], *((v is None, v) for v in (x[0], x[1], x[5], x[4]))))
    often: dict = {}
    for x in pieces:
        often[x[5]] = often.get(x[5], 0) + 1
    bits: dict = {}
    names: dict = {}
    bins, out = Bins(p), []
    for x in pieces:
        cluster = 1 << bits.setdefault(x[5], len(bits)) if often[x[5]] > 1 else 0
        source = 1 << names.setdefault(x[4], len(names))
        out.append((*x, *bins.place(x[3], source, cluster)))
    return out


_OUT = "doc_id long, piece long, first_word long, n_words long, source string, shard long, bin long, place long, offset long"


def _pack(p: Packing):
    def packed(shard: int, pieces: list[tuple]) -> pa.RecordBatch:
        rows = pack_shard(pieces, p)
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(columns[0], pa.int64()),
                pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.int64()),
                pa.array(columns[3], pa.int64()),
                pa.array(columns[4], pa.string()),
                pa.array([shard] * len(rows), pa.int64()),
                pa.array(columns[6], pa.int64()),
                pa.array(columns[7], pa.int64()),
                pa.array(columns[8], pa.int64()),
            ],
            names=["doc_id", "piece", "first_word", "n_words", "source", "shard", "bin", "place", "offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pieces = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "piece", "first_word", "n_words", "source", "cluster"))):
                if row[0] != shard and pieces:
                    yield packed(shard, pieces)
                    pieces = []
                shard = row[0]
                pieces.append(row[1:])
        if pieces:
            yield packed(shard, pieces)

    return run


def pack(docs: DataFrame, p: Packing = Packing()) -> DataFrame:
    """Where every piece of every document goes.

    doc_id, piece (from 0), first_word and n_words of the piece, source, shard, bin (from 0 in
    its shard), place in the bin (from 0) and offset, the words before it there. Bins are named
    by shard and bin. Null and blank texts have no words and are in no bin; a null source is a
    source of its own. Repeated rows are packed each, never two into one bin. Other columns are
    ignored.
    """
    sized = durable(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).cast("long").alias("words"),
            cluster_key(F.col("text")).alias("cluster"),
        ).where("words > 0")
    )
    pieces = sized.withColumn(
        "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("words") / p.capacity) - 1))
    ).select(
        "doc_id",
        "source",
        "cluster",
        "piece",
        (F.col("piece") * p.capacity).alias("first_word"),
        F.least(F.lit(p.capacity), F.col("words") - F.col("piece") * p.capacity).cast("long").alias("n_words"),
    )
    total = sized.agg(F.sum(F.ceil(F.col("words") / p.capacity))).first()[0] or 0
    shards = max(1, -(-total // p.pieces_per_shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)))
    return (
        dealt.repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(_pack(p), _OUT)
    )
