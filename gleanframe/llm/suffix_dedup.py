"""Removes passages that occur more than once, by sorting suffixes deep and shallow.

Every byte goes that lies in a string of ``length`` bytes which starts anywhere else too. Which
starts are repeated is decided by sorting suffixes: multikey quicksort on 8-byte characters to a
shallow depth, then blind tries for the groups that still share a prefix. A blind trie keeps
for each node only the depth to which its suffixes agree and the byte they branch on; the tries
of all groups grow level by level.

Sorting all suffixes of a corpus would move every byte ``length`` times, so suffixes meet by
anchor. The anchor of a start is the place with the least hash of 16 bytes among its ``length``
bytes, the leftmost if they tie. It depends on these bytes alone, so equal strings have anchors
with equal bytes at equal distance. The starts of one anchor are neighbours; their bytes
together are its region, on average 590 bytes. Regions whose anchor's hash is found nowhere else
hold no repeated start. Regions that are equal as a whole are repeated as a whole. What is left,
mostly where a repeated passage begins or ends, is sorted, one region of each kind, in groups
with equal anchors. A group of more than ``regions_per_group`` is split and sorted in parts. What
is new to its part meets by digest, first in blocks of ``block`` starts: strings of one block,
counted from the anchor, have most bytes in common, so only blocks in which these are found
again are taken apart into their strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gleanframe.operators.joins import join_unique
from gleanframe.session import durable

_GRAM = 16
_POSITION_BITS = np.uint64(23)
_POSITION = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
_BLOCK = 1 << 22
_NO_ID = -(2**63)


@dataclass(frozen=True)
class Repeats:
    length: int = 400
    shallow: int = 4
    regions_per_group: int = 2000
    block: int = 32
    bytes_at_once: int = 1 << 21
    # An anchor met more often than this is spread over ``hot_salts`` tasks in the joins by anchor.
    hot_rows: int = 20_000
    hot_salts: int = 64


def words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number, the first byte highest; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(len(data) + 8, np.uint64)
    for shift in range(8):
        part = padded[shift : shift + (len(padded) - shift) // 8 * 8].view(">u8")
        place = out[shift::8]
        place[:] = part[: len(place)]
    return out[: len(data)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _window_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def regions(data: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(hash of the anchor, its place, first start, last start) of each run of starts with one anchor."""
    for block in range(0, max(0, len(data) - length + 1), _BLOCK):
        part = data[block : block + _BLOCK + length - 1]
        words = words_at(part)
        grams = len(part) - _GRAM + 1
        hashed = _mixed(words[:grams] * np.uint64(0x9E3779B97F4A7C15) + _mixed(words[8 : 8 + grams]))
        ranked = (hashed & ~_POSITION) | np.arange(grams, dtype=np.uint64)
        anchor = (_window_least(ranked, length - _GRAM + 1) & _POSITION).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        places = anchor[first]
        for a, at, s, e in zip(hashed[places].view(np.int64).tolist(), places.tolist(), first.tolist(), last.tolist()):
            yield a, block + at, block + s, block + e


_ANCHOR = "doc_key long, text_hash long, anchor long, region binary, at long, low long, high long"


def _anchors(p: Repeats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[list] = [[], [], [], [], [], [], []]
            for key, digest, value in zip(batch.column("doc_key").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("text")):
                raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
                for a, at, s, e in regions(np.frombuffer(raw, np.uint8), p.length):
                    row = (key, digest, a, xxhash.xxh3_128_digest(raw[s : e + p.length]), at, s, e)
                    for column, cell in zip(made, row):
                        column.append(cell)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_key", "text_hash", "anchor", "region", "at", "low", "high"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names=names)

    return run


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k in range(1, 9):
        out += x < np.uint64(1) << np.uint64(64 - 8 * k) if k < 8 else x == 0
    return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Numbers the runs of equal keys in sorted columns."""
    new = np.zeros(len(keys[0]), bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.cumsum(new)


def _without_single(group: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.bincount(group)[group] > 1) if len(group) else np.empty(0, np.int64)


def repeated(data: np.ndarray, starts: np.ndarray, p: Repeats) -> np.ndarray:
    """For each start whether another one begins an equal string of ``length`` bytes; equal strings get one number from 1."""
    words = words_at(np.concatenate([data, np.zeros(p.length + 16, np.uint8)]))
    out = np.zeros(len(starts), np.int64)
    who, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    # Shallow: multikey quicksort, all partitions of a depth at once.
    depth = 0
    for depth in range(0, 8 * p.shallow, 8):
        key = words[starts[who] + depth]
        order = np.lexsort((key, group))
        who, group, key = who[order], group[order], key[order]
        group = _groups(group, key)
        keep = _without_single(group)
        who, group = who[keep], group[keep]
    known = np.full(len(who), 8 * p.shallow)
    numbers = 0
    # Deep: blind tries of the groups that still agree.
    while len(who):
        group = _groups(group)
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        lead = starts[who[head]][group]
        mine = starts[who]
        agree = known.copy()
        going = np.arange(len(who))
        while len(going):
            x = words[mine[going] + agree[going]] ^ words[lead[going] + agree[going]]
            agree[going] += _leading_zero_bytes(x)
            going = going[(x == 0) & (agree[going] < p.length)]
        skip = np.minimum.reduceat(np.minimum(agree, p.length), head)[group]
        whole = skip >= p.length
        if whole.any():
            out[who[whole]] = numbers + 1 + group[whole]
            numbers += int(group[-1]) + 1
        who, group, skip = who[~whole], group[~whole], skip[~whole]
        if not len(who):
            break
        branch = data[starts[who] + skip]
        order = np.lexsort((branch, group))
        who, group, branch, skip = who[order], group[order], branch[order], skip[order]
        group = _groups(group, branch)
        keep = _without_single(group)
        who, group, known = who[keep], group[keep], skip[keep] + 1
    return out


def _runs(mark: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        yield a, b - 1


_SORTED = "doc_key long, text_hash long, low long, high long, core binary, bytes binary"


def _sort_groups(p: Repeats):
    """Spans of repeated bytes; for parts of a split group also the blocks to be compared, with what they share."""

    def decide(rows: list[tuple]) -> pa.RecordBatch:
        raw = b"".join(r[5] for r in rows)
        data = np.frombuffer(raw, np.uint8)
        sizes = np.array([len(r[5]) for r in rows])
        begin = np.cumsum(sizes) - sizes
        amount = sizes - p.length + 1
        starts = np.repeat(begin - (np.cumsum(amount) - amount), amount) + np.arange(amount.sum())
        same = repeated(data, starts, p)
        made: list[tuple] = []
        at = 0
        told: set[int] = set()
        for (_, split, key, digest, low, _, place), base, n in zip(rows, begin.tolist(), amount.tolist()):
            mine = same[at : at + n]
            at += n
            for a, b in _runs(mine > 0):
                made.append((key, digest, low + a, low + b + p.length, None, None))
            blocks: dict[int, list[int]] = {}
            for k, number in enumerate(mine.tolist() if split else ()):
                if number not in told:
                    blocks.setdefault((place - low - k) // p.block, []).append(k)
                if number:
                    told.add(number)
            for block, ks in blocks.items():
                # From the last start of the block to the end of the string at its first one.
                last = base + place - low - block * p.block
                core = raw[last : last - p.block + 1 + p.length]
                mark = xxhash.xxh3_128_digest(core, seed=block)
                for a, b in _runs(np.isin(np.arange(ks[0], ks[-1] + 1), ks)):
                    first, end = ks[0] + a, ks[0] + b + p.length
                    made.append((key, digest, low + first, low + end, mark, raw[base + first : base + end]))
        columns = list(zip(*made)) if made else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        names = ["doc_key", "text_hash", "low", "high", "core", "bytes"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, group = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "split", "doc_key", "text_hash", "low", "bytes", "at", "part"))):
                if (row[0], row[7]) != group and size >= p.bytes_at_once:
                    yield decide(rows)
                    rows, size = [], 0
                group = (row[0], row[7])
                rows.append(row[:7])
                size += len(row[5])
        if rows:
            yield decide(rows)

    return run


def _cut_regions(p: Repeats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], [], [], []]
            for key, digest, wanted, value in zip(
                *(batch.column(c).to_pylist() for c in ("doc_key", "text_hash", "wanted")), batch.column("text")
            ):
                raw = value.as_py().encode("utf-8", "surrogatepass")
                for w in wanted:
                    row = (w["anchor"], w["parts"] > 1, w["part"], key, digest, w["at"], w["low"], raw[w["low"] : w["high"] + p.length])
                    for column, cell in zip(columns, row):
                        column.append(cell)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["anchor", "split", "part", "doc_key", "text_hash", "at", "low", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


_STRING = "doc_key long, text_hash long, low long, digest binary"


def _strings(p: Repeats):
    """The digests of all strings of ``length`` bytes in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, digest, low + k, xxhash.xxh3_128_digest(raw[k : k + p.length]))
                for key, digest, low, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_key", "text_hash", "low", "bytes")))
                for k in range(len(raw) - p.length + 1)
            ]
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_key", "text_hash", "low", "digest"]
            )

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_key"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )


def repeated_spans(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """doc_key, text_hash, low, high: byte spans of ``docs`` to remove; they may overlap."""
    texts = _keyed(docs)
    anchors = durable(texts.drop("doc_id").mapInArrow(_anchors(p), _ANCHOR))
    kinds = anchors.groupBy("anchor", "region").agg(F.count("*").alias("times"))
    met = (
        kinds.groupBy("anchor")
        .agg(F.sum("times").alias("all"), F.count("*").alias("kinds"))
        .where("all > 1")
        .select("anchor", "kinds")
    )
    # An anchor of a passage that many documents share is a hot key: its rows are salted.
    chosen = durable(join_unique(anchors, met, ["anchor"], "inner", p.hot_rows, p.hot_salts))
    times = chosen.groupBy("anchor", "region").agg(F.count("*").alias("times"), F.min(F.struct("doc_key", "text_hash", "at", "low", "high")).alias("one"), F.first("kinds").alias("kinds"))
    times = durable(times)
    again_met = times.where("times > 1").select("anchor", "region")
    whole = join_unique(chosen, again_met, ["anchor", "region"], "inner", p.hot_rows, p.hot_salts).select(
        "doc_key", "text_hash", "low", (F.col("high") + p.length).alias("high")
    )
    mixed = times.where("kinds > 1").select("anchor", "one.*", F.ceil(F.col("kinds") / p.regions_per_group).alias("parts"))
    wanted = mixed.groupBy("doc_key", "text_hash").agg(
        F.collect_list(
            F.struct("anchor", "at", "low", "high", "parts", F.pmod(F.xxhash64("doc_key", "low"), F.col("parts")).alias("part"))
        ).alias("wanted")
    )
    cut = (
        texts.drop("doc_id")
        .join(wanted, ["doc_key", "text_hash"])
        .dropDuplicates(["doc_key", "text_hash"])
        .mapInArrow(_cut_regions(p), "anchor long, split boolean, part long, doc_key long, text_hash long, at long, low long, bytes binary")
    )
    found = durable(
        cut.repartition("anchor", "part").sortWithinPartitions("anchor", "part").mapInArrow(_sort_groups(p), _SORTED)
    )
    blocks = found.where("core is not null")
    shared = blocks.groupBy("core").count().where("count > 1").select("core")
    strings = durable(blocks.join(shared, "core").drop("core", "high").mapInArrow(_strings(p), _STRING))
    again = strings.groupBy("digest").count().where("count > 1").select("digest")
    split = strings.join(again, "digest").select("doc_key", "text_hash", "low", (F.col("low") + p.length).alias("high"))
    return whole.union(found.where("core is null").drop("core", "bytes")).union(split)


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string"


def _remove(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, spans, value in zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist(), batch.column("text")):
                raw = (value.as_py() or "").encode("utf-8", "surrogatepass")
                kept, at, runs, end = [], 0, 0, -1
                for s in sorted((s["low"], s["high"]) for s in spans or ()):
                    if s[0] > end:
                        runs += 1
                        kept.append(raw[at : s[0]])
                    end = max(end, s[1])
                    at = max(at, end)
                left = b"".join([*kept, raw[at:]])
                text = left.decode("utf-8", "ignore") if keep_text else None
                rows.append((doc, len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest(), text))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"],
            )

    return run


def remove_repeats(docs: DataFrame, p: Repeats = Repeats(), keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and the kept text if asked for.

    Null texts read as empty. Texts of fewer than ``length`` bytes stay whole. Repeated rows,
    of one doc_id or none, repeat each other's text and lose it where it is long enough. Where
    a cut splits a character, its rest counts in the digest and is left out of ``kept_text``.
    Other columns are ignored.
    """
    spans = (
        repeated_spans(docs, p)
        .groupBy("doc_key", "text_hash")
        .agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    )
    joined = _keyed(docs).join(spans, ["doc_key", "text_hash"], "left").select("doc_id", "text", "spans")
    out = joined.mapInArrow(_remove(keep_text), _OUT)
    return out if keep_text else out.drop("kept_text")
