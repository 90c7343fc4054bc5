"""Conversation prefix trie from padded turn-id matrices.

Every distinct (role, text) turn gets a 128-bit id (two 64-bit hashes). Conversations, as arrays
of turn ids, are range-partitioned by that array (then by ``conv_id``, so a hot conversation is
spread too) into shards of bounded rows. In a shard the arrays become a padded matrix (rows:
conversations, columns: depths), sorted by ``numpy.lexsort``; a column-wise change mask between
neighbouring rows, OR-accumulated along the depths, marks where each node of each depth starts,
and ``reduceat`` over those starts gives every node's members, smallest id, longest member and
ends at once. Subtree sums (leaves, saved tokens) are suffix sums along depths and prefix sums
along rows of the same matrix.

A node is whole inside one shard unless it holds the shard's first or last row. Those boundary
nodes (at most two root paths a shard) are merged across shards by Spark: their partial counts
are added by node key (a 128-bit hash of the prefix), their children and subtree sums come from
their own small table (each adds itself to its ancestors' keys), and their ends' digest is taken
in shard order, which is ascending ``conv_id`` order, by one streaming hash a node. Interior nodes
leave their shard finished; only those whose parent is a boundary node look up its ``conv_id``.

Defined cases: rows with a null ``conv_id`` belong to no conversation and are ignored; a null
role or text reads as empty, a null turn sorts first, and equal turns are ordered by role, then
text. ``c - c % 100`` uses SQL's remainder (the sign of ``c``). Repeated rows are repeated turns.
Very long texts only add to their length in code points; very long conversations widen the
matrix of their shard. An empty table gives no nodes. Only the four contract columns are read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from gleanframe.session import durable

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Trie:
    rebuild_every: int = 100
    rebuild_turns: int = 6
    shard_rows: int = 2000
    shard_cells: int = 4_000_000
    broadcast_rows: int = 200_000


def rebuilt(conversations: DataFrame, t: Trie = Trie()) -> DataFrame:
    """conv_id, pos (1-based), role, text of every rebuilt conversation (the contract's rule)."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = durable(rows.select("conv_id", F.row_number().over(order).alias("pos"), "role", "text"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n_own")).select(
        "conv_id",
        "n_own",
        (F.crc32(F.col("conv_id").cast("string")) % t.rebuild_turns).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % t.rebuild_every).alias("base"),
    )
    sizes = convs.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    convs = durable(
        convs.join(sizes, "base", "left").select(
            "conv_id", "base", "h", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))).alias("n_pref")
        )
    )
    head = turns.select(F.col("conv_id").alias("base"), "pos", "role", "text")
    first = convs.join(head, "base").where(F.col("pos") <= F.col("h")).select("conv_id", "pos", "role", "text")
    rest = turns.join(convs.select("conv_id", "h", "n_pref"), "conv_id").where(F.col("pos") > F.col("h"))
    rest = rest.select("conv_id", (F.col("n_pref") + F.col("pos") - F.col("h")).alias("pos"), "role", "text")
    return convs.select("conv_id"), first.union(rest)


SHARD_OUT = T.StructType(
    [
        T.StructField(n, k)
        for n, k in [
            ("k1", T.LongType()),
            ("k2", T.LongType()),
            ("depth", T.LongType()),
            ("edge", T.BooleanType()),
            ("shard", T.LongType()),
            ("conv_id", T.LongType()),
            ("n_convs", T.LongType()),
            ("tlen", T.LongType()),
            ("parent_k1", T.LongType()),
            ("parent_k2", T.LongType()),
            ("parent_conv_id", T.LongType()),
            ("parent_edge", T.BooleanType()),
            ("n_children", T.LongType()),
            ("n_leaves", T.LongType()),
            ("saved_tokens", T.LongType()),
            ("ends", T.StringType()),
            ("ancestors", T.ArrayType(T.ArrayType(T.LongType()))),
        ]
    ]
)

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + _M1
        z = (z ^ (z >> np.uint64(30))) * _M2
        z = (z ^ (z >> np.uint64(27))) * _M3
        return z ^ (z >> np.uint64(31))


def shard_nodes(conv_ids: np.ndarray, seqs: list, tlens: list, shard: int) -> pd.DataFrame:
    """Every node of one shard, finished for interior nodes and partial for the two root paths.

    ``seqs[i]`` is an (n, 2) int64 array of turn ids, ``tlens[i]`` the code points of each text.
    """
    rows = len(conv_ids)
    lengths = np.array([len(s) for s in seqs], np.int64)
    depth = int(lengths.max(initial=0))
    width = depth + 1
    m1 = np.zeros((rows, width), np.int64)
    m2 = np.zeros((rows, width), np.int64)
    tl = np.zeros((rows, width), np.int64)
    r_idx = np.repeat(np.arange(rows), lengths)
    c_idx = np.concatenate([np.arange(1, n + 1) for n in lengths]) if rows else np.zeros(0, np.int64)
    if len(r_idx):
        both = np.concatenate([s for s in seqs if len(s)])
        m1[r_idx, c_idx], m2[r_idx, c_idx] = both[:, 0], both[:, 1]
        tl[r_idx, c_idx] = np.concatenate([x for x in tlens if len(x)])
    present = np.arange(width)[None, :] <= lengths[:, None]
    keys = [conv_ids]
    for d in range(depth, 0, -1):
        keys += [m2[:, d], m1[:, d], present[:, d]]
    order = np.lexsort(keys)
    m1, m2, tl, present, lengths, ids = m1[order], m2[order], tl[order], present[order], lengths[order], conv_ids[order]

    # Node keys: a hash chain over the prefix, two independent 64-bit lanes.
    k1 = np.zeros((rows, width), np.uint64)
    k2 = np.zeros((rows, width), np.uint64)
    k2[:, 0] = _mix(np.full(rows, 7, np.uint64))
    for d in range(1, width):
        k1[:, d] = _mix(_mix(k1[:, d - 1] ^ m1[:, d].view(np.uint64)) ^ m2[:, d].view(np.uint64))
        k2[:, d] = _mix(_mix(k2[:, d - 1] + m2[:, d].view(np.uint64)) ^ _mix(m1[:, d].view(np.uint64)))
    k1, k2 = k1.view(np.int64), k2.view(np.int64)

    changed = (m1[1:] != m1[:-1]) | (m2[1:] != m2[:-1]) | (present[1:] != present[:-1])
    changed = np.logical_or.accumulate(changed, axis=1)
    starts = np.vstack([np.ones((1, width), bool), changed]) & present

    # Nodes depth by depth: rows [a, b), smallest id, longest member.
    levels = []
    for d in range(width):
        idx = np.flatnonzero(present[:, d])
        at = np.flatnonzero(starts[idx, d])
        a = idx[at]
        b = np.append(idx[at[1:] - 1] + 1, idx[-1] + 1) if len(at) else a
        levels.append(
            {
                "a": a,
                "b": b,
                "least": np.minimum.reduceat(ids[idx], at) if len(at) else a,
                "longest": np.maximum.reduceat(lengths[idx], at) if len(at) else a,
                "edge": (a == 0) | (b == rows),
            }
        )
    # Parents and children by depth.
    for d in range(1, width):
        up, here = levels[d - 1], levels[d]
        here["parent"] = np.searchsorted(up["a"], here["a"], side="right") - 1
        up["children_inner"] = np.bincount(here["parent"], weights=~here["edge"], minlength=len(up["a"])).astype(np.int64)
    levels[-1]["children_inner"] = np.zeros(len(levels[-1]["a"]), np.int64)
    # Contributions of interior nodes at their first row, then suffix sums along depths.
    leaf_at = np.zeros((rows, width), np.int64)
    saved_at = np.zeros((rows, width), np.int64)
    for d, level in enumerate(levels):
        inner = ~level["edge"]
        n = level["b"] - level["a"]
        leaf_at[level["a"][inner], d] = (level["longest"] == d)[inner]
        saved_at[level["a"][inner], d] = ((n - 1) * tl[level["a"], d])[inner]
    leaf_rows = np.vstack([np.zeros((1, width), np.int64), np.cumsum(np.cumsum(leaf_at[:, ::-1], axis=1)[:, ::-1], axis=0)])
    saved_rows = np.vstack([np.zeros((1, width), np.int64), np.cumsum(np.cumsum(saved_at[:, ::-1], axis=1)[:, ::-1], axis=0)])

    out = []
    for d, level in enumerate(levels):
        a, b = level["a"], level["b"]
        if not len(a):
            continue
        if d:
            parent = levels[d - 1]
            p = level["parent"]
            pk1, pk2 = k1[parent["a"][p], d - 1], k2[parent["a"][p], d - 1]
            pconv, pedge = parent["least"][p], parent["edge"][p]
        else:
            pk1 = pk2 = pconv = np.zeros(len(a), np.int64)
            pedge = np.zeros(len(a), bool)
        ends = []
        for lo, hi, edge in zip(a, b, level["edge"]):
            stop = lo + int(np.searchsorted(lengths[lo:hi] > d, True))  # members that end here come first
            text = ",".join(map(str, ids[lo:stop]))
            ends.append(text if edge else hashlib.sha256(text.encode()).hexdigest())
        ancestors = [
            [[int(k1[x, e]), int(k2[x, e])] for e in range(d)] if edge else None for x, edge in zip(a, level["edge"])
        ]
        out.append(
            pd.DataFrame(
                {
                    "k1": k1[a, d],
                    "k2": k2[a, d],
                    "depth": d,
                    "edge": level["edge"],
                    "shard": shard,
                    "conv_id": level["least"],
                    "n_convs": b - a,
                    "tlen": tl[a, d],
                    "parent_k1": pk1,
                    "parent_k2": pk2,
                    "parent_conv_id": pconv,
                    "parent_edge": pedge,
                    "n_children": level["children_inner"],
                    "n_leaves": leaf_rows[b, d] - leaf_rows[a, d],
                    "saved_tokens": saved_rows[b, d] - saved_rows[a, d],
                    "ends": ends,
                    "ancestors": ancestors,
                }
            )
        )
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=SHARD_OUT.names)


def _digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's ends, streamed over its shards in order (rows sorted by key, shard)."""
    key, sha, first = None, None, True
    out: list[tuple] = []
    for batch in batches:
        for k1, k2, ends in zip(batch["k1"], batch["k2"], batch["ends"]):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha, first = (k1, k2), hashlib.sha256(), True
            if ends:
                sha.update(((b"" if first else b",") + ends.encode()))
                first = False
        if len(out) > 1000:
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
            out = []
    if key is not None:
        out.append((*key, sha.hexdigest()))
    if out:
        yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, t: Trie = Trie()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    ids, turns = rebuilt(conversations, t)
    turns = turns.select(
        "conv_id",
        "pos",
        F.xxhash64("role", "text").alias("t1"),
        F.xxhash64(F.lit("second"), "text", "role").alias("t2"),
        F.length("text").cast("long").alias("tlen"),
    )
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "tlen"))).alias("s"))
    convs = durable(
        ids.join(lists, "conv_id", "left").select(
            "conv_id",
            # A conversation without turns has a null list: it sorts first, like an empty one.
            F.transform("s", lambda x: F.struct(x["t1"].alias("t1"), x["t2"].alias("t2"))).alias("seq"),
            F.transform("s", lambda x: x["t1"]).alias("t1s"),
            F.transform("s", lambda x: x["t2"]).alias("t2s"),
            F.transform("s", lambda x: x["tlen"]).alias("tlens"),
        )
    )
    size = convs.agg(F.count("*").alias("n"), F.max(F.size("seq")).alias("d")).first()
    if not size.n:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in NODE))
    shards = max(math.ceil(size.n / t.shard_rows), math.ceil(size.n * (size.d + 1) / t.shard_cells), 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = [b for b in batches if len(b)]
        if not part:
            return
        part = pd.concat(part, ignore_index=True)
        none = np.zeros(0, np.int64)
        seqs = [
            none.reshape(0, 2) if a is None else np.stack([np.asarray(a, np.int64), np.asarray(b, np.int64)], axis=1)
            for a, b in zip(part["t1s"], part["t2s"])
        ]
        tlens = [none if x is None else np.asarray(x, np.int64) for x in part["tlens"]]
        yield shard_nodes(part["conv_id"].to_numpy(np.int64), seqs, tlens, TaskContext.get().partitionId())

    nodes = durable(convs.repartitionByRange(shards, "seq", "conv_id").select("conv_id", "t1s", "t2s", "tlens").mapInPandas(run, SHARD_OUT))

    # Boundary nodes: partials added up by key.
    edge = nodes.where("edge")
    merged = durable(
        edge.groupBy("k1", "k2").agg(
            F.first("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.first("tlen").alias("tlen"),
            F.first("parent_k1").alias("parent_k1"),
            F.first("parent_k2").alias("parent_k2"),
            F.sum("n_children").alias("inner_children"),
            F.sum("n_leaves").alias("inner_leaves"),
            F.sum("saved_tokens").alias("inner_saved"),
            F.first("ancestors").alias("ancestors"),
        )
    )
    kids = merged.where("depth > 0").groupBy(F.col("parent_k1").alias("k1"), F.col("parent_k2").alias("k2")).agg(F.count("*").alias("edge_children"))
    own = durable(
        merged.join(kids, ["k1", "k2"], "left").select(
            "*",
            (F.col("inner_children") + F.coalesce("edge_children", F.lit(0))).alias("n_children"),
        ).select(
            "*",
            (F.col("n_children") == 0).cast("long").alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("tlen")).alias("saved"),
        )
    )
    up = own.select("leaf", "saved", F.explode("ancestors").alias("a")).groupBy(
        F.col("a")[0].alias("k1"), F.col("a")[1].alias("k2")
    ).agg(F.sum("leaf").alias("below_leaves"), F.sum("saved").alias("below_saved"))
    parents = own.select(F.col("k1").alias("parent_k1"), F.col("k2").alias("parent_k2"), F.col("conv_id").alias("parent_conv_id"))
    digests = edge.select("k1", "k2", "shard", "ends").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "shard")
    digests = digests.mapInPandas(_digest, "k1 long, k2 long, ends_sha256 string")
    boundary = durable(
        own.join(up, ["k1", "k2"], "left")
        .join(parents, ["parent_k1", "parent_k2"], "left")
        .join(digests, ["k1", "k2"])
        .select(
            "k1",
            "k2",
            "conv_id",
            "depth",
            F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"),
            "n_convs",
            "n_children",
            (F.col("leaf") + F.col("inner_leaves") + F.coalesce("below_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved") + F.col("inner_saved") + F.coalesce("below_saved", F.lit(0))).alias("saved_tokens"),
            "ends_sha256",
        )
    )
    # Interior nodes are finished but for a parent on a root path.
    inner = nodes.where(~F.col("edge")).withColumnRenamed("ends", "ends_sha256")
    lookup = boundary.select(F.col("k1").alias("parent_k1"), F.col("k2").alias("parent_k2"), F.col("conv_id").alias("edge_parent"))
    if boundary.count() <= t.broadcast_rows:
        lookup = F.broadcast(lookup)
    inner = inner.join(lookup, ["parent_k1", "parent_k2"], "left").select(
        *(F.when(F.col("parent_edge"), F.col("edge_parent")).otherwise(F.col("parent_conv_id")).alias(c) if c == "parent_conv_id" else c for c in NODE)
    )
    return inner.unionByName(boundary.select(*NODE))
