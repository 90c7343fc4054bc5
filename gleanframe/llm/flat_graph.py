"""Near-duplicate vectors over robust-pruned flat graphs.

Equal vectors of a label meet first and go on as one. The rest of a label is a cell; a label
too large for one cell is cut into cells around drawn pivots, each vector in the cell of its
nearest one, and a cell that is still too large is cut into pieces. Cells bound what a task holds.
No link is lost by the cut: two cells are compared through all vectors that lie near enough to
the border between them for a link across it, and such pairs are compared exhaustively.

Within a cell, vectors are dealt to overlapping cluster shards. Each shard's graph joins every
vector to near ones, pruned robustly: a candidate is dropped when a neighbour already taken is
much nearer to it. The adjacency lists of the shards are united, and every vector is searched
for from the nearest shard medoids: first greedily, then the range is expanded through all
vectors found within it until no new one appears. A sample of queries is audited against brute
force; when too few neighbours were found the search is repeated wider, and then exhaustively.
Each found pair is verified in double precision, and a link that one end finds holds for both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.llm.components import components
from gleanframe.session import durable


@dataclass(frozen=True)
class FlatGraph:
    """Parameters. A large label has at most ``most_pivots`` cells, ``cell_overlap`` for each ``cell_rows`` vectors."""

    threshold: float = 0.93
    cell_rows: int = 12_000
    most_pivots: int = 512
    cell_overlap: int = 3
    shard_rows: int = 800
    shard_overlap: int = 2
    candidates: int = 40
    degree: int = 16
    alpha: float = 1.2
    beam: int = 16
    entries: int = 4
    slack: float = 0.03
    audited: int = 64
    least_recall: float = 0.98
    queries_at_once: int = 256


def _shards(x: np.ndarray, p: FlatGraph) -> tuple[np.ndarray, np.ndarray]:
    """Nearest ``shard_overlap`` shards of each vector, and the medoid of each shard."""
    n = len(x)
    k = max(1, -(-n // p.shard_rows))
    centres = x[np.linspace(0, n - 1, k).astype(np.int64)]
    for _ in range(4):
        own = (x @ centres.T).argmax(axis=1)
        for s in range(k):
            inside = x[own == s]
            if len(inside):
                mean = inside.sum(axis=0)
                centres[s] = mean / max(float(np.linalg.norm(mean)), 1e-12)
    near = x @ centres.T
    some = min(p.shard_overlap, k)
    return np.argsort(-near, axis=1, kind="stable")[:, :some], near.argmax(axis=0)


def robust_prune(x: np.ndarray, p: FlatGraph) -> np.ndarray:
    """Adjacency of the vectors of one shard; -1 where a list is shorter."""
    n = len(x)
    out = np.full((n, p.degree), -1, np.int64)
    take = min(p.candidates, n - 1)
    if take < 1:
        return out
    for low in range(0, n, 512):
        rows = np.arange(low, min(n, low + 512))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -2
        pool = np.argpartition(-near, take - 1, axis=1)[:, :take]
        far = 1 - np.take_along_axis(near, pool, 1)
        alive = np.ones(pool.shape, bool)
        for k in range(min(p.degree, take)):
            best = np.where(alive, far, np.inf).argmin(axis=1)
            any_left = alive.any(axis=1)
            taken = np.where(any_left, pool[np.arange(len(rows)), best], -1)
            out[rows, k] = taken
            between = 1 - np.einsum("nd,nkd->nk", x[taken], x[pool])
            alive &= ~((p.alpha * between <= far) & any_left[:, None])
            alive[np.arange(len(rows)), best] = False
    return out


@dataclass(frozen=True)
class Graph:
    """United adjacency lists, end to end; ``table`` holds the first of each list in padded rows (-1: none)."""

    starts: np.ndarray
    counts: np.ndarray
    links: np.ndarray
    table: np.ndarray
    medoids: np.ndarray

    def neighbours(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All neighbours of the given vectors, and for each which of the given it belongs to."""
        sizes = self.counts[of]
        owner = np.repeat(np.arange(len(of)), sizes)
        ends = np.cumsum(sizes)
        inside = np.arange(len(owner)) - np.repeat(ends - sizes, sizes)
        return self.links[np.repeat(self.starts[of], sizes) + inside], owner


def united_graph(x: np.ndarray, p: FlatGraph) -> Graph:
    """The shards' adjacency lists united, with back links: a search reaches what no list names."""
    shards, medoids = _shards(x, p)
    heads, tails = [], []
    for s in range(len(medoids)):
        members = np.flatnonzero((shards == s).any(axis=1))
        lists = robust_prune(x[members], p)
        a, b = np.nonzero(lists >= 0)
        heads.append(members[a]), tails.append(members[lists[a, b]])
    u, v = np.concatenate(heads), np.concatenate(tails)
    pairs = np.unique(np.concatenate([u * len(x) + v, v * len(x) + u]))
    u, v = pairs // len(x), pairs % len(x)
    counts = np.bincount(u, minlength=len(x))
    starts = np.cumsum(counts) - counts
    table = np.full((len(x), 4 * p.degree), -1, np.int64)
    place = np.arange(len(u)) - starts[u]
    inside = place < table.shape[1]
    table[u[inside], place[inside]] = v[inside]
    return Graph(starts, counts, v, table, np.unique(medoids))


def _search(x: np.ndarray, graph: Graph, queries: np.ndarray, p: FlatGraph, beam: int, slack: float) -> np.ndarray:
    """Marks, for each query, the vectors found within the range."""
    n, q, table, medoids = len(x), len(queries), graph.table, graph.medoids
    found = np.zeros((q, n), bool)
    seen = np.zeros((q, n), bool)
    at = np.arange(q)
    y = x[queries]
    near = y @ x[medoids].T
    # A query is a vector of the graph: its own list is an entry beside the nearest medoids.
    entry = np.hstack([queries[:, None], medoids[np.argsort(-near, axis=1, kind="stable")[:, : p.entries]]])
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -3.0, np.float32)
    done = np.ones((q, beam), bool)
    width = min(entry.shape[1], beam)
    ids[:, :width] = entry[:, :width]
    sims[:, :width] = np.einsum("qd,qkd->qk", y, x[ids[:, :width]])
    done[:, :width] = False
    seen[at[:, None], ids[:, :width]] = True
    low = p.threshold - slack
    r, c = np.nonzero(sims[:, :width] >= low)
    found[r, ids[r, c]] = True
    while True:
        open_sims = np.where(done, -9.0, sims)
        best = open_sims.argmax(axis=1)
        active = np.flatnonzero(~done.all(axis=1))
        if not len(active):
            break
        done[active, best[active]] = True
        neighbours = table[ids[active, best[active]]]
        fresh = (neighbours >= 0) & ~seen[active[:, None], neighbours]
        new_sims = np.einsum("qd,qkd->qk", y[active], x[neighbours]).astype(np.float32)
        new_sims[~fresh] = -3.0
        r, c = np.nonzero(fresh)
        seen[active[r], neighbours[r, c]] = True
        hit = new_sims[r, c] >= low
        found[active[r[hit]], neighbours[r[hit], c[hit]]] = True
        all_ids = np.hstack([ids[active], neighbours])
        all_sims = np.hstack([sims[active], new_sims])
        all_done = np.hstack([done[active], ~fresh])
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[active] = np.take_along_axis(all_ids, keep, 1)
        sims[active] = np.take_along_axis(all_sims, keep, 1)
        done[active] = np.take_along_axis(all_done, keep, 1)
    front = found.copy()
    while front.any():
        r, c = np.nonzero(front)
        front = np.zeros_like(found)
        share = np.cumsum(graph.counts[c]) // 1_000_000
        for start, end in zip(*(np.searchsorted(share, np.unique(share), side) for side in ("left", "right"))):
            flat, owner = graph.neighbours(c[start:end])
            owner = r[start:end][owner]
            fresh = ~seen[owner, flat]
            pairs = np.unique(owner[fresh] * n + flat[fresh])
            owner, flat = pairs // n, pairs % n
            seen[owner, flat] = True
            for part in range(0, len(owner), 100_000):
                o, f = owner[part : part + 100_000], flat[part : part + 100_000]
                hit = np.einsum("kd,kd->k", y[o], x[f]) >= low
                found[o[hit], f[hit]] = True
                front[o[hit], f[hit]] = True
    return found


def _verified(x: np.ndarray, queries: np.ndarray, found: np.ndarray, p: FlatGraph) -> np.ndarray:
    """The found pairs whose cosine in double precision reaches the threshold."""
    out = np.zeros_like(found)
    r, c = np.nonzero(found)
    for low in range(0, len(r), 100_000):
        rr, cc = r[low : low + 100_000], c[low : low + 100_000]
        ok = np.einsum("kd,kd->k", x[queries[rr]], x[cc]) >= p.threshold
        out[rr[ok], cc[ok]] = True
    out[np.arange(len(queries)), queries] = False
    return out


def _exact(x: np.ndarray, queries: np.ndarray, p: FlatGraph) -> np.ndarray:
    return _verified(x, queries, x[queries] @ x.T >= p.threshold - 1e-9, p)


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cross_links(raw: np.ndarray, side: np.ndarray, p: FlatGraph) -> np.ndarray:
    """Packed bit rows of all links (both directions) between vectors of different sides (true, false)."""
    x = _unit(raw)
    n = len(x)
    links = np.zeros((n, -(-n // 8)), np.uint8)
    for mine, others in ((np.flatnonzero(side), np.flatnonzero(~side)), (np.flatnonzero(~side), np.flatnonzero(side))):
        step = max(1, 16_000_000 // n)
        for low in range(0, len(mine), step):
            queries = mine[low : low + step]
            near = x[queries] @ x[others].T
            hit = near >= p.threshold + 1e-9
            r, c = np.nonzero(np.abs(near - p.threshold) <= 1e-9)
            hit[r, c] = np.einsum("kd,kd->k", x[queries[r]], x[others[c]]) >= p.threshold
            rows = np.zeros((len(queries), n), bool)
            rows[:, others] = hit
            links[queries] = np.packbits(rows, axis=1)
    return links


def cell_links(raw: np.ndarray, p: FlatGraph) -> tuple[np.ndarray, float]:
    """Packed bit rows of verified links (both directions) among the vectors of one cell, and the audited recall."""
    x = _unit(raw)
    n = len(x)
    single = x.astype(np.float32)
    audit = np.unique(np.linspace(0, n - 1, min(n, p.audited)).astype(np.int64))
    truth = _exact(x, audit, p)
    links = np.zeros((n, -(-n // 8)), np.uint8)
    graph = united_graph(single, p)
    recall = 0.0
    for beam, slack in ((p.beam, p.slack), (4 * p.beam, 2 * p.slack)):
        got = _verified(x, audit, _search(single, graph, audit, p, beam, slack), p)
        recall = float(got[truth].mean()) if truth.any() else 1.0
        if recall >= p.least_recall:
            break
    step = max(1, min(p.queries_at_once, 64_000_000 // max(1, n)))
    for low in range(0, n, step):
        queries = np.arange(low, min(n, low + step))
        if recall >= p.least_recall:
            rows = _verified(x, queries, _search(single, graph, queries, p, beam, slack), p)
        else:
            rows = _exact(x, queries, p)
        links[queries] |= np.packbits(rows, axis=1)
        # What one end found holds for the other.
        r, c = np.nonzero(rows)
        np.bitwise_or.at(links, (c, queries[r] >> 3), (128 >> (queries[r] & 7)).astype(np.uint8))
    return links, recall


def _roots(links: np.ndarray, n: int) -> np.ndarray:
    """Smallest position each vector reaches."""
    root = np.full(n, -1, np.int64)
    for i in range(n):
        if root[i] >= 0:
            continue
        root[i] = i
        todo = [i]
        while todo:
            row = np.flatnonzero(np.unpackbits(links[todo.pop()], count=n))
            new = row[root[row] < 0]
            root[new] = i
            todo.extend(new.tolist())
    return root


def _cell(p: FlatGraph):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table.column("rep").to_pylist()), kind="stable")
        table = table.take(pa.array(order))
        rep = np.array(table.column("rep").to_pylist(), np.int64)
        many = np.array(table.column("copies").to_pylist(), np.int64)
        unit = np.array(table.column("unit").to_pylist(), np.int64)
        low, high = (table.column(c)[0].as_py() for c in ("low", "high"))
        raw = np.array(table.column("embedding").to_pylist(), np.float64)
        if low == high:
            links, _ = cell_links(raw, p)
        else:
            links = cross_links(raw, unit == low, p)
        counts = np.zeros(len(rep), np.int64)
        for i in range(len(rep)):
            counts[i] = many[np.flatnonzero(np.unpackbits(links[i], count=len(rep)))].sum()
        # The own cell names every vector; of a pair of cells only what is linked is told.
        told = (counts > 0) | (low == high)
        return pa.table({"rep": rep[told], "links": counts[told], "root": rep[_roots(links, len(rep))][told]})

    return run


def _usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def _nearest_pivots(p: FlatGraph, pivots: dict[tuple, np.ndarray]):
    """Adds to each vector of a large label the cell of its nearest pivot, and the cells it can have links in.

    The vectors of two cells are parted by the plane half-way between the pivots. A vector whose
    angle to that plane is larger than that of the threshold has no link across it.
    """
    across = np.sqrt(1 - p.threshold**2) if p.threshold > 0 else np.inf
    apart = {k: np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)) for k, x in pivots.items()}

    def run(batches):
        for batch in batches:
            keys = list(zip(batch.column("label").to_pylist(), batch.column("size").to_pylist()))
            homes, reach = [], []
            for key, vector in zip(keys, batch.column("embedding")):
                near = pivots[key] @ _unit(np.array([vector.as_py()]))[0]
                home = int(near.argmax())
                homes.append(home)
                reach.append(np.flatnonzero(near[home] - near <= across * apart[key][home] + 1e-6).tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("label", "size", "rep", "copies", "embedding")),
                    pa.array(homes, pa.int64()),
                    pa.array(reach, pa.list_(pa.int64())),
                ],
                names=["label", "size", "rep", "copies", "embedding", "home", "reach"],
            )

    return run


def _in_cells(reps: DataFrame, p: FlatGraph) -> DataFrame:
    """Each vector with its cell (home) and the cells it is compared with (reach)."""
    totals = reps.groupBy("label", "size").count().where(F.col("count") > p.cell_rows)
    large = totals.collect()  # labels with more than cell_rows vectors: their number is bounded by rows / cell_rows
    only = F.lit(0).cast("long")
    if not large:
        return reps.withColumn("home", only).withColumn("reach", F.array(only))
    pivots = {}
    for row in large:
        k = min(p.most_pivots, -(-p.cell_overlap * row["count"] // p.cell_rows) + 1)
        drawn = (
            reps.where((F.col("label") == row["label"]) & (F.col("size") == row["size"]))
            .orderBy(F.xxhash64("rep"), "rep")
            .limit(k)
            .collect()
        )
        pivots[(row["label"], row["size"])] = _unit(np.array([d["embedding"] for d in drawn]))
    marked = reps.join(F.broadcast(totals.select("label", "size", F.lit(True).alias("large"))), ["label", "size"], "left")
    rest = marked.where("large is null").drop("large").withColumn("home", only).withColumn("reach", F.array(only))
    dealt = marked.where("large").drop("large").select("label", "size", "rep", "copies", "embedding").mapInArrow(
        _nearest_pivots(p, pivots), "label int, size int, rep long, copies long, embedding array<double>, home long, reach array<long>"
    )
    return rest.select(dealt.columns).union(dealt)


def near_vectors(vectors: DataFrame, p: FlatGraph = FlatGraph()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding, label).

    Only vectors of one label and one length are compared. Null, zero and non-finite vectors,
    and those with a null label or a null vec_id, link with nothing: 0 links and their own
    component. Repeated rows of a vec_id are one vector. Other columns are ignored.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )
    good = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding"))).distinct()
    key = F.xxhash64("embedding")
    reps = durable(
        good.groupBy("label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
        .select("label", F.size("embedding").alias("size"), "rep", "copies", "embedding", key.alias("key"))
    )
    placed = durable(_in_cells(reps.drop("key"), p))
    sizes = placed.groupBy("label", "size", "home").agg(F.ceil(F.count("*") / p.cell_rows).alias("pieces"))
    there = sizes.select("label", "size", F.col("home").alias("to"), F.col("pieces").alias("to_pieces"))
    unit = lambda cell, piece: F.shiftleft(F.col(cell), 32) + piece
    grouped = (
        placed.join(sizes, ["label", "size", "home"])
        .withColumn("unit", unit("home", F.pmod(F.xxhash64("rep"), F.col("pieces"))))
        .withColumn("to", F.explode("reach"))
        .join(there, ["label", "size", "to"])
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("to_pieces") - 1)))
        .withColumn("other", unit("to", F.col("piece")))
        .select("label", "size", F.least("unit", "other").alias("low"), F.greatest("unit", "other").alias("high"), "unit", "rep", "copies", "embedding")
    )
    parts = durable(grouped.groupBy("label", "size", "low", "high").applyInArrow(_cell(p), "rep long, links long, root long"))
    counts = parts.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(parts.select("rep", "root"))
    named = (
        reps.join(counts, "rep")
        .join(joined, reps.rep == joined.node, "left")
        .select("label", "key", "embedding", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    keyed = rows.withColumn("key", key).alias("v")
    same = (
        (F.col("v.key") == F.col("r.key"))
        & (F.col("v.label") == F.col("r.label"))
        & (F.col("v.embedding") == F.col("r.embedding"))
        & F.col("v.vec_id").isNotNull()
    )
    return (
        keyed.join(named.alias("r"), same, "left")
        .select(
            "v.vec_id",
            F.coalesce("r.n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("r.component_id", "v.vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
