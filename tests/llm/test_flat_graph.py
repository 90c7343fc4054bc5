import numpy as np

from gleanframe.llm.flat_graph import FlatGraph, cell_links, near_vectors, robust_prune

VECTORS = "vec_id long, embedding array<float>, label int, rep string, key string"


def clusters(seed, n, dims=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    return np.array([centres[rng.integers(12)] + rng.normal(size=dims) * rng.choice([0.05, 0.25, 0.6, 2.0]) for _ in range(n)])


def brute(vectors, threshold=0.93):
    ids = sorted(vectors)
    links = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            (x, la), (y, lb) = vectors[a], vectors[b]
            if a < b and la == lb and la is not None and x is not None and y is not None:
                if len(x) != len(y):
                    continue
                x, y = np.array(x, float), np.array(y, float)
                if np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any():
                    if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                        links[a].add(b), links[b].add(a)
    least = {}
    for i in ids:
        if i not in least:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in least:
                    least[k] = i
                    todo += links[k]
    return {i: (len(links[i]), least[i], least[i] == i) for i in ids}


def test_recall_against_brute_force():
    raw = clusters(1, 3000)
    links, audited = cell_links(raw, FlatGraph(shard_rows=300))
    x = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    truth = x @ x.T >= 0.93
    np.fill_diagonal(truth, False)
    got = np.unpackbits(links, axis=1, count=len(x)).astype(bool)
    assert not (got & ~truth).any() and (got & truth).sum() / truth.sum() > 0.99 and audited >= 0.98


def test_pruned_lists_drop_what_a_neighbour_covers():
    x = clusters(2, 200)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    p = FlatGraph()
    for i, row in enumerate(robust_prune(x, p)):
        taken = [j for j in row if j >= 0]
        assert i not in taken and len(set(taken)) == len(taken)
        for k, j in enumerate(taken):
            assert all(p.alpha * (1 - x[j] @ x[a]) > 1 - x[i] @ x[j] for a in taken[:k])


def check(spark, rows, p):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame([(*r, "x", "x") for r in rows], VECTORS), p).collect()}
    assert got == brute({i: (e, label) for i, e, label in rows})


def test_rows_against_brute_force_whole_and_in_cells_and_pieces(spark):
    raw = clusters(3, 240).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(raw)]
    rows += [(1000 + i, raw[4].tolist(), 0) for i in range(40)]
    rows += [(2000, None, 0), (2001, [0.0] * 24, 0), (2002, [float("nan")] * 24, 0), (2003, raw[4].tolist(), None), (2004, [float("inf")] + [1.0] * 23, 1), (2005, [1.0, 2.0], 0), (2006, [2.0, 4.0], 0)]
    rows += [(2007, [None] + [1.0] * 23, 0)]
    check(spark, [r for r in rows if r[0] != 2007], FlatGraph())
    check(spark, [r for r in rows if r[0] != 2007], FlatGraph(cell_rows=30, cell_overlap=3, most_pivots=2, least_recall=1.1))
    one = near_vectors(spark.createDataFrame([(2007, [None, 1.0], 0, "", "")], VECTORS)).collect()
    assert [tuple(r) for r in one] == [(2007, 0, 2007, True)]


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, [1.0, 0.0], 0, "", ""), (1, [1.0, 0.0], 0, "", ""), (2, [1.0, 0.01], 0, "", ""), (None, [1.0, 0.0], 0, "", "")]
    got = sorted(map(str, (tuple(r) for r in near_vectors(spark.createDataFrame(rows, VECTORS)).collect())))
    assert got == sorted(map(str, [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]))
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_many_cells_lose_no_link_of_a_dense_group(spark):
    rng = np.random.default_rng(5)
    group = rng.normal(size=24)
    dense = group + rng.normal(size=(200, 24)) * 0.3
    raw = np.concatenate([dense, clusters(6, 300), rng.normal(size=(100, 24))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(raw)]
    p = FlatGraph(cell_rows=50, least_recall=1.1)
    assert -(-p.cell_overlap * len(rows) // p.cell_rows) > 10 * p.cell_overlap
    check(spark, rows, p)
