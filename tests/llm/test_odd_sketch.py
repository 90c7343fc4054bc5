import math
import random
import re
import tracemalloc

import numpy as np

from gleanframe.llm.components import components
from gleanframe.llm.odd_sketch import OddSketch, Sampler, near_duplicates, shingle_set
from tests.llm.helpers import docs


def sets_of(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent=85):
    sets = {i: sets_of(t) for i, t in rows}
    ids = sorted(sets)
    links = {i: [] for i in ids}
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links[a].append(b), links[b].append(a)
    least = {}
    for i in ids:
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in least:
                least[k] = i
                todo += links[k]
    return {i: (len(sets[i]), least[i], least[i] == i) for i in ids}


def family(rng, base, n, edits):
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randint(0, 10**6)}"
        yield " ".join(words)


def test_families_against_brute_force(spark):
    rng = random.Random(6)
    texts = []
    for n, length, edits in ((40, 120, 4), (25, 60, 2), (30, 200, 12), (5, 8, 1)):
        base = [f"W{rng.randint(0, 500)}" for _ in range(length)]
        texts += family(rng, base, n, edits)
    texts += [texts[0]] * 20 + [texts[0].upper(), "", None, " \n", "one", "ONE", "a b c d", "a b c d e", "é É", "  x"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows)
    for p in (OddSketch(), OddSketch(star_turns=0, members_per_task=2)):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs(spark, rows), p).collect()}
        assert got == want


def test_repeated_rows_null_ids_and_empty_tables(spark):
    same = "a long enough text that says the same thing to all"
    rows = [(5, same), (5, same), (2, same), (None, same), (None, None)]
    got = sorted(map(str, (tuple(r) for r in near_duplicates(docs(spark, rows)).drop("text_hash").collect())))
    assert got == sorted(map(str, [(5, 7, 2, False), (5, 7, 2, False), (2, 7, 2, True), (None, 7, None, True), (None, 0, None, True)]))
    assert near_duplicates(docs(spark, [])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(300, i) for i in range(301, 340)] + [(7, 7), (9, 8), (8, 9), (None, 3)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 300 for i in range(300, 340)} | {8: 8, 9: 8}
    assert got == want


def test_samples_of_large_sets_are_made_in_small_blocks():
    sampler = Sampler(OddSketch(bands=1, band_rows=1024, bits=2048))
    large = np.random.default_rng(1).integers(0, 2**63, 20_000, dtype=np.uint64)
    tracemalloc.start()
    sampler.samples(large)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1_000_000


def test_samples_agree_as_often_as_sets_are_similar():
    p = OddSketch(bands=1, band_rows=4096)
    sampler = Sampler(p)
    texts = [" ".join(f"w{i}" for i in range(a, a + 2_004)) for a in (0, 100, 400, 2_100)]
    first, *others = [shingle_set(t, 5) for t in texts]
    assert len(first) == 2_000
    for other, shared in zip(others, (1_900, 1_600, 0)):
        similarity = shared / (4_000 - shared)
        assert len(np.intersect1d(first, other)) == shared
        agree = np.mean(sampler.samples(first) == sampler.samples(other))
        assert abs(agree - similarity) <= 5 * math.sqrt(similarity * (1 - similarity) / p.samples)
