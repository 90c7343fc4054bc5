import random

from gleanframe.llm.packing import Packing, pack, pack_shard
from tests.llm.helpers import docs


def plain_pack(pieces, p):
    """The tightest compatible bin by looking at all."""
    bins = []
    out = {}
    for i, x in enumerate(sorted(pieces, key=lambda x: (-x[3], *((v is None, v) for v in (x[0], x[1], x[5], x[4]))))):
        fits = [
            (b["left"], k)
            for k, b in enumerate(bins)
            if b["left"] >= x[3] and x[5] not in b["clusters"] and b["sources"].count(x[4]) < p.per_source
        ]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"left": p.capacity, "clusters": set(), "sources": []})
        out[i] = (k, p.capacity - bins[k]["left"])
        bins[k]["left"] -= x[3]
        bins[k]["clusters"].add(x[5])
        bins[k]["sources"].append(x[4])
    return out


def test_shard_against_looking_at_all_bins():
    rng = random.Random(2)
    p = Packing(capacity=50, per_source=2)
    for _ in range(40):
        pieces = [(i, 0, 0, rng.randint(1, 50), rng.choice(["a", "a", "b", None]), rng.choice([i, 1000, 1001])) for i in range(rng.randint(1, 60))]
        got = [(x[6], x[8]) for x in pack_shard(pieces, p)]
        assert got == list(plain_pack(pieces, p).values())


def test_every_word_is_in_one_bin(spark):
    rng = random.Random(5)
    rows = [(i, " ".join("w%d" % rng.randint(0, 9) for _ in range(rng.choice([1, 5, 40, 700]))), "en", rng.choice(["a", "a", "b", None])) for i in range(200)]
    rows += [(900 + i, "the same text", "en", "a") for i in range(60)] + [(7, rows[7][1], "en", "b"), (None, "no id", None, None), (1000, None), (1001, " \n ")]
    p = Packing(capacity=100, per_source=3, pieces_per_shard=100)
    got = pack(docs(spark, rows), p).collect()
    assert sum(r.n_words for r in got) == sum(len((t or "").split()) for _, t, *_ in rows)
    bins = {}
    for r in got:
        bins.setdefault((r.shard, r.bin), []).append(r)
    text = {i: t for i, t, *_ in rows}
    for inside in bins.values():
        inside.sort(key=lambda r: r.place)
        assert [r.place for r in inside] == list(range(len(inside)))
        assert [r.offset for r in inside] == [sum(x.n_words for x in inside[:k]) for k in range(len(inside))]
        assert sum(r.n_words for r in inside) <= p.capacity
        keys = [text[r.doc_id] for r in inside]
        assert len(set(keys)) == len(keys)
        assert max([r.source for r in inside].count(s) for s in {r.source for r in inside}) <= p.per_source
    assert {r.doc_id for r in got} >= {None, 7} and not {r.doc_id for r in got} & {1000, 1001}
    assert pack(docs(spark, [])).count() == 0
