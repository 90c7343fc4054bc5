import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from gleanframe.llm.suffix_dedup import Repeats, regions, remove_repeats, repeated
from tests.llm.helpers import docs


def removed(raws, length):
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        mark = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                mark[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], mark.astype(np.int8)])) == 1).sum())
        kept = np.frombuffer(r, np.uint8)[~mark].tobytes()
        out.append((len(r), int(mark.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_sorter_finds_equal_strings():
    rng = random.Random(3)
    p = Repeats(length=40, shallow=2)
    for _ in range(150):
        alphabet = rng.choice([b"a", b"ab", b"abcdefgh"])
        parts = [bytes(rng.choice(alphabet) for _ in range(rng.randint(0, 150))) for _ in range(4)]
        raw = b"".join(rng.choice(parts) for _ in range(6))
        if len(raw) < p.length:
            continue
        starts = np.arange(len(raw) - p.length + 1)
        got = repeated(np.frombuffer(raw, np.uint8), starts, p)
        seen = Counter(raw[i : i + p.length] for i in starts)
        assert ((got > 0) == np.array([seen[raw[i : i + p.length]] > 1 for i in starts])).all()
        assert [x for *_, s, e in regions(np.frombuffer(raw, np.uint8), p.length) for x in range(s, e + 1)] == list(starts)


@pytest.mark.parametrize("group, hot", [(2000, 20_000), (3, 20_000), (2, 20_000), (2000, 2)])
def test_removal_against_brute_force(spark, group, hot):
    rng = random.Random(group)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(12), text(20), "ab" * 60, "x" * 150]
    texts = []
    for _ in range(40):
        some = [rng.choice([text(8), rng.choice(passages), rng.choice(passages)[5:70]]) for _ in range(rng.randint(0, 5))]
        texts.append(" ".join(some))
    texts += [texts[3], texts[3], "", "short"]
    got = remove_repeats(docs(spark, list(enumerate(texts))), Repeats(length=60, regions_per_group=group, block=8 if group == 3 else 32, hot_rows=hot, hot_salts=5), keep_text=False)
    rows = {r.doc_id: tuple(r)[1:] for r in got.collect()}
    want = removed([t.encode() for t in texts], 60)
    assert [rows[i] for i in range(len(texts))] == want


def test_repeated_ids_nulls_and_empty_tables(spark):
    a, b = "first text " * 20, "another one " * 20
    rows = [(1, a + "1"), (1, a + "2"), (None, b), (None, b), (3, None), (4, "")]
    got = sorted(map(str, (tuple(r)[1:4] for r in remove_repeats(docs(spark, rows), Repeats(length=60)).collect())))
    want = sorted(map(str, (x[:3] for x in removed([(t or "").encode() for _, t in rows], 60))))
    assert got == want
    assert remove_repeats(docs(spark, [])).count() == 0
