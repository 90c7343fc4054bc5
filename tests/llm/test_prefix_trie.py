"""Prefix trie against a plain loop over all prefixes."""

import hashlib
import zlib

from gleanframe.llm.prefix_trie import Trie, prefix_trie

ROWS = "conv_id long, turn long, role string, text string, depth string, k1 string, ends string, seq string"


def rebuild(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    ordered = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))] for c, v in own.items()}
    out = {}
    for c, turns in ordered.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = ordered.get(base, [])[:h] + turns[h:]
    return out


def brute(rows):
    convs = rebuild(rows)
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves = 0 if kids.get(p) else 1
        saved = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        for k in kids.get(p, []):
            a, b = below(k)
            leaves, saved = leaves + a, saved + b
        return leaves, saved

    out = []
    for p, members in nodes.items():
        ends = sorted(c for c in members if len(convs[c]) == len(p))
        leaves, saved = below(p)
        out.append(
            (min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids.get(p, [])), leaves, saved,
             hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
        )
    return sorted(out, key=str)


def test_against_a_plain_loop(spark):
    rows = []
    for c in list(range(0, 30)) + list(range(100, 140)) + [250, 251, -7, 1000]:
        n = c % 7
        for k in range(n):
            rows.append((c, k, "user" if k % 2 == 0 else "assistant", f"t{k} {c % 3}" if k < 3 else f"x{c}"))
    rows += [(5, None, None, None), (5, 9, "user", "ünï"), (None, 1, "user", "gone"), (130, 2, "user", "tie"), (130, 2, "user", "tie")]
    rows += [(2000 + i, 0, "user", "same") for i in range(30)]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], ROWS)
    got = prefix_trie(df, Trie(shard_rows=7)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty_table(spark):
    assert prefix_trie(spark.createDataFrame([], ROWS)).count() == 0
