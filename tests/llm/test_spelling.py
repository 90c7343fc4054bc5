"""Spelling variants against a plain loop over all word pairs."""

import re
import zlib
from collections import Counter

from gleanframe.llm.spelling import Variants, one_edit, spelling_variants
from tests.llm.helpers import docs


def brute(rows, v=Variants()):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 31 == 0:
                k = h % len(low)
                low = low[:k] + low[k + 1 :]
            if len(low) >= v.min_chars:
                counts[low] += 1
    words = {w: n for w, n in counts.items() if n >= v.min_count}
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= v.ratio * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        f = form[w]
        out[w] = (f, root, words[w], len(near[w]), words[f] if f else None)
    return out


def test_against_a_plain_loop(spark):
    base = "Colour colours Spelling spellling speling Ünïcodes Ünicodes Übersetzung Uebersetzung"
    rows = [(i, base + (" Colour spelling" * (i % 5)) + " spelling" * 12) for i in range(40)]
    rows += [(None, "speeling speeling elephant elephants elephant"), (3, None), (4, ""), (5, "x" * 50000 + " elephantx"), (7, "spelling"), (7, "spelling")]
    rows += [(8, "abcdefgh abcdefgh abcdefgi abcdefgi abcdefgj abcdefgj")]
    got = spelling_variants(docs(spark, rows, "word", "form", "root", "n", "low", "run", "pair", "side", "chunk"), Variants(chunk_rows=2)).collect()
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == brute(rows)


def test_one_edit():
    assert one_edit("spelling", "speling") and one_edit("speling", "spelling") and one_edit("abc", "abd")
    assert not one_edit("abc", "abc") and not one_edit("abc", "acb") and not one_edit("abc", "abcde")


def test_empty_table(spark):
    assert spelling_variants(docs(spark, [(1, "x")]).where("false")).count() == 0
