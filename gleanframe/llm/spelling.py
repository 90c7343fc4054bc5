"""Spelling variants grouped by blocked Gram matrices of letter counts.

Words are counted over the whole corpus in Spark (map-side partial counts, so a frequent word is
no hot key). Two words one edit apart (one code point inserted, deleted or replaced) have letter
count vectors at squared distance 1 or 2 and lengths at most one apart. Words are cut into blocks
by length and by the counts of a few key letters; a neighbour block is any block whose key counts
an edit can reach. Blocks larger than ``chunk_rows`` are cut into chunks by a hash of the word, so
a hot block becomes many bounded tasks. Every pair of neighbouring chunks is one task: a NumPy
product of the two letter-count blocks gives all squared distances at once, pairs at distance at
most two are kept, and the edit is then checked on the words themselves. Only verified pairs leave
a task; no pair list of a block is ever built.

A word's form is its near word of the largest count (ties: the smallest word in code-point order)
where that count is at least ``ratio`` times its own; roots follow forms by pointer doubling (each
step at least ``ratio`` times more frequent, so chains are short), one written table per round.

Defined cases: a null text has no words; a null ``doc_id`` hashes as the empty string; empty and
very long texts are read whole; repeated rows count each time; ties of counts go to the smaller
word; an empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from gleanframe.session import durable

# Fixed values of the contract: the letters of a run, and the deletion rule's modulus.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETE_EVERY = 31

# The alphabet of words after lower-casing: a-z and U+00C0..U+00FF, 90 letters.
_PLACES = np.full(256, -1, np.int64)
_PLACES[97:123] = np.arange(26)
_PLACES[192:256] = np.arange(26, 90)


@dataclass(frozen=True)
class Variants:
    min_chars: int = 7
    min_count: int = 2
    ratio: int = 10
    key_letters: str = "eaion"
    chunk_rows: int = 4096


def words(docs: DataFrame, v: Variants = Variants()) -> DataFrame:
    """word, n: the corpus's words after the deletion rule, counted over all rows."""
    run = F.translate(F.col("run"), UPPER, LOWER)
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("low"))
    h = F.crc32(key)
    cut = (h % F.length("low")).cast("int")
    dropped = F.concat(F.col("low").substr(F.lit(1), cut), F.col("low").substr(cut + 2, F.lit(1 << 30)))
    found = (
        docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(RUN), 0)).alias("run"))
        # A deletion shortens by one at most: shorter runs cannot give a word.
        .where(F.length("run") >= v.min_chars)
        .select("doc_id", run.alias("low"))
        .select(F.when(h % DELETE_EVERY == 0, dropped).otherwise(F.col("low")).alias("word"))
        .where(F.length("word") >= v.min_chars)
    )
    return found.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= v.min_count)


def _counts(words: list[str], kind=np.float32) -> np.ndarray:
    """Letter counts of words, one row each, over the 90 letters."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    out = np.zeros(len(words) * 90, kind)
    np.add.at(out, rows * 90 + _PLACES[codes], 1)
    return out.reshape(len(words), 90)


def one_edit(a: str, b: str) -> bool:
    """True when b is a with exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i:] == b[i + 1 :]


#: Rows of a home multiplied at once: a 512 x 8,192 float64 product is 32 MB.
SLAB = 512
#: Longest word whose letter counts multiply exactly in float32 (squares and sums below 2**23).
EXACT_FLOAT32 = 2048
#: Blocks and routes are small tables (distinct lengths and key counts); above these sizes they are joined by a shuffle.
BROADCAST_BLOCKS = 200_000
BROADCAST_ROUTES = 2_000_000

PAIRS = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType())])


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    """Verified near pairs of one home: its own words among themselves and against the others sent there."""
    own = rows[rows["side"] == 0]["word"].tolist()
    others = rows[rows["side"] == 1]["word"].tolist()
    a, b = [], []
    if own:
        # float32 products are exact while squared lengths stay below 2**23; longer words use float64.
        kind = np.float32 if max(map(len, own + others)) <= EXACT_FLOAT32 else np.float64
        x = _counts(own, kind)
        y = _counts(others, kind) if others else x[:0]
        # |p - q|^2 <= 2  <=>  p.q >= (|p|^2 + |q|^2 - 2) / 2
        half_own, half_other = (x * x).sum(1) / 2, (y * y).sum(1) / 2
        for top in range(0, len(own), SLAB):
            part = x[top : top + SLAB]
            need = half_own[top : top + SLAB, None] - 1
            close = part @ x.T >= need + half_own[None, :] - 0.25
            close &= np.arange(top, top + len(part))[:, None] < np.arange(len(own))[None, :]
            hits = [(own[top + i], own[j]) for i, j in zip(*np.nonzero(close))]
            if others:
                close = part @ y.T >= need + half_other[None, :] - 0.25
                hits += [(own[top + i], others[j]) for i, j in zip(*np.nonzero(close))]
            for p, q in hits:
                if one_edit(p, q):
                    a.append(p)
                    b.append(q)
    return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})


def near_pairs(counted: DataFrame, v: Variants = Variants()) -> DataFrame:
    """Pairs (a, b) of distinct words one edit apart, each unordered pair once.

    A home is one chunk of one block. Its own words are compared among themselves, with the
    later chunks of their block, and with all chunks of the neighbour blocks an edit reaches
    from it that come later (same length, larger key counts) or are one longer. So each pair of
    blocks is compared in exactly one home, and a word is sent to its own home and to the homes
    of the blocks before it: about 1 + neighbours / 2 copies, never a pair list.
    """
    keys = [(F.length("word") - F.length(F.regexp_replace("word", c, ""))).alias(f"k{i}") for i, c in enumerate(v.key_letters)]
    placed = counted.select("word", F.length("word").alias("len"), *keys)
    cols = ["len", *(f"k{i}" for i in range(len(v.key_letters)))]
    blocks = durable(placed.groupBy(*cols).agg(F.ceil(F.count("*") / v.chunk_rows).alias("chunks")))
    blocks = durable(blocks.withColumn("block", F.monotonically_increasing_id()))
    a, b = blocks.alias("a"), blocks.alias("b")
    deltas = [F.col(f"b.k{i}") - F.col(f"a.k{i}") for i in range(len(v.key_letters))]
    moved = sum((F.abs(d) for d in deltas), F.lit(0))
    raised = sum((d for d in deltas), F.lit(0))
    bounded = F.lit(True)
    for d in deltas:
        bounded = bounded & (F.abs(d) <= 1)
    a_key = F.struct(*(F.col(f"a.{c}") for c in cols))
    b_key = F.struct(*(F.col(f"b.{c}") for c in cols))
    same_len = (F.col("b.len") == F.col("a.len")) & (a_key < b_key) & (moved <= 2) & (raised >= -1) & (raised <= 1)
    longer = (F.col("b.len") == F.col("a.len") + 1) & (moved <= 1) & (raised >= 0)
    # Routes: the words of block b (any chunk) go to every chunk of each block a before it.
    routes = a.join(b, bounded & (same_len | longer)).select(
        F.col("b.block").alias("from_block"),
        F.lit(-1).cast("long").alias("from_chunk"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("a.chunks") - 1)).alias("to_chunk"),
        F.col("a.block").alias("to_block"),
    )
    # Within a block, chunk c also goes to the homes of the chunks before it.
    inside = blocks.where("chunks > 1").select(
        F.col("block").alias("from_block"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("chunks") - 1)).alias("from_chunk"),
        F.col("block").alias("to_block"),
    ).select("from_block", "from_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("from_chunk") - 1)).alias("to_chunk"), "to_block")
    routes = durable(routes.unionByName(inside))
    home = F.col("block") * (1 << 20) + F.col("chunk")
    chunked = durable(
        placed.join(F.broadcast(blocks) if blocks.count() <= BROADCAST_BLOCKS else blocks, cols).select(
            "word", "block", F.pmod(F.xxhash64("word"), F.col("chunks")).alias("chunk")
        )
    )
    own = chunked.select(home.alias("home"), "word", F.lit(0).alias("side"))
    sent = routes.count() <= BROADCAST_ROUTES
    by_block = routes.where("from_chunk < 0")
    by_chunk = routes.where("from_chunk >= 0")
    to_home = (F.col("to_block") * (1 << 20) + F.col("to_chunk")).alias("home")
    near = chunked.join(F.broadcast(by_block) if sent else by_block, F.col("block") == F.col("from_block")).select(to_home, "word", F.lit(1).alias("side"))
    same = chunked.join(
        F.broadcast(by_chunk) if sent else by_chunk, (F.col("block") == F.col("from_block")) & (F.col("chunk") == F.col("from_chunk"))
    ).select(to_home, "word", F.lit(1).alias("side"))
    found = own.unionByName(near).unionByName(same).groupBy("home").applyInPandas(_compare, PAIRS)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def spelling_variants(docs: DataFrame, v: Variants = Variants()) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the corpus (see the module's text)."""
    counted = durable(words(docs, v))
    pairs = durable(near_pairs(counted, v))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other")).union(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"))
    )
    others = counted.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    near = both.join(others, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("neg"), F.col("other").alias("other"))).alias("best")
    )
    table = counted.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.neg") >= v.ratio * F.col("n"), F.col("best.other")).alias("form"),
        F.when(-F.col("best.neg") >= v.ratio * F.col("n"), -F.col("best.neg")).alias("form_n"),
    )
    table = durable(table.withColumn("root", F.coalesce("form", "word")))
    while True:
        hop = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(
            table.join(hop, "root", "left").select(
                "word", "n", "n_near", "form", "form_n", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("changed")
            )
        )
        if not moved.where("changed").limit(1).count():
            return moved.select("word", "form", "root", "n", "n_near", F.col("form_n").cast("long").alias("form_n"))
        table = moved.drop("changed")
