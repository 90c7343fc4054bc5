"""Near-duplicate documents: MinHash bands find candidates, odd sketches sieve them, full sets decide.

A document's set holds its distinct five-word shingles. MinHash samples of the set are cut
into bands; sets that share a band are candidates. The samples are also folded into an odd
sketch, a bitmap in which each sample flips one bit. The exclusive-or of two sketches keeps
only bits of samples that differ, so its population count estimates high similarities well:
``J = 1 + n/(4k) * ln(1 - 2d/n)`` for n bits, k samples and d differing bits. Candidates whose
estimate lies five deviations below the threshold are left; the rest is confirmed on full sets.

Equal sets meet by digest and go on as one representative. Within a bucket every member is
first held against the bucket's smallest member only, which joins groups of copies with as many
comparisons as they have members. Where components still meet in a bucket, each member is held
against the closest of a few drawn members, which joins loose groups. After that, members of
*different* components of such buckets that share one of their rarest shingles, as any two that
reach the threshold must, are all compared. So no link between components is lost, and no pair
inside one is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gleanframe.llm.components import components
from gleanframe.session import durable

_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class OddSketch:
    """Parameters. With 32 bands of 6, a pair at similarity 0.85 is missed with chance 3e-7."""

    shingle_words: int = 5
    percent: int = 85
    bands: int = 32
    band_rows: int = 6
    bits: int = 512
    deviations: float = 5.0
    seed: int = 7
    members_per_task: int = 2000
    star_turns: int = 1
    fine_samples: int = 1024
    fine_bits: int = 2048

    @property
    def samples(self) -> int:
        return self.bands * self.band_rows

    @property
    def most_differing_bits(self) -> int:
        """Bits that may differ before a pair cannot reach the threshold any more."""
        j = self.percent / 100
        low = max(0.0, j - self.deviations * math.sqrt(j * (1 - j) / self.samples))
        share = 1 - math.exp(-4 * self.samples * (1 - low) / self.bits)
        return math.ceil(self.bits / 2 * share + math.sqrt(self.bits) / 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


@lru_cache
def _places(n: int) -> np.ndarray:
    """One odd factor for every place of a sequence of ``n`` hashes."""
    return np.random.default_rng(3).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes. ``bytes.split`` and ``bytes.lower`` know ASCII only, as wanted."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    # Texts hold many rare words: a word is hashed faster than it is found in a table of words.
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    short = len(parts) < width
    width = min(width, len(parts))
    count, places = len(parts) - width + 1, _places(width)
    total = hashed[:count] * places[0]
    for k in range(1, width):
        total += hashed[k : count + k] * places[k]
    total = _mix(total)
    if short:
        total = _mix(total ^ np.uint64(width))
    total.sort()
    new = np.empty(count, bool)
    new[0] = True
    np.not_equal(total[1:], total[:-1], out=new[1:])
    return total[new]


class Sampler:
    """MinHash samples of shingle sets, and the odd sketches of such samples."""

    def __init__(self, p: OddSketch):
        rng = np.random.default_rng(p.seed)
        self.p = p
        # 32-bit products suffice: a set's hashes are spread evenly, and its smallest product names one of them.
        self.odd = (rng.integers(0, 2**31, p.samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.plus = rng.integers(0, 2**32, p.samples, dtype=np.uint32)[:, None]
        self.nth = _mix(np.arange(1, p.samples + 1, dtype=np.uint64) * _MIX)
        # Products of one block stay in the cache of a core.
        self.block = np.empty((p.samples, max(64, 131_072 // p.samples)), np.uint32)

    def samples(self, s: np.ndarray) -> np.ndarray:
        s = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(self.p.samples, np.iinfo(np.uint32).max, np.uint32)
        step = self.block.shape[1]
        for at in range(0, len(s), step):
            part = s[at : at + step]
            products = self.block[:, : len(part)]
            np.multiply(part, self.odd, out=products)
            np.add(products, self.plus, out=products)
            np.minimum(low, products.min(axis=1), out=low)
        return _mix(low * _MIX + self.nth)

    def sketch(self, samples: np.ndarray) -> np.ndarray:
        flips = np.bincount((samples % np.uint64(self.p.bits)).astype(np.int64), minlength=self.p.bits) & 1
        return np.packbits(flips.astype(np.uint8)).view(np.int64)

    def bands(self, samples: np.ndarray) -> np.ndarray:
        rows = samples.reshape(self.p.bands, self.p.band_rows)
        return _mix((rows * _places(self.p.band_rows)).sum(axis=1, dtype=np.uint64)).view(np.int64)


_SIGNATURE = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, sketch array<long>"


def _signatures(p: OddSketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(p)
        for batch in batches:
            n, digests, bands, sketches = [], [], [], []
            for value in batch.column("text"):
                s = shingle_set(value.as_py(), p.shingle_words)
                n.append(len(s))
                if not len(s):
                    digests.append(None), bands.append([]), sketches.append([])
                    continue
                samples = sampler.samples(s)
                sketches.append(sampler.sketch(samples))
                bands.append(sampler.bands(samples))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(n, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "n_shingles", "digest", "bands", "sketch"],
            )

    return run


def signatures(docs: DataFrame, p: OddSketch) -> DataFrame:
    """One row per document: set size, digest of the set, band keys and odd sketch."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"
    )
    return rows.mapInArrow(_signatures(p), _SIGNATURE)


def _differing(a: str, b: str, p: OddSketch) -> Column:
    words = (F.bit_count(F.col(f"{a}.sketch")[k].bitwiseXOR(F.col(f"{b}.sketch")[k])) for k in range(p.bits // 64))
    return sum(words, F.lit(0))


def _close(a: str, b: str, p: OddSketch) -> Column:
    """Sizes allow the threshold, and the sketches differ in few enough bits."""
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * 100 >= large * p.percent) & (_differing(a, b, p) <= p.most_differing_bits)


def _confirm(p: OddSketch):
    """Holds each member's full set against the set of its lead; the lead's row comes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, key = None, None
        for batch in batches:
            a, b = [], []
            leads, salts, members, firsts = (batch.column(c).to_pylist() for c in ("a", "salt", "b", "is_lead"))
            for i, text in enumerate(batch.column("text")):
                s = None
                if firsts[i]:
                    if key != (leads[i], salts[i]):
                        key = (leads[i], salts[i])
                        lead = shingle_set(text.as_py(), p.shingle_words)
                    continue
                s = shingle_set(text.as_py(), p.shingle_words)
                both = len(np.intersect1d(lead, s, assume_unique=True))
                if 100 * both >= p.percent * (len(lead) + len(s) - both):
                    a.append(leads[i]), b.append(members[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]
            )

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, reps: DataFrame, p: OddSketch) -> DataFrame:
    """The pairs (a, b) of representatives whose full sets reach the threshold.

    Texts go to the pair, not sets: they are smaller. A lead with many members is repeated
    for every ``members_per_task`` of them.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / p.members_per_task).alias("shares"))
    dealt = pairs.join(shares, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("shares")))
    wanted = (
        dealt.select("a", "salt", "b", F.lit(False).alias("is_lead"), F.col("b").alias("rep"))
        .union(dealt.select("a", "salt", F.lit(None).cast("long"), F.lit(True), "a").distinct())
        .join(reps.select("rep", "text_hash"), "rep")
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_hash"), "text"
    )
    near = wanted.join(rows, ["rep", "text_hash"]).select("a", "salt", "b", "is_lead", "text")
    return (
        near.repartition("a", "salt")
        .sortWithinPartitions("a", "salt", F.desc("is_lead"))
        .mapInArrow(_confirm(p), "a long, b long")
        .distinct()
    )


def _open_rows(met: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of bands in which components, as far as they are known, still meet."""
    known = durable(components(links))
    placed = met.join(known, met.rep == known.node, "left").select(
        "band", "rep", F.coalesce("component", "rep").alias("component")
    )
    mixed = (
        placed.groupBy("band")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low != high")
        .select("band")
    )
    return durable(placed.join(mixed, "band"))


def _sieved(pairs: DataFrame, facts: DataFrame, p: OddSketch) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link, with their differing ``bits``."""
    x = facts.select(F.col("rep").alias("a"), F.struct("n", "sketch").alias("x"))
    y = facts.select(F.col("rep").alias("b"), F.struct("n", "sketch").alias("y"))
    return pairs.join(x, "a").join(y, "b").where(_close("x", "y", p)).select("a", "b", _differing("x", "y", p).alias("bits"))


def _best_stars(open_rows: DataFrame, facts: DataFrame, turn: int, p: OddSketch) -> DataFrame:
    """For each set the closest of its bands' leads outside its component; leads are drawn anew each turn."""
    drawn = F.xxhash64(F.lit(turn), "band", "rep")
    leads = open_rows.groupBy("band").agg(F.min_by(F.struct("rep", "component"), drawn).alias("lead"))
    pairs = (
        open_rows.join(leads, "band")
        .where("component != lead.component")
        .select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"))
        .distinct()
    )
    best = _sieved(pairs, facts, p).groupBy("b").agg(F.min(F.struct("bits", "a")).alias("best"))
    return best.select(F.least("best.a", "b").alias("a"), F.greatest("best.a", "b").alias("b")).distinct()


def _shingles(p: OddSketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rep, text in zip(batch.column("rep").to_pylist(), batch.column("text")):
                s = shingle_set(text.as_py(), p.shingle_words).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(s), rep), pa.int64()), pa.array(s, pa.int64())], names=["rep", "shingle"]
                )

    return run


def _sketches(p: OddSketch):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(p)
        for batch in batches:
            found = [
                sampler.sketch(sampler.samples(shingle_set(x.as_py(), p.shingle_words))) for x in batch.column("text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array(found, pa.list_(pa.int64()))], names=["rep", "sketch"]
            )

    return run


def _across(open_rows: DataFrame, docs: DataFrame, reps: DataFrame, p: OddSketch) -> DataFrame:
    """All pairs of open sets of different components that can reach the threshold.

    With the shingles of each set ordered from rare to frequent, two sets that reach it share
    one among their first ``n - ceil(threshold * n) + 1``. Members of a loose family of copies
    differ in their rare shingles, so most do not meet here; those that do are sieved by finer
    sketches, made for these sets alone.
    """
    sets = durable(open_rows.select("rep", "component").distinct().join(reps.select("rep", "n"), "rep"))
    rows = docs.select(F.col("doc_id").cast("long").alias("rep"), F.xxhash64("text").alias("text_hash"), "text")
    wanted = sets.select("rep").join(reps.select("rep", "text_hash"), "rep")
    opened = durable(wanted.join(rows, ["rep", "text_hash"]).dropDuplicates(["rep", "text_hash"]).select("rep", "text"))
    shingles = durable(opened.mapInArrow(_shingles(p), "rep long, shingle long").distinct())
    finer = replace(p, bands=1, band_rows=p.fine_samples, bits=p.fine_bits)
    fine = opened.mapInArrow(_sketches(finer), "rep long, sketch array<long>")
    sets = durable(sets.join(fine, "rep"))
    frequency = shingles.groupBy("shingle").agg(F.count("*").alias("sets"))
    rare_first = Window.partitionBy("rep").orderBy("sets", "shingle")
    first = F.col("n") - F.ceil(F.col("n") * p.percent / 100) + 1
    heads = durable(
        shingles.join(frequency, "shingle")
        .withColumn("nth", F.row_number().over(rare_first))
        .join(sets, "rep")
        .where((F.col("nth") <= first) & (F.col("sets") > 1))
        .select("shingle", "rep", "nth", "n", "sketch", "component")
    )
    # What two sets share from their first common shingle on, at most; for later common ones
    # this asks more than is needed, but the first finds the pair.
    rest = 1 + F.least(F.col("x.n") - F.col("x.nth"), F.col("y.n") - F.col("y.nth"))
    enough = rest * (100 + p.percent) >= p.percent * (F.col("x.n") + F.col("y.n"))
    return (
        heads.alias("x")
        .join(heads.alias("y"), F.col("x.shingle") == F.col("y.shingle"))
        .where((F.col("x.component") < F.col("y.component")) & enough & _close("x", "y", finer))
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, p: OddSketch = OddSketch()) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash and kept for every row of ``docs`` (doc_id, text).

    ``text_hash`` (xxhash64 of the text) tells the rows of one doc_id apart.

    Repeated rows of a doc_id get the same result; where their texts differ, each row is
    judged by its own text under the one name. Null and blank texts have an empty set and link
    with nothing. A row whose doc_id is null cannot be named by a link: its component_id is
    null and it is kept. Other columns are ignored.
    """
    signed = durable(signatures(docs, p))
    full = signed.where("n_shingles > 0 and doc_id is not null")
    sets = full.groupBy("digest").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"),
        F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"),
        F.first("sketch").alias("sketch"),
    )
    reps = durable(
        sets.select(F.col("first.doc_id").alias("rep"), F.col("first.text_hash").alias("text_hash"), "digest", "n", "bands", "sketch")
    )
    facts = reps.select("rep", "n", "sketch")
    in_bands = reps.select("rep", F.explode("bands").alias("band"))
    shared = in_bands.groupBy("band").agg(F.count("*").alias("size"), F.min("rep").alias("lead")).where("size > 1").drop("size")
    met = durable(in_bands.join(shared, "band"))
    first_stars = met.where("lead < rep").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    stars = _sieved(first_stars, facts, p).select("a", "b").distinct()
    links = durable(confirmed(durable(stars), docs, reps, p))
    for turn in range(p.star_turns):
        open_rows = _open_rows(met, links)
        if open_rows.isEmpty():
            break
        closest = durable(_best_stars(open_rows, facts, turn, p))
        if closest.isEmpty():
            break
        links = links.union(durable(confirmed(closest, docs, reps, p)))
    open_rows = _open_rows(met, links)
    if not open_rows.isEmpty():
        across = durable(_across(open_rows, docs, reps, p))
        if not across.isEmpty():
            links = links.union(durable(confirmed(across, docs, reps, p)))
    final = durable(components(links))

    named = reps.join(final, reps.rep == final.node, "left").select(
        "digest", F.coalesce("component", "rep").alias("component_id")
    )
    found = full.select("doc_id", "n_shingles", "digest", "text_hash").join(named, "digest").select(
        "doc_id", "n_shingles", "component_id", "text_hash"
    )
    alone = signed.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash"
    )
    return found.union(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )
