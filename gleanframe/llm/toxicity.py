"""Toxicity by weak supervision.

Voters are word patterns: a whole word, or a beginning of words, seen at least once, twice or
three times in a text. They come from a small lexicon and are mined from the labelled training
rows, so they follow the languages at hand. A generative label model takes each voter's vote,
and the given label as one more vote, for noisy evidence of the true class: EM estimates how
often each fires in either class, and the correlations among voters within the classes, by
which the votes of voters that say the same are shared out. A linear classifier over the
voters is trained on the posterior labels and scores every text.

Labels are learned from training rows only; of these a sample bounded by ``sample_rows`` is
used, drawn by hash. Scoring reads the text alone.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanframe.llm.batches import texts
from gleanframe.session import durable

# Fixed values.
LEXICON = "clown disgusting dumb fool garbage hate idiot imbecile jerk loser moron pathetic scum shut stupid trash ugly vermin worthless"
_WORDS = re.compile(r"[^\W\d_]+")
_SHORTEST, _LONGEST = 3, 9


@dataclass(frozen=True)
class WeakSupervision:
    """Parameters. ``sample_rows`` bounds the labelled rows that are fitted on, in expectation."""

    sample_rows: int = 12_000
    levels: tuple[int, ...] = (1, 2, 3)
    voters: int = 300
    least_support: int = 5
    least_precision: float = 0.6
    rounds: int = 25
    ridge: float = 1.0
    threshold: float = 0.7
    seed: int = 5


def pattern_counts(text: str) -> Counter:
    """How many words of the text begin with, or are (marked ``$``), each pattern."""
    out: Counter = Counter()
    for word, n in Counter(_WORDS.findall(text.lower())).items():
        for k in range(_SHORTEST, min(_LONGEST, len(word)) + 1):
            out[word[:k]] += n
        out[word + "$"] += n
    return out


def _mine(p: WeakSupervision):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(texts(batch), batch.column("label").to_pylist()):
                found = seen[label]
                for pattern, n in pattern_counts(text).items():
                    for level in p.levels:
                        if n >= level:
                            found[(pattern, level)] += 1
        keys = [k for k in seen[1]]
        for low in range(0, len(keys), 50_000):
            some = keys[low : low + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in some]),
                    pa.array([k[1] for k in some], pa.int32()),
                    pa.array([seen[1][k] for k in some], pa.int64()),
                    pa.array([seen[0][k] for k in some], pa.int64()),
                ],
                names=["pattern", "level", "toxic", "clean"],
            )
        keys = [k for k in seen[0] if k not in seen[1]]
        for low in range(0, len(keys), 50_000):
            some = keys[low : low + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in some]),
                    pa.array([k[1] for k in some], pa.int32()),
                    pa.array([0] * len(some), pa.int64()),
                    pa.array([seen[0][k] for k in some], pa.int64()),
                ],
                names=["pattern", "level", "toxic", "clean"],
            )

    return run


def mined(sample: DataFrame, p: WeakSupervision) -> list[tuple[str, int]]:
    """The patterns that tell the classes of the labelled sample apart best, by likelihood ratio."""
    totals = sample.groupBy("label").count().collect()
    size = {r["label"]: r["count"] for r in totals}
    if not size.get(0) or not size.get(1):
        return []
    counted = (
        sample.select("text", "label")
        .mapInArrow(_mine(p), "pattern string, level int, toxic long, clean long")
        .groupBy("pattern", "level")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .where(F.col("toxic") >= p.least_support)
    )
    prior = size[1] / (size[0] + size[1])
    share = (F.col("toxic") + 0.5 * prior) / (F.col("toxic") + F.col("clean") + 0.5)
    gain = F.col("toxic") * F.log(share / prior) + F.col("clean") * F.log((1 - share) / (1 - prior))
    best = (
        counted.where(share >= p.least_precision)
        .withColumn("gain", gain)
        .orderBy(F.desc("gain"), "level", F.length("pattern"), "pattern")
        .limit(p.voters)
        .collect()
    )
    return [(r["pattern"], r["level"]) for r in best]


class Voters:
    """Which voters fire in a text."""

    def __init__(self, patterns: list[tuple[str, int]]):
        self.patterns = patterns
        self.whole: dict[str, list[int]] = {}
        self.begins: dict[str, list[int]] = {}
        for k, (pattern, _) in enumerate(patterns):
            if pattern.endswith("$"):
                self.whole.setdefault(pattern[:-1], []).append(k)
            else:
                self.begins.setdefault(pattern, []).append(k)
        self.heads = {w[:_SHORTEST] for w in (*self.whole, *self.begins)}
        self.levels = np.array([level for _, level in patterns], np.int64)

    def fired(self, text: str) -> np.ndarray:
        counts = np.zeros(len(self.patterns), np.int64)
        for word, n in Counter(_WORDS.findall(text.lower())).items():
            if word[:_SHORTEST] not in self.heads:
                continue
            for k in self.whole.get(word, ()):
                counts[k] += n
            for end in range(_SHORTEST, min(_LONGEST, len(word)) + 1):
                for k in self.begins.get(word[:end], ()):
                    counts[k] += n
        return counts >= self.levels


def _votes(patterns: list[tuple[str, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(patterns)
        for batch in batches:
            packed = [np.packbits(voters.fired(t)).tobytes() for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(packed, pa.binary())], names=["label", "votes"]
            )

    return run


def label_model(fires: np.ndarray, given: np.ndarray, p: WeakSupervision) -> np.ndarray:
    """Posterior of the true class of each row, from voters that fire or abstain and the given label.

    A voter's log-likelihood ratio is divided by one plus its absolute correlations with the
    other voters within the classes: two voters that always agree count as one.
    """
    if not len(given):
        return np.empty(0)
    fires, posterior = fires.astype(np.float64), np.where(given == 1, 0.95, 0.05)
    for _ in range(p.rounds):
        logit = np.zeros(len(given))
        mass = np.array([(1 - posterior).sum(), posterior.sum()]) + 1e-9
        logit += np.log(mass[1] / mass[0])
        hit = [(((1 - posterior)[:, None] * fires).sum(0) + 0.02) / (mass[0] + 2), ((posterior[:, None] * fires).sum(0) + 0.02) / (mass[1] + 2)]
        right = [((1 - posterior)[given == 0].sum() + 9.5) / (mass[0] + 10), (posterior[given == 1].sum() + 9.5) / (mass[1] + 10)]
        logit += np.where(given == 1, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
        if fires.shape[1]:
            rest = fires - ((1 - posterior)[:, None] * hit[0] + posterior[:, None] * hit[1])
            spread = rest.std(axis=0) + 1e-9
            correlation = np.abs((rest / spread).T @ (rest / spread)) / len(given)
            shared = correlation.sum(axis=1) - np.diag(correlation) + 1
            ratio_on = np.log(hit[1] / hit[0]) / shared
            ratio_off = np.log((1 - hit[1]) / (1 - hit[0])) / shared
            logit += fires @ (ratio_on - ratio_off) + ratio_off.sum()
        updated = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(updated - posterior).max() < 1e-6:
            break
        posterior = updated
    return posterior


def linear_classifier(fires: np.ndarray, target: np.ndarray, p: WeakSupervision) -> np.ndarray:
    """Weights and, last, the intercept of a ridge-penalised logistic regression on soft labels."""
    x = np.hstack([fires.astype(np.float64), np.ones((len(target), 1))])
    weights = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], p.ridge)
    penalty[-1] = 1e-3
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (chance - target) + penalty * weights
        bend = (x * (chance * (1 - chance) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return weights


@dataclass(frozen=True)
class Model:
    patterns: list[tuple[str, int]]
    weights: np.ndarray


def learn(docs: DataFrame, labels: DataFrame, training: Column, p: WeakSupervision = WeakSupervision()) -> Model:
    """Fits on the labelled rows of ``docs`` for which ``training`` holds."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").alias("labelled_id")).agg(F.max("toxic").alias("label"))
    texts_of = docs.where(training).select("doc_id", "text")
    total = known.join(texts_of.select("doc_id"), F.col("doc_id") == F.col("labelled_id")).count()
    draw = F.pmod(F.xxhash64(F.lit(p.seed), "labelled_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, p.sample_rows / max(1, total)))
    sample = durable(
        texts_of.join(known.where(draw), F.col("doc_id") == F.col("labelled_id")).select("text", F.col("label").cast("int").alias("label"))
    )
    patterns = [(f"{w}$", 1) for w in LEXICON.split()]
    patterns += [x for x in mined(sample, p) if x not in set(patterns)]
    rows = sample.mapInArrow(_votes(patterns), "label int, votes binary").collect()
    rows.sort(key=lambda r: (r["label"], bytes(r["votes"])))
    fires = np.array([np.unpackbits(np.frombuffer(r["votes"], np.uint8))[: len(patterns)] for r in rows]).reshape(len(rows), len(patterns))
    given = np.array([r["label"] for r in rows], np.int64)
    if not len(rows) or given.min() == given.max():
        return Model(patterns, np.concatenate([np.where(np.arange(len(patterns)) < len(LEXICON.split()), 4.0, 0.0), [-2.0]]))
    return Model(patterns, linear_classifier(fires, label_model(fires, given, p), p))


def _score(model: Model, p: WeakSupervision):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(model.patterns)
        for batch in batches:
            scores = []
            for text in texts(batch):
                logit = float(model.weights[:-1][voters.fired(text)].sum() + model.weights[-1])
                scores.append(1 / (1 + np.exp(-min(30.0, max(-30.0, logit)))))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= p.threshold) for s in scores], pa.int32()),
                ],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score(docs: DataFrame, model: Model, held_out: Column, p: WeakSupervision = WeakSupervision()) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null and empty texts get the score of a text in which no voter fires. Without any labelled
    row, or with labels of one class only, the fixed lexicon decides. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(_score(model, p), "doc_id long, held_out boolean, score double, predicted int")
