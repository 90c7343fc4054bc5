"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1, drawn from its code point. A letter n-gram is
bound from its letters: the vector of each is rotated by its place and the rotated vectors are
multiplied. A text bundles (adds) the vectors of all its n-grams, a language bundles the unit
vectors of its texts, and a text gets the language whose prototype has the largest cosine.

Only text and language of the training rows are learned from, and only the text is looked at
to predict. Prototypes are exact integer sums, so they do not depend on partitioning.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from gleanframe.llm.batches import texts

UNKNOWN = "und"
_SHIFT = np.int64(1 << 21)


@dataclass(frozen=True)
class Profiles:
    dimensions: int = 1024
    ngram: int = 3
    seed: int = 11
    texts_at_once: int = 64
    scale: int = 1 << 20


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """Marks the code points that are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points; each run of anything else is one 0, also at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.concatenate(([0], np.where(_letters()[codes], codes, 0), [0]))
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
    return codes[keep]


def ngram_counts(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    codes = letter_codes(text)
    if len(codes) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    width = min(n, len(codes))
    keys = np.zeros(len(codes) - width + 1, np.int64)
    for k in range(width):
        keys = keys * _SHIFT + codes[k : len(codes) - width + 1 + k]
    return np.unique(keys, return_counts=True)


class Binder:
    """Bundles of texts; remembers the letter vectors of its task."""

    def __init__(self, p: Profiles):
        self.p, self.at, self.rows = p, {}, np.empty((0, p.dimensions), np.int8)

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        fresh = [c for c in codes.tolist() if c not in self.at]
        if fresh:
            drawn = [
                np.random.default_rng((self.p.seed, c)).integers(0, 2, self.p.dimensions, dtype=np.int8) * 2 - 1
                for c in fresh
            ]
            for c in fresh:
                self.at[c] = len(self.at)
            self.rows = np.concatenate([self.rows, np.array(drawn, np.int8)])
        return self.rows[[self.at[c] for c in codes.tolist()]]

    def _bound(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones((len(keys), self.p.dimensions), np.int8)
        for place in range(self.p.ngram):
            codes, back = np.unique(keys % _SHIFT, return_inverse=True)
            out *= np.roll(self._vectors(codes), place, axis=1)[back]
            keys = keys // _SHIFT
        return out

    def bundles(self, some: list[str]) -> np.ndarray:
        """One unit vector per text; zero for texts without letters."""
        counted = [ngram_counts(t, self.p.ngram) for t in some]
        keys, back = np.unique(np.concatenate([k for k, _ in counted]), return_inverse=True)
        amount = np.concatenate([c for _, c in counted]).astype(np.float32)
        owner = np.repeat(np.arange(len(some)), [len(k) for k, _ in counted])
        out = np.zeros((len(some), self.p.dimensions), np.float32)
        for low in range(0, len(keys), 4096):
            inside = (back >= low) & (back < low + 4096)
            counts = np.zeros((len(some), min(4096, len(keys) - low)), np.float32)
            counts[owner[inside], back[inside] - low] = amount[inside]
            out += counts @ self._bound(keys[low : low + 4096]).astype(np.float32)
        length = np.linalg.norm(out.astype(np.float64), axis=1, keepdims=True)
        return np.where(length > 0, out / np.where(length > 0, length, 1), 0.0)


def _in_parts(items: list, size: int) -> Iterator[list]:
    for low in range(0, len(items), size):
        yield items[low : low + size]


def _sums(p: Profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder, total = Binder(p), {}
        for batch in batches:
            rows = list(zip(batch.column("lang").to_pylist(), texts(batch)))
            for part in _in_parts(rows, p.texts_at_once):
                units = np.rint(binder.bundles([t for _, t in part]) * p.scale).astype(np.int64)
                for (lang, _), unit in zip(part, units):
                    total[lang] = total.get(lang, 0) + unit
        for lang in sorted(total):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * p.dimensions),
                    pa.array(range(p.dimensions), pa.int32()),
                    pa.array(total[lang], pa.int64()),
                ],
                names=["lang", "place", "value"],
            )

    return run


def learn(docs: DataFrame, training: Column, p: Profiles = Profiles()) -> dict[str, np.ndarray]:
    """Language -> unit prototype, from the rows of ``docs`` where ``training`` holds.

    Each task adds up its texts; one vector per language is what reaches the driver, however
    many rows there are. Rows with a null language are left out.
    """
    rows = docs.where(training & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    sums = (
        rows.mapInArrow(_sums(p), "lang string, place int, value long")
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
    )
    found: dict[str, np.ndarray] = {}
    for row in sums.collect():
        found.setdefault(row.lang, np.zeros(p.dimensions))[row.place] = row.value
    return {
        lang: vector / np.linalg.norm(vector)
        for lang, vector in sorted(found.items())
        if np.linalg.norm(vector) > 0
    }


def _predict(names: list[str], prototypes: np.ndarray, p: Profiles, into: tuple[str, str], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder = Binder(p)
        for batch in batches:
            langs, scores = [], []
            for part in _in_parts(list(texts(batch)), p.texts_at_once):
                units = binder.bundles(part)
                cosines = units @ prototypes.T if names else np.zeros((len(part), 1))
                best = cosines.argmax(axis=1)
                for unit, row, k in zip(units, cosines, best):
                    known = bool(names) and unit.any()
                    langs.append(names[k] if known else UNKNOWN)
                    scores.append(float(min(1.0, max(0.0, row[k]))) if known else 0.0)
            columns = {into[0]: pa.array(langs, pa.string()), into[1]: pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays(
                [columns[f.name] if f.name in columns else batch.column(f.name) for f in schema],
                schema=schema,
            )

    return run


def identify(
    docs: DataFrame,
    prototypes: dict[str, np.ndarray],
    carry: list[str],
    p: Profiles = Profiles(),
    into: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """``carry`` columns of ``docs`` and, ``into`` two more, language and cosine (0 to 1) of each text.

    ``und`` with score 0 for null texts, texts without letters, or when nothing was learned.
    Ties go to the first language by name. Rows may repeat; other columns are ignored.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names]) if names else np.zeros((1, p.dimensions))
    kept = docs.select(*carry)
    schema = T.StructType(
        [*kept.schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())]
    )
    rows = kept if "text" in carry else docs.select(*carry, "text")
    return rows.mapInArrow(_predict(names, matrix, p, into, to_arrow_schema(schema)), schema)
