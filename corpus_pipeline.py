"""A corpus pipeline of five stages; each works on all rows the one before has kept.

``STAGES`` are (name, function); a function takes (spark, docs, sf_dir) and returns a frame
that is written and read again as the next one's docs. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from gleanframe.llm.batches import bucket_of, unused
from gleanframe.llm.decontamination import contaminated
from gleanframe.llm.language import UNKNOWN, Profiles, identify, learn
from gleanframe.llm.odd_sketch import OddSketch, near_duplicates
from gleanframe.llm.packing import pack
from gleanframe.llm.pii import mask_personal_data
from gleanframe.session import durable, prepare

# More dimensions than op4 has: random vectors are then less alike than a short text and its language.
LANGUAGES = Profiles(dimensions=4096)
# Cosines of random vectors deviate by 1 / sqrt(dimensions).
DEVIATION = 1 / math.sqrt(LANGUAGES.dimensions)
# A text of a word or two shares too few n-grams with its own language to be held to more than two deviations.
JUDGED_CHARS = 32

# Near copies of a corpus share four fifths of their shingles; op10 alone asks for 85 %. With 48 bands
# of 5, a pair at similarity 0.80 is missed with chance 5e-9.
NEAR = OddSketch(percent=80, bands=48, band_rows=5)


def least_cosine(low: float | None) -> float:
    """Half-way between four deviations and the ``low`` cosines of the training texts, within four and eight."""
    return max(4 * DEVIATION, min(8 * DEVIATION, (4 * DEVIATION + (low or 0.0)) / 2))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters, and those no nearer to any language than unrelated letters are."""
    prepare(spark)
    training = ~bucket_of("doc_id", 2, 4)
    prototypes = learn(docs, training, LANGUAGES)
    lang, cosine = unused("lang_found", docs), unused("cosine", docs)
    named = durable(identify(docs, prototypes, docs.columns, LANGUAGES, into=(lang, cosine)))
    known = F.col(lang) != UNKNOWN
    judged = F.length("text") >= JUDGED_CHARS
    low = named.where(known & judged & training & F.col("lang").isNotNull()).agg(F.percentile_approx(cosine, 0.001)).first()[0]
    floor = F.when(judged, least_cosine(low)).otherwise(2 * DEVIATION)
    return named.where(known & (F.col(cosine) >= floor)).select(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest doc_id.

    Rows are told apart by (doc_id, text): of rows that repeat a doc_id, each text is judged on
    its own, so a unique text under a repeated doc_id stays while a copy goes; of rows with equal
    doc_id and text one stays. Rows without a doc_id stay.
    """
    prepare(spark)
    one, digest = unused("kept_id", docs), unused("kept_hash", docs)
    kept = (
        near_duplicates(docs, NEAR)
        .where("kept and doc_id is not null")
        .select(F.col("doc_id").alias(one), F.col("text_hash").alias(digest))
        .distinct()
    )
    same = (F.col("doc_id") == F.col(one)) & (F.xxhash64("text") == F.col(digest))
    named = docs.where("doc_id is not null").join(kept, same, "left_semi")
    # Repeated rows: one of each (doc_id, text); an aggregate, combined before its shuffle.
    return named.dropDuplicates(["doc_id", "text"]).union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold passages of the benchmark."""
    benchmark = prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    leak, digest = unused("leak_id", docs), unused("leak_hash", docs)
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias(leak), F.col("text_hash").alias(digest))
    leaks = durable(found.distinct())
    same = F.col("doc_id").eqNullSafe(F.col(leak)) & (F.xxhash64("text") == F.col(digest))
    return docs.join(leaks, same, "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; every document stays."""
    prepare(spark)
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes."""
    prepare(spark)
    return pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicate", near_duplicate),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

# Language profiles and the random field are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
