"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from gleanframe.llm import oracles, toxicity
from gleanframe.llm.batches import bucket_of
from gleanframe.llm.chat import format_chat, read_back
from gleanframe.llm.decontamination import contaminated
from gleanframe.llm.flat_graph import near_vectors
from gleanframe.llm.language import identify, learn
from gleanframe.llm.odd_sketch import near_duplicates
from gleanframe.llm.packing import pack
from gleanframe.llm.pii import find_personal_data
from gleanframe.llm.prefix_trie import prefix_trie
from gleanframe.llm.secret_forest import scan_secrets
from gleanframe.llm.spelling import spelling_variants
from gleanframe.llm.suffix_dedup import remove_repeats
from gleanframe.llm.token_codes import token_codes
from gleanframe.session import prepare


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def op1_chat_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return read_back(format_chat(turns.union(extra)))


def op2_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents"))


def op3_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op4_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 2, 4)
    prototypes = learn(docs, ~held_out)
    return identify(docs.select("doc_id", "text", held_out.alias("held_out")), prototypes, ["doc_id", "held_out"])


def op5_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), keep_text=True)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op8_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = bucket_of("doc_id", 1, 3)
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model, held_out)


def op9_flat_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents")).drop("text_hash")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


def op13_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codes(_table(spark, sf_dir, "documents"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_chat_segments, op2_pii_field, op3_secret_forest, op4_language_profiles, op5_template_decontamination, op6_suffix_dedup, op7_best_fit_packing, op8_weak_toxicity, op9_flat_graph_dedup, op10_odd_sketch_dedup, op11_spelling_variants, op12_prefix_trie, op13_token_codes]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracles.SQL.items() if k in registered()}
