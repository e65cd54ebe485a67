"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastre.llm import codes, html_extract, line_dedup, mixing, negatives, paragraph_dedup, pieces, quality, rules, setsketch, sharding, topk
from cadastre.llm.jaccard_join import jaccard_components
from cadastre.llm.twins import SQL  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The piece vocabulary: ``LLM_PIECES`` if set, else that of the installed package."""
    if named := os.environ.get("LLM_PIECES"):
        return named
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@_query
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and where in its order: the first slot and the number of slots."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.taken.join(mixed.sources, "k").select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


@_query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


@_query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, and whether they decode to its text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, tokenizer_path())
    return coded.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.size("pieces").cast("long").alias("n_pieces"), "pieces", F.col("pieces_lossless").alias("lossless"))


@_query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, equal texts together, counts at most one apart."""
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=8)


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return rules.judge(_table(spark, sf_dir, "documents"))


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with a line: its lines, and the places of those within two edits of an earlier one."""
    out = line_dedup.removed_lines(_table(spark, sf_dir, "documents"), tau=2, least=16)
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


@_query
def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by linked component, at four words and 0.85."""
    return jaccard_components(_table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


@_query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that documents share, and which copy stays."""
    return paragraph_dedup.repeated_passages(_table(spark, sf_dir, "documents"), percent=80)


@_query
def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=5, every=50)


@_query
def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by linked component and whether each stays, at two words and 0.8."""
    return setsketch.near_duplicates(_table(spark, sf_dir, "documents"), n=2, percent=80)


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector: 16 parts, 64 entries, two rounds."""
    return codes.compress(_table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)


@_query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every fiftieth vector; every seventh label is moved on by one."""
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", moved), every=50, positives=5, negatives=3, least=50, most=95)
