"""A training corpus in five stages, each applied to all that the one before kept.

1. quality classifier: documents scored below 0.3 go
2. line dedup: lines within two edits of an earlier line go, and documents left without a line
3. n-gram Jaccard join: of documents linked at five words and 0.8 the one of smallest id stays
4. mixing: sources in the weights 3, 1, 2, repeating; a document comes as often as it is taken
5. SentencePiece: the pieces of every document

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of documents. A null or empty text scores by the bias of the classifier, loses no
line, is linked with nothing and is not taken into the mix. Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cadastre.llm import jaccard_join, line_dedup, mixing, pieces, quality
from cadastre.llm.queries import tokenizer_path
from cadastre.session import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``sf_dir``, does not reject."""
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, weights, "__score").where("__score >= 0.3").drop("__score")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that come earlier."""
    return line_dedup.dedup_lines(docs, tau=2, least=16)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.one_of_each_group(docs, n=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, most=2.0)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document, and whether they decode to its text."""
    return pieces.encode(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", pieces_stage),
]

# a fitted classifier and sampled pieces are beyond SQL; tests compare with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
