"""Reading a symbol index: one small text file per declaration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The layout of an index file name and of its text.
SYMBOL_SUFFIX = ".goindex"
TEST_SUFFIX = "_test.go"
HEADER = r"(?s)^package [^\n]*\n(?:import \(.*?\n\)\n|import [^\n]*\n)?(.*)$"


def scan_symbol_index(
    spark: SparkSession, paths: str | list[str], suffix: str = SYMBOL_SUFFIX, skip: str = TEST_SUFFIX
) -> DataFrame:
    """One row (path, text) per index file below ``paths``.

    Overlapping targets are folded. Opening many tiny files is slow, so run
    this once and keep its rows as Parquet.
    """
    targets = [paths] if isinstance(paths, str) else list(paths)
    files = (
        spark.read.text(targets, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}")
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
        .where(~F.col("path").endswith(skip))
    )
    return files.dropDuplicates(["path"]) if len(targets) > 1 else files


def parse_symbol_path(symbols: DataFrame) -> DataFrame:
    """Add kind, receiver, name, package_dir, service and subpackage."""
    path = F.translate("path", "\\", "/")
    file = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.goindex$", "")
    kind = F.regexp_extract(file, r"^(func|method|type|var)\.", 1)
    package_dir = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return symbols.select(
        "*",
        kind.alias("kind"),
        F.when(kind == "method", F.split_part(file, F.lit("."), F.lit(2))).alias("receiver"),
        F.when(kind == "method", F.regexp_extract(file, r"^method\.[^.]*\.(.*)$", 1))
        .otherwise(F.regexp_extract(file, r"^[a-z]+\.(.*)$", 1))
        .alias("name"),
        package_dir.alias("package_dir"),
        F.nullif(F.regexp_extract(path, r"(?i)(?:^|/)services/([^/]+)", 1), F.lit("")).alias("service"),
        F.regexp_extract(package_dir, r"(?i)(?:^|/)services/[^/]+/(.*)$", 1).alias("subpackage"),
    )


def parse_symbol_text(symbols: DataFrame) -> DataFrame:
    """Add package, import_block, body, decl_line and loc."""
    body = F.regexp_extract("text", HEADER, 1)
    header = F.expr("left(text, length(text) - length(body))")
    return (
        symbols.withColumn("body", body)
        .withColumn("header", header)
        .withColumn("package", F.regexp_extract("text", r"^package ([^\n]*)", 1))
        .withColumn("import_block", F.regexp_extract("header", r"(?s)import (.*)", 1))
        .withColumn("decl_line", (F.regexp_count("header", F.lit("\n")) + 1).cast("int"))
        .withColumn("loc", (F.regexp_count(F.rtrim("body", F.lit("\n")), F.lit("\n")) + 1).cast("int"))
        .drop("header")
    )
