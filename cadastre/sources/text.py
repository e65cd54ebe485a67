"""Readers of pages, diffs, changelogs and exception tables, and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Changelog headings, and the texts of a findings report.
VERSION_HEADING = r"## \d*\.\d*\.\d* \(\w* \d{1,2}, \d{4}\)"
SECTION_HEADINGS = ("BREAKING CHANGES", "FEATURES", "ENHANCEMENTS", "BUG FIXES")
FINDING_LINE = "%s:%d:%d: %s [%s] %s"
FIX_LINE = "    → fix: %s"
TOTALS_LINE = "%d finding(s): %d error(s), %d warning(s)"


def read_pages(spark: SparkSession, path: str, glob: str = "*.markdown") -> DataFrame:
    """Whole pages as (page, text)."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob).select(
        F.col("_metadata.file_path").alias("page"), F.col("value").alias("text")
    )


def page_lines(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row (key, line_no from 0, text) per line of a page."""
    return pages.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "text"))


def map_resource_to_page(resources: DataFrame, pages: DataFrame) -> DataFrame:
    """Page of each resource: by conventional path first, else by page title.

    ``resources`` has (resource, convention_path), ``pages`` (path, title). Of
    pages with one title the last path wins.
    """
    by_path = pages.select(F.col("path").alias("convention_path"), F.col("path").alias("by_path")).distinct()
    by_title = pages.groupBy(F.col("title").alias("resource")).agg(F.max("path").alias("by_title"))
    return (
        resources.join(by_path, "convention_path", "left")
        .join(by_title, "resource", "left")
        .select("resource", F.coalesce("by_path", "by_title").alias("page"))
    )


def read_unified_diff(diffs: DataFrame, key: str, text: str = "text", root: str = "") -> DataFrame:
    """Added lines (key, file, line) of zero-context unified diffs.

    A diff is cut into files, hunks and added lines; the line number is the
    hunk start plus the rank among the hunk's added lines, so no shuffle and no
    window is needed. Hunk headers without a start number do not begin a hunk.
    """
    name = F.trim(F.regexp_extract("file_part", r"^\+\+\+ ([^\n]*)", 1))
    stripped = F.when(F.instr(name, "/") > 0, F.regexp_extract(name, r"^[^/]*/(.*)$", 1)).otherwise(name)
    added = F.filter(
        F.split("hunk", "\n"), lambda line: line.startswith("+") & ~line.startswith("+++ ")
    )
    return (
        diffs.select(key, F.explode(F.split(text, r"(?m)^(?=\+\+\+ )")).alias("file_part"))
        .where(F.col("file_part").startswith("+++ ") & (name != "/dev/null"))
        .select(
            key,
            F.when(stripped.startswith("/"), stripped).otherwise(F.concat(F.lit(root), stripped)).alias("file"),
            F.explode(F.split("file_part", r"(?m)^(?=@@[^+\n]*\+\d+(?:[, ]|$))")).alias("hunk"),
        )
        .where(F.col("hunk").startswith("@@"))
        .select(
            key,
            "file",
            F.regexp_extract("hunk", r"^@@[^+\n]*\+(\d+)", 1).cast("long").alias("start"),
            F.posexplode(added).alias("rank", "line_text"),
        )
        .select(key, "file", (F.col("start") + F.col("rank")).alias("line"))
    )


def read_exceptions(spark: SparkSession, path: str, historical: bool = False) -> DataFrame:
    """Exception rows with surrounding blanks trimmed; historical ones carry no owner."""
    columns = ["module", "service", "version", "stableVersionTargetDate", "responsibleIndividual"]
    rows = spark.read.schema(", ".join(f"{c} STRING" for c in columns)).json(path)
    return rows.select(*(F.trim(c).alias(c) for c in columns), F.lit(historical).alias("historical"))


def read_changelog(lines: DataFrame, key: str) -> DataFrame:
    """Carry version heading and section down the lines of each changelog.

    ``lines`` has (key, line_no, text). A changelog is one file, so a window
    over it holds no more than that file.
    """
    down = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    section = F.coalesce(
        *(F.when(F.col("text").startswith(h), F.lit(h)) for h in SECTION_HEADINGS)
    )
    version = F.when(F.regexp_like("text", F.lit(VERSION_HEADING)), F.col("text"))
    return lines.select(
        key,
        "line_no",
        "text",
        version.isNotNull().alias("is_version"),
        section.isNotNull().alias("is_section"),
        F.last(version, ignorenulls=True).over(down).alias("version"),
        # a version heading closes the section above it
        F.last(F.coalesce(section, F.when(version.isNotNull(), F.lit("UNKNOWN"))), ignorenulls=True)
        .over(down)
        .alias("section"),
    )


def write_findings_json(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines; absent optional fields are left out."""
    findings.write.option("ignoreNullFields", "true").json(path)


def _relative(root: str) -> Column:
    return F.when(F.col("file").startswith(root), F.expr(f"substr(file, {len(root) + 1})")).otherwise(F.col("file"))


def format_findings_text(findings: DataFrame, root: str = "") -> DataFrame:
    """Report lines, and one totals line marked by ``is_total``."""
    message = F.when(
        F.coalesce("resource", F.lit("")) != "", F.concat_ws(": ", "resource", "message")
    ).otherwise(F.col("message"))
    line = F.format_string(FINDING_LINE, _relative(root), "line", "col", "severity", "rule_id", message)
    fix = F.when(F.coalesce("fix", F.lit("")) != "", F.format_string("\n" + FIX_LINE, "fix"))
    errors = F.count(F.when(F.col("severity") == "error", 1))
    totals = findings.agg(
        F.format_string(TOTALS_LINE, F.count("*"), errors, F.count("*") - errors).alias("text")
    ).select("text", F.lit(True).alias("is_total"))
    return findings.select(
        F.concat(line, F.coalesce(fix, F.lit(""))).alias("text"), F.lit(False).alias("is_total")
    ).unionByName(totals)


def rewrite_documents(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Whole text of every page of which at least one line changed.

    Both inputs have (key, line_no, text). A group is one page.
    """
    joined = after.join(before.select(key, "line_no", F.col("text").alias("old_text")), [key, "line_no"], "left")
    pages = joined.groupBy(key).agg(
        F.bool_or(~F.col("text").eqNullSafe(F.col("old_text"))).alias("changed"),
        F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("lines"),
    )
    return pages.where("changed").select(key, F.array_join("lines.text", "\n").alias("text"))
