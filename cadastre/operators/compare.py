"""Comparison of two snapshots of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Comparator = Callable[[Column, Column], Column]


def compare_snapshots(
    old: DataFrame, new: DataFrame, key: str, columns: dict[str, Comparator | None]
) -> DataFrame:
    """Per key: status of every column, the changed columns, and the row's status.

    A column is same, suppressed (its comparator lets the difference pass) or
    changed. One full outer join on the key; the rest is narrow.
    """
    sides = [
        df.select(key, F.struct(*columns).alias(name)) for df, name in ((old, "o"), (new, "n"))
    ]
    joined = sides[0].join(sides[1], key, "full_outer")
    statuses = {}
    for column, comparator in columns.items():
        o, n = F.col(f"o.{column}"), F.col(f"n.{column}")
        status = F.when(o.eqNullSafe(n), "same")
        if comparator is not None:
            status = status.when(comparator(o, n), "suppressed")
        statuses[column] = status.otherwise("changed")
    listed = F.array(*(F.struct(F.lit(c).alias("column"), s.alias("status")) for c, s in statuses.items()))
    out = joined.withColumn("columns", listed).withColumn(
        "changed", F.transform(F.filter("columns", lambda c: c["status"] == "changed"), lambda c: c["column"])
    )
    row_status = (
        F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed")
        .when(F.size("changed") > 0, "changed").otherwise("same")
    )
    return out.withColumn("status", row_status)


def column_statuses(compared: DataFrame, key: str) -> DataFrame:
    """One row (key, column, status) per column of keys on both sides."""
    return compared.where("o IS NOT NULL AND n IS NOT NULL").select(key, F.inline("columns"))


def changes_except(compared: DataFrame, ignored: list[str]) -> DataFrame:
    """Rows with a change outside of ``ignored``."""
    return compared.where(F.size(F.array_except("changed", F.array(*(F.lit(c) for c in ignored)))) > 0)


def replace_or_update(
    compared: DataFrame, force_new: list[str], force_new_if: dict[str, Column] | None = None
) -> DataFrame:
    """Add ``action``: replace if a changed column forces a new row, else update, else none.

    ``force_new_if`` holds columns that only force one under a condition over
    ``o`` and ``n``.
    """
    forced = F.arrays_overlap("changed", F.array(*(F.lit(c) for c in force_new)))
    for column, condition in (force_new_if or {}).items():
        forced = forced | (F.array_contains("changed", column) & F.coalesce(condition, F.lit(False)))
    action = (
        F.when(F.col("status") == "added", "create").when(F.col("status") == "removed", "delete")
        .when(F.size("changed") == 0, "none").when(forced, "replace").otherwise("update")
    )
    return compared.withColumn("action", action)


def exclusive_changes(compared: DataFrame, a: str, b: str) -> DataFrame:
    """Rows on both sides in which two columns changed that must not change together."""
    both = F.array_contains("changed", a) & F.array_contains("changed", b)
    return compared.where("o IS NOT NULL AND n IS NOT NULL").where(both).withColumn(
        "error", F.lit(f"switching between {a} and {b} is not supported")
    )
