"""State migrations: versioned rewrites of a table of state maps.

A state is a ``map<string, string>``. Every step is a column expression, so a
chain of any length is one narrow pass over the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.operators.ids import formatted_id, parse_by_template

Step = Callable[[Column], Column]
STEP_NAME = r"V(\d+)[tT]oV(\d+)"


def _put(state: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(state, lambda k, _: k != key), F.create_map(F.lit(key), value))


def rename_field(old: str, new: str) -> Step:
    """Move a value to a new key, only if the old one is there."""
    def step(state: Column) -> Column:
        kept = F.map_filter(state, lambda k, _: ~k.isin(old, new))
        moved = F.map_concat(kept, F.create_map(F.lit(new), F.try_element_at(state, F.lit(old))))
        return F.when(F.map_contains_key(state, old), moved).otherwise(state)

    return step


def conditional_drop(key: str, other: str, keep_value: str) -> Step:
    """Drop a key unless another field has the given value, ignoring case."""
    def step(state: Column) -> Column:
        keep = F.lower(F.coalesce(F.try_element_at(state, F.lit(other)), F.lit(""))) == keep_value.lower()
        return F.when(keep, state).otherwise(F.map_filter(state, lambda k, _: k != key))

    return step


def set_field(key: str, value: str) -> Step:
    return lambda state: _put(state, key, F.lit(value))


def convert_field(key: str, convert: Callable[[Column], Column]) -> Step:
    """Rewrite the value of a field that is there."""
    def step(state: Column) -> Column:
        return F.transform_values(state, lambda k, v: F.when(k == key, convert(v)).otherwise(v))

    return step


def replace_first(text: Column, old: str, new: str) -> Column:
    """Literal replacement of the first occurrence."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.left(text, at - 1), F.lit(new), F.substr(text, at + len(old)))).otherwise(text)


def string_replace(key: str, old: str, new: str) -> Step:
    return convert_field(key, lambda v: replace_first(v, old, new))


def no_change(state: Column) -> Column:
    return state


def rewrite_id(rows: DataFrame, template_rows: DataFrame) -> DataFrame:
    """Write the canonical id into each state (row_key, type, state); errors mark quarantine rows.

    Old ids are read ignoring case.
    """
    parsed = parse_by_template(
        rows.withColumn("id", F.try_element_at("state", F.lit("id"))), template_rows, ignore_case=True
    )
    fixed = F.when(F.col("error").isNull(), _put(F.col("state"), "id", formatted_id())).otherwise(F.col("state"))
    return parsed.withColumn("state", fixed).select(*rows.columns, "error")


def migrate_chain(rows: DataFrame, steps: dict[str, list[Step]]) -> DataFrame:
    """Bring every row (type, version, state) to the latest version of its type.

    ``steps[type][v]`` leads from version v to v + 1. Rows of a type without
    steps, or already at the latest version, stay as they are.
    """
    out = rows
    for kind, chain in steps.items():
        for version, step in enumerate(chain):
            due = (F.col("type") == kind) & (F.col("version") <= version)
            out = out.withColumn("state", F.when(due, step(F.col("state"))).otherwise(F.col("state")))
    latest = F.lit(None).cast("int")
    for kind, chain in steps.items():
        latest = F.when(F.col("type") == kind, len(chain)).otherwise(latest)
    return out.withColumn("version", F.greatest("version", latest))


def chain_gap_check(steps: DataFrame) -> DataFrame:
    """First missing version of each type's steps (type, version), which must run from 0 on.

    Versions are small whole numbers, so their distinct set per type is small too.
    """
    versions = F.array_sort(F.collect_set("version"))
    return (
        steps.groupBy("type")
        .agg(versions.alias("versions"))
        .select(
            "type",
            F.get(
                F.array_sort(F.array_except(F.sequence(F.lit(0), F.array_max("versions").cast("int")), F.transform("versions", lambda v: v.cast("int")))),
                F.lit(0),
            ).alias("missing_version"),
        )
        .where("missing_version IS NOT NULL")
    )


def migration_catalogue(steps: DataFrame) -> DataFrame:
    """Steps (service, step, class) counted by service, versions and class."""
    return (
        steps.select(
            "service",
            F.regexp_extract("step", STEP_NAME, 1).try_cast("int").alias("from_version"),
            F.regexp_extract("step", STEP_NAME, 2).try_cast("int").alias("to_version"),
            "class",
        )
        .groupBy("service", "from_version", "to_version", "class")
        .agg(F.count("*").alias("steps"))
    )
