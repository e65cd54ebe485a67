"""Validation of columns against rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastre.functions.validators import NAME_RULES, UUID_V4, check

TEXT_TYPES = ("string",)


@dataclass(frozen=True)
class Rule:
    """One rule on one column; rules are data, and only shape the plan."""

    id: str
    column: str
    kind: str
    args: dict = field(default_factory=dict)


def _violation(rule: Rule) -> Column:
    value = F.col(rule.column)
    error = F.when(value.isNull(), F.lit(f"{rule.column} has no value of the expected type")).otherwise(
        check(rule.kind, value, rule.column, rule.args)
    )
    return F.when(
        error.isNotNull(),
        F.struct(F.lit(rule.column).alias("column"), F.lit(rule.id).alias("rule_id"), error.alias("message")),
    )


def violations_column(rules: list[Rule]) -> Column:
    """All violations of a row, as an array."""
    return F.array_compact(F.array(*(_violation(r) for r in rules)))


def validate_columns(rows: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """One row (key, column, rule_id, message) per violation, in one pass over the table."""
    return rows.select(key, F.inline(violations_column(rules)))


def split_by_validity(rows: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their violations; no join is needed."""
    marked = rows.withColumn("violations", violations_column(rules))
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def violation_counts(violations: DataFrame) -> DataFrame:
    """Violations per rule and column."""
    return violations.groupBy("column", "rule_id").agg(F.count("*").alias("violations"))


NAME_RULE = "kind string, rule_id string, rule string, pattern string, least int, most int, message string"


def name_rules(spark: SparkSession, rules: dict[str, list[tuple[str, dict]]] = NAME_RULES) -> DataFrame:
    """The table of name rules, from rule lists by kind; any table of these columns serves as well."""
    rows = []
    for kind, listed in rules.items():
        for number, (rule, args) in enumerate(listed, start=1):
            pattern = args.get("pattern", args.get("chars"))
            message = args.get("text") or NAME_MESSAGES[rule].format(**args)
            rows.append((kind, f"{kind}-{number}", rule, pattern, args.get("min"), args.get("max"), message))
    return spark.createDataFrame(rows, NAME_RULE)


NAME_MESSAGES = {
    "not_white_space": "must not be empty or white space",
    "length_between": "must have a length from {min} to {max}",
    "contains_none_of": "must not contain any of {chars}",
    "match": "must match {pattern}",
    "not_match": "must not match {pattern}",
}


def validate_names(rows: DataFrame, key: str, rules: DataFrame) -> DataFrame:
    """Check names (key, kind, name) by the rules of their kind; kinds without rules pass, as do null names.

    ``rules`` is a table as ``name_rules`` gives it: kind, rule_id, the rule (match, not_match,
    not_white_space, length_between in bytes, contains_none_of), its pattern or characters, bounds and message.
    A rule that is none of these breaks every name. The rules of a kind are gathered, so names are joined once
    and never multiplied.
    """
    per_kind = rules.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("rule_id", "rule", "pattern", "least", "most", "message"))).alias("rules"))

    def broken(rule: Column) -> Column:
        name, pattern = F.col("name"), rule["pattern"]
        passes = (
            F.when(rule["rule"] == "match", F.rlike(name, pattern))
            .when(rule["rule"] == "not_match", ~F.rlike(name, pattern))
            .when(rule["rule"] == "not_white_space", name.rlike(r"\S"))
            .when(rule["rule"] == "length_between", F.octet_length(name).between(rule["least"], rule["most"]))
            .when(rule["rule"] == "contains_none_of", F.call_function("translate", name, pattern, F.lit("")) == name)
        )
        return name.isNotNull() & ~F.coalesce(passes, F.lit(False))

    found = F.transform(F.filter("rules", broken), lambda r: F.struct(r["rule_id"].alias("rule_id"), F.concat(F.lit("name "), r["message"]).alias("message")))
    return rows.select(key, "kind", "name").join(per_kind, "kind").select(key, "kind", F.inline(found))


def validate_maps(
    rows: DataFrame, key: str, column: str, max_keys: int = 50, max_key: int = 128, max_value: int = 256,
    key_pattern: str = r"^([a-z_]{1}[a-z0-9_]{1,})$", forbidden: tuple[str, ...] = (),
) -> DataFrame:
    """Violations of map rules: number of keys, lengths in bytes, key pattern, forbidden keys."""
    entries = F.map_entries(column)

    def bad(condition, rule: str) -> Column:
        wrong = F.filter(entries, condition)
        return F.transform(wrong, lambda e: F.struct(F.lit(rule).alias("rule_id"), e["key"].alias("map_key")))

    too_many = F.when(
        F.size(F.map_keys(column)) > max_keys,
        F.array(F.struct(F.lit("max_keys").alias("rule_id"), F.lit(None).cast("string").alias("map_key"))),
    ).otherwise(F.array().cast("array<struct<rule_id:string,map_key:string>>"))
    found = F.concat(
        too_many,
        bad(lambda e: F.octet_length(e["key"]) > max_key, "key_length"),
        bad(lambda e: F.octet_length(e["value"]) > max_value, "value_length"),
        bad(lambda e: ~e["key"].rlike(key_pattern), "key_pattern"),
        bad(lambda e: F.lower(e["key"]).isin(list(forbidden)), "forbidden_key"),
    )
    return rows.select(key, F.inline(found))


def block_combinations(
    blocks: DataFrame, parent: str, exclusive: list[tuple[str, str]], at_most: int = 5, parents: DataFrame | None = None
) -> DataFrame:
    """First error per parent of its blocks (parent, kind): none, exclusive kinds together, too many.

    ``parents`` names parents that may have no block at all.
    """
    kinds = list(dict.fromkeys(k for pair in exclusive for k in pair))
    counts = blocks.groupBy(parent).agg(
        F.count("*").alias("total"), *(F.count(F.when(F.col("kind") == k, 1)).alias("n_" + k) for k in kinds)
    )
    if parents is not None:
        counts = parents.select(parent).distinct().join(counts, parent, "left").fillna(0)
    error = F.when(F.col("total") == 0, "the block must define at least one action")
    for a, b in exclusive:
        error = error.when(
            (F.col("n_" + a) > 0) & (F.col("n_" + b) > 0), f"cannot specify both `{a}` and `{b}` in the block"
        )
    error = error.when(
        F.col("total") > at_most, F.format_string(f"the block may only contain up to {at_most} actions, got %d", "total")
    )
    return counts.select(parent, "total", error.alias("error"))


def reference_list_check(rows: DataFrame, key: str, column: str, reference: DataFrame | None) -> DataFrame:
    """Rows (key, value, error) whose value is empty or not in the reference table.

    Without a loaded table only emptiness is checked.
    """
    value = F.col(column)
    empty = rows.where(F.coalesce(value, F.lit("")) == "").select(
        key, value.alias("value"), F.lit("must not be empty").alias("error")
    )
    if reference is None:
        return empty
    known = reference.select(F.col("name").alias("__known")).distinct()
    error = F.when(F.coalesce(value, F.lit("")) == "", "must not be empty").otherwise("was not found in the list of supported names")
    # an empty value is an error even if the table lists it, so it meets nothing
    return rows.join(known, (value == F.col("__known")) & (value != ""), "left_anti").select(key, value.alias("value"), error.alias("error"))


# Expectations on a column: name -> condition(column, argument).
EXPECTATIONS = {
    "exists": lambda c, _: c.isNotNull(),
    "absent": lambda c, _: c.isNull(),
    "equals": lambda c, arg: c.cast("string").eqNullSafe(F.lit(arg)),
    "is_empty": lambda c, _: c.cast("string").eqNullSafe(F.lit("")),
    "not_empty": lambda c, _: F.coalesce(c.cast("string"), F.lit("")) != "",
    "is_uuid": lambda c, _: F.coalesce(c.cast("string"), F.lit("")).rlike(UUID_V4),
    "matches_column": lambda c, arg: c.eqNullSafe(F.col(arg)),
    "matches": lambda c, arg: F.coalesce(c.cast("string"), F.lit("")).rlike(arg),
}


def table_expectations(rows: DataFrame, expectations: list[tuple[str, str, str | None]]) -> DataFrame:
    """One row (expectation, passed, failures) per (column, check, argument), from one pass."""
    failed = []
    for number, (column, name, arg) in enumerate(expectations):
        failed.append(F.count(F.when(~EXPECTATIONS[name](F.col(column), arg), 1)).alias(f"e{number}"))
    labels = [f"{column} {name}" + (f" {arg}" if arg is not None else "") for column, name, arg in expectations]
    counted = rows.agg(*failed)
    report = F.array(
        *(F.struct(F.lit(label).alias("expectation"), F.col(f"e{i}").alias("failures")) for i, label in enumerate(labels))
    )
    return counted.select(F.inline(report)).withColumn("passed", F.col("failures") == 0)


def priority_in_range(rows: DataFrame, group: str, priority: str) -> DataFrame:
    """Groups in which some priority is above group size - 1."""
    return rows.groupBy(group).agg(
        F.count("*").alias("size"), (F.max(priority) > F.count("*") - 1).alias("bad")
    )
