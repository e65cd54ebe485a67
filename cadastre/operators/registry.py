"""Registration catalogue and provider statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.functions.names import common_prefix

# The registration methods, what each one registers, and how.
METHODS = {
    "SupportedResources": ("resource", "legacy"),
    "SupportedDataSources": ("data_source", "legacy"),
    "Resources": ("resource", "modern"),
    "DataSources": ("data_source", "modern"),
    "FrameworkResources": ("resource", "modern"),
    "FrameworkDataSources": ("data_source", "modern"),
    "EphemeralResources": ("ephemeral", "modern"),
    "ListResources": ("list", "modern"),
    "Actions": ("action", "modern"),
}
MAP_ENTRY = r'"([a-z0-9_]+)":\s*(\w+)\('
SLICE_ENTRY = r"(?m)^[ \t]+(\w+)\{\},"
CONSTRUCTOR_ENTRY = r"(?m)^[ \t]+([Nn]ew\w+),"


def _method_value(position: int) -> Column:
    value = F.lit(None).cast("string")
    for method, pair in METHODS.items():
        value = F.when(F.col("method") == method, pair[position]).otherwise(value)
    return value


def registration_texts(symbols: DataFrame) -> DataFrame:
    """Registration methods (service, method, body) of a parsed symbol index."""
    return symbols.where(
        (F.col("kind") == "method") & (F.col("receiver") == "Registration") & F.col("name").isin(list(METHODS))
    ).select("service", F.col("name").alias("method"), "body")


def resource_type_names(symbols: DataFrame) -> DataFrame:
    """Type name that each receiver's ``ResourceType`` method returns, one row per receiver."""
    literal = F.regexp_extract("body", r'return "([^"]+)"', 1)
    return (
        symbols.where((F.col("kind") == "method") & (F.col("name") == "ResourceType") & (literal != ""))
        .groupBy("service", "receiver")
        .agg(F.min(literal).alias("resource_type"))
    )


def untyped_mappings(texts: DataFrame) -> DataFrame:
    """(service, object_kind, resource_type, registration_method) of map literals."""
    entries = F.arrays_zip(
        F.regexp_extract_all("body", F.lit(MAP_ENTRY), F.lit(1)).alias("resource_type"),
        F.regexp_extract_all("body", F.lit(MAP_ENTRY), F.lit(2)).alias("registration_method"),
    )
    return (
        texts.where(F.col("method").isin("SupportedResources", "SupportedDataSources"))
        .select("service", _method_value(0).alias("object_kind"), F.inline(entries))
    )


def typed_registrations(texts: DataFrame) -> DataFrame:
    """(service, object_kind, receiver) of slice literals."""
    return texts.where(F.col("method").isin("Resources", "DataSources")).select(
        "service",
        _method_value(0).alias("object_kind"),
        F.explode(F.regexp_extract_all("body", F.lit(SLICE_ENTRY), F.lit(1))).alias("receiver"),
    )


def resolve_typed_names(typed: DataFrame, type_names: DataFrame) -> DataFrame:
    """Add the type name that a receiver returns; unknown receivers keep null.

    ``type_names`` has (service, receiver, resource_type), one row per receiver.
    """
    return typed.join(type_names, ["service", "receiver"], "left")


def other_registrations(texts: DataFrame) -> DataFrame:
    """(service, object_kind, constructor) of ephemeral, list, action and framework lists."""
    entries = F.array_union(
        F.regexp_extract_all("body", F.lit(CONSTRUCTOR_ENTRY), F.lit(1)),
        F.regexp_extract_all("body", F.lit(SLICE_ENTRY), F.lit(1)),
    )
    other = ["EphemeralResources", "ListResources", "Actions", "FrameworkResources", "FrameworkDataSources"]
    return texts.where(F.col("method").isin(other)).select(
        "service", "method", _method_value(0).alias("object_kind"), F.explode(entries).alias("constructor")
    )


def all_registrations(*parts: DataFrame) -> DataFrame:
    """Union of registrations; a type registered in two ways counts once."""
    columns = ["service", "object_kind", "resource_type"]
    out = parts[0].select(columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(columns))
    return out.distinct()


def registrations_from_texts(texts: DataFrame, type_names: DataFrame) -> DataFrame:
    """Every registration with its style, as the statistics take them.

    A typed receiver whose type name is unknown counts under its own name, and
    so does a constructor.
    """
    untyped = untyped_mappings(texts).withColumn("style", F.lit("legacy"))
    typed = resolve_typed_names(typed_registrations(texts), type_names).select(
        "service", "object_kind", F.coalesce("resource_type", "receiver").alias("resource_type"),
        F.col("receiver").alias("registration_method"), F.lit("modern").alias("style"),
    )
    other = other_registrations(texts).select(
        "service", "object_kind", F.col("constructor").alias("resource_type"), F.col("constructor").alias("registration_method"),
        F.when(F.col("object_kind") == "ephemeral", "ephemeral").otherwise("modern").alias("style"),
    )
    return untyped.unionByName(typed).unionByName(other)


def _flags() -> list[Column]:
    resource = F.col("object_kind") == "resource"
    return [
        F.max(F.when(F.col("object_kind") == "data_source", 1).otherwise(0)).alias("d"),
        F.max(F.when(resource, 1).otherwise(0)).alias("r"),
        F.max(F.when(resource & (F.col("style") == "legacy"), 1).otherwise(0)).alias("l"),
        F.max(F.when(resource & (F.col("style") == "modern"), 1).otherwise(0)).alias("m"),
        F.max(F.when(F.col("style") == "ephemeral", 1).otherwise(0)).alias("e"),
    ]


_FLAG_NAMES = {
    "d": "total_data_sources",
    "r": "total_resources",
    "l": "legacy_resources",
    "m": "modern_resources",
    "e": "ephemeral_resources",
}


def provider_statistics(registrations: DataFrame) -> DataFrame:
    """The six counts of a provider, as one row.

    Five distinct counts in one aggregate would copy every row five times.
    Instead each type is folded to five flags (combined on the map side, one
    shuffle), and the flags are summed; services likewise fold to one row each.
    """
    per_type = registrations.groupBy("resource_type").agg(*_flags()).drop("resource_type")
    per_service = registrations.select("service").distinct().select(F.lit(1).alias("s"))
    parts = per_type.unionByName(per_service, allowMissingColumns=True)
    names = {"s": "service_count", **_FLAG_NAMES}
    return parts.agg(*(F.coalesce(F.sum(f), F.lit(0)).alias(n) for f, n in names.items()))


def service_rollup(registrations: DataFrame) -> DataFrame:
    """The same counts per service, and over all services where service is null."""
    per_type = registrations.groupBy("service", "resource_type").agg(*_flags())
    per_service = per_type.groupBy("service").agg(*(F.sum(f).alias(n) for f, n in _FLAG_NAMES.items()))
    total = (
        per_type.groupBy("resource_type")
        .agg(*(F.max(f).alias(f) for f in _FLAG_NAMES))
        .agg(*(F.coalesce(F.sum(f), F.lit(0)).alias(n) for f, n in _FLAG_NAMES.items()))
        .withColumn("service", F.lit(None).cast("string"))
    )
    return per_service.unionByName(total)


def duplicate_registrations(registrations: DataFrame) -> DataFrame:
    """Types registered more than once, with the number of rows and of services."""
    per_service = registrations.groupBy("resource_type", "service").agg(F.count("*").alias("n"))
    return (
        per_service.groupBy("resource_type")
        .agg(F.sum("n").alias("registrations"), F.count("*").alias("services"))
        .where("registrations > 1")
    )


def website_categories(*services: DataFrame) -> DataFrame:
    """Distinct categories of every service list, sorted."""
    out = services[0].select("category")
    for part in services[1:]:
        out = out.unionByName(part.select("category"))
    return out.distinct().orderBy("category")


def service_filter(services: DataFrame, skipped: DataFrame) -> DataFrame:
    """Services that are not in the skip list (an anti join, so any list size works)."""
    return services.join(skipped.select("service").distinct(), "service", "left_anti")


def names_by_label(names: DataFrame) -> DataFrame:
    """Distinct resource names per label, one row per (label, name)."""
    return names.select("label", "name").distinct()


def label_prefixes(names: DataFrame, group: Column) -> DataFrame:
    """Longest common prefix of each (label, group) of names: that of its least and greatest."""
    return (
        names.groupBy("label", group.alias("name_group"))
        .agg(F.min("name").alias("first"), F.max("name").alias("last"))
        .select("label", "name_group", common_prefix(F.col("first"), F.col("last")).alias("prefix"))
    )


def prefix_conflicts(prefixes: DataFrame) -> DataFrame:
    """(label, prefix) whose prefix lies inside a prefix of another label.

    "Lies inside" is turned into an equality: every prefix is expanded to its
    own substrings, which are folded to the least and greatest label that has
    them. Prefixes are short names, so the expansion is small per row.
    """
    text = F.col("prefix")
    starts = F.sequence(F.lit(1), F.length(text) + 1)
    pieces = F.flatten(
        F.transform(
            starts,
            lambda s: F.transform(
                F.sequence(F.lit(0), F.length(text) - s + 1), lambda n: F.substr(text, s, n)
            ),
        )
    )
    inside = (
        prefixes.select("label", F.explode(F.array_distinct(pieces)).alias("prefix"))
        .groupBy("prefix")
        .agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    )
    return (
        prefixes.select("label", "prefix")
        .distinct()
        .join(inside, "prefix")
        .where((F.col("lo") != F.col("label")) | (F.col("hi") != F.col("label")))
        .select("label", "prefix")
    )


def deprecation_report(resources: DataFrame, replacements: DataFrame) -> DataFrame:
    """Deprecated resources with the text to show: what replaces them, else their own message.

    ``resources`` has (service, resource_type, deprecation_message),
    ``replacements`` (resource_type, replaced_by).
    """
    return (
        resources.join(replacements, "resource_type", "left")
        .withColumn("notice", F.coalesce(F.nullif("replaced_by", F.lit("")), F.nullif("deprecation_message", F.lit(""))))
        .where("notice IS NOT NULL")
        .select("service", "resource_type", "notice", F.col("replaced_by").isNotNull().alias("has_replacement"))
    )
