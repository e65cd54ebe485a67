"""Schema snapshots: JSON wrappers that hold resources and data sources.

A snapshot may be one document or any number of them (for example one per
service or per property); reading merges them, so neither reading nor writing
gathers a whole provider in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastre.session import materialise

_RESOURCES = T.MapType(T.StringType(), T.VariantType())
WRAPPER = T.StructType(
    [
        T.StructField("providerName", T.StringType()),
        T.StructField("schemaVersion", T.StringType()),
        T.StructField(
            "providerSchema",
            T.StructType(
                [
                    T.StructField("schema", _RESOURCES),
                    T.StructField("resources", _RESOURCES),
                    T.StructField("dataSources", _RESOURCES),
                ]
            ),
        ),
    ]
)

TIMEOUTS = ("create", "read", "update", "delete")

# Names of the numeric config modes.
CONFIG_MODES = {1: "Auto", 2: "Block", 4: "Attribute"}


def read_snapshot_parts(spark: SparkSession, path: str) -> DataFrame:
    """Rows (provider, version, kind, resource, node) of every document, as they stand.

    The provider's own schema is a row of kind ``provider``, under the provider's name.
    """
    wrappers = spark.read.schema(WRAPPER).json(path)
    own = F.when(F.size("providerSchema.schema") > 0, F.create_map("providerName", F.to_variant_object(F.struct(F.col("providerSchema.schema").alias("schema")))))
    kinds = F.map_from_arrays(
        F.array(F.lit("resource"), F.lit("data source"), F.lit("provider")),
        F.array("providerSchema.resources", "providerSchema.dataSources", own),
    )
    return wrappers.select(
        F.col("providerName").alias("provider"),
        F.col("schemaVersion").alias("version"),
        F.explode(kinds).alias("kind", "members"),
    ).select("provider", "version", "kind", F.explode("members").alias("resource", "node"))


def read_schema_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row (provider, version, kind, resource, node) per resource, data source and provider schema.

    Documents that hold parts of one resource are put together: its properties by name (of
    two of one name that whose text is least), and the greatest of each timeout. A
    resource that stands in one document is taken as it is.
    """
    return merge_snapshot_parts(read_snapshot_parts(spark, path))


def merge_snapshot_parts(parts: DataFrame) -> DataFrame:
    """Rows of ``read_snapshot_parts`` folded by resource.

    The parts are written once, for the JSON they come from is slow to read. Which resources stand
    in several documents is found by their names alone; where these are few, no node is shuffled but theirs.
    """
    keys = ["provider", "version", "kind", "resource"]
    found = materialise(parts, "parts").withColumn("at", F.struct(*keys))
    several = materialise(found.groupBy("at").agg(F.count("*").alias("n")).where("n > 1").select("at"), "several")
    split = found.join(several, "at", "left_semi").drop("at")
    timeouts = [F.max(F.expr(f"try_variant_get(node, '$.timeouts.{t}', 'int')")).alias(t) for t in TIMEOUTS]
    properties = (
        split.select(*keys, F.explode(F.expr("try_variant_get(node, '$.schema', 'map<string,variant>')")).alias("name", "p"))
        .groupBy(*keys, "name").agg(F.min(F.to_json("p")).alias("p"))
        .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("name", F.parse_json("p")))).alias("schema"))
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    # as JSON text a timeout that is not there leaves no trace
    node = F.to_json(
        F.struct(
            F.coalesce("schema", none).alias("schema"),
            F.when(F.coalesce(*(F.col(f"`{t}`") for t in TIMEOUTS)).isNotNull(), F.struct(*(F.col(f"`{t}`") for t in TIMEOUTS))).alias("timeouts"),
        )
    )
    merged = split.groupBy(*keys).agg(*timeouts).join(properties, keys, "left").select(*keys, F.parse_json(node).alias("node"))
    return found.join(several, "at", "left_anti").select(*keys, "node").unionByName(merged)


def _typed(field: str, sql_type: str, variant_type: str, zero: str) -> str:
    at = f"variant_get(node, '$.{field}')"
    return f"CASE WHEN schema_of_variant({at}) = '{variant_type}' THEN try_variant_get(node, '$.{field}', '{sql_type}') ELSE {zero} END"


def _number(field: str) -> str:
    at = f"variant_get(node, '$.{field}')"
    return (
        f"CASE WHEN schema_of_variant({at}) IN ('BIGINT', 'DOUBLE') OR schema_of_variant({at}) LIKE 'DECIMAL%'"
        f" THEN CAST(try_variant_get(node, '$.{field}', 'double') AS INT) ELSE 0 END"
    )


def property_columns() -> list:
    """Lenient attributes of one variant ``node``: a wrong type reads as the zero value.

    ``minItems`` and ``maxItems`` stay two columns.
    """
    default = "variant_get(node, '$.default')"
    return [
        F.expr(_typed("type", "string", "STRING", "''")).alias("type"),
        F.expr(_typed("configMode", "string", "STRING", "''")).alias("config_mode"),
        F.expr(_typed("optional", "boolean", "BOOLEAN", "false")).alias("optional"),
        F.expr(_typed("required", "boolean", "BOOLEAN", "false")).alias("required"),
        F.expr(_typed("computed", "boolean", "BOOLEAN", "false")).alias("computed"),
        F.expr(_typed("forceNew", "boolean", "BOOLEAN", "false")).alias("force_new"),
        F.expr(_typed("description", "string", "STRING", "''")).alias("description"),
        F.expr(_number("maxItems")).alias("max_items"),
        F.expr(_number("minItems")).alias("min_items"),
        F.expr(
            f"CASE WHEN schema_of_variant({default}) LIKE 'OBJECT%' OR schema_of_variant({default}) LIKE 'ARRAY%'"
            " THEN NULL ELSE try_variant_get(node, '$.default', 'string') END"
        ).alias("default_value"),
        F.expr(
            "CASE WHEN try_variant_get(node, '$.elem.type', 'string') IS NOT NULL"
            " THEN try_variant_get(node, '$.elem.type', 'string')"
            " WHEN variant_get(node, '$.elem.schema') IS NOT NULL THEN 'block' END"
        ).alias("elem"),
    ]


def decode_schema_node(nodes: DataFrame, json_column: str = "node_json") -> DataFrame:
    """Decode one property node per row from JSON text; bad JSON gives null attributes."""
    parsed = nodes.withColumn("node", F.try_parse_json(json_column))
    return parsed.select(*nodes.columns, *property_columns())


def config_mode_name(code) -> "F.Column":
    """Numeric config mode to its name, else the empty string."""
    out = F.lit("")
    for number, name in CONFIG_MODES.items():
        out = F.when(code == number, name).otherwise(out)
    return out


def write_schema_snapshot(
    properties: DataFrame, path: str, provider: str = "sample", version: str = "1",
    timeouts: DataFrame | None = None, provider_schema: DataFrame | None = None, mode: str = "errorifexists",
) -> None:
    """Write a snapshot as wrapper documents: one per property, per resource with timeouts, and per property of the provider.

    ``properties`` holds (kind, resource, name, node_json); a row without name is a resource
    without properties. ``timeouts`` holds (kind, resource, create, read, update, delete) in
    minutes, ``provider_schema`` (name, node_json). Nothing is grouped, so the size of a
    resource or provider does not matter; the reader puts the documents together.
    """
    schema = F.when(F.col("name").isNotNull(), F.create_map(F.coalesce("name", F.lit("")), F.parse_json("node_json")))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    empty = F.struct(*(F.lit(None).cast("int").alias(t) for t in TIMEOUTS))
    no_times = F.when(F.lit(False), empty)
    parts = [properties.select("kind", "resource", F.struct(F.coalesce(schema, none).alias("schema"), no_times.alias("timeouts")).alias("node"))]
    if timeouts is not None:
        times = F.struct(*(F.col(f"`{t}`").cast("int").alias(t) for t in TIMEOUTS))
        parts.append(timeouts.select("kind", "resource", F.struct(none.alias("schema"), F.when(F.lit(True), times).alias("timeouts")).alias("node")))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    entry = F.create_map("resource", "node")
    documents = rows.select(
        F.lit(provider).alias("providerName"),
        F.lit(version).alias("schemaVersion"),
        F.when(F.lit(False), none).alias("own"),
        F.when(F.col("kind") == "resource", entry).alias("resources"),
        F.when(F.col("kind") == "data source", entry).alias("dataSources"),
    )
    if provider_schema is not None:
        nothing = F.lit(None).cast(documents.schema["resources"].dataType)
        documents = documents.unionByName(
            provider_schema.select(
                F.lit(provider).alias("providerName"), F.lit(version).alias("schemaVersion"), F.create_map("name", F.parse_json("node_json")).alias("own"),
                nothing.alias("resources"), nothing.alias("dataSources"),
            )
        )
    documents.select(
        "providerName", "schemaVersion", F.struct(F.col("own").alias("schema"), "resources", "dataSources").alias("providerSchema")
    ).write.mode(mode).json(path)
