"""Registration catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.operators import registry as op
from cadastre.plans.inputs import cte, load
from cadastre.plans.registry import query

TEXTS = cte("registration_texts")
MAP_SQL = """
maps AS (SELECT service, CASE method WHEN 'SupportedResources' THEN 'resource' ELSE 'data_source' END AS object_kind,
   unnest(regexp_extract_all(body, '"([a-z0-9_]+)":\\s*(\\w+)\\(', 1)) AS resource_type,
   unnest(regexp_extract_all(body, '"([a-z0-9_]+)":\\s*(\\w+)\\(', 2)) AS registration_method
  FROM registration_texts WHERE method IN ('SupportedResources', 'SupportedDataSources'))"""
SLICE_SQL = """
slices AS (SELECT service, CASE method WHEN 'Resources' THEN 'resource' ELSE 'data_source' END AS object_kind,
   unnest(regexp_extract_all(body, '(?m)^[ \\t]+(\\w+)\\{\\},', 1)) AS receiver
  FROM registration_texts WHERE method IN ('Resources', 'DataSources'))"""
NAMES_SQL = """
type_names AS (SELECT DISTINCT 'svc' || o_custkey AS service, 'Recv' || o_orderkey || 'Resource' AS receiver,
   'type_' || o_orderkey AS resource_type FROM orders WHERE o_totalprice > 100000)"""


@query("reg01_untyped_mappings", TEXTS.rstrip() + "," + MAP_SQL + " SELECT * FROM maps")
def untyped_mappings(spark, sf):
    return op.untyped_mappings(load(spark, sf, "registration_texts"))


@query("reg02_typed_registrations", TEXTS.rstrip() + "," + SLICE_SQL + " SELECT * FROM slices")
def typed_registrations(spark, sf):
    return op.typed_registrations(load(spark, sf, "registration_texts"))


def _type_names(spark, sf):
    orders = load(spark, sf, "orders").where("o_totalprice > 100000")
    return orders.selectExpr(
        "'svc' || o_custkey AS service",
        "'Recv' || o_orderkey || 'Resource' AS receiver",
        "'type_' || o_orderkey AS resource_type",
    ).distinct()


@query(
    "reg03_resolve_typed_names",
    TEXTS.rstrip() + "," + SLICE_SQL + "," + NAMES_SQL
    + " SELECT s.*, t.resource_type FROM slices s LEFT JOIN type_names t USING (service, receiver)",
)
def resolve_typed_names(spark, sf):
    typed = op.typed_registrations(load(spark, sf, "registration_texts"))
    return op.resolve_typed_names(typed, _type_names(spark, sf))


@query(
    "reg04_other_registrations",
    TEXTS
    + """SELECT service, method,
  CASE method WHEN 'EphemeralResources' THEN 'ephemeral' WHEN 'ListResources' THEN 'list' WHEN 'Actions' THEN 'action'
    WHEN 'FrameworkResources' THEN 'resource' ELSE 'data_source' END AS object_kind,
  unnest(list_concat(regexp_extract_all(body, '(?m)^[ \\t]+(New\\w+),', 1),
                     regexp_extract_all(body, '(?m)^[ \\t]+(\\w+)\\{\\},', 1))) AS constructor
FROM registration_texts
WHERE method IN ('EphemeralResources', 'ListResources', 'Actions', 'FrameworkResources', 'FrameworkDataSources')""",
)
def other_registrations(spark, sf):
    return op.other_registrations(load(spark, sf, "registration_texts"))


@query(
    "reg05_all_registrations",
    TEXTS.rstrip() + "," + MAP_SQL + "," + SLICE_SQL + "," + NAMES_SQL
    + """
SELECT service, object_kind, resource_type FROM maps
UNION SELECT service, object_kind, resource_type FROM slices JOIN type_names USING (service, receiver)""",
)
def all_registrations(spark, sf):
    texts = load(spark, sf, "registration_texts")
    typed = op.resolve_typed_names(op.typed_registrations(texts), _type_names(spark, sf))
    return op.all_registrations(op.untyped_mappings(texts), typed.where("resource_type IS NOT NULL"))


_SIX = """count(DISTINCT resource_type) FILTER (object_kind = 'data_source') AS total_data_sources,
  count(DISTINCT resource_type) FILTER (object_kind = 'resource') AS total_resources,
  count(DISTINCT resource_type) FILTER (object_kind = 'resource' AND style = 'legacy') AS legacy_resources,
  count(DISTINCT resource_type) FILTER (object_kind = 'resource' AND style = 'modern') AS modern_resources,
  count(DISTINCT resource_type) FILTER (style = 'ephemeral') AS ephemeral_resources"""


@query(
    "reg06_provider_statistics",
    cte("registrations") + f"SELECT count(DISTINCT service) AS service_count, {_SIX} FROM registrations",
)
def provider_statistics(spark, sf):
    return op.provider_statistics(load(spark, sf, "registrations"))


@query(
    "reg06_statistics_from_texts",
    TEXTS.rstrip() + "," + MAP_SQL + "," + SLICE_SQL + "," + NAMES_SQL + """,
others AS (SELECT service, method, unnest(list_concat(regexp_extract_all(body, '(?m)^[ \\t]+([Nn]ew\\w+),', 1), regexp_extract_all(body, '(?m)^[ \\t]+(\\w+)\\{\\},', 1))) AS c
  FROM registration_texts WHERE method NOT IN ('SupportedResources', 'SupportedDataSources', 'Resources', 'DataSources')),
r AS (SELECT service, object_kind, resource_type, 'legacy' AS style FROM maps
  UNION ALL SELECT service, object_kind, coalesce(resource_type, receiver), 'modern' FROM slices LEFT JOIN type_names USING (service, receiver)
  UNION ALL SELECT service, CASE method WHEN 'FrameworkResources' THEN 'resource' WHEN 'FrameworkDataSources' THEN 'data_source' ELSE method END, c, CASE WHEN method = 'EphemeralResources' THEN 'ephemeral' ELSE 'modern' END FROM others)
"""
    + f"SELECT count(DISTINCT service) AS service_count, {_SIX} FROM r",
)
def statistics_from_texts(spark, sf):
    found = op.registrations_from_texts(load(spark, sf, "registration_texts"), _type_names(spark, sf))
    return op.provider_statistics(found)


@query(
    "reg07_service_rollup",
    cte("registrations") + f"SELECT service, {_SIX} FROM registrations GROUP BY GROUPING SETS ((service), ())",
)
def service_rollup(spark, sf):
    return op.service_rollup(load(spark, sf, "registrations"))


@query(
    "reg08_duplicate_registrations",
    cte("registrations")
    + """SELECT resource_type, count(*) AS registrations, count(DISTINCT service) AS services
FROM registrations GROUP BY resource_type HAVING count(*) > 1""",
)
def duplicate_registrations(spark, sf):
    return op.duplicate_registrations(load(spark, sf, "registrations"))


@query(
    "reg09_website_categories",
    "SELECT c_mktsegment AS category FROM customer UNION SELECT p_type FROM part ORDER BY 1",
)
def website_categories(spark, sf):
    untyped = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("category"))
    typed = load(spark, sf, "part").select(F.col("p_type").alias("category"))
    return op.website_categories(typed, untyped)


@query(
    "reg10_service_filter",
    cte("registrations")
    + """SELECT service, count(*) AS registrations FROM registrations
WHERE service NOT IN (SELECT 'svc_' || s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY service""",
)
def service_filter(spark, sf):
    skipped = load(spark, sf, "supplier").where("s_acctbal < 0").selectExpr("'svc_' || s_suppkey AS service")
    kept = op.service_filter(load(spark, sf, "registrations"), skipped)
    return kept.groupBy("service").agg(F.count("*").alias("registrations"))


@query("reg11_names_by_label", "SELECT DISTINCT p_brand AS label, p_name AS name FROM part")
def names_by_label(spark, sf):
    return op.names_by_label(
        load(spark, sf, "part").select(F.col("p_brand").alias("label"), F.col("p_name").alias("name"))
    )


_PREFIX_SQL = """
grouped AS (SELECT p_brand AS label, split_part(p_name, ' ', 1) AS name_group, list(p_name ORDER BY p_name) AS names
            FROM part GROUP BY ALL),
prefixes AS (SELECT label, name_group,
   left(names[1], len(list_filter(range(1, length(names[1]) + 1),
        lambda n: list_aggregate(list_transform(names, lambda x: left(x, n) = left(names[1], n)), 'bool_and')))) AS prefix
  FROM grouped)"""


def _prefixes(spark, sf):
    names = load(spark, sf, "part").select(F.col("p_brand").alias("label"), F.col("p_name").alias("name"))
    return op.label_prefixes(names, F.split_part("name", F.lit(" "), F.lit(1)))


@query("reg12_longest_common_prefix", f"WITH {_PREFIX_SQL} SELECT * FROM prefixes")
def longest_common_prefix(spark, sf):
    return _prefixes(spark, sf)


@query(
    "reg13_prefix_conflicts",
    f"""WITH {_PREFIX_SQL} SELECT DISTINCT a.label, a.prefix FROM prefixes a
WHERE EXISTS (SELECT 1 FROM prefixes b WHERE b.label <> a.label AND contains(b.prefix, a.prefix))""",
)
def prefix_conflicts(spark, sf):
    return op.prefix_conflicts(_prefixes(spark, sf))


@query(
    "reg14_deprecation_report",
    """WITH r AS (SELECT 'svc_' || o_custkey AS service, 'type_' || o_orderkey AS resource_type,
    CASE o_orderstatus WHEN 'F' THEN 'gone since ' || o_orderpriority WHEN 'P' THEN '' END AS m FROM orders),
x AS (SELECT 'type_' || l_orderkey AS resource_type, min('type_' || l_partkey) AS replaced_by
      FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey)
SELECT service, resource_type, coalesce(replaced_by, nullif(m, '')) AS notice, replaced_by IS NOT NULL AS has_replacement
FROM r LEFT JOIN x USING (resource_type) WHERE coalesce(replaced_by, nullif(m, '')) IS NOT NULL""",
)
def deprecation_report(spark, sf):
    resources = load(spark, sf, "orders").selectExpr(
        "'svc_' || o_custkey AS service",
        "'type_' || o_orderkey AS resource_type",
        "CASE o_orderstatus WHEN 'F' THEN 'gone since ' || o_orderpriority WHEN 'P' THEN '' END AS deprecation_message",
    )
    replacements = (
        load(spark, sf, "lineitem")
        .where("l_returnflag = 'R'")
        .groupBy("l_orderkey")
        .agg(F.expr("min('type_' || l_partkey) AS replaced_by"))
        .selectExpr("'type_' || l_orderkey AS resource_type", "replaced_by")
    )
    return op.deprecation_report(resources, replacements)
