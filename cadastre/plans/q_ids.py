"""Resource-ID queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.operators import ids as op
from cadastre.plans.inputs import cte, load
from cadastre.plans.registry import query

IDS = cte("resource_ids").rstrip() + """,
seg AS (SELECT row_key, id, string_split(trim(id, '/'), '/') AS s FROM resource_ids)
"""
# Two types with one shape, so that rows are matched to templates by a real join.
TEMPLATES = [(t, "Sample.Org", ["customers"], ["Customer Name"]) for t in ("customer", "client")]


def _templates(spark):
    return op.templates(spark, TEMPLATES)


def _typed_ids(spark, sf):
    return load(spark, sf, "resource_ids").withColumn("type", F.when(F.col("row_key") % 3 == 0, "client").otherwise("customer"))


@query(
    "rid01_parse_resource_id",
    IDS + """SELECT row_key, CASE WHEN lower(s[1]) = 'subscriptions' THEN s[2] ELSE '' END AS subscription_id,
  CASE WHEN lower(s[1]) = 'subscriptions' AND lower(s[3]) = 'resourcegroups' THEN s[4] WHEN lower(s[1]) = 'resourcegroups' THEN s[2] ELSE '' END AS resource_group_name,
  CASE WHEN p > 0 THEN s[p + 1] ELSE '' END AS resource_provider,
  CASE WHEN p = 0 OR len(s) < p + 2 THEN '' WHEN len(s) >= p + 4 THEN s[p + 4] ELSE s[p + 2] END AS resource_type,
  CASE WHEN p = 0 THEN '/' WHEN len(s) < p + 2 THEN s[p + 1] || '/' WHEN len(s) >= p + 4 THEN s[p + 1] || '/' || s[p + 2] || '/' || s[p + 4] ELSE s[p + 1] || '/' || s[p + 2] END AS full_resource_type,
  CASE WHEN p = 0 OR len(s) < p + 3 THEN '' WHEN len(s) >= p + 5 THEN s[p + 5] ELSE s[p + 3] END AS resource_name, '' AS resource_scope,
  CASE WHEN p > 0 AND len(s) >= p + 5 THEN s[p + 2] || '=' || s[p + 3] ELSE '' END AS parents
FROM (SELECT *, coalesce(list_position(list_transform(s, lambda x: lower(x)), 'providers'), 0) AS p FROM seg)""",
)
def parse_resource_id(spark, sf):
    out = op.parse_resource_id(load(spark, sf, "resource_ids"))
    parents = F.array_join(F.transform(F.map_entries("parent_resources"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumn("parents", parents).drop("parent_resources", "id")


PARSED = IDS.rstrip() + """,
kv AS (SELECT *, list_transform(range(1, len(s), 2), lambda i: s[i]) AS ks, list_transform(range(1, len(s), 2), lambda i: s[i + 1]) AS vs FROM seg),
got AS (SELECT *, vs[list_position(ks, 'subscriptions')] AS subscription_id, coalesce(vs[list_position(ks, 'resourceGroups')], vs[list_position(ks, 'resourcegroups')]) AS resource_group,
   vs[list_position(ks, 'customers')] AS exact_name, vs[list_position(list_transform(ks, lambda k: lower(k)), 'customers')] AS any_name FROM kv)
"""


def _parsed_sql(name):
    return PARSED.rstrip() + f""",
parsed AS (SELECT row_key, id, subscription_id, resource_group, {name} AS name,
  CASE WHEN len(s) % 2 = 1 THEN 'The number of path segments is not divisible by 2' WHEN list_contains(s, '') THEN 'Key/Value cannot be empty strings'
       WHEN subscription_id IS NULL THEN 'ID was missing the ''subscriptions'' element' WHEN resource_group IS NULL THEN 'ID was missing the ''resourceGroups'' element'
       WHEN {name} IS NULL THEN 'ID was missing the `customers` element' WHEN len(ks) > 4 THEN 'ID contained more segments than a Resource ID requires' END AS error FROM got)
"""


def _flat(parsed):
    return parsed.select("row_key", "subscription_id", "resource_group", F.col("names")[0].alias("name"), "error")


@query("rid02_parse_by_template", _parsed_sql("exact_name") + "SELECT row_key, subscription_id, resource_group, name, error FROM parsed")
def parse_by_template(spark, sf):
    return _flat(op.parse_by_template(_typed_ids(spark, sf), _templates(spark)))


@query("rid03_parse_by_template_insensitive", _parsed_sql("any_name") + "SELECT row_key, subscription_id, resource_group, name, error FROM parsed")
def parse_by_template_insensitive(spark, sf):
    return _flat(op.parse_by_template(_typed_ids(spark, sf), _templates(spark), ignore_case=True))


@query("rid02_quarantine", _parsed_sql("exact_name") + "SELECT error, count(*) AS n FROM parsed WHERE error IS NOT NULL GROUP BY error")
def quarantine(spark, sf):
    _, bad = op.split_parsed(op.parse_by_template(_typed_ids(spark, sf), _templates(spark)))
    return bad.groupBy("error").agg(F.count("*").alias("n"))


@query(
    "rid04_format_resource_id",
    _parsed_sql("any_name") + "SELECT row_key, '/subscriptions/' || subscription_id || '/resourceGroups/' || resource_group || '/providers/Sample.Org/customers/' || name AS formatted FROM parsed WHERE error IS NULL",
)
def format_resource_id(spark, sf):
    good, _ = op.split_parsed(op.parse_by_template(_typed_ids(spark, sf), _templates(spark), ignore_case=True))
    return op.format_resource_id(good).select("row_key", "formatted")


@query(
    "rid05_describe_resource_id",
    _parsed_sql("any_name") + """SELECT row_key, 'Customer: (Customer Name "' || name || '" / Resource Group "' || resource_group || '")' AS description FROM parsed WHERE error IS NULL""",
)
def describe_resource_id(spark, sf):
    good, _ = op.split_parsed(op.parse_by_template(_typed_ids(spark, sf), _templates(spark), ignore_case=True))
    return op.describe_resource_id(good, "Customer").select("row_key", "description")


@query(
    "rid06_normalise_resource_id",
    IDS + """SELECT row_key, id, '/' || array_to_string(list_transform(s, lambda x, i: CASE WHEN i % 2 = 1 THEN
   CASE lower(x) WHEN 'subscriptions' THEN 'subscriptions' WHEN 'resourcegroups' THEN 'resourceGroups' WHEN 'providers' THEN 'providers' WHEN 'customers' THEN 'customers' ELSE x END
   WHEN lower(coalesce(s[i - 1], '')) = 'providers' AND lower(x) = 'sample.org' THEN 'Sample.Org' ELSE x END), '/') AS normalised FROM seg""",
)
def normalise_resource_id(spark, sf):
    return op.normalise_resource_id(load(spark, sf, "resource_ids"), ["customers", "Sample.Org"])


@query(
    "rid06_sql_functions",
    IDS + """SELECT row_key, CASE WHEN lower(s[1]) = 'subscriptions' THEN s[2] ELSE '' END AS subscription_id,
  CASE WHEN lower(s[1]) = 'subscriptions' AND lower(s[3]) = 'resourcegroups' THEN s[4] WHEN lower(s[1]) = 'resourcegroups' THEN s[2] ELSE '' END AS resource_group_name,
  CASE WHEN p > 0 THEN 'Sample.Org' ELSE '' END AS resource_provider,
  CASE WHEN p = 0 OR len(s) < p + 2 THEN '' WHEN len(s) >= p + 4 THEN s[p + 4] ELSE 'customers' END AS resource_type,
  CASE WHEN p = 0 THEN '/' WHEN len(s) < p + 2 THEN 'Sample.Org/' WHEN len(s) >= p + 4 THEN 'Sample.Org/customers/' || s[p + 4] ELSE 'Sample.Org/customers' END AS full_resource_type,
  CASE WHEN p = 0 OR len(s) < p + 3 THEN '' WHEN len(s) >= p + 5 THEN s[p + 5] ELSE s[p + 3] END AS resource_name, '' AS resource_scope,
  CASE WHEN p > 0 AND len(s) >= p + 5 THEN 'customers=' || s[p + 3] ELSE '' END AS parents
FROM (SELECT *, coalesce(list_position(list_transform(s, lambda x: lower(x)), 'providers'), 0) AS p FROM seg)""",
)
def sql_functions(spark, sf):
    op.register_functions(spark, ["customers", "Sample.Org"])
    return spark.sql(
        "SELECT row_key, p.* EXCEPT (parent_resources), array_join(transform(map_entries(p.parent_resources), e -> e.key || '=' || e.value), ',') AS parents "
        "FROM (SELECT row_key, parse_resource_id(normalise_resource_id(id)) AS p FROM {ids})",
        ids=load(spark, sf, "resource_ids"),
    )


_CANON = "'/subscriptions/' || CAST(row_key AS STRING) || '/resourceGroups/rg-1/providers/Sample.Org/customers/c'"
_LEGACY = f"""SELECT row_key, {_CANON} AS canonical, CASE row_key % 6 WHEN 0 THEN {_CANON} WHEN 1 THEN replace({_CANON}, 'resourceGroups', 'resourcegroups')
  WHEN 2 THEN replace({_CANON}, 'Sample.Org', 'SAMPLE.org') WHEN 3 THEN replace({_CANON}, 'customers', 'Customers') WHEN 4 THEN {_CANON} || '/x' ELSE replace({_CANON}, 'rg-1', 'rg-2') END AS id FROM {{resource_ids}}"""


@query(
    "rid07_check_legacy_casing",
    cte("resource_ids").rstrip() + ", x AS (" + _LEGACY.replace("{resource_ids}", "resource_ids") + """)
SELECT row_key, CASE row_key % 6 WHEN 3 THEN 'the segment "Customers" should be "customers"' WHEN 4 THEN 'expected the ID to be in the format "' || canonical || '"'
   WHEN 5 THEN 'the segment "rg-2" should be "rg-1"' END AS error FROM x""",
)
def check_legacy_casing(spark, sf):
    rows = spark.sql(_LEGACY, resource_ids=load(spark, sf, "resource_ids"))
    return op.check_legacy_casing(rows).select("row_key", "error")


@query(
    "rid08_composite_ids",
    """SELECT l_orderkey, l_linenumber, '/a/' || l_partkey || '|/b/' || l_suppkey || CASE WHEN l_returnflag = 'R' THEN '|/c' ELSE '' END AS id,
 CASE WHEN l_returnflag <> 'R' THEN '/a/' || l_partkey END AS first, CASE WHEN l_returnflag <> 'R' THEN '/b/' || l_suppkey END AS second,
 CASE WHEN l_returnflag = 'R' THEN 'expected two IDs joined by `|`' END AS error FROM lineitem""",
)
def composite_ids(spark, sf):
    pairs = load(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "'/a/' || l_partkey AS first",
        "'/b/' || l_suppkey || CASE WHEN l_returnflag = 'R' THEN '|/c' ELSE '' END AS second",
    )
    return op.split_composite_ids(op.compose_ids(pairs).drop("first", "second"))


@query(
    "rid09_data_plane_ids",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+([^?#]*)', 1) AS path FROM pages), s AS (SELECT *, string_split(regexp_replace(path, '^/', ''), '/') AS s FROM p),
e AS (SELECT page_id, s, CASE WHEN len(s) <> 2 THEN 'wrong number of segments' WHEN s[1] <> 'en' THEN 'expected the Nested Item Type to be "en" but got "' || s[1] || '"' WHEN trim(s[2]) = '' THEN 'unexpected empty value' WHEN trim(s[2]) <> s[2] THEN 'contained extra whitespace' END AS error FROM s)
SELECT page_id, CASE WHEN error IS NULL THEN s[2] END AS item_name, CAST(NULL AS VARCHAR) AS item_version, error FROM e""",
)
def data_plane_ids(spark, sf):
    return op.data_plane_ids(load(spark, sf, "pages").select("page_id", "url"), "en").drop("url")


@query(
    "rid10_template_catalogue",
    """SELECT 'Sample.' || p_type AS namespace, (CASE WHEN p_size % 3 = 0 THEN '' ELSE '/subscriptions/%s/resourceGroups/%s' END) || '/providers/Sample.' || p_type || '/' || replace(p_name, ' ', '') || '/%s' AS template, count(*) AS uses
FROM part WHERE p_size % 7 <> 0 GROUP BY ALL""",
)
def template_catalogue(spark, sf):
    """Texts given to variables of two names, straight to the formatter, and in comments."""
    bodies = load(spark, sf, "part").selectExpr(
        "'func (id X) ID() string {' || chr(10) || CASE WHEN p_size % 7 = 0 THEN '  // fmtString := \"' WHEN p_size % 3 = 0 THEN '  xIdFmt := \"'"
        " WHEN p_size % 3 = 1 THEN '  fmtString := \"' ELSE '  return fmt.Sprintf(\"' END"
        " || CASE WHEN p_size % 3 = 0 THEN '' ELSE '/subscriptions/%s/resourceGroups/%s' END || '/providers/Sample.'"
        " || p_type || '/' || replace(p_name, ' ', '') || '/%s\"' || chr(10) || '}' AS body"
    )
    return op.template_catalogue(bodies)


_SEGMENTS = """SELECT DISTINCT l_orderkey AS id_type, l_linenumber - 1 AS idx, split_part('subscriptionId,resourceGroupName,signalRName,webPubSubName,keyVaultName,itemID,siteName', ',', l_linenumber) AS name,
  CASE WHEN l_linenumber = 5 THEN 'scope' WHEN l_linenumber = 1 THEN 'subscription_id' ELSE 'user_specified' END AS kind, l_orderkey % 5 = 0 AS virtual FROM {lineitem}"""


@query(
    "rid11_identity_columns",
    "WITH s AS (" + _SEGMENTS.replace("{lineitem}", "lineitem") + """), m AS (SELECT *, max(idx) OVER (PARTITION BY id_type) AS last_idx FROM s)
SELECT id_type, idx, name, kind, virtual, CASE WHEN NOT virtual AND idx = last_idx AND suffix(name, 'Name') THEN 'name' ELSE CASE name WHEN 'subscriptionId' THEN 'subscription_id' WHEN 'resourceGroupName' THEN 'resource_group_name'
  WHEN 'signalRName' THEN 'signalr_name' WHEN 'webPubSubName' THEN 'web_pubsub_name' WHEN 'itemID' THEN 'item_id' WHEN 'siteName' THEN 'site_name' END END AS column_name FROM m WHERE kind <> 'scope'""",
)
def identity_columns(spark, sf):
    return op.identity_columns(spark.sql(_SEGMENTS, lineitem=load(spark, sf, "lineitem")))
