"""Schema snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.operators import snapshots as op
from cadastre.plans.inputs import cte, load
from cadastre.plans.q_sources import written_snapshots
from cadastre.plans.registry import query

FLAT = """WITH o AS (SELECT *, 'res_' || o_orderkey AS resource, CASE WHEN o_orderstatus = 'P' THEN 'data source' ELSE 'resource' END AS kind FROM orders),
flat AS (
 SELECT kind, resource, 'name' AS path, 'name' AS name, '' AS parent_path, 1 AS depth, 'TypeString' AS type, FALSE AS optional, TRUE AS required, FALSE AS computed, TRUE AS force_new, 0 AS max_items, NULL AS default_value, NULL AS elem FROM o
 UNION ALL SELECT kind, resource, 'sku', 'sku', '', 1, 'TypeList', TRUE, FALSE, FALSE, FALSE, 1, NULL, 'block' FROM o
 UNION ALL SELECT kind, resource, 'tags', 'tags', '', 1, 'TypeMap', FALSE, FALSE, FALSE, FALSE, 0, NULL, 'TypeString' FROM o
 UNION ALL SELECT kind, resource, 'sku.tier', 'tier', 'sku', 2, 'TypeString', TRUE, FALSE, FALSE, FALSE, 0, o_orderpriority, NULL FROM o
 UNION ALL SELECT kind, resource, 'sku.size', 'size', 'sku', 2, 'TypeInt', FALSE, TRUE, FALSE, FALSE, 0, NULL, NULL FROM o
 UNION ALL SELECT kind, resource, 'sku.limits', 'limits', 'sku', 2, 'TypeSet', TRUE, FALSE, FALSE, FALSE, 0, NULL, 'block' FROM o WHERE o_orderstatus = 'F'
 UNION ALL SELECT kind, resource, 'sku.limits.cpu', 'cpu', 'sku.limits', 3, 'TypeInt', FALSE, FALSE, TRUE, FALSE, 0, NULL, NULL FROM o WHERE o_orderstatus = 'F')
"""


@query("sch01_flatten_properties", FLAT + "SELECT kind, resource, path, name, parent_path, depth, depth = 1 AS top_level FROM flat")
def flatten_properties(spark, sf):
    return op.flatten_properties(written_snapshots(spark, sf)).drop("node")


@query(
    "sch02_property_attributes",
    FLAT + """SELECT kind, resource, path, name, parent_path, depth, depth = 1 AS top_level, type, '' AS config_mode, optional, required, computed, force_new,
  '' AS description, max_items, 0 AS min_items, default_value, elem, type IN ('TypeList', 'TypeSet') AS is_collection,
  type IN ('TypeList', 'TypeSet') AND coalesce(elem, '') = 'block' AS is_block, coalesce(elem <> 'block', FALSE) AS elem_is_scalar, path = 'sku' AS declares_max_items FROM flat""",
)
def property_attributes(spark, sf):
    return op.property_attributes(op.flatten_properties(written_snapshots(spark, sf)))


@query(
    "sch03_children_and_siblings",
    cte("properties") + """SELECT p.kind, p.resource, p.parent_path, p.path, p.name,
  count(*) OVER (PARTITION BY p.kind, p.resource, p.parent_path) AS n_siblings, coalesce(c.n, 0) AS n_children, c.only_child
FROM properties p LEFT JOIN (SELECT kind, resource, parent_path AS path, count(*) AS n, CASE WHEN count(*) = 1 THEN min(name) END AS only_child
                             FROM properties GROUP BY ALL) c USING (kind, resource, path)""",
)
def children_and_siblings(spark, sf):
    return op.children_and_siblings(load(spark, sf, "properties"))


@query(
    "sch04_lookup_schema",
    """SELECT w.kind, w.resource, CASE WHEN o.o_orderkey IS NULL THEN 'resource not found' END AS error FROM
 (SELECT DISTINCT 'resource' AS kind, 'res_' || l_partkey AS resource FROM lineitem) w
 LEFT JOIN orders o ON w.resource = 'res_' || o.o_orderkey AND o.o_orderstatus <> 'P'""",
)
def lookup_schema(spark, sf):
    wanted = load(spark, sf, "lineitem").selectExpr("'resource' AS kind", "'res_' || l_partkey AS resource").distinct()
    return op.lookup_schema(written_snapshots(spark, sf), wanted).select("kind", "resource", "error")


@query(
    "sch04_list_resources",
    "SELECT CASE WHEN o_orderstatus = 'P' THEN 'data source' ELSE 'resource' END AS kind, 'res_' || o_orderkey AS resource FROM orders",
)
def list_resources(spark, sf):
    return written_snapshots(spark, sf).select("kind", "resource")


@query(
    "sch05_property_path_exists",
    cte("properties") + """SELECT w.resource, w.path, EXISTS (SELECT 1 FROM properties p WHERE p.resource = w.resource AND p.path = w.path) AS "exists"
FROM (SELECT 'res_' || o_orderkey AS resource, CASE WHEN o_orderkey % 2 = 0 THEN 'location' ELSE 'vm_size' END AS path FROM orders) w""",
)
def property_path_exists(spark, sf):
    wanted = load(spark, sf, "orders").selectExpr(
        "'res_' || o_orderkey AS resource", "CASE WHEN o_orderkey % 2 = 0 THEN 'location' ELSE 'vm_size' END AS path"
    )
    return op.property_path_exists(wanted, load(spark, sf, "properties"))


_ARGS = """SELECT 'r' || CAST(c_nationkey AS STRING) AS resource, 'k' || CAST(c_custkey % 60 AS STRING) AS name,
 min(c_acctbal) > 0 AS optional, min(c_acctbal) < -500 AS required, max(c_custkey) % 3 = 0 AS computed FROM {customer} GROUP BY c_nationkey, c_custkey % 60"""
_ATTRS = """SELECT 'r' || CAST(s_nationkey AS STRING) AS resource, 'k' || CAST(s_suppkey % 60 AS STRING) AS name,
 min(s_acctbal) > 5000 AS optional, FALSE AS required, FALSE AS computed FROM {supplier} GROUP BY s_nationkey, s_suppkey % 60"""


@query(
    "sch06_combine_schemas",
    ("WITH a AS (" + _ARGS + "), t AS (" + _ATTRS + """)
SELECT resource, name, optional, required, computed, 'argument' AS side,
  CASE WHEN computed AND NOT (optional OR required) THEN '"' || name || '" is a Computed-only field - this should be specified as an Attribute' END AS error FROM a
UNION ALL SELECT t.resource, t.name, t.optional, t.required, TRUE, 'attribute',
  CASE WHEN a.name IS NOT NULL THEN '"' || t.name || '" already exists in the schema'
       WHEN t.optional OR t.required THEN '"' || t.name || '" is a user-specifyable field - this should be specified as an Argument' END
FROM t LEFT JOIN a USING (resource, name)""").replace("{customer}", "customer").replace("{supplier}", "supplier"),
)
def combine_schemas(spark, sf):
    return op.combine_schemas(
        spark.sql(_ARGS, customer=load(spark, sf, "customer")), spark.sql(_ATTRS, supplier=load(spark, sf, "supplier"))
    )


@query(
    "sch07_timeouts_in_minutes",
    """WITH t AS (SELECT user_id, max(CASE WHEN event_type = 'click' THEN event_id END) * 60 + 59 AS "create", max(CASE WHEN event_type = 'view' THEN event_id END) * 61 AS "read",
   max(CASE WHEN event_type = 'error' THEN event_id END) AS "update", max(CASE WHEN event_type = 'signup' THEN event_id END) * 3600 AS "delete" FROM events GROUP BY user_id)
SELECT user_id, action, seconds // 60 AS minutes FROM t, LATERAL (VALUES ('create', "create"), ('read', "read"), ('update', "update"), ('delete', "delete")) v(action, seconds)""",
)
def timeouts_in_minutes(spark, sf):
    def last(event_type):
        return F.max(F.when(F.col("event_type") == event_type, F.col("event_id")))

    timeouts = load(spark, sf, "events").groupBy("user_id").agg(
        (last("click") * 60 + 59).alias("create"), (last("view") * 61).alias("read"),
        last("error").alias("update"), (last("signup") * 3600).alias("delete"),
    )
    return op.timeouts_in_minutes(timeouts, "user_id")


_SIDE = "coalesce({s}.{c}, {z}) AS {s}_{c}"
DIFF = cte("properties", "properties_current").rstrip() + """,
d AS (SELECT kind, resource, path, coalesce(b.name, c.name) AS name, coalesce(c.depth, 0) AS c_depth, b.name IS NOT NULL AS in_base, c.name IS NOT NULL AS in_current,
   coalesce(b.type, '') AS bt, coalesce(c.type, '') AS ct, coalesce(b.optional, FALSE) AS bo, coalesce(c.optional, FALSE) AS co,
   coalesce(b.required, FALSE) AS br, coalesce(c.required, FALSE) AS cr, coalesce(b.computed, FALSE) AS bc, coalesce(c.computed, FALSE) AS cc,
   b.default_value AS bd, c.default_value AS cd,
   b.type IS DISTINCT FROM c.type OR b.optional IS DISTINCT FROM c.optional OR b.required IS DISTINCT FROM c.required OR b.computed IS DISTINCT FROM c.computed
   OR b.force_new IS DISTINCT FROM c.force_new OR b.default_value IS DISTINCT FROM c.default_value OR b.max_items IS DISTINCT FROM c.max_items OR b.min_items IS DISTINCT FROM c.min_items AS differs
 FROM properties b FULL JOIN properties_current c USING (kind, resource, path)),
v AS (SELECT * FROM d WHERE in_base OR c_depth = 1)
"""


def _diff(spark, sf):
    return op.snapshot_diff(load(spark, sf, "properties"), load(spark, sf, "properties_current"))


@query(
    "sch08_snapshot_diff",
    DIFF + """SELECT kind, resource, path, CASE WHEN NOT in_base THEN 'added' WHEN NOT in_current THEN 'removed' WHEN differs THEN 'changed' ELSE 'same' END AS status FROM d""",
)
def snapshot_diff(spark, sf):
    return _diff(spark, sf).select("kind", "resource", "path", "status")


RULE_SQL = {
    "become_computed_only": ("(bo OR br) AND NOT co AND NOT cr AND cc", "'Cannot change property \"' || name || '\" to Computed only'"),
    "new_required_property": ("bt = '' AND cr", "'new property \"' || name || '\" is Required'"),
    "optional_remove_computed": (
        "bo AND bc AND co AND NOT cc",
        "'cannot remove Computed from the Optional property \"' || name || '\" as the user config may not supply the value, thus causing a diff'",
    ),
    "optional_to_required": ("bo AND cr", "'Cannot change property \"' || name || '\" from Optional to Required'"),
    "property_type": (
        "bt <> '' AND ct <> '' AND bt <> 'TypeSet' AND bt <> ct",
        "'schema type has changed for \"' || name || '\" (' || bt || ' to ' || ct || ')'",
    ),
    "default_value_change": ("bd IS DISTINCT FROM cd", "'default of property \"' || name || '\" has changed'"),
}


def _rule_sql(rule, kinds):
    condition, message = RULE_SQL[rule]
    return f"SELECT kind, resource, path, '{rule}' AS rule, {message} AS message FROM v WHERE kind IN ({kinds}) AND {condition}"


def _register_rule(number, rule):
    @query(f"sch{number:02d}_rule_{rule}", DIFF + _rule_sql(rule, "'resource'"))
    def one_rule(spark, sf):
        return op.breaking_changes(_diff(spark, sf), (rule,), ())


for _number, _rule in enumerate(RULE_SQL, start=9):
    _register_rule(_number, _rule)


@query(
    "sch15_breaking_changes",
    DIFF + " UNION ALL ".join(
        _rule_sql(r, "'resource', 'data source'" if r == "property_type" else "'resource'") for r in op.ACTIVE_RULES
    ),
)
def breaking_changes(spark, sf):
    return op.breaking_changes(_diff(spark, sf))


@query(
    "sch16_path_segments",
    """WITH p AS (SELECT p_partkey AS row_key, CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', '.') WHEN 1 THEN split_part(p_name, ' ', 1) || '.' || p_size || '.' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END AS path FROM part)
SELECT row_key, path, CASE WHEN contains(path, '.') THEN left(path, length(path) - length(split_part(path, '.', -1)) - 1) ELSE path END AS parent, split_part(path, '.', -1) AS leaf,
  array_to_string(list_transform(string_split(path, '.'), lambda s: CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') THEN 'index=' ELSE 'attribute=' END || s), '/') AS segments FROM p""",
)
def path_segments(spark, sf):
    paths = load(spark, sf, "part").selectExpr(
        "p_partkey AS row_key",
        "CASE p_size % 3 WHEN 0 THEN replace(p_name, ' ', '.') WHEN 1 THEN split_part(p_name, ' ', 1) || '.' || p_size || '.' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END AS path",
    )
    out = op.path_segments(paths)
    return out.withColumn(
        "segments", F.array_join(F.transform("segments", lambda s: F.concat(s["kind"], F.lit("="), s["value"])), "/")
    )
