"""State-migration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.operators import ids
from cadastre.operators import migrate as op
from cadastre.plans.inputs import cte, load
from cadastre.plans.registry import query

STATE = cte("state_rows")
FIELDS = ["id", "tier", "status", "price", "old_name"]


def states(spark, sf):
    """State rows with their fields as a map; absent fields are left out."""
    entries = F.array(*(F.struct(F.lit(f).alias("k"), F.col(f).alias("v")) for f in FIELDS))
    return load(spark, sf, "state_rows").select(
        "row_key", "version", "type",
        F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull())).alias("state"),
    )


def shown(rows):
    """States as text with sorted keys."""
    entries = F.array_sort(F.transform(F.map_entries("state"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return rows.withColumn("state", F.array_join(entries, ";"))


def state_sql(**changes):
    """The same text in SQL; ``changes`` overrides or adds fields, in SQL that may be null."""
    fields = {f: f for f in FIELDS} | changes
    parts = ", ".join(f"'{k}=' || ({v})" for k, v in sorted(fields.items()))
    return f"concat_ws(';', {parts})"


def _one_step(spark, sf, step):
    return shown(states(spark, sf).withColumn("state", step(F.col("state")))).select("row_key", "state")


_ID = "'/subscriptions/' || split_part(id, '/', 3) || '/resourceGroups/rg-1/providers/Sample.Org/orders/' || split_part(id, '/', 9)"


@query("mig01_rewrite_id", STATE + f"SELECT row_key, {state_sql(id=_ID)} AS state, NULL AS error FROM state_rows")
def rewrite_id(spark, sf):
    templates = ids.templates(spark, [(t, "Sample.Org", ["orders"], ["Order"]) for t in ("order", "sale")])
    return shown(op.rewrite_id(states(spark, sf), templates)).select("row_key", "state", "error")


@query("mig02_rename_field", STATE + f"SELECT row_key, {state_sql(old_name='NULL', public_name='old_name')} AS state FROM state_rows")
def rename_field(spark, sf):
    return _one_step(spark, sf, op.rename_field("old_name", "public_name"))


@query("mig03_conditional_drop", STATE + f"""SELECT row_key, {state_sql(price="CASE WHEN tier = '1-URGENT' THEN price END")} AS state FROM state_rows""")
def conditional_drop(spark, sf):
    return _one_step(spark, sf, op.conditional_drop("price", "tier", "1-urgent"))


@query("mig04_set_field", STATE + f"""SELECT row_key, {state_sql(tier="'Classic'")} AS state FROM state_rows""")
def set_field(spark, sf):
    return _one_step(spark, sf, op.set_field("tier", "Classic"))


@query("mig04_convert_field", STATE + f"""SELECT row_key, {state_sql(id="replace(id, 'resourcegroups', 'resourceGroups')")} AS state FROM state_rows""")
def convert_field(spark, sf):
    return _one_step(spark, sf, op.convert_field("id", lambda v: ids.normalised_id(v, ["orders"])))


@query("mig05_string_replace_id", STATE + f"""SELECT row_key, {state_sql(id="regexp_replace(id, '/orders/', '/order-set/')")} AS state FROM state_rows""")
def string_replace_id(spark, sf):
    return _one_step(spark, sf, op.string_replace("id", "/orders/", "/order-set/"))


@query(
    "mig06_migrate_chain",
    STATE + f"""SELECT row_key, 3 AS version, CASE version
  WHEN 0 THEN {state_sql(old_name='NULL', public_name='old_name', price="CASE WHEN tier = '1-URGENT' THEN price END", status="'Z'")}
  WHEN 1 THEN {state_sql(price="CASE WHEN tier = '1-URGENT' THEN price END", status="'Z'")} ELSE {state_sql(status="'Z'")} END AS state FROM state_rows""",
)
def migrate_chain(spark, sf):
    steps = [op.rename_field("old_name", "public_name"), op.conditional_drop("price", "tier", "1-URGENT"), op.set_field("status", "Z")]
    return shown(op.migrate_chain(states(spark, sf), {"order": steps, "sale": steps})).drop("type")


@query(
    "mig07_chain_gap_check",
    """SELECT l_orderkey AS type, CAST(min(m) AS INT) AS missing_version FROM (SELECT l_orderkey, unnest(range(0, max(l_linenumber) + 1)) AS m FROM lineitem GROUP BY l_orderkey) x
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = x.l_orderkey AND l.l_linenumber - 1 = x.m) AND m < (SELECT max(l_linenumber) FROM lineitem l WHERE l.l_orderkey = x.l_orderkey) GROUP BY l_orderkey""",
)
def chain_gap_check(spark, sf):
    steps = load(spark, sf, "lineitem").selectExpr("l_orderkey AS type", "l_linenumber - 1 AS version")
    return op.chain_gap_check(steps)


_STEPS = """SELECT 'svc_' || CAST(user_id % 20 AS STRING) AS service, 'Thing' || CAST(user_id AS STRING) || 'V' || CAST(event_id % 4 AS STRING) || CASE WHEN event_id % 2 = 0 THEN 'ToV' ELSE 'toV' END || CAST(event_id % 4 + 1 AS STRING) AS step,
  CASE event_type WHEN 'click' THEN 'id rewrite' WHEN 'view' THEN 'replace' WHEN 'error' THEN 'set field' ELSE 'no-op' END AS class FROM {events}"""


@query(
    "mig08_migration_catalogue",
    """SELECT 'svc_' || (user_id % 20) AS service, CAST(event_id % 4 AS INT) AS from_version, CAST(event_id % 4 + 1 AS INT) AS to_version,
 CASE event_type WHEN 'click' THEN 'id rewrite' WHEN 'view' THEN 'replace' WHEN 'error' THEN 'set field' ELSE 'no-op' END AS class, count(*) AS steps FROM events GROUP BY ALL""",
)
def migration_catalogue(spark, sf):
    return op.migration_catalogue(spark.sql(_STEPS, events=load(spark, sf, "events")))
