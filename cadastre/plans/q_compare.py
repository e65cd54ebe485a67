"""Change-comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.functions import compare as c
from cadastre.operators import compare as op
from cadastre.plans.inputs import load
from cadastre.plans.registry import query

_OLD = "SELECT o_orderkey AS k, o_orderpriority AS priority, o_orderstatus AS status, CAST(CAST(o_totalprice AS BIGINT) AS STRING) AS price FROM {orders} WHERE o_orderkey % 10 <> 9"
_NEW = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN lower(o_orderpriority) WHEN o_orderkey % 3 = 1 THEN 'x' || o_orderpriority ELSE o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 4 = 0 THEN 'N' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 THEN '1' ELSE CAST(CAST(o_totalprice AS BIGINT) AS STRING) END AS price FROM {orders} WHERE o_orderkey % 10 <> 8"""
# the price of an order is a whole amount, so that both engines cast alike
_OLD, _NEW = (t.replace("CAST(o_totalprice AS BIGINT)", "CAST(floor(o_totalprice) AS BIGINT)") for t in (_OLD, _NEW))
BOTH = "WITH o AS (" + _OLD.replace("{orders}", "orders") + "), n AS (" + _NEW.replace("{orders}", "orders") + """),
j AS (SELECT k, o.k1 IS NOT NULL AS in_o, n.k2 IS NOT NULL AS in_n, o.priority AS op, n.priority AS np, o.status AS os, n.status AS ns, o.price AS oc, n.price AS nc
  FROM (SELECT *, k AS k1 FROM o) o FULL JOIN (SELECT *, k AS k2 FROM n) n USING (k)),
d AS (SELECT *, CASE WHEN op IS NOT DISTINCT FROM np THEN 'same' WHEN lower(op) = lower(np) THEN 'suppressed' ELSE 'changed' END AS p, CASE WHEN os IS NOT DISTINCT FROM ns THEN 'same' ELSE 'changed' END AS s,
   CASE WHEN oc IS NOT DISTINCT FROM nc THEN 'same' ELSE 'changed' END AS c FROM j),
x AS (SELECT *, concat_ws(',', CASE WHEN p = 'changed' THEN 'priority' END, CASE WHEN s = 'changed' THEN 'status' END, CASE WHEN c = 'changed' THEN 'price' END) AS changed FROM d)
"""


def _compared(spark, sf):
    orders = load(spark, sf, "orders")
    return op.compare_snapshots(
        spark.sql(_OLD, orders=orders), spark.sql(_NEW, orders=orders), "k", {"priority": c.ignore_case, "status": None, "price": None}
    )


@query(
    "cmp01_compare_snapshots",
    BOTH + "SELECT k, changed, CASE WHEN NOT in_o THEN 'added' WHEN NOT in_n THEN 'removed' WHEN changed <> '' THEN 'changed' ELSE 'same' END AS status FROM x",
)
def compare_snapshots(spark, sf):
    return _compared(spark, sf).select("k", F.array_join("changed", ",").alias("changed"), "status")


@query(
    "cmp01_column_statuses",
    BOTH + """SELECT k, 'priority' AS "column", p AS status FROM x WHERE in_o AND in_n UNION ALL SELECT k, 'status', s FROM x WHERE in_o AND in_n UNION ALL SELECT k, 'price', c FROM x WHERE in_o AND in_n""",
)
def column_statuses(spark, sf):
    return op.column_statuses(_compared(spark, sf), "k")


@query("cmp01_changes_except", BOTH + "SELECT k FROM x WHERE p = 'changed' OR s = 'changed'")
def changes_except(spark, sf):
    return op.changes_except(_compared(spark, sf), ["price"]).select("k")


@query(
    "cmp02_replace_or_update",
    BOTH + """SELECT k, CASE WHEN NOT in_o THEN 'create' WHEN NOT in_n THEN 'delete' WHEN changed = '' THEN 'none'
  WHEN s = 'changed' OR (c = 'changed' AND CAST(oc AS BIGINT) > 200000) THEN 'replace' ELSE 'update' END AS action FROM x""",
)
def replace_or_update(spark, sf):
    condition = F.col("o.price").cast("long") > 200000
    return op.replace_or_update(_compared(spark, sf), ["status"], {"price": condition}).select("k", "action")


@query(
    "cmp03_case_and_order",
    """WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, [l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR), l_returnflag] AS old FROM lineitem)
SELECT k, n, k % 3 <> 2 OR array_to_string(list_sort(old), ',') = array_to_string(list_sort(list_transform(old, lambda f: CASE WHEN f = 'A' THEN 'N' ELSE f END)), ',') AS same_members,
  k % 2 = 0 AS same_case FROM l""",
)
def case_and_order(spark, sf):
    lists = load(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS k", "l_linenumber AS n", "array(l_returnflag, l_linestatus, CAST(l_linenumber AS STRING), l_returnflag) AS old"
    )
    new = F.when(F.col("k") % 3 == 2, F.transform("old", lambda f: F.when(f == "A", "N").otherwise(f))).otherwise(F.reverse("old"))
    text = F.concat(F.lit("Name"), F.col("k").cast("string"))
    other = F.when(F.col("k") % 2 == 0, F.upper(text)).otherwise(F.concat(text, F.lit("x")))
    return lists.select("k", "n", c.ignore_order(F.col("old"), new).alias("same_members"), c.ignore_case(text, other).alias("same_case"))


_TIMES = """SELECT event_id AS k, '2024-03-10T12:' || m || ':30Z' AS old, CASE event_id % 5 WHEN 0 THEN '2024-03-10T14:' || m || ':30+02:00' WHEN 1 THEN '2024-03-10T12:' || m || ':45Z'
  WHEN 2 THEN '2024-03-10T12:' || m || ':30' WHEN 3 THEN 'soon' ELSE '2024-03-10T13:' || m || ':30Z' END AS new FROM (SELECT event_id, lpad(CAST(event_id % 60 AS STRING), 2, '0') AS m FROM {events}) e"""


@query("cmp04_timestamps", "SELECT event_id AS k, event_id % 5 = 0 AS same_instant, event_id % 5 < 2 AS same_minute FROM events")
def timestamps(spark, sf):
    rows = spark.sql(_TIMES, events=load(spark, sf, "events"))
    return rows.select("k", c.same_instant(F.col("old"), F.col("new")).alias("same_instant"), c.same_minute(F.col("old"), F.col("new")).alias("same_minute"))


@query(
    "cmp05_json",
    """SELECT event_id AS k, event_id % 6 = 0 AS same_json, event_id % 6 IN (0, 1, 5) AND event_id % 6 <> 5 OR (event_id % 6 = 5 AND FALSE) AS same_metadata,
  event_id % 6 = 4 AS empty_is_object FROM events""",
)
def json_comparison(spark, sf):
    k = F.col("event_id") % 6
    value = F.get_json_object("props", "$.k")
    old = F.concat(F.lit('{"a": '), value, F.lit(', "b": [1, 2]}'))
    new = (
        F.when(k == 0, F.concat(F.lit('{ "b":[1,2], "a":'), value, F.lit("}")))
        .when(k == 1, F.concat(F.lit('{"createdBy": "me", "b": [1,2], "a": '), value, F.lit("}")))
        .when(k == 2, F.lit("not json"))
        .when(k == 3, F.concat(F.lit('{"b": [2, 1], "a": '), value, F.lit("}")))
        .when(k == 4, F.lit(""))
        .otherwise(F.lit("{}"))
    )
    only_managed = F.lit('{"createdBy": "me", "updatedOn": "now"}')
    return load(spark, sf, "events").select(
        F.col("event_id").alias("k"),
        c.same_json(old, new).alias("same_json"),
        c.same_metadata(old, new).alias("same_metadata"),
        (c.same_metadata(only_managed, new) & (k == 4)).alias("empty_is_object"),
    )


@query(
    "cmp06_xml",
    """WITH x AS (SELECT page_id AS k, html AS old, CASE page_id % 3 WHEN 0 THEN replace(html, '><', '> ' || chr(10) || '<') WHEN 1 THEN replace(html, ' ', '  ') ELSE html || '<p>more</p>' END AS new FROM pages),
t AS (SELECT *, trim(regexp_replace(old, '>\\s+<', '><', 'g')) AS a, trim(regexp_replace(new, '>\\s+<', '><', 'g')) AS b, translate(old, chr(10) || chr(13) || chr(9) || ' ', '') AS aw, translate(new, chr(10) || chr(13) || chr(9) || ' ', '') AS bw FROM x)
SELECT k, a = b AS same_xml, a = b OR aw = bw AS same_text, length(replace(replace(replace(replace(replace(aw, '&quot;', '"'), '&gt;', '>'), '&lt;', '<'), '&amp;', '&'), '&apos;', '''')) AS decoded_length FROM t""",
)
def xml_comparison(spark, sf):
    pages = load(spark, sf, "pages").select(
        F.col("page_id").alias("k"), F.col("html").alias("old"),
        F.expr("CASE page_id % 3 WHEN 0 THEN replace(html, '><', '> ' || chr(10) || '<') WHEN 1 THEN replace(html, ' ', '  ') ELSE html || '<p>more</p>' END").alias("new"),
    )
    old, new = F.col("old"), F.col("new")
    return pages.select(
        "k", c.same_xml(old, new).alias("same_xml"), c.same_xml_text(old, new).alias("same_text"),
        F.length(c.decoded_xml(old)).cast("long").alias("decoded_length"),
    )


_SECRETS = """SELECT p_partkey AS k, 'Server=' || p_brand || ';Database=' || p_type || ';User=u' || CAST(p_size AS STRING) || ';' AS old,
 CASE p_partkey % 4 WHEN 0 THEN 'database=' || p_type || ';server=' || p_brand || ';password=x;user=U' || CAST(p_size AS STRING) WHEN 1 THEN 'Server=' || p_brand || ';Database=' || p_type
   WHEN 2 THEN 'Server=' || p_brand || ';Database=other;User=u' || CAST(p_size AS STRING) ELSE 'User=u' || CAST(p_size AS STRING) || ';Server=' || p_brand || ';Database=' || p_type || ';Password=a;Password=b;' END AS new,
 'ssh-rsa ' || p_name AS key_old, CASE p_partkey % 3 WHEN 0 THEN '<<~EOT' || chr(10) || 'ssh-rsa ' || p_name || chr(13) || chr(10) || 'EOT' WHEN 1 THEN '  ssh-rsa ' || p_name || chr(10) ELSE 'ssh-rsa' || p_name END AS key_new,
 'https://v.example.org/keys/' || p_type || '/' || CAST(p_size AS STRING) AS url_old, CASE p_partkey % 3 WHEN 0 THEN 'https://v.example.org/keys/' || p_type WHEN 1 THEN 'https://v.example.org/keys/' || p_type || '/new' ELSE 'https://w.example.org/keys/' || p_type || '/1' END AS url_new FROM {part}"""


@query(
    "cmp07_keys_and_connection_strings",
    "SELECT p_partkey AS k, p_partkey % 4 IN (0, 3) AS same_connection, p_partkey % 3 < 2 AS same_key, p_partkey % 3 < 2 AS same_url FROM part",
)
def keys_and_connection_strings(spark, sf):
    rows = spark.sql(_SECRETS, part=load(spark, sf, "part"))
    return rows.select(
        "k", c.same_connection_string(F.col("old"), F.col("new")).alias("same_connection"),
        c.same_ssh_key(F.col("key_old"), F.col("key_new")).alias("same_key"),
        c.same_versioned_url(F.col("url_old"), F.col("url_new")).alias("same_url"),
    )


@query("cmp08_exclusive_changes", BOTH + "SELECT k, 'switching between status and price is not supported' AS error FROM x WHERE in_o AND in_n AND s = 'changed' AND c = 'changed'")
def exclusive_changes(spark, sf):
    return op.exclusive_changes(_compared(spark, sf), "status", "price").select("k", "error")
