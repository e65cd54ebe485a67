"""Set, map, nested, range and order queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.functions import collections as c
from cadastre.operators import collections as op
from cadastre.plans.inputs import cte, load
from cadastre.plans.registry import query


# The checking engine has no crc32: its table and the fold over the bytes stand here.
@query(
    "set01_hash_key",
    """WITH tbl AS (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, n: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)))
SELECT p_partkey, k[1] AS name_key, k[2] AS folded_key, k[3] AS number_key, k[4] AS ipv4_key, k[5] AS ipv6_key FROM (
 SELECT p_partkey, list_transform([p_name, lower(p_type), CAST(p_size AS VARCHAR), '10.0.0.' || p_size || '/32', '2001:db8::' || p_size],
   lambda t: xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(t) + 1), lambda i: CAST(ascii(substr(t, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, tbl[1 + (xor(c, b) & 255)])), 4294967295)) AS k FROM part, tbl)""",
)
def hash_key(spark, sf):
    return load(spark, sf, "part").select(
        "p_partkey",
        c.hash_key(F.col("p_name")).alias("name_key"),
        c.hash_key(F.col("p_type"), ignore_case=True).alias("folded_key"),
        c.hash_key(F.col("p_size")).alias("number_key"),
        c.hash_ipv4(F.concat(F.lit("10.0.0."), F.col("p_size").cast("string"))).alias("ipv4_key"),
        c.hash_ipv6(F.concat(F.lit("2001:DB8:0:0::"), F.col("p_size").cast("string"))).alias("ipv6_key"),
    )


_LISTS = """SELECT l_orderkey AS k, l_linenumber AS n, l_returnflag || ',' || l_linestatus || ',A,' || l_returnflag || ',' || CAST(l_linenumber AS STRING) AS t FROM {lineitem}"""


@query(
    "set02_set_from_list",
    "WITH l AS (SELECT k, n, string_split(t, ',') AS v FROM (" + _LISTS.replace("{lineitem}", "lineitem") + """))
SELECT k, n, array_to_string(list_filter(v, lambda x, i: list_position(v, x) = i), ',') AS members, array_to_string(list_filter(v, lambda x: x <> 'A'), ',') AS removed, CASE WHEN k % 5 <> 0 THEN len(list_distinct(v)) END AS nilable, CASE WHEN k % 5 <> 0 THEN len(list_distinct(v)) ELSE 0 END AS plain FROM l""",
)
def set_from_list(spark, sf):
    lists = spark.sql(_LISTS, lineitem=load(spark, sf, "lineitem"))
    members = F.split("t", ",")
    nilable = F.when(F.col("k") % 5 != 0, members)
    return lists.select(
        "k", "n",
        F.array_join(c.set_of(members), ",").alias("members"),
        F.array_join(c.without_member(members, "a"), ",").alias("removed"),
        F.when(nilable.isNotNull(), F.size(c.set_of(nilable, nil=True))).cast("long").alias("nilable"),
        F.size(c.set_of(nilable)).cast("long").alias("plain"),
    )


@query(
    "set03_find_duplicates",
    """SELECT user_id, event_id AS place, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, lower(v) ORDER BY event_id) AS n FROM
 (SELECT user_id, event_id, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS v FROM events))
WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1""",
)
def find_duplicates(spark, sf):
    rows = load(spark, sf, "events").selectExpr(
        "user_id", "event_id", "CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END AS v"
    )
    return op.first_duplicates(rows, "user_id", "v", "event_id")


@query(
    "set04_required_vs_registered",
    """WITH r AS (SELECT DISTINCT 'p' || l_partkey AS name FROM lineitem WHERE l_returnflag = 'R'), s AS (SELECT 'p' || p_partkey AS name, bool_or(p_size % 2 = 0) AS reg FROM part WHERE p_size < 40 GROUP BY 1)
SELECT name, CASE WHEN reg THEN 'skip' WHEN reg IS NOT NULL THEN 'register' ELSE 'warn' END AS decision FROM r LEFT JOIN s USING (name)""",
)
def required_vs_registered(spark, sf):
    required = load(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr("'p' || l_partkey AS name")
    states = load(spark, sf, "part").where("p_size < 40").selectExpr(
        "'p' || p_partkey AS name", "CASE WHEN p_size % 2 = 0 THEN 'Registered' ELSE 'NotRegistered' END AS state"
    )
    return op.required_vs_registered(required, states)


@query("set05_tiered_sets", "SELECT DISTINCT n_name AS name FROM nation WHERE n_regionkey < 3")
def tiered_sets(spark, sf):
    members = load(spark, sf, "nation").selectExpr(
        "CASE n_regionkey WHEN 0 THEN 'core' WHEN 1 THEN 'extended' WHEN 2 THEN 'core' ELSE 'all' END AS tier", "n_name AS name"
    )
    return op.tier_members(members, "Extended")


@query(
    "set06_expected_subset_done",
    """WITH e AS (SELECT DISTINCT l_orderkey AS g, l_linenumber AS m FROM lineitem WHERE l_linenumber < 4), s AS (SELECT l_orderkey AS g, l_linenumber AS m, bool_or(l_linestatus = 'F') AS ok FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT g AS "group", bool_and(coalesce(ok, FALSE)) AS all_linked, bool_and(ok IS NULL) AS all_unlinked FROM e LEFT JOIN s USING (g, m) GROUP BY g""",
)
def expected_subset_done(spark, sf):
    items = load(spark, sf, "lineitem")
    expected = items.where("l_linenumber < 4").selectExpr("l_orderkey AS `group`", "l_linenumber AS member")
    linked = items.where("l_returnflag <> 'N'").selectExpr("l_orderkey AS `group`", "l_linenumber AS member", "l_linestatus AS state")
    return op.expected_members_done(expected, linked, "F")


DELTA = """WITH a AS (SELECT o_custkey AS g, lower('M' || o_orderpriority) AS k, min('M' || o_orderpriority) AS o FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL),
b AS (SELECT o_custkey AS g, lower('m' || o_orderpriority) AS k, min('m' || o_orderpriority) AS n FROM orders WHERE o_orderkey % 3 <> 1 GROUP BY ALL),
d AS (SELECT g, coalesce(o, n) AS member, CASE WHEN n IS NULL THEN 'remove' WHEN o IS NULL THEN 'add' ELSE 'keep' END AS action FROM a FULL JOIN b USING (g, k))
"""


def _delta(spark, sf):
    orders = load(spark, sf, "orders")
    old = orders.where("o_orderkey % 3 <> 0").selectExpr("o_custkey AS `group`", "'M' || o_orderpriority AS member")
    new = orders.where("o_orderkey % 3 <> 1").selectExpr("o_custkey AS `group`", "'m' || o_orderpriority AS member")
    return op.set_delta(old, new, ignore_case=True)


@query("set07_set_delta", DELTA + 'SELECT g AS "group", member, action FROM d')
def set_delta(spark, sf):
    return _delta(spark, sf)


@query(
    "set08_link_plan",
    DELTA + """SELECT a.g AS "group", a.member AS id, (SELECT string_agg(x.member, ',' ORDER BY x.action = 'add', x.member) FROM d x WHERE x.g = a.g AND (x.action = 'keep' OR (x.action = 'add' AND x.member <= a.member))) AS ids FROM d a WHERE a.action = 'add'""",
)
def link_plan(spark, sf):
    return op.link_plan(_delta(spark, sf)).withColumn("ids", F.array_join("ids", ","))


@query(
    "set08_plan_positions",
    DELTA + """SELECT g AS "group", row_number() OVER (PARTITION BY g ORDER BY action = 'add', member) AS position, member, action FROM d WHERE action <> 'remove'""",
)
def plan_positions(spark, sf):
    return op.plan_positions(_delta(spark, sf))


@query(
    "set08_unlink_plan",
    DELTA + """SELECT r.g AS "group", k.id, r.member AS ids FROM d r JOIN (SELECT g, min(member) AS id FROM d WHERE action = 'keep' GROUP BY g) k USING (g) WHERE r.action = 'remove'""",
)
def unlink_plan(spark, sf):
    return op.unlink_plan(_delta(spark, sf)).withColumn("ids", F.array_join("ids", ","))


def _text(tags):
    entries = F.array_sort(F.transform(F.map_entries(tags), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("<null>")))))
    return F.array_join(entries, ";")


def _tags(spark, sf):
    """Tags from the event properties, with more kinds of value."""
    value = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"k": '), value, F.lit(', "Type": "'), F.col("event_type"), F.lit('", "ratio": 1.5, "none": null}'))
    return load(spark, sf, "events").select("event_id", c.tags_from_json(text).alias("tags"))


TAGS = "WITH t AS (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)\n"


@query("map01_tags_to_map", TAGS + "SELECT event_id, 'Type=' || event_type || ';k=' || k || ';none=<null>;ratio=' AS tags, 'Type=' || event_type || ';k=' || k || ';ratio=' AS flat FROM t")
def tags_to_map(spark, sf):
    return _tags(spark, sf).select("event_id", _text("tags").alias("tags"), _text(c.drop_null_values(F.col("tags"))).alias("flat"))


@query("map02_drop_keys", TAGS + "SELECT event_id, 'k=' || k || ';none=<null>;ratio=' AS folded, 'Type=' || event_type || ';k=' || k || ';none=<null>' AS exact FROM t")
def drop_keys(spark, sf):
    tags = F.col("tags")
    managed = F.map_concat(tags, F.create_map(F.lit("WEBSITE_VNET_ROUTE_ALL"), F.lit("1")))
    return _tags(spark, sf).select(
        "event_id",
        _text(c.drop_keys(tags, ["TYPE", ""])).alias("folded"),
        _text(c.drop_keys(managed, [*c.MANAGED_SETTINGS, "ratio"], ignore_case=False)).alias("exact"),
    )


@query("map03_match_tags", TAGS + "SELECT event_id FROM t WHERE event_type = 'click' AND k % 10 = 7 AND event_id % 4 <> 0")
def match_tags(spark, sf):
    tags = _tags(spark, sf).withColumn("tags", F.when(F.col("event_id") % 4 != 0, F.col("tags")))
    digit = F.transform_values("tags", lambda k, v: F.when(k == "k", F.right(v, F.lit(1))).otherwise(v))
    return tags.where(c.has_tags(digit, {"Type": "click", "k": "7"})).select("event_id")


@query(
    "map04_merge_settings",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'A=1;b=2' WHEN 1 THEN 'A=1;B=' || o_orderstatus ELSE 'A=1;b=2;c=' || o_orderpriority END AS merged FROM orders""",
)
def merge_settings(spark, sf):
    system = F.create_map(F.lit("A"), F.lit("1"), F.lit("b"), F.lit("2"))
    user = (
        F.when(F.col("o_orderkey") % 3 == 1, F.create_map(F.lit("B"), F.col("o_orderstatus")))
        .when(F.col("o_orderkey") % 3 == 2, F.create_map(F.lit("c"), F.col("o_orderpriority")))
    )
    return load(spark, sf, "orders").select("o_orderkey", _text(c.merge_settings(system, user)).alias("merged"))


@query(
    "nst01_flatten_block",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END AS blocks, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS name FROM orders",
)
def flatten_block(spark, sf):
    rows = load(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_orderstatus <> 'P' THEN named_struct('name', o_orderpriority, 'price', o_totalprice) END AS plan"
    )
    return op.flatten_block(rows, "plan").select("o_orderkey", F.size("plan").alias("blocks"), F.get("plan", F.lit(0))["name"].alias("name"))


@query("nst02_expand_block", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS name FROM orders")
def expand_block(spark, sf):
    rows = load(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "CASE o_orderkey % 3 WHEN 0 THEN array(named_struct('name', o_orderpriority)) WHEN 1 THEN array(CAST(NULL AS STRUCT<name: STRING>)) ELSE CAST(array() AS ARRAY<STRUCT<name: STRING>>) END AS plan",
    )
    return op.expand_block(rows, "plan").select("o_orderkey", "plan.name")


@query(
    "nst03_explode_block",
    "SELECT o_orderkey, l_linenumber, l_partkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'",
)
def explode_block(spark, sf):
    items = load(spark, sf, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    nested = op.collect_blocks(items, "o_orderkey", "l_linenumber", ["l_partkey"])
    orders = load(spark, sf, "orders").select("o_orderkey").join(nested, "o_orderkey", "left")
    return op.explode_blocks(orders, "o_orderkey", "blocks")


@query(
    "nst04_json_text_columns",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'object' WHEN 1 THEN 'missing' ELSE 'bad' END AS state, CASE WHEN event_id % 3 = 0 THEN CAST(regexp_extract(props, '[0-9]+', 0) AS INT) END AS k,
 CASE WHEN event_id % 3 = 0 THEN replace(props, ' ', '') END AS text FROM events""",
)
def json_text_columns(spark, sf):
    rows = load(spark, sf, "events").selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN props WHEN 2 THEN '{oops' END AS t")
    parsed = c.json_object(F.col("t"))
    return rows.select(
        "event_id",
        F.when(F.col("t").isNull(), "missing").when(parsed.isNull(), "bad").otherwise("object").alias("state"),
        F.try_variant_get(F.try_element_at(parsed, F.lit("k")), "$", "int").alias("k"),
        F.to_json(F.try_parse_json("t")).alias("text"),
    )


CIDRS = cte("cidrs").rstrip() + """,
n AS (SELECT DISTINCT cidr, CAST(split_part(cidr, '/', 2) AS INT) AS bits,
  CAST(split_part(cidr, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(cidr, '.', 2) AS BIGINT) * 65536 + CAST(split_part(cidr, '.', 3) AS BIGINT) * 256 + CAST(split_part(split_part(cidr, '.', 4), '/', 1) AS BIGINT) AS ip, row_key % 2 AS side FROM cidrs),
b AS (SELECT *, ip - ip % CAST(pow(2, 32 - bits) AS BIGINT) AS lo, ip - ip % CAST(pow(2, 32 - bits) AS BIGINT) + CAST(pow(2, 32 - bits) AS BIGINT) - 1 AS hi FROM n)
"""


@query("rng01_cidr_overlap_join", CIDRS + "SELECT DISTINCT a.cidr AS l, c.cidr AS r FROM b a JOIN b c ON a.lo <= c.hi AND c.lo <= a.hi WHERE a.side = 0 AND c.side = 1")
def cidr_overlap_join(spark, sf):
    cidrs = load(spark, sf, "cidrs")
    return op.cidr_overlaps(cidrs.where("row_key % 2 = 0"), cidrs.where("row_key % 2 = 1"))


_VERSIONS = """SELECT p_partkey AS row_key, p_brand AS grp, CASE WHEN p_partkey % 11 = 0 THEN 'latest' WHEN p_partkey % 13 = 0 THEN '1.x' ELSE CAST(p_size AS STRING) || '.' || CAST(p_partkey % 12 AS STRING) || '.' || CAST(p_partkey % 7 AS STRING) END AS version FROM {part}"""
VERSIONS = "WITH v AS (" + _VERSIONS.replace("{part}", "part") + """),
k AS (SELECT *, CASE WHEN version <> 'latest' AND version <> '1.x' THEN CAST(split_part(version, '.', 1) AS BIGINT) * 10000 + CAST(split_part(version, '.', 2) AS BIGINT) * 100 + CAST(split_part(version, '.', 3) AS BIGINT) END AS n FROM v)
"""


def _versions(spark, sf):
    return spark.sql(_VERSIONS, part=load(spark, sf, "part"))


@query("ord01_semver_sort", VERSIONS + "SELECT row_key, version, CASE WHEN n IS NULL THEN 'Malformed version' END AS error FROM k ORDER BY n NULLS LAST, version")
def semver_sort(spark, sf):
    return op.semver_sort(_versions(spark, sf), "version").select("row_key", "version", "error")


@query("ord02_latest_per_group", VERSIONS + "SELECT grp, arg_max(version, n) AS latest FROM k WHERE n IS NOT NULL GROUP BY grp")
def latest_per_group(spark, sf):
    return op.latest_per_group(_versions(spark, sf), "grp", "version")


@query(
    "ord02_resolve_latest",
    VERSIONS + "SELECT row_key, CASE WHEN version = 'latest' THEN m.latest ELSE version END AS resolved FROM k LEFT JOIN (SELECT grp, arg_max(version, n) AS latest FROM k WHERE n IS NOT NULL GROUP BY grp) m USING (grp)",
)
def resolve_latest(spark, sf):
    rows = _versions(spark, sf)
    return op.resolve_latest(rows, op.latest_per_group(rows, "grp", "version"), "grp", "version").select("row_key", "resolved")


@query(
    "ord03_ordinal_compare",
    """WITH t AS (SELECT p_partkey AS row_key, split_part('Basic,S1,GP_Gen5,P2,BC_Gen5,Hyper', ',', CAST(1 + p_partkey % 6 AS INT)) AS a, split_part('bc_x,premium,gp,standard,b', ',', CAST(1 + p_size % 5 AS INT)) AS b FROM part)
SELECT row_key, CASE a WHEN 'Hyper' THEN 0 WHEN 'Basic' THEN 1 WHEN 'S1' THEN 2 WHEN 'GP_Gen5' THEN 3 WHEN 'P2' THEN 4 ELSE 5 END AS rank_a,
  a <> 'Hyper' AND CASE a WHEN 'Basic' THEN 1 WHEN 'S1' THEN 2 WHEN 'GP_Gen5' THEN 3 WHEN 'P2' THEN 4 ELSE 5 END > CASE b WHEN 'b' THEN 1 WHEN 'standard' THEN 2 WHEN 'gp' THEN 3 WHEN 'premium' THEN 4 ELSE 5 END AS higher FROM t""",
)
def ordinal_compare(spark, sf):
    rows = load(spark, sf, "part").selectExpr(
        "p_partkey AS row_key", "split_part('Basic,S1,GP_Gen5,P2,BC_Gen5,Hyper', ',', CAST(1 + p_partkey % 6 AS INT)) AS a",
        "split_part('bc_x,premium,gp,standard,b', ',', CAST(1 + p_size % 5 AS INT)) AS b",
    )
    return rows.select("row_key", c.tier_rank(F.col("a")).alias("rank_a"), c.higher_tier(F.col("a"), F.col("b")).alias("higher"))


@query(
    "ord04_sorted_keys",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '[]' ELSE '[a:' || o_orderpriority || '][z:' || o_orderstatus || ']' END AS tags FROM orders",
)
def sorted_keys(spark, sf):
    tags = F.when(
        F.col("o_orderkey") % 4 != 0, F.create_map(F.lit("z"), F.col("o_orderstatus"), F.lit("a"), F.col("o_orderpriority"))
    ).otherwise(F.create_map().cast("map<string,string>"))
    return load(spark, sf, "orders").select("o_orderkey", c.filter_text_id(tags).alias("tags"))


@query("flt01_exclude_default", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING'")
def exclude_default(spark, sf):
    return op.exclude_default(load(spark, sf, "customer"), "c_mktsegment", "BUILDING").select("c_custkey", "c_mktsegment")


@query(
    "flt02_classify_by_first_set",
    "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'database' WHEN c_nationkey % 2 = 0 THEN 'pool' ELSE 'server' END AS class FROM customer",
)
def classify_by_first_set(spark, sf):
    database = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise("")
    pool = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_mktsegment"))
    return load(spark, sf, "customer").select("c_custkey", c.first_set("server", database=database, pool=pool).alias("class"))


@query(
    "flt03_translate_codes",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderstatus END AS status, o_orderstatus IN ('O', 'P') AS enabled FROM orders",
)
def translate_codes(spark, sf):
    status = F.col("o_orderstatus")
    return load(spark, sf, "orders").select(
        "o_orderkey", c.translate_code(status, {"o": "open", "f": "done"}).alias("status"), status.isin("O", "P").alias("enabled")
    )
