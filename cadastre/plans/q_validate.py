"""Column validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.functions import validators as v
from cadastre.operators import validate as op
from cadastre.operators.validate import Rule
from cadastre.plans.inputs import cte, load
from cadastre.plans.registry import query


def _cases(table: str, key: str, cases: list[tuple[str, str, str]]) -> str:
    """SQL twin: one select per (column, rule id, condition that fails)."""
    return " UNION ALL ".join(
        f"SELECT {key} AS row_key, '{column}' AS \"column\", '{rule}' AS rule_id FROM {table} WHERE {bad}" for column, rule, bad in cases
    )


def _brief(violations):
    return violations.select("row_key", "column", "rule_id")


CUSTOMER_RULES = [
    Rule("name-length", "c_name", "length_between", {"min": 1, "max": 18}),
    Rule("name-match", "c_name", "match", {"pattern": "^Customer#[0-9]*[02468]$", "text": "must end with an even digit"}),
    Rule("balance", "c_acctbal", "at_least", {"min": 0}),
    Rule("segment", "c_mktsegment", "in_list", {"values": ["BUILDING", "machinery"], "ignore_case": True}),
]


@query(
    "val01_validate_columns",
    """SELECT c_custkey AS row_key, 'c_name' AS "column", 'name-length' AS rule_id, 'c_name must have a length from 1 to 18' AS message FROM customer WHERE length(c_name) > 18
UNION ALL SELECT c_custkey, 'c_name', 'name-match', 'c_name must end with an even digit' FROM customer WHERE NOT regexp_matches(c_name, '[02468]$')
UNION ALL SELECT c_custkey, 'c_acctbal', 'balance', 'c_acctbal must be at least 0' FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, 'c_mktsegment', 'segment', 'c_mktsegment must be one of [''BUILDING'', ''machinery'']' FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery')""",
)
def validate_columns(spark, sf):
    return op.validate_columns(load(spark, sf, "customer").withColumn("row_key", F.col("c_custkey")), "row_key", CUSTOMER_RULES)


@query(
    "val02_combinators",
    """SELECT p_partkey AS row_key, concat_ws(';', CASE WHEN NOT starts_with(p_name, 'red') THEN 'p_name must start with one of [''red'']' END, CASE WHEN p_size < 10 THEN 'p_size must be at least 10' END) AS all_errors,
 CASE WHEN NOT starts_with(p_name, 'red') AND p_size < 10 THEN 'p_name must start with one of [''red''];p_size must be at least 10' ELSE '' END AS any_errors,
 concat_ws(';', CASE WHEN starts_with(p_name, 'red') THEN 'ID cannot be a red' END, CASE WHEN p_size >= 10 THEN 'ID cannot be a big' END) AS none_errors FROM part""",
)
def combinators(spark, sf):
    red = v.check("starts_with", F.col("p_name"), "p_name", {"values": ["red"]})
    big = v.check("at_least", F.col("p_size"), "p_size", {"min": 10})
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("row_key"),
        F.array_join(v.all_of(red, big), ";").alias("all_errors"),
        F.array_join(v.any_of(red, big), ";").alias("any_errors"),
        F.array_join(v.none_of(red=red, big=big), ";").alias("none_errors"),
    )


_BAD_CUSTOMER = "length(c_name) > 18 OR NOT regexp_matches(c_name, '[02468]$') OR c_acctbal < 0 OR lower(c_mktsegment) NOT IN ('building', 'machinery')"


@query("val03_good_rows", f"SELECT c_custkey, c_name FROM customer WHERE NOT ({_BAD_CUSTOMER})")
def good_rows(spark, sf):
    good, _ = op.split_by_validity(load(spark, sf, "customer"), CUSTOMER_RULES)
    return good.select("c_custkey", "c_name")


@query(
    "val03_violation_counts",
    """SELECT 'c_name' AS "column", 'name-length' AS rule_id, count(*) AS violations FROM customer WHERE length(c_name) > 18 HAVING count(*) > 0
UNION ALL SELECT 'c_name', 'name-match', count(*) FROM customer WHERE NOT regexp_matches(c_name, '[02468]$') HAVING count(*) > 0
UNION ALL SELECT 'c_acctbal', 'balance', count(*) FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0
UNION ALL SELECT 'c_mktsegment', 'segment', count(*) FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery') HAVING count(*) > 0""",
)
def violation_counts(spark, sf):
    return op.violation_counts(op.validate_columns(load(spark, sf, "customer"), "c_custkey", CUSTOMER_RULES))


_TEXTS = "SELECT p_partkey AS row_key, CASE p_size % 10 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE p_name END AS t FROM {part}"
STRING_RULES = [
    Rule("s1", "t", "not_empty"), Rule("s2", "t", "empty"), Rule("s3", "t", "not_white_space"),
    Rule("s4", "t", "length_between", {"min": 5, "max": 9}),
    Rule("s5", "t", "match", {"pattern": "^[a-z ]*t$", "text": "must end with t"}),
    Rule("s6", "t", "not_match", {"pattern": "^(red|hot)", "text": "must not be warm"}),
    Rule("s7", "t", "contains_none_of", {"chars": "xyz"}),
    Rule("s8", "t", "in_list", {"values": ["RED BOLT", "old gear"], "ignore_case": True}),
    Rule("s9", "t", "not_in_list", {"values": ["red bolt", "old gear"]}),
    Rule("s10", "t", "starts_with", {"values": ["red", "blue"]}),
    Rule("s11", "t", "not_starts_with", {"values": ["red", "blue"]}),
]


@query(
    "val04_string_rules",
    "WITH x AS (" + _TEXTS.replace("{part}", "part") + ") " + _cases("x", "row_key", [
        ("t", "s1", "t = ''"), ("t", "s2", "t <> ''"), ("t", "s3", "trim(t) = ''"), ("t", "s4", "length(t) NOT BETWEEN 5 AND 9"),
        ("t", "s5", "NOT suffix(t, 't')"), ("t", "s6", "starts_with(t, 'red') OR starts_with(t, 'hot')"), ("t", "s7", "contains(t, 'x') OR contains(t, 'y') OR contains(t, 'z')"),
        ("t", "s8", "t NOT IN ('red bolt', 'old gear')"), ("t", "s9", "t IN ('red bolt', 'old gear')"),
        ("t", "s10", "NOT starts_with(t, 'red') AND NOT starts_with(t, 'blue')"), ("t", "s11", "starts_with(t, 'red') OR starts_with(t, 'blue')"),
    ]),
)
def string_rules(spark, sf):
    return _brief(op.validate_columns(spark.sql(_TEXTS, part=load(spark, sf, "part")), "row_key", STRING_RULES))


NUMBER_RULES = [
    Rule("n1", "s", "between", {"min": 5, "max": 40}), Rule("n2", "s", "at_least", {"min": 3}), Rule("n3", "s", "at_most", {"max": 45}),
    Rule("n4", "s", "positive"), Rule("n5", "s", "divisible_by", {"by": 3}), Rule("n6", "s", "number_in", {"values": [1, 2, 3, 5, 8, 13]}),
    Rule("n7", "s", "number_not_in", {"values": [7, 14]}), Rule("n8", "d", "between", {"min": 0.02, "max": 0.06}), Rule("n9", "d", "at_least", {"min": 0.03}),
    Rule("n10", "d", "number_in", {"values": [0.01, 0.05]}), Rule("n11", "d", "non_zero"), Rule("n12", "d", "price_or_minus_one"),
]


@query(
    "val05_numeric_rules",
    "WITH x AS (SELECT l_orderkey AS row_key, CAST(l_quantity AS INT) AS s, l_discount AS d FROM lineitem) " + _cases("x", "row_key", [
        ("s", "n1", "s NOT BETWEEN 5 AND 40"), ("s", "n2", "s < 3"), ("s", "n3", "s > 45"), ("s", "n4", "s < 1"), ("s", "n5", "s % 3 <> 0"),
        ("s", "n6", "s NOT IN (1, 2, 3, 5, 8, 13)"), ("s", "n7", "s IN (7, 14)"), ("d", "n8", "d NOT BETWEEN 0.02 AND 0.06"), ("d", "n9", "d < 0.03"),
        ("d", "n10", "d NOT IN (0.01, 0.05)"), ("d", "n11", "d = 0"), ("d", "n12", "d <> -1 AND d < 0.00001"),
    ]),
)
def numeric_rules(spark, sf):
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey AS row_key", "CAST(l_quantity AS INT) AS s", "l_discount AS d")
    return _brief(op.validate_columns(rows, "row_key", NUMBER_RULES))


_FORMATS = """SELECT event_id AS row_key,
 CASE event_id % 3 WHEN 0 THEN substr(md5(props), 1, 8) || '-' || substr(md5(props), 9, 4) || '-' || substr(md5(props), 13, 4) || '-' || substr(md5(props), 17, 4) || '-' || substr(md5(props), 21, 12) ELSE md5(props) END AS uuid,
 CASE WHEN event_id % 4 = 0 THEN replace(props, ':', ';') ELSE props END AS js,
 CASE event_id % 4 WHEN 0 THEN 'QUJD' WHEN 1 THEN 'QUI=' WHEN 2 THEN 'QUI' ELSE '' END AS b64,
 CASE event_id % 3 WHEN 0 THEN 'u' || CAST(user_id AS STRING) || '@example.org' WHEN 1 THEN 'User <u@example.org>' ELSE 'u@@x' END AS mail,
 CASE event_id % 4 WHEN 0 THEN '2024-02-30T10:00:00Z' WHEN 1 THEN '2024-02-29T10:00:00Z' WHEN 2 THEN '2024-02-29T10:00:00+02:00' ELSE '2024-02-29 10:00:00' END AS t,
 CASE event_id % 3 WHEN 0 THEN 'Monday' WHEN 1 THEN 'monday' ELSE 'Day' END AS wd, CASE event_id % 3 WHEN 0 THEN 'May' WHEN 1 THEN 'may' ELSE 'Mai' END AS mo,
 CASE event_id % 5 WHEN 0 THEN '1.02:03:04' WHEN 1 THEN '02:03:04' WHEN 2 THEN '02:03' WHEN 3 THEN 'x.02:03:04' ELSE '-1:00:00' END AS span,
 CASE event_id % 3 WHEN 0 THEN '^a+$' WHEN 1 THEN '(' ELSE 'a*' END AS rx FROM {events}"""
FORMAT_RULES = [
    Rule("f1", "uuid", "uuid"), Rule("f2", "js", "json"), Rule("f3", "b64", "base64"), Rule("f4", "mail", "email"), Rule("f5", "t", "rfc3339"),
    Rule("f6", "wd", "weekday"), Rule("f7", "mo", "month", {"ignore_case": True}), Rule("f8", "span", "time_span"), Rule("f9", "rx", "regex"),
]


@query(
    "val06_format_rules",
    "WITH x AS (" + _FORMATS.replace("{events}", "events") + ") " + _cases("x", "row_key", [
        ("uuid", "f1", "row_key % 3 <> 0"), ("js", "f2", "row_key % 4 = 0"), ("b64", "f3", "row_key % 4 IN (2, 3)"), ("mail", "f4", "row_key % 3 = 2"),
        ("t", "f5", "row_key % 4 IN (0, 3)"), ("wd", "f6", "row_key % 3 <> 0"), ("mo", "f7", "row_key % 3 = 2"), ("span", "f8", "row_key % 5 > 1"), ("rx", "f9", "row_key % 3 = 1"),
    ]),
)
def format_rules(spark, sf):
    return _brief(op.validate_columns(spark.sql(_FORMATS, events=load(spark, sf, "events")), "row_key", FORMAT_RULES))


URL_RULES = [
    Rule("u1", "url", "https_url"), Rule("u2", "url", "http_url"), Rule("u3", "url", "scheme_url", {"values": ["ftp", "http"]}), Rule("u4", "url", "url_with_path"),
]
_URLS = "SELECT page_id AS row_key, CASE page_id % 5 WHEN 0 THEN 'ftp://files.example.org' WHEN 1 THEN 'no url' ELSE url END AS url FROM {pages}"


@query(
    "val06_url_rules",
    "WITH x AS (" + _URLS.replace("{pages}", "pages") + ") " + _cases("x", "row_key", [
        ("url", "u1", "NOT starts_with(url, 'https://')"), ("url", "u2", "NOT starts_with(url, 'http')"),
        ("url", "u3", "NOT starts_with(url, 'ftp://') AND NOT starts_with(url, 'http://')"), ("url", "u4", "row_key % 5 < 2 OR regexp_matches(url, '^https?://[^/]*/?$')"),
    ]),
)
def url_rules(spark, sf):
    return _brief(op.validate_columns(spark.sql(_URLS, pages=load(spark, sf, "pages")), "row_key", URL_RULES))


_IPS = """SELECT c_custkey AS row_key, CASE c_custkey % 4 WHEN 0 THEN '10.' || a || '.' || b || '.7' WHEN 1 THEN '172.' || CAST(c_custkey % 40 AS STRING) || '.0.1' WHEN 2 THEN '256.1.1.' || b ELSE '23.4.' || a || '.' || b END AS ip,
  CASE c_custkey % 6 WHEN 0 THEN '2001:db8::' || lower(h) WHEN 1 THEN '::1' WHEN 2 THEN '1:2:3:4:5:6:7:8' WHEN 3 THEN '1:2:3' WHEN 4 THEN '::ffff:10.0.0.1' ELSE 'g::1' END AS ip6,
  CASE c_custkey % 4 WHEN 0 THEN '10.0.0.0/8' WHEN 1 THEN '10.0.0.0/33' WHEN 2 THEN '10.0.0/8' ELSE '0.0.0.0/0' END AS cidr,
  CASE c_custkey % 3 WHEN 0 THEN '10.0.0.1-10.0.0.9' WHEN 1 THEN '10.0.0.9-10.0.0.1' ELSE '10.0.0.1' END AS rng,
  CAST(c_custkey * 50 AS STRING) AS port, CAST(c_custkey % 100 AS STRING) || '-' || CAST(c_custkey % 70 AS STRING) AS ports,
  '169.254.' || CAST(c_custkey % 30 AS STRING) || '.5' AS apipa, CAST(c_custkey % 260 AS STRING) AS num
FROM (SELECT c_custkey, CAST(c_custkey % 256 AS STRING) AS a, CAST(c_custkey % 199 AS STRING) AS b, to_hex(c_custkey) AS h FROM {customer}) c"""
NETWORK_RULES = [
    Rule("w1", "ip", "ipv4"), Rule("w2", "ip6", "ipv6"), Rule("w3", "ip6", "ip"), Rule("w4", "cidr", "cidr"), Rule("w5", "rng", "ipv4_range"), Rule("w6", "port", "port"),
    Rule("w7", "ports", "port_range"), Rule("w8", "apipa", "reserved_range"), Rule("w9", "ip", "public_ip_rule"), Rule("w10", "num", "power_of_two"),
]


@query(
    "val07_network_rules",
    "WITH x AS (" + _IPS.replace("{customer}", "customer") + ") " + _cases("x", "row_key", [
        ("ip", "w1", "row_key % 4 = 2"), ("ip6", "w2", "row_key % 6 IN (3, 5)"), ("ip6", "w3", "row_key % 6 IN (3, 5)"), ("cidr", "w4", "row_key % 4 IN (1, 2)"),
        ("rng", "w5", "row_key % 3 <> 0"), ("port", "w6", "CAST(port AS BIGINT) NOT BETWEEN 1 AND 65535"), ("ports", "w7", "row_key % 100 >= row_key % 70"),
        ("apipa", "w8", "row_key % 30 NOT IN (21, 22)"), ("ip", "w9", "row_key % 4 = 0 OR (row_key % 4 = 1 AND row_key % 40 BETWEEN 16 AND 31)"),
        ("num", "w10", "CAST(num AS INT) NOT IN (1, 2, 4, 8, 16, 32, 64, 128, 256)"),
    ]),
)
def network_rules(spark, sf):
    text = _IPS.replace("to_hex(c_custkey)", "hex(c_custkey)")
    return _brief(op.validate_columns(spark.sql(text, customer=load(spark, sf, "customer")), "row_key", NETWORK_RULES))


_NAMES = """SELECT c_custkey AS row_key, split_part('virtual_machine,linux_computer,storage_account,image_version,other', ',', CAST(1 + c_custkey % 5 AS INT)) AS kind,
 CASE CAST(floor(c_custkey / 5) AS BIGINT) % 6 WHEN 0 THEN 'good1' WHEN 1 THEN '_bad' WHEN 2 THEN '12345' WHEN 3 THEN '1.2.3' WHEN 4 THEN c_name ELSE 'ends-' END AS name FROM {customer}"""


@query(
    "val08_name_rule_catalogue",
    "WITH x AS (" + _NAMES.replace("{customer}", "customer") + """)
SELECT row_key, kind, 'virtual_machine-3' AS rule_id FROM x WHERE kind = 'virtual_machine' AND contains(name, '#')
UNION ALL SELECT row_key, kind, 'virtual_machine-4' FROM x WHERE kind = 'virtual_machine' AND name = '_bad'
UNION ALL SELECT row_key, kind, 'virtual_machine-5' FROM x WHERE kind = 'virtual_machine' AND name = 'ends-'
UNION ALL SELECT row_key, kind, 'virtual_machine-6' FROM x WHERE kind = 'virtual_machine' AND name = '12345'
UNION ALL SELECT row_key, kind, 'linux_computer-3' FROM x WHERE kind = 'linux_computer' AND name = '_bad'
UNION ALL SELECT row_key, kind, 'linux_computer-5' FROM x WHERE kind = 'linux_computer' AND (contains(name, '#') OR contains(name, '_'))
UNION ALL SELECT row_key, kind, 'linux_computer-6' FROM x WHERE kind = 'linux_computer' AND name = 'ends-'
UNION ALL SELECT row_key, kind, 'storage_account-1' FROM x WHERE kind = 'storage_account' AND name NOT IN ('good1', '12345')
UNION ALL SELECT row_key, kind, 'image_version-1' FROM x WHERE kind = 'image_version' AND name <> '1.2.3'""",
)
def name_rule_catalogue(spark, sf):
    names = spark.sql(_NAMES, customer=load(spark, sf, "customer"))
    return op.validate_names(names, "row_key", op.name_rules(spark)).select("row_key", "kind", "rule_id")


@query(
    "val09_map_rules",
    """WITH x AS (SELECT event_id AS row_key, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)
SELECT row_key, 'key_pattern' AS rule_id, 'Key' || k AS map_key FROM x UNION ALL SELECT row_key, 'forbidden_key', 'class' FROM x WHERE k % 2 = 0
UNION ALL SELECT row_key, 'value_length', 'note' FROM x WHERE k > 50 UNION ALL SELECT row_key, 'key_length', repeat('z', k) FROM x WHERE k > 90 UNION ALL SELECT row_key, 'max_keys', NULL FROM x WHERE k % 2 = 0""",
)
def map_rules(spark, sf):
    rows = load(spark, sf, "events").select(
        F.col("event_id").alias("row_key"), F.get_json_object("props", "$.k").cast("int").alias("k")
    )
    maps = rows.select(
        "row_key",
        F.expr("map_from_entries(filter(array(struct('Key' || k, 'v'), struct('note', repeat('n', k)), struct(repeat('z', greatest(k, 2)), 'v'),"
               " struct(CASE WHEN k % 2 = 0 THEN 'class' END, 'v')), e -> e.col1 IS NOT NULL))").alias("tags"),
    )
    return op.validate_maps(maps, "row_key", "tags", max_keys=3, max_key=90, max_value=50, forbidden=("class",))


@query(
    "val10_block_combinations",
    """WITH c AS (SELECT u.user_id, count(e.event_id) AS total, count(*) FILTER (event_type = 'click') AS k, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'view') AS v
  FROM (SELECT c_custkey AS user_id FROM customer) u LEFT JOIN events e USING (user_id) GROUP BY u.user_id)
SELECT user_id, total, CASE WHEN total = 0 THEN 'the block must define at least one action' WHEN k > 0 AND e > 0 THEN 'cannot specify both `click` and `error` in the block'
  WHEN k > 0 AND v > 0 THEN 'cannot specify both `click` and `view` in the block' WHEN total > 5 THEN 'the block may only contain up to 5 actions, got ' || total END AS error FROM c""",
)
def block_combinations(spark, sf):
    blocks = load(spark, sf, "events").select("user_id", F.col("event_type").alias("kind"))
    parents = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return op.block_combinations(blocks, "user_id", [("click", "error"), ("click", "view")], parents=parents)


@query(
    "val11_reference_list_check",
    """SELECT l_orderkey, p AS value, CASE WHEN p = '' THEN 'must not be empty' ELSE 'was not found in the list of supported names' END AS error
FROM (SELECT l_orderkey, CASE WHEN l_partkey % 50 = 0 THEN '' ELSE 'part_' || l_partkey END AS p FROM lineitem) WHERE p = '' OR p NOT IN (SELECT 'part_' || p_partkey FROM part WHERE p_size > 5)""",
)
def reference_list_check(spark, sf):
    rows = load(spark, sf, "lineitem").selectExpr("l_orderkey", "CASE WHEN l_partkey % 50 = 0 THEN '' ELSE 'part_' || l_partkey END AS p")
    reference = load(spark, sf, "part").where("p_size > 5").selectExpr("'part_' || p_partkey AS name")
    return op.reference_list_check(rows, "l_orderkey", "p", reference)


@query(
    "val12_table_expectations",
    """SELECT 'o_orderkey exists' AS expectation, count(*) FILTER (o_orderkey IS NULL) AS failures, count(*) FILTER (o_orderkey IS NULL) = 0 AS passed FROM orders
UNION ALL SELECT 'o_orderstatus equals O', count(*) FILTER (o_orderstatus <> 'O'), FALSE FROM orders
UNION ALL SELECT 'o_orderstatus absent', count(*), FALSE FROM orders UNION ALL SELECT 'o_orderstatus is_empty', count(*), FALSE FROM orders
UNION ALL SELECT 'o_orderstatus not_empty', 0, TRUE UNION ALL SELECT 'o_orderstatus is_uuid', count(*), FALSE FROM orders
UNION ALL SELECT 'o_custkey matches_column o_orderkey', count(*) FILTER (o_custkey <> o_orderkey), FALSE FROM orders
UNION ALL SELECT 'o_orderpriority matches ^[1-5]-', 0, TRUE""",
)
def table_expectations(spark, sf):
    return op.table_expectations(
        load(spark, sf, "orders"),
        [
            ("o_orderkey", "exists", None), ("o_orderstatus", "equals", "O"), ("o_orderstatus", "absent", None), ("o_orderstatus", "is_empty", None),
            ("o_orderstatus", "not_empty", None), ("o_orderstatus", "is_uuid", None), ("o_custkey", "matches_column", "o_orderkey"),
            ("o_orderpriority", "matches", "^[1-5]-"),
        ],
    )


@query(
    "val13_priority_in_range",
    "SELECT l_orderkey, count(*) AS size, max(l_linenumber) > count(*) - 1 AS bad FROM lineitem GROUP BY l_orderkey",
)
def priority_in_range(spark, sf):
    return op.priority_in_range(load(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")
