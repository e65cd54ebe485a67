"""Symbol-index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.functions import names
from cadastre.operators import symbols as op
from cadastre.plans.inputs import cte, load
from cadastre.plans.registry import query
from cadastre.sources.symbol_index import parse_symbol_path, parse_symbol_text

RAW = cte("symbols_raw")
PARSED = RAW.rstrip() + """,
s1 AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS package_dir,
    regexp_extract(path, '([^/]+)\\.goindex$', 1) AS file,
    regexp_extract(text, '(?s)^package [^\\n]*\\n(?:import \\(.*?\\n\\)\\n|import [^\\n]*\\n)?(.*)$', 1) AS body FROM symbols_raw),
symbols AS (SELECT *, split_part(file, '.', 1) AS kind,
    CASE WHEN file LIKE 'method.%' THEN split_part(file, '.', 2) END AS receiver,
    CASE WHEN file LIKE 'method.%' THEN split_part(file, '.', 3) ELSE split_part(file, '.', 2) END AS name,
    split_part(path, '/', 3) AS service,
    CASE WHEN len(string_split(path, '/')) > 4 THEN split_part(path, '/', 4) ELSE '' END AS subpackage,
    regexp_extract(text, '^package ([^\\n]*)', 1) AS package,
    substr(text, strpos(text, 'import') + 7, length(text) - length(body) - strpos(text, 'import') - 6) AS import_block,
    CAST(len(string_split(left(text, length(text) - length(body)), chr(10))) AS INT) AS decl_line,
    CAST(len(string_split(rtrim(body, chr(10)), chr(10))) AS INT) AS loc FROM s1)
"""


def _symbols(spark, sf):
    return parse_symbol_text(parse_symbol_path(load(spark, sf, "symbols_raw")))


@query("src02_parse_symbol_path", PARSED + "SELECT path, kind, receiver, name, package_dir, service, subpackage FROM symbols")
def symbol_paths(spark, sf):
    return parse_symbol_path(load(spark, sf, "symbols_raw")).drop("text")


@query("src03_parse_symbol_text", PARSED + "SELECT path, package, import_block, body, decl_line, loc FROM symbols")
def symbol_texts(spark, sf):
    return parse_symbol_text(load(spark, sf, "symbols_raw")).drop("text")


@query(
    "idx01_symbol_counts",
    PARSED + """SELECT kind, service, subpackage, count(*) AS declarations, CAST(sum(loc) AS BIGINT) AS loc,
CAST(grouping(kind, service, subpackage) AS INT) AS level FROM symbols GROUP BY CUBE (kind, service, subpackage)""",
)
def symbol_counts(spark, sf):
    return op.symbol_counts(_symbols(spark, sf), "kind", "service", "subpackage")


IMPORTS = PARSED.rstrip() + """,
lines AS (SELECT path, body, unnest(string_split(import_block, chr(10))) AS line,
                 unnest(range(1000)[1:len(string_split(import_block, chr(10)))]) AS i FROM symbols),
imports AS (SELECT path, body, CAST(row_number() OVER (PARTITION BY path ORDER BY i) - 1 AS INT) AS pos,
    nullif(trim(split_part(line, '"', 1)), '') AS alias, split_part(line, '"', 2) AS import_path
  FROM lines WHERE line LIKE '%"%')
"""


@query("idx02_explode_imports", IMPORTS + "SELECT path, pos, alias, import_path FROM imports")
def explode_imports(spark, sf):
    return op.explode_imports(_symbols(spark, sf))


@query(
    "idx03_used_imports",
    IMPORTS + """SELECT path, import_path, used_as FROM (SELECT *, coalesce(alias, regexp_extract(import_path, '([^/]+)$', 1)) AS used_as FROM imports)
WHERE regexp_matches(body, '(?:^|[^A-Za-z0-9_.])' || used_as || '\\.')""",
)
def used_imports(spark, sf):
    return op.used_imports(_symbols(spark, sf))


EDGES = IMPORTS.rstrip() + """,
edges AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS src, import_path AS dst, count(*) AS weight FROM imports GROUP BY ALL)
"""


def _edges(spark, sf):
    imports = op.explode_imports(_symbols(spark, sf))
    return op.dependency_edges(
        imports.withColumn("package_dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1)), "package_dir", "import_path"
    )


@query("idx04_package_dependency_graph", EDGES + "SELECT * FROM edges")
def package_dependency_graph(spark, sf):
    return _edges(spark, sf)


@query(
    "idx04_package_degrees",
    EDGES + """SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree
FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node""",
)
def package_degrees(spark, sf):
    return op.degrees(_edges(spark, sf))


@query(
    "idx04_supplier_part_edges",
    "SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL",
)
def supplier_part_edges(spark, sf):
    return op.dependency_edges(load(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query(
    "idx05_local_call_graph",
    PARSED.rstrip() + """,
calls AS (SELECT DISTINCT package_dir, path AS caller, unnest(regexp_extract_all(
      replace(regexp_replace(body, '^func \\w+', ''), '(', '( '), '(?:^|[^.\\w])([A-Za-z_]\\w*)\\(', 1)) AS name FROM symbols)
SELECT caller, f.path AS callee FROM calls JOIN symbols f USING (package_dir, name) WHERE f.kind = 'func'""",
)
def local_call_graph(spark, sf):
    return op.local_call_graph(_symbols(spark, sf))


_GRAPH = """
SELECT 'supplier:' || s_suppkey AS src, 'nation:' || s_nationkey AS dst FROM {supplier}
UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM {nation}
UNION ALL SELECT 'region:' || r_regionkey, 'nation:' || (r_regionkey * 3) FROM {region}
UNION ALL SELECT 'customer:' || c_custkey, 'supplier:' || (c_custkey % 50) FROM {customer}
"""


@query(
    "idx06_reachability",
    "WITH RECURSIVE g AS (" + _GRAPH.replace("{", "").replace("}", "") + """),
walk AS (SELECT DISTINCT 'customer:' || c_custkey AS node, 0 AS depth FROM customer WHERE c_mktsegment = 'BUILDING'
  UNION SELECT g.dst, walk.depth + 1 FROM walk JOIN g ON g.src = walk.node WHERE walk.depth < 20)
SELECT node, CAST(min(depth) AS INT) AS depth FROM walk GROUP BY node""",
)
def reachability(spark, sf):
    graph = spark.sql(_GRAPH, **{t: load(spark, sf, t) for t in ("supplier", "nation", "region", "customer")})
    entries = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    return op.reachability(graph, entries.selectExpr("'customer:' || c_custkey AS node"))


FIELDS = cte("struct_fields_raw").rstrip() + """,
lines AS (SELECT type_name, unnest(string_split(body, chr(10))) AS line, unnest([0,1,2,3,4,5,6,7,8,9][1:len(string_split(body, chr(10)))]) AS i FROM struct_fields_raw),
named AS (SELECT type_name, line, i, unnest(n) AS field, unnest(range(len(n))) AS k FROM (SELECT *, CASE WHEN contains(ltrim(line), ' ')
   THEN string_split(regexp_extract(ltrim(line), '^((?:\\w+, )*\\w+) ', 1), ', ') ELSE [split_part(ltrim(line), '.', -1)] END AS n FROM lines WHERE line LIKE '    %') t),
fields AS (SELECT type_name, CAST(row_number() OVER (PARTITION BY type_name ORDER BY i, k) - 1 AS INT) AS pos, field,
   regexp_extract(ltrim(line), '^(?:\\w+, )*(?:\\w+ )?([^ ]+)', 1) AS field_type,
   nullif(regexp_extract(line, 'json:"([^",]*)', 1), '') AS json_tag,
   nullif(regexp_extract(line, 'tfschema:"([^",]*)', 1), '') AS tfschema_tag,
   nullif(regexp_extract(line, 'tfsdk:"([^",]*)', 1), '') AS tfsdk_tag
  FROM named)
"""


@query("idx07_struct_fields", FIELDS + "SELECT * FROM fields")
def struct_fields(spark, sf):
    return op.struct_fields(load(spark, sf, "struct_fields_raw"))


@query(
    "idx08_model_tag_check",
    FIELDS.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """,
f AS (SELECT replace(type_name, 'type_', 'T') AS type_name, field, tfschema_tag, regexp_extract(field_type, '^\\[\\](\\w+)$', 1) AS inner_type FROM fields),
walk AS (SELECT type_name AS root, field AS field_path, tfschema_tag, inner_type, [type_name] AS seen FROM f
  UNION ALL SELECT w.root, w.field_path || '.' || f.field, f.tfschema_tag, f.inner_type, list_append(w.seen, f.type_name)
  FROM walk w JOIN f ON f.type_name = w.inner_type WHERE NOT list_contains(w.seen, f.type_name))
SELECT root, field_path FROM walk WHERE tfschema_tag IS NULL""",
)
def model_tag_check(spark, sf):
    fields = op.struct_fields(load(spark, sf, "struct_fields_raw"))
    return op.model_tag_check(fields.withColumn("type_name", F.expr("replace(type_name, 'type_', 'T')")))


@query(
    "idx09_interface_satisfaction",
    """SELECT o_custkey AS receiver, CAST(n AS INT) AS n_have, n = 3 AS satisfied,
  array_to_string(list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM'], lambda x: NOT list_contains(have, x)), ',') AS missing
FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) FILTER (o_orderpriority < '4') AS n, list(o_orderpriority) AS have FROM orders GROUP BY 1)""",
)
def interface_satisfaction(spark, sf):
    methods = load(spark, sf, "orders").select(
        F.col("o_custkey").alias("receiver"), F.col("o_orderpriority").alias("method")
    )
    return op.interface_satisfaction(methods, ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query(
    "idx10_name_case_convert",
    """WITH n AS (SELECT p_partkey, replace(initcap_name, ' ', '') || CASE WHEN p_size % 3 = 0 THEN 'ID' WHEN p_size % 3 = 1 THEN 'HTTPUrl' ELSE '2' END AS camel, snake
 FROM (SELECT *, upper(left(p_name, 1)) || substr(p_name, 2, strpos(p_name, ' ') - 1) || upper(substr(p_name, strpos(p_name, ' ') + 1, 1)) || substr(p_name, strpos(p_name, ' ') + 2) AS initcap_name,
       replace(p_name, ' ', '__') || '_x' AS snake FROM part))
SELECT p_partkey AS row_key, camel, snake,
  CASE WHEN camel LIKE '%ID' THEN lower(regexp_replace(left(camel, length(camel) - 2), '(.)([A-Z])', '\\1_\\2')) || '_id'
       WHEN camel LIKE '%HTTPUrl' THEN lower(regexp_replace(left(camel, length(camel) - 7), '(.)([A-Z])', '\\1_\\2')) || '_http_url'
       ELSE lower(regexp_replace(camel, '(.)([A-Z])', '\\1_\\2')) END AS by_run,
  replace(substr(lower(regexp_replace(camel, '([A-Z])', '_\\1', 'g')), 2), '_i_d', '_id') AS by_capital,
  upper(left(snake, 1)) || substr(split_part(snake, '__', 1), 2) || upper(left(split_part(snake, '__', 2), 1)) || substr(replace(split_part(snake, '__', 2), '_x', ''), 2) || 'X' AS from_snake
FROM n""",
)
def name_case_convert(spark, sf):
    part = load(spark, sf, "part").selectExpr(
        "p_partkey AS row_key",
        "replace(initcap(p_name), ' ', '') || CASE WHEN p_size % 3 = 0 THEN 'ID' WHEN p_size % 3 = 1 THEN 'HTTPUrl' ELSE '2' END AS camel",
        "replace(p_name, ' ', '__') || '_x' AS snake",
    )
    return part.select(
        "*",
        names.snake_by_run(F.col("camel")).alias("by_run"),
        names.snake_by_capital(F.col("camel")).alias("by_capital"),
        names.camel_case(F.col("snake")).alias("from_snake"),
    )
