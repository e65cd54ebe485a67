"""Documentation queries, over pages derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.functions import pages as px
from cadastre.operators import docs as op
from cadastre.plans.inputs import cte, load
from cadastre.plans.registry import query

LINES = cte("page_lines")


def q(pattern: str) -> str:
    """A pattern as an SQL string literal."""
    return "'" + pattern.replace("'", "''") + "'"


def _lines(spark, sf):
    return load(spark, sf, "page_lines").select("page", "line_no", "text")


_TYPE_SQL = "'unknown'"
for _name, _pattern in op.SECTION_PATTERNS.items():
    _TYPE_SQL = f"CASE WHEN regexp_matches(text, {q(_pattern)}) THEN '{_name}' ELSE {_TYPE_SQL} END"
SECTIONED = LINES.rstrip() + f""",
h AS (SELECT page, line_no, text, starts_with(text, '#') OR (line_no = 0 AND starts_with(text, '---')) AS is_heading, {_TYPE_SQL} AS t,
   CASE WHEN starts_with(text, '## Example') THEN 'example' WHEN regexp_matches(text, '^#.*## Arguments? Reference|^## Arguments? Reference') THEN 'args'
        WHEN regexp_matches(text, '^## Attributes? Reference') THEN 'attr' WHEN starts_with(text, '## Timeout') THEN 'timeout' WHEN starts_with(text, '## Import') THEN 'import'
        WHEN starts_with(text, '##') AND NOT starts_with(text, '###') THEN 'other' END AS pos FROM page_lines),
sectioned AS (SELECT page, line_no, text, is_heading, greatest(CAST(sum(CAST(is_heading AS INT)) OVER w AS BIGINT), 1) AS section_no,
   last_value(CASE WHEN is_heading THEN t END IGNORE NULLS) OVER w AS section_type,
   last_value(CASE WHEN is_heading THEN CAST(length(regexp_extract(text, '^(#{{1,6}})', 1)) AS INT) END IGNORE NULLS) OVER w AS level,
   last_value(CASE WHEN is_heading THEN trim(regexp_extract(text, '^#{{1,6}}(.*)$', 1)) END IGNORE NULLS) OVER w AS heading,
   last_value(pos IGNORE NULLS) OVER w AS position FROM h WINDOW w AS (PARTITION BY page ORDER BY line_no)),
sections AS (SELECT page, section_no, section_type, level, heading, line_no FROM sectioned WHERE is_heading)
"""


@query("doc01_sectionise_page", SECTIONED + "SELECT * FROM sectioned")
def sectionise_page(spark, sf):
    return op.sectionise_page(_lines(spark, sf))


def _sections(spark, sf):
    return op.sections(op.sectionise_page(_lines(spark, sf)))


@query(
    "doc02_find_section",
    SECTIONED + "SELECT * FROM sections WHERE contains(lower(heading), 'reference') QUALIFY row_number() OVER (PARTITION BY page ORDER BY section_no) = 1",
)
def find_section(spark, sf):
    return op.find_section(_sections(spark, sf), "REFERENCE")


@query(
    "doc02_insert_section",
    SECTIONED + """, a AS (SELECT page, min(section_no) AS anchor FROM sections WHERE section_type = 'arguments' GROUP BY page),
u AS (SELECT page, CAST(section_no AS DOUBLE) AS k, section_type, heading FROM sections UNION ALL SELECT page, anchor + 0.5, 'new', 'API Providers' FROM a)
SELECT page, row_number() OVER (PARTITION BY page ORDER BY k) AS section_no, section_type, heading FROM u""",
)
def insert_section(spark, sf):
    return op.insert_section(_sections(spark, sf), "API Providers", "arguments", after=True)


FIELDS = LINES.rstrip() + f""",
f0 AS (SELECT page, line_no, text, word, regexp_extract(text, {q(px.FIELD)}, 1) AS name,
   translate(lower(regexp_extract(text, {q(px.FIELD)}, 2)), '()', '') AS requirement, regexp_extract(text, {q(px.DEFAULT)}, 1) AS dq,
   regexp_matches(text, {q(px.FORCE_NEW)}) AND NOT regexp_matches(text, {q(px.FORCE_NEW_WHEN)}) AS force_new,
   regexp_matches(text, {q(px.BLOCK_FIELD)}) OR contains(text, 'A block to') AS is_block,
   regexp_extract_all(regexp_extract(text, {q(px.POSSIBLE_VALUES)}, 0), {q(px.CODE)}, 1) AS e FROM page_lines WHERE regexp_matches(text, {q(px.FIELD)})),
fields AS (SELECT page, line_no, text, name, requirement, CASE WHEN length(dq) > 2 THEN dq[2:-2] ELSE '' END AS default_value, force_new, is_block,
   CASE WHEN is_block THEN coalesce(nullif(regexp_extract(text, {q(px.BLOCK_FIELD_ANY_CASE)}, 1), ''), name) END AS block_type,
   array_to_string(list_distinct_in_order, ',') AS enums FROM (SELECT *, list_filter(e, lambda x, i: list_position(e, x) = i) AS list_distinct_in_order FROM f0))
"""


def _fields(spark, sf):
    return op.parse_field_lines(_lines(spark, sf))


@query("doc03_parse_field_lines", FIELDS + "SELECT * FROM fields")
def parse_field_lines(spark, sf):
    return _fields(spark, sf).withColumn("enums", F.array_join("enums", ","))


HEADS = f"""
heads AS (SELECT page, line_no, text, regexp_matches(text, {q(px.BLOCK_HEAD)}) AS is_head,
   CASE WHEN regexp_matches(text, {q(px.BLOCK_HEAD)}) THEN array_to_string(regexp_extract_all(split_part(text, 'block', 1), {q(px.CODE)}, 1), ',') END AS names
  FROM page_lines WHERE regexp_matches(text, {q(px.BLOCK_HEAD)}) OR regexp_matches(text, {q(px.BLOCK_HEAD_TRY)}) OR (contains(text, 'supports') AND suffix(text, ':')))"""


@query("doc04_block_heads", LINES.rstrip() + "," + HEADS + " SELECT * FROM heads")
def block_heads(spark, sf):
    return op.block_heads(_lines(spark, sf)).withColumn("names", F.array_join("names", ","))


# Block fields stand below the block heading last seen in the page.
_BLOCK_ROWS = """SELECT page, 'b' || CAST(line_no % 4 AS STRING) AS block, CAST(floor(line_no / 5) AS BIGINT) AS block_line, line_no, substr(name, 1, 1) AS name, requirement FROM {fields}"""


@query(
    "doc04_same_block_definitions",
    FIELDS + """, r AS (""" + _BLOCK_ROWS.replace("{fields}", "fields") + """),
d AS (SELECT page, block, block_line, string_agg(concat_ws(':', name, requirement), ',' ORDER BY line_no) AS d FROM r GROUP BY ALL)
SELECT page, block, count(*) AS definitions, min(d) = max(d) AS same FROM d GROUP BY ALL HAVING count(*) > 1""",
)
def same_block_definitions(spark, sf):
    return op.same_block_definitions(spark.sql(_BLOCK_ROWS, fields=_fields(spark, sf)))


@query(
    "doc05_normalise_lines",
    LINES + """SELECT page, line_no, CASE WHEN starts_with(t, '*') AND length(t) >= 4 THEN
  replace(replace(replace(replace(replace(left(t, 4) || regexp_replace(substr(t, 5), ' \\s+', ' ', 'g'), '(Optional) -', '- (Optional)'), '(Required) -', '- (Required)'), '`-', '` -'), '- (optional)', '- (Optional)'), '- (required)', '- (Required)')
  ELSE t END AS text FROM (SELECT page, line_no, regexp_replace(text, '[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]', ' ', 'g') AS t FROM page_lines)""",
)
def normalise_lines(spark, sf):
    return op.normalise_lines(_lines(spark, sf))


_LOOSE_HEADS = """SELECT page, line_no, CASE line_no % 4 WHEN 0 THEN '* `' || word || '` supports the following:' WHEN 1 THEN '`' || word || '` block supports:' WHEN 2 THEN 'supports `' || word || '` and more:' ELSE text END AS text FROM {page_lines}"""


@query(
    "doc05_fix_block_heads",
    LINES.rstrip() + ", l AS (" + _LOOSE_HEADS.replace("{page_lines}", "page_lines") + f"""),
h AS (SELECT * FROM l WHERE NOT regexp_matches(text, {q(px.BLOCK_HEAD)}) AND (regexp_matches(text, {q(px.BLOCK_HEAD_TRY)}) OR (contains(text, 'supports') AND suffix(text, ':')))),
s AS (SELECT *, CASE WHEN starts_with(text, '*') THEN trim(substr(text, 2)) ELSE text END AS t FROM h), a AS (SELECT *, CASE WHEN starts_with(t, '`') THEN 'The ' || t ELSE t END AS u FROM s)
SELECT page, line_no, text, CASE WHEN contains(u, 'block') THEN u ELSE regexp_replace(u, '^(.+`)([^`]*)$', '\\1 block\\2') END AS fixed FROM a""",
)
def fix_block_heads(spark, sf):
    return op.fix_block_heads(spark.sql(_LOOSE_HEADS, page_lines=load(spark, sf, "page_lines")))


@query(
    "doc06_attach_blocks",
    FIELDS.rstrip() + "," + HEADS + """,
b AS (SELECT page, unnest(string_split(names, ',')) AS block, line_no FROM heads WHERE is_head), b1 AS (SELECT page, block, min(line_no) AS block_line FROM b GROUP BY ALL)
SELECT f.page, f.line_no, f.name, f.block_type, t.block_line,
  CASE WHEN t.block_line IS NULL THEN CASE WHEN n.block_line IS NOT NULL THEN 'misspell of name from `' || f.name || '` to `' || f.block_type || '`'
       ELSE '`' || f.name || '` block is not defined in the documentation' END END AS error
FROM fields f LEFT JOIN b1 t ON t.page = f.page AND t.block = f.block_type LEFT JOIN b1 n ON n.page = f.page AND n.block = f.name WHERE f.is_block""",
)
def attach_blocks(spark, sf):
    heads = op.block_heads(_lines(spark, sf)).where("is_head")
    blocks = heads.select("page", F.explode("names").alias("block"), F.col("line_no").alias("block_line"))
    return op.attach_blocks(_fields(spark, sf).where("is_block"), blocks)


@query(
    "doc07_merge_args_attrs",
    FIELDS + """, a AS (SELECT page, name, min(line_no) AS l FROM fields WHERE requirement <> '' GROUP BY ALL), t AS (SELECT page, name, min(line_no) AS l FROM fields WHERE requirement = '' GROUP BY ALL)
SELECT page, name, CASE WHEN a.l IS NOT NULL THEN 'argument' ELSE 'attribute' END AS side, coalesce(a.l, t.l) AS line_no, CASE WHEN a.l IS NOT NULL THEN t.l END AS same_name_attribute FROM a FULL JOIN t USING (page, name)""",
)
def merge_args_attrs(spark, sf):
    fields = _fields(spark, sf)

    def first(rows):
        return rows.groupBy("page", "name").agg(F.min("line_no").alias("line_no"))

    return op.merge_args_attrs(first(fields.where("requirement <> ''")), first(fields.where("requirement = ''")))


# Schema side: the words of a page two lines further down; page side: its fields.
_SCHEMA_NAMES = "SELECT page AS resource, CASE WHEN line_no % 9 NOT IN (0, 4, 8) THEN word || CAST(line_no % 7 AS STRING) WHEN line_no % 2 = 0 THEN word ELSE 'deep.' || word END AS name FROM {page_lines}"
CROSS = FIELDS + ", sch AS (SELECT DISTINCT * FROM (" + _SCHEMA_NAMES.replace("{page_lines}", "page_lines") + """)),
doc AS (SELECT DISTINCT page AS resource, name FROM fields),
misses AS (SELECT resource, name, CASE WHEN doc.name IS NULL THEN 'miss_in_doc' ELSE 'miss_in_code' END AS miss
  FROM (SELECT *, name AS k FROM sch) sch FULL JOIN (SELECT *, name AS k FROM doc) doc USING (resource, name) WHERE sch.k IS NULL OR doc.k IS NULL)
""".replace("CASE WHEN doc.name IS NULL", "CASE WHEN doc.k IS NULL")


def _misses(spark, sf):
    schema = spark.sql(_SCHEMA_NAMES, page_lines=load(spark, sf, "page_lines"))
    return op.cross_check(schema, _fields(spark, sf).select(F.col("page").alias("resource"), "name"))


@query("doc08_cross_check", CROSS + "SELECT * FROM misses")
def cross_check(spark, sf):
    return _misses(spark, sf)


@query(
    "doc09_merge_misspellings",
    CROSS.rstrip() + """,
m AS (SELECT *, split_part(name, '.', -1) AS leaf FROM misses),
near AS (SELECT c.resource, c.name, d.name AS correct_name, c.leaf AS l, d.leaf AS r FROM m c JOIN m d USING (resource)
  WHERE c.miss = 'miss_in_code' AND d.miss = 'miss_in_doc' AND levenshtein(c.leaf, d.leaf) <= 3)
SELECT resource, name, CASE WHEN l = r AND contains(correct_name, '.') THEN 'wrong_place' ELSE 'misspelling' END AS miss, correct_name FROM near
UNION ALL SELECT resource, name, miss, NULL FROM m WHERE miss = 'miss_in_code' AND NOT EXISTS (SELECT 1 FROM near n WHERE n.resource = m.resource AND n.name = m.name)
UNION ALL SELECT resource, name, miss, NULL FROM m WHERE miss = 'miss_in_doc' AND NOT EXISTS (SELECT 1 FROM near n WHERE n.resource = m.resource AND n.correct_name = m.name)""",
)
def merge_misspellings(spark, sf):
    return op.merge_misspellings(_misses(spark, sf))



@query(
    "doc10_possible_values_diff",
    """WITH w AS (SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS want, list_sort(list_distinct(list(lower(o_orderpriority)) FILTER (o_orderstatus = 'F'))) AS got FROM orders GROUP BY 1),
g AS (SELECT k, want, list_append(coalesce(got, []), 'extra') AS got FROM w)
SELECT k, array_to_string(list_filter(want, lambda v: NOT list_contains(got, lower(v))), ',') AS missed,
       array_to_string(list_filter(got, lambda v: NOT list_contains(list_transform(want, lambda x: lower(x)), lower(v))), ',') AS spare FROM g""",
)
def possible_values_diff(spark, sf):
    grouped = load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.sort_array(F.collect_set("o_orderpriority")).alias("want"),
        F.sort_array(F.collect_set(F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority")))).alias("got"),
    )
    rows = grouped.withColumn("got", F.concat("got", F.array(F.lit("extra"))))
    out = op.possible_values_diff(rows, ignore_case=True)
    return out.select("k", F.array_join("missed", ",").alias("missed"), F.array_join("spare", ",").alias("spare"))


# A documented field beside what the schema says of it.
_PAIRS = """SELECT page, line_no, text, name, requirement, default_value AS page_default, force_new AS page_force_new,
  line_no % 4 = 0 AS required, line_no % 4 = 1 AS optional, line_no % 4 = 2 AS computed,
  CASE WHEN line_no % 3 = 0 THEN 'One' WHEN line_no % 3 = 1 THEN 'Two' END AS schema_default, line_no % 5 < 2 AS schema_force_new FROM {fields}"""
PAIRS = FIELDS + ", pairs AS (" + _PAIRS.replace("{fields}", "fields") + """),
req AS (SELECT *, CASE WHEN required AND requirement <> 'required' THEN 'should_be_required' WHEN optional AND requirement <> 'optional' THEN 'should_be_optional'
   WHEN computed AND requirement <> '' THEN 'should_be_computed' END AS miss FROM pairs)
"""


def _pairs(spark, sf):
    return spark.sql(_PAIRS, fields=_fields(spark, sf))


@query(
    "doc11_required_diff",
    PAIRS + """SELECT page, line_no, name, miss, CASE miss
  WHEN 'should_be_computed' THEN regexp_replace(regexp_replace(text, ' \\(Required\\) ', ' '), ' \\(Optional\\) ', ' ')
  WHEN 'should_be_required' THEN CASE WHEN contains(text, '(Optional)') THEN regexp_replace(text, '\\(Optional\\)', '(Required)') ELSE regexp_replace(text, ' - ', ' - (Required) ') END
  ELSE CASE WHEN contains(text, '(Required)') THEN regexp_replace(text, '\\(Required\\)', '(Optional)') ELSE regexp_replace(text, ' - ', ' - (Optional) ') END END AS fixed
FROM req WHERE miss IS NOT NULL""",
)
def required_diff(spark, sf):
    found = op.required_diff(_pairs(spark, sf))
    return found.select("page", "line_no", "name", "miss", px.fix_required(F.col("text"), F.col("miss")).alias("fixed"))


@query(
    "doc12_default_diff",
    PAIRS + f"""SELECT page, line_no, name, coalesce(schema_default, '') AS default_value, page_default AS current_value,
  CASE WHEN regexp_matches(text, {q(px.DEFAULT)}) THEN
     CASE WHEN schema_default IS NULL THEN replace(text, regexp_extract(text, {q(px.DEFAULT)}, 0), left(regexp_extract(text, {q(px.DEFAULT)}, 0), 1))
          ELSE replace(text, 'Defaults to `' || page_default || '`', 'Defaults to `' || schema_default || '`') END
     WHEN schema_default IS NOT NULL THEN trim(text) || ' Defaults to `' || schema_default || '`.' ELSE text END AS fixed
FROM pairs WHERE coalesce(schema_default, '') <> page_default""",
)
def default_diff(spark, sf):
    found = op.default_diff(_pairs(spark, sf))
    return found.select(
        "page", "line_no", "name", "default_value", "current_value",
        px.fix_default(F.col("text"), F.col("default_value")).alias("fixed"),
    )


@query(
    "doc13_force_new_diff",
    PAIRS + f"""SELECT page, line_no, name, CASE WHEN schema_force_new THEN 'should_be_force_new' ELSE 'should_be_not_force_new' END AS miss,
  CASE WHEN schema_force_new THEN CASE WHEN suffix(rtrim(text), ',') THEN left(rtrim(text), length(rtrim(text)) - 1) || '.' WHEN suffix(rtrim(text), '.') THEN rtrim(text) ELSE rtrim(text) || '.' END
       || ' Changing this forces a new resource to be created.' ELSE regexp_replace(text, {q(px.FORCE_NEW)}, '', 'g') END AS fixed
FROM pairs WHERE schema_force_new <> page_force_new""",
)
def force_new_diff(spark, sf):
    found = op.force_new_diff(_pairs(spark, sf))
    return found.select(
        "page", "line_no", "name", "miss", px.fix_force_new(F.col("text"), F.col("miss") == "should_be_force_new").alias("fixed")
    )


TIMEOUTS = LINES.rstrip() + """,
t0 AS (SELECT page, line_no, regexp_extract(text, '([0-9]+) (hours?|minutes?)', 1) AS n, regexp_extract(text, '([0-9]+) (hours?|minutes?)', 2) AS u,
   CASE WHEN contains(text, '`create`') THEN 'create' WHEN contains(text, '`update`') THEN 'update' WHEN contains(text, '`read`') THEN 'read' WHEN contains(text, '`delete`') THEN 'delete' END AS action FROM page_lines),
touts AS (SELECT page, action, max(line_no) AS line_no, arg_max(CAST(n AS BIGINT) * CASE WHEN u LIKE 'hour%' THEN 3600 ELSE 60 END, line_no) AS seconds FROM t0 WHERE action IS NOT NULL AND n <> '' GROUP BY ALL)
"""
_WANTED = """SELECT 'page_' || CAST(doc_id AS STRING) AS page, split_part('create,read,update,delete', ',', CAST(1 + doc_id % 3 AS INT)) AS action, (1 + doc_id % 50) * 600 AS want FROM {documents}"""


@query(
    "doc14_timeout_diff",
    TIMEOUTS + ", w AS (" + _WANTED.replace("{documents}", "documents") + """)
SELECT page, action, want, line_no, seconds AS got, '* `' || action || '` - (Defaults to ' || CASE WHEN want > 3600 AND want % 3600 = 0 THEN (want // 3600) || ' hours' WHEN want // 60 > 1 THEN (want // 60) || ' minutes' ELSE (want // 60) || ' minute' END
  || ') Used when ' || CASE action WHEN 'create' THEN 'creating' WHEN 'read' THEN 'retrieving' WHEN 'update' THEN 'updating' ELSE 'deleting' END || ' the ' || page || '.' AS expected
FROM w LEFT JOIN touts USING (page, action) WHERE seconds IS NULL OR seconds <> want""",
)
def timeout_diff(spark, sf):
    wanted = spark.sql(_WANTED, documents=load(spark, sf, "documents"))
    return op.timeout_diff(wanted, op.page_timeouts(_lines(spark, sf)))


@query(
    "doc15_format_errors",
    LINES + f"""SELECT page, line_no, text, error, CASE error WHEN 'starred_note' THEN substr(text, 3) WHEN 'incorrect_block_mark' THEN regexp_replace(text, {q(px.INCORRECT_MARK)}, '', 'g') WHEN 'empty_marker' THEN '' ELSE text END AS fixed
FROM (SELECT page, line_no, text, CASE WHEN regexp_matches(text, {q(px.FIELD)}) AND regexp_matches(text, {q(px.INCORRECT_MARK)}) AND NOT (regexp_matches(text, {q(px.BLOCK_FIELD)}) OR contains(text, 'A block to')) THEN 'incorrect_block_mark'
   WHEN trim(text) = '*' THEN 'empty_marker' WHEN starts_with(text, '* ~>') THEN 'starred_note' WHEN NOT regexp_matches(text, {q(px.FIELD)}) THEN 'format' END AS error
  FROM (SELECT page, line_no, CASE line_no % 11 WHEN 1 THEN '* ' WHEN 2 THEN '* ~> ' || word WHEN 3 THEN '* ' || word WHEN 4 THEN '* `' || word || '` - x blocks as defined below.' ELSE text END AS text FROM page_lines)
  WHERE starts_with(text, '*')) WHERE error IS NOT NULL""",
)
def format_errors(spark, sf):
    lines = load(spark, sf, "page_lines").selectExpr(
        "page",
        "line_no",
        "CASE line_no % 11 WHEN 1 THEN '* ' WHEN 2 THEN '* ~> ' || word WHEN 3 THEN '* ' || word WHEN 4 THEN '* `' || word || '` - x blocks as defined below.' ELSE text END AS text",
    )
    return op.format_errors(lines)


@query(
    "doc16_duplicate_fields",
    FIELDS + """SELECT page, 'top' AS block, name, max(line_no) AS line_no, count(*) AS times, 'duplicate field `' || name || '` in block top' AS message FROM fields GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_fields(spark, sf):
    return op.duplicate_fields(_fields(spark, sf).withColumn("block", F.lit("top")))


_BLOCK_EDGES = """SELECT 'page_' || CAST(c_nationkey AS STRING) AS page, 'b' || CAST(c_custkey % 23 AS STRING) AS block, 'b' || CAST((c_custkey * 7 + c_nationkey) % 29 AS STRING) AS child FROM {customer} WHERE c_mktsegment <> 'MACHINERY'"""


@query(
    "doc17_circular_blocks",
    "WITH RECURSIVE e AS (SELECT DISTINCT * FROM (" + _BLOCK_EDGES.replace("{customer}", "customer") + """)),
r AS (SELECT page, block, child AS node FROM e UNION SELECT r.page, r.block, e.child FROM r JOIN e ON e.page = r.page AND e.block = r.node)
SELECT page, min(block) AS block FROM r WHERE node = block GROUP BY page""",
)
def circular_blocks(spark, sf):
    return op.circular_blocks(spark.sql(_BLOCK_EDGES, customer=load(spark, sf, "customer")))


@query(
    "doc18_missing_pages",
    """SELECT 'c_' || c_custkey AS resource, 'c_' || c_custkey || ' has no document' AS message, c_acctbal < 0 AS skip FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def missing_pages(spark, sf):
    resources = load(spark, sf, "customer").selectExpr("'c_' || c_custkey AS resource", "c_acctbal < 0 AS deprecated")
    pages = load(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("'c_' || o_custkey AS resource")
    return op.missing_pages(resources, pages)


_SKIPS = """SELECT DISTINCT entry FROM (SELECT CASE o_custkey % 4 WHEN 0 THEN resource WHEN 1 THEN resource || '.sku_name' WHEN 2 THEN 'all.level' ELSE resource || '.*' END AS entry
 FROM (SELECT o_custkey, 'res_' || CAST(o_orderkey AS STRING) AS resource FROM {orders} WHERE o_orderpriority = '1-URGENT') x) y"""


@query(
    "doc19_skip_rules",
    cte("properties").rstrip() + ", s AS (" + _SKIPS.replace("{orders}", "orders") + """)
SELECT resource, path FROM properties p WHERE NOT EXISTS (SELECT 1 FROM s WHERE entry IN (p.resource, p.resource || '.' || p.path, p.resource || '.*', 'all.' || p.name))
 AND NOT regexp_matches(resource || '.' || path, 'res_.*7\\.zone_id')""",
)
def skip_rules(spark, sf):
    entries = spark.sql(_SKIPS, orders=load(spark, sf, "orders"))
    findings = load(spark, sf, "properties").select("resource", "path")
    return op.skip_rules(findings, entries, [r"res_.*7\.zone_id"])


_CLASSED = """SELECT 'res_' || CAST(user_id AS STRING) AS resource, split_part('cross_check,possible_values,required,default,timeout,force_new', ',', CAST(1 + event_id % 6 AS INT)) AS class,
 event_type = 'view' AS skip FROM {events}"""


@query(
    "doc20_lint_summary",
    "WITH f AS (" + _CLASSED.replace("{events}", "events") + ") SELECT count(DISTINCT resource) AS resources, count(*) AS issues, count(*) FILTER (skip) AS skipped, "
    + ", ".join(f"count(*) FILTER (NOT skip AND class = '{c}') AS {c if c != 'default' else chr(34) + c + chr(34)}" for c in op.CLASSES)
    + ", bool_or(NOT skip) AS has_diff FROM f",
)
def lint_summary(spark, sf):
    return op.lint_summary(spark.sql(_CLASSED, events=load(spark, sf, "events")))


@query(
    "doc21_sort_possible_values",
    """WITH v AS (SELECT user_id AS k, list_distinct(list(dayname(ts))) AS vals FROM events GROUP BY 1 UNION ALL SELECT 100000 + o_custkey, list_distinct(list(CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) || 'x' ELSE o_orderpriority END)) FROM orders GROUP BY o_custkey),
s AS (SELECT k, CASE WHEN k < 100000 THEN list_filter(['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'], lambda d: list_contains(vals, d))
   ELSE list_transform(list_sort(list_transform(vals, lambda x: lower(x) || chr(1) || x)), lambda x: split_part(x, chr(1), 2)) END AS vals FROM v)
SELECT k, CASE WHEN len(vals) = 1 THEN '`' || vals[1] || '`' ELSE '`' || array_to_string(vals[:-2], '`, `') || '` and `' || vals[-1] || '`' END AS shown FROM s""",
)
def sort_possible_values(spark, sf):
    days = load(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(
        F.collect_set(F.date_format("ts", "EEEE")).alias("vals")
    )
    other = load(spark, sf, "orders").groupBy((F.col("o_custkey") + 100000).alias("k")).agg(
        F.collect_set(F.expr("CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) || 'x' ELSE o_orderpriority END")).alias("vals")
    )
    return days.unionByName(other).select("k", px.values_text(F.col("vals")).alias("shown"))


def _stopped(text: str) -> str:
    """SQL of a line that ends with a full stop."""
    return f"CASE WHEN regexp_replace({text}, ' $', '') <> '' AND NOT regexp_matches(regexp_replace({text}, ' $', ''), '[.?]$') THEN regexp_replace({text}, ' $', '') || '.' ELSE {text} END"


_VALUE = "CASE WHEN want > 3600 AND want % 3600 = 0 THEN (want // 3600) || ' hours' WHEN want // 60 > 1 THEN (want // 60) || ' minutes' ELSE (want // 60) || ' minute' END"


@query(
    "doc22_fix_lines",
    PAIRS.rstrip() + ", " + TIMEOUTS.removeprefix(LINES.rstrip()).strip().removeprefix(",").strip() + ", w AS (" + _WANTED.replace("{documents}", "documents") + f"""),
g0 AS (SELECT page, line_no, {_VALUE} AS t FROM w JOIN touts USING (page, action) WHERE seconds <> want),
g1 AS (SELECT l.page, l.line_no, CASE WHEN t IS NULL THEN l.text ELSE regexp_replace(l.text, '[0-9]+ (hours?|minutes?)', t) END AS x FROM page_lines l LEFT JOIN g0 USING (page, line_no)),
g2 AS (SELECT g1.*, r.name, r.miss, r.schema_default, r.page_default, r.page_force_new, r.schema_force_new, CASE WHEN miss IS NULL THEN x
   WHEN miss = 'should_be_computed' THEN regexp_replace(regexp_replace(x, ' \\(Required\\) ', ' '), ' \\(Optional\\) ', ' ')
   WHEN miss = 'should_be_required' THEN CASE WHEN contains(x, '(Optional)') THEN regexp_replace(x, '\\(Optional\\)', '(Required)') ELSE regexp_replace(x, ' - ', ' - (Required) ') END
   ELSE CASE WHEN contains(x, '(Required)') THEN regexp_replace(x, '\\(Required\\)', '(Optional)') ELSE regexp_replace(x, ' - ', ' - (Optional) ') END END AS y FROM g1 LEFT JOIN req r USING (page, line_no)),
g3 AS (SELECT * REPLACE (CASE WHEN miss IS NULL THEN y ELSE {_stopped('y')} END AS y) FROM g2),
g4 AS (SELECT *, name IS NOT NULL AND coalesce(schema_default, '') <> page_default AS dd,
   CASE WHEN regexp_matches(y, {q(px.DEFAULT)}) THEN CASE WHEN schema_default IS NULL THEN replace(y, regexp_extract(y, {q(px.DEFAULT)}, 0), left(regexp_extract(y, {q(px.DEFAULT)}, 0), 1))
          ELSE replace(y, regexp_extract(y, {q(px.DEFAULT)}, 1), '`' || schema_default || '`') END
     WHEN schema_default IS NOT NULL THEN trim(y) || ' Defaults to `' || schema_default || '`.' ELSE y END AS z FROM g3),
g5 AS (SELECT *, CASE WHEN dd THEN {_stopped('z')} ELSE y END AS u FROM g4),
g6 AS (SELECT *, CASE WHEN page_force_new AND NOT schema_force_new THEN regexp_replace(u, {q(px.FORCE_NEW)}, '', 'g')
   ELSE CASE WHEN suffix(rtrim(u), ',') THEN left(rtrim(u), length(rtrim(u)) - 1) || '.' WHEN suffix(rtrim(u), '.') THEN rtrim(u) ELSE rtrim(u) || '.' END || ' Changing this forces a new resource to be created.' END AS v FROM g5),
g7 AS (SELECT *, CASE WHEN name IS NOT NULL AND page_force_new <> schema_force_new THEN {_stopped('v')} ELSE u END AS m FROM g6),
g8 AS (SELECT *, replace(m, '`' || name || '`', '`' || name || '_id`') AS n FROM g7)
SELECT page, line_no, CASE WHEN name IS NOT NULL AND line_no % 7 = 0 THEN {_stopped('n')} ELSE m END AS text FROM g8""",
)
def fix_lines(spark, sf):
    """All five kinds of fix; a timeout is mended first."""
    pairs, lines = _pairs(spark, sf), _lines(spark, sf)
    wanted = spark.sql(_WANTED, documents=load(spark, sf, "documents"))
    timeouts = op.timeout_diff(wanted, op.page_timeouts(lines)).where("line_no IS NOT NULL")
    fixes = [
        timeouts.selectExpr("page", "line_no", "0 AS seq", "'timeout' AS kind", "CAST(want AS STRING) AS arg", "'' AS arg2"),
        # the kinds of one pair, in one pass over the pairs
        pairs.select("page", "line_no", F.inline(op.pair_fixes(F.when(F.col("line_no") % 7 == 0, F.concat("name", F.lit("_id")))))),
    ]
    return op.fix_lines(lines, fixes[0].unionByName(fixes[1]))


@query(
    "doc23_note_format",
    LINES + """SELECT * FROM (SELECT page, line_no, text, CASE WHEN lvl = '>' THEN '->' ELSE lvl END || ' **Note:** '
   || regexp_replace(regexp_replace(regexp_replace(rest, '^\\s+|\\s+$', '', 'g'), '(?i)^(?:note)?:?', ''), '^\\s+|\\s+$', '', 'g') AS expected
 FROM (SELECT *, regexp_extract(text, '^[\\s\\t]*(>|->|~>|!>)(.*)', 1) AS lvl,
   CASE WHEN regexp_matches(text, '^[\\s\\t]*(>|->|~>|!>)[\\s|\\t]*(\\*\\*[\\w\\s:]*\\*\\*)(.*)') THEN regexp_extract(text, '^[\\s\\t]*(>|->|~>|!>)[\\s|\\t]*(\\*\\*[\\w\\s:]*\\*\\*)(.*)', 3)
        ELSE regexp_extract(text, '^[\\s\\t]*(>|->|~>|!>)(.*)', 2) END AS rest FROM page_lines WHERE regexp_matches(text, '^[\\s\\t]*(>|->|~>|!>)')))
WHERE expected <> text""",
)
def note_format(spark, sf):
    return op.note_format(_lines(spark, sf))


@query(
    "doc24_timeouts_in_crud_order",
    LINES + """, t AS (SELECT page, line_no, text, list_position(['create', 'read', 'update', 'delete'], lower(regexp_extract(text, '`(\\w*)`', 1))) AS rank
   FROM (SELECT page, line_no, regexp_replace(text, '`\\w+`', '`' || split_part('delete,create,update,read', ',', CAST(1 + line_no % 4 AS INT)) || '`') AS text FROM page_lines
         WHERE regexp_matches(text, '(?i)^\\* `(read|create|update|delete)` - \\(Defaults to'))),
f AS (SELECT page, rank, max(line_no) AS line_no, arg_max(text, line_no) AS text FROM t WHERE rank > 0 GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line_no) AS by_line, row_number() OVER (PARTITION BY page ORDER BY rank) AS by_rank FROM f)
SELECT a.page, a.line_no, a.text, b.text AS expected FROM n a JOIN n b ON a.page = b.page AND a.by_line = b.by_rank WHERE a.text <> b.text""",
)
def timeouts_in_crud_order(spark, sf):
    lines = _lines(spark, sf).where(r"text RLIKE '(?i)^\\* `(read|create|update|delete)` - \\(Defaults to'")
    moved = lines.withColumn(
        "text",
        F.regexp_replace(
            F.col("text"), F.lit(r"`\w+`"),
            F.expr("'`' || split_part('delete,create,update,read', ',', CAST(1 + line_no % 4 AS INT)) || '`'"),
        ),
    )
    # one action a line: only the first code word was renamed above, as in the source pattern
    return op.timeouts_in_crud_order(moved)


@query(
    "doc24_expected_timeout_lines",
    """SELECT user_id AS page, a AS action, '* `' || a || '` - (Defaults to ' || CASE WHEN m % 60 = 0 THEN (m // 60) || CASE WHEN m // 60 > 1 THEN ' hours' ELSE ' hour' END ELSE m || CASE WHEN m > 1 THEN ' minutes' ELSE ' minute' END END
  || ') Used when ' || CASE a WHEN 'create' THEN 'creating' WHEN 'read' THEN 'retrieving' WHEN 'update' THEN 'updating' ELSE 'deleting' END || ' the ' || event_type AS line
FROM (SELECT user_id, event_type, split_part('create,read,update,delete', ',', CAST(1 + event_id % 4 AS INT)) AS a, 1 + event_id % 240 AS m FROM events)""",
)
def expected_timeout_lines(spark, sf):
    timeouts = load(spark, sf, "events").selectExpr(
        "user_id AS page", "split_part('create,read,update,delete', ',', CAST(1 + event_id % 4 AS INT)) AS action",
        "1 + event_id % 240 AS minutes", "event_type AS subject",
    )
    return op.expected_timeout_lines(timeouts)


@query(
    "doc25_heading_rules",
    SECTIONED + """SELECT page, line_no, CASE section_type WHEN 'title' THEN 'S003' WHEN 'arguments' THEN 'S004' ELSE 'S005' END AS rule, heading, expected
FROM (SELECT *, CASE section_type WHEN 'title' THEN CASE WHEN CAST(split_part(page, '_', 2) AS INT) % 2 = 0 THEN 'Data Source: sample_' || page ELSE 'sample_' || page END
  WHEN 'arguments' THEN 'Arguments Reference' WHEN 'attributes' THEN 'Attributes Reference' END AS expected FROM sections) WHERE expected <> heading""",
)
def heading_rules(spark, sf):
    names = load(spark, sf, "documents").selectExpr(
        "'page_' || doc_id AS page", "'sample_page_' || doc_id AS name",
        "CASE WHEN doc_id % 2 = 0 THEN 'data source' ELSE 'resource' END AS page_type",
    )
    return op.heading_rules(_sections(spark, sf), names)


@query(
    "doc26_api_section",
    """SELECT l_partkey AS resource, api, '* `' || api || '` - ' || string_agg(DISTINCT v, ', ' ORDER BY v) AS line
FROM (SELECT l_partkey, 'Sample.S' || (l_suppkey % 10) AS api, '202' || l_linenumber || '-01-01' AS v FROM lineitem) GROUP BY l_partkey, api""",
)
def api_section(spark, sf):
    uses = load(spark, sf, "lineitem").selectExpr(
        "l_partkey AS resource", "'Sample.S' || (l_suppkey % 10) AS api", "'202' || l_linenumber || '-01-01' AS version"
    )
    return op.api_section(uses)


@query(
    "doc27_rule_exceptions",
    cte("findings") + """SELECT seq, page_type, name, rule FROM (SELECT seq, CASE seq % 3 WHEN 0 THEN 'data source' WHEN 1 THEN 'ephemeral' ELSE 'resource' END AS page_type,
   CASE seq % 3 WHEN 0 THEN 'd.' WHEN 1 THEN 'e.' ELSE 'r.' END || path AS target, path AS name, rule_id AS rule FROM findings) f
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE f.target = CASE WHEN p_size % 2 = 0 THEN 'd.prop_' ELSE 'r.prop_' END || p_size AND f.rule = 'SL00' || (1 + p_partkey % 9))""",
)
def rule_exceptions(spark, sf):
    findings = load(spark, sf, "findings").selectExpr(
        "seq", "CASE seq % 3 WHEN 0 THEN 'data source' WHEN 1 THEN 'ephemeral' ELSE 'resource' END AS page_type", "path AS name", "rule_id AS rule"
    )
    exceptions = load(spark, sf, "part").selectExpr(
        "CASE WHEN p_size % 2 = 0 THEN 'd.prop_' ELSE 'r.prop_' END || p_size AS target", "'SL00' || (1 + p_partkey % 9) AS rule"
    )
    return op.rule_exceptions(findings, exceptions)


_ENTRIES = """SELECT user_id AS log, event_id AS line_no, CASE event_type WHEN 'click' THEN 'FEATURES' WHEN 'view' THEN 'ENHANCEMENTS' WHEN 'error' THEN 'BUG FIXES' ELSE 'BREAKING CHANGES' END AS section,
 CASE event_id % 5 WHEN 0 THEN '* provider: ' WHEN 1 THEN '* **New Data Source**: ' WHEN 2 THEN '* dependencies: ' WHEN 3 THEN '* Data Source: ' ELSE '* thing ' END || CAST(event_id AS STRING) AS text FROM {events}"""


@query(
    "doc28_changelog_group",
    "WITH e AS (" + _ENTRIES.replace("{events}", "events") + """),
k AS (SELECT *, CASE WHEN section = 'FEATURES' AND contains(text, 'New Data Source') THEN 'data_sources' WHEN section = 'ENHANCEMENTS' AND contains(text, '* dependencies') THEN 'dependencies'
  WHEN section IN ('ENHANCEMENTS', 'BUG FIXES') AND contains(text, '* provider') THEN 'provider' WHEN section IN ('ENHANCEMENTS', 'BUG FIXES') AND contains(text, 'Data Source:') THEN 'data_sources' ELSE 'general' END AS kind FROM e)
SELECT log, line_no, section, text, kind, CAST(row_number() OVER (PARTITION BY log ORDER BY list_position(['BREAKING CHANGES', 'FEATURES', 'ENHANCEMENTS', 'BUG FIXES'], section),
  CASE kind WHEN 'general' THEN 9 WHEN 'dependencies' THEN 0 WHEN 'provider' THEN 1 ELSE 2 END, line_no) AS INT) AS place FROM k""",
)
def changelog_group(spark, sf):
    return op.changelog_group(spark.sql(_ENTRIES, events=load(spark, sf, "events")), "log")


_NEW = """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '[BUG] x' WHEN 1 THEN '[FEATURE] y' WHEN 2 THEN '[ENHANCEMENT] z' ELSE 'oops' END AS entry FROM {documents}"""


@query(
    "doc28_place_new_entries",
    cte("changelog_lines") + ", n AS (" + _NEW.replace("{documents}", "documents") + """),
h AS (SELECT doc_id, regexp_extract(text, '^(BUG FIXES|ENHANCEMENTS|FEATURES)', 1) AS header, min(line_no) AS after_line FROM changelog_lines WHERE regexp_matches(text, '^(BUG FIXES|ENHANCEMENTS|FEATURES)') GROUP BY ALL),
m AS (SELECT *, CASE split_part(entry, ' ', 1) WHEN '[BUG]' THEN 'BUG FIXES' WHEN '[FEATURE]' THEN 'FEATURES' WHEN '[ENHANCEMENT]' THEN 'ENHANCEMENTS' END AS header FROM n)
SELECT m.doc_id, m.header, m.entry, h.after_line, CASE WHEN m.header IS NULL THEN 'entry has no known mark' WHEN h.after_line IS NULL THEN 'header not found' END AS error FROM m LEFT JOIN h USING (doc_id, header)""",
)
def place_new_entries(spark, sf):
    entries = spark.sql(_NEW, documents=load(spark, sf, "documents"))
    return op.place_new_entries(load(spark, sf, "changelog_lines"), entries, "doc_id")
