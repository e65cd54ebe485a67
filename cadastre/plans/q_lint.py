"""Schema lint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.operators import lint as op
from cadastre.plans.inputs import cte, load
from cadastre.plans.registry import query

CONTEXT = cte("properties").rstrip() + """,
kids AS (SELECT kind, resource, parent_path AS path, count(*) AS n, min(name) AS child, min(type) AS child_type, bool_or(opaque) AS child_opaque,
   bool_or(NOT opaque AND (required OR at_least_one_of OR exactly_one_of)) AS constrained FROM properties GROUP BY ALL),
p AS (SELECT p.*, coalesce(k.n, 0) AS n_children, child, child_type, child_opaque, constrained,
   count(*) FILTER (starts_with(name, 'sku_')) OVER (PARTITION BY kind, resource, parent_path) AS n_sku,
   NOT opaque AND (optional OR required) AS settable, regexp_extract(name, '([^_]*)$', 1) AS tail
  FROM properties p LEFT JOIN kids k USING (kind, resource, path))
"""
_UNITS = ", ".join(f"'{u}'" for u in op.UNIT_SUFFIXES)
_ABBREV = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in op.ABBREVIATIONS.items()) + "}"
_SPELT = f"array_to_string(list_transform(string_split(name, '_'), lambda w: coalesce({_ABBREV}[w], w)), '_')"
_IN = "left(name, length(name) - length(tail)) || 'in_' || tail"
_STEM = "regexp_replace(name, '(_properties|_config|_profile)$', '')"
_ACCEPTED = """list_filter(['None', 'Off', 'Default', 'Disabled'], lambda v: len(list_filter(string_split(enum_values, ','),
   lambda e: CASE WHEN enum_literal THEN e = v ELSE suffix(e, v) END)) > 0)"""


def _rename(preferred):
    return f"'rename \"' || name || '\" to \"' || {preferred} || '\"'"


# rule -> condition, message, fix, new name
RULE_SQL = {
    "SL001": ("NOT opaque AND coalesce(description, '') = ''", "'property \"' || path || '\" is missing a description'", "NULL", "NULL"),
    "SL002": (
        "NOT opaque AND max_items = 1 AND n_children = 1",
        "'block \"' || path || '\" has a single nested property \"' || child || '\" (MaxItems 1); consider flattening it'",
        "CASE WHEN child = 'enabled' AND child_type = 'TypeBool' AND NOT child_opaque THEN 'replace the block \"' || path || '\" with a single top-level boolean \"' || name || '_enabled\"' ELSE 'flatten \"' || path || '\" into a single top-level \"' || name || '_' || child || '\" property' END",
        "NULL",
    ),
    "SL003": (
        "NOT opaque AND type NOT IN ('TypeList', 'TypeSet') AND (min_items <> 0 OR max_items <> 0)",
        "'property \"' || path || '\" (' || type || ') sets MinItems/MaxItems, which only apply to TypeList/TypeSet'",
        "'remove MinItems/MaxItems from \"' || path || '\"'",
        "NULL",
    ),
    "SL004": (
        f"settable AND validate_func = 'StringInSlice' AND len({_ACCEPTED}) > 0",
        f"'property \"' || path || '\" accepts ' || array_to_string({_ACCEPTED}, ', ') || ' via validation; omit these values (leave the property unset) and normalise in Create/Read'",
        "NULL",
        "NULL",
    ),
    "SL005": (
        "settable AND validate_func IS NULL AND type IN ('TypeString', 'TypeInt', 'TypeFloat')",
        "CASE WHEN type = 'TypeString' THEN 'string property \"' || path || '\" has no validation; add a ValidateFunc (StringIsNotEmpty at minimum)' ELSE 'numeric property \"' || path || '\" has no validation; specify a valid range at minimum' END",
        "NULL",
        "NULL",
    ),
    "SL006": (
        "settable AND n_children > 0 AND NOT child_opaque AND NOT constrained",
        "'block \"' || path || '\" has no required fields and no AtLeastOneOf/ExactlyOneOf; add conditional validation so it cannot be configured empty'",
        "NULL",
        "NULL",
    ),
    "SL007": (
        "settable AND type IN ('TypeList', 'TypeSet') AND elem = 'scalar' AND max_items = 0",
        "'array property \"' || path || '\" does not set MaxItems; declare MinItems/MaxItems based on the API constraints'",
        "NULL",
        "NULL",
    ),
    "SL008": (
        "top_level AND starts_with(name, 'sku_') AND n_sku > 1",
        "'argument \"' || path || '\" uses the sku_* format; with multiple sku_* arguments, prefer a single `sku` block'",
        "NULL",
        "NULL",
    ),
    "SL009": (
        f"tail IN ({_UNITS}) AND length(name) > length(tail) + 1 AND NOT suffix(name, '_in_' || tail)",
        f"'property \"' || path || '\" uses a bare unit suffix; prefer the \"_in_' || tail || '\" naming convention (\"' || {_IN} || '\")'",
        _rename(_IN),
        _IN,
    ),
    "SL010": (f"{_SPELT} <> name", f"'property \"' || path || '\" uses an abbreviation; prefer full words (\"' || {_SPELT} || '\")'", _rename(_SPELT), _SPELT),
    "SL011": (
        "NOT opaque AND type = 'TypeBool' AND starts_with(name, 'is_') AND length(name) > 3",
        "'boolean property \"' || path || '\" has a redundant \"is_\" prefix (\"' || substr(name, 4) || '\")'",
        _rename("substr(name, 4)"),
        "substr(name, 4)",
    ),
    "SL012": (
        f"{_STEM} <> name AND {_STEM} <> ''",
        f"'property \"' || path || '\" has a redundant \"' || substr(name, length({_STEM}) + 1) || '\" suffix (\"' || {_STEM} || '\")'",
        _rename(_STEM),
        _STEM,
    ),
    "SL013": (
        "settable AND type = 'TypeString' AND suffix(name, '_id') AND (validate_func IS NULL OR validate_func = 'StringIsNotEmpty')",
        "CASE WHEN validate_func IS NULL THEN 'ID reference \"' || path || '\" has no validation; use a resource-specific ID validator (e.g. a commonids Validate...ID function) or validation.IsUUID' ELSE 'ID reference \"' || path || '\" uses weak validation (accepts arbitrary strings); use a resource-specific ID validator or validation.IsUUID' END",
        "NULL",
        "NULL",
    ),
}


def _rule_select(rule):
    condition, message, fix, new_name = RULE_SQL[rule]
    rule_name, severity, _ = op.RULES[rule]
    old_name = "NULL" if new_name == "NULL" else "name"
    return (
        f"SELECT '{rule}' AS rule_id, '{rule_name}' AS rule_name, '{severity}' AS severity, resource, kind, path, file, line, end_line, col,"
        f" {message} AS message, {fix} AS fix, {old_name} AS rename_from, {new_name} AS rename_to FROM p WHERE {condition}"
    )


def _register_rule(number, rule):
    @query(f"lnt{number:02d}_{rule.lower()}_{op.RULES[rule][0].replace('-', '_')}", CONTEXT + _rule_select(rule))
    def one_rule(spark, sf):
        return op.lint_properties(load(spark, sf, "properties"), [rule])


for _number, _rule in enumerate(op.RULES, start=1):
    _register_rule(_number, _rule)

ALL_SQL = CONTEXT.rstrip() + ",\nfound AS (" + "\nUNION ALL ".join(_rule_select(r) for r in op.RULES) + ")\n"


@query(
    "lnt_all_rules",
    ALL_SQL + "SELECT rule_id, severity, resource, path, message FROM found",
)
def all_rules(spark, sf):
    found = op.lint_properties(load(spark, sf, "properties"))
    return found.select("rule_id", "severity", "resource", "path", "message")


@query(
    "lnt14_rule_dictionaries",
    cte("properties") + f"""SELECT CASE WHEN w IN ({_UNITS}) THEN 'unit' ELSE 'abbreviation' END AS dictionary, w AS key, count(*) AS uses
 FROM (SELECT unnest(string_split(name, '_')) AS w FROM properties) WHERE w IN ({_UNITS}) GROUP BY ALL
UNION ALL SELECT 'abbreviation', w, count(*) FROM (SELECT unnest(string_split(name, '_')) AS w FROM properties) WHERE {_ABBREV}[w] IS NOT NULL GROUP BY ALL""",
)
def rule_dictionaries(spark, sf):
    words = load(spark, sf, "properties").select(F.explode(F.split("name", "_")).alias("key"))
    # counted before the join: the join then sees one row per word
    counted = words.groupBy("key").agg(F.count("*").alias("uses"))
    return counted.join(op.rule_dictionaries(spark), "key").select("dictionary", "key", "uses")


@query(
    "lnt15_select_rules",
    cte("findings") + "SELECT rule_id, count(*) AS n FROM findings WHERE rule_id IN ('SL001', 'SL003', 'SL009') GROUP BY rule_id",
)
def select_rules(spark, sf):
    chosen = op.select_rules(load(spark, sf, "findings"), only=" sl001,SL003 , sl009,SL011", disable="SL011")
    return chosen.groupBy("rule_id").agg(F.count("*").alias("n"))


_ADDED = """SELECT DISTINCT 'src_' || CAST(o_custkey % 100 AS STRING) || '.x' AS file, CAST(o_orderkey * 10 + o_custkey % 40 AS BIGINT) AS line FROM {orders}"""


@query(
    "lnt16_changed_lines_only",
    ALL_SQL.rstrip() + ", added AS (" + _ADDED.replace("{orders}", "orders") + """),
spans AS (SELECT rule_id, file, line, col, path, line + (col - 3) * 5 AS end_line FROM found)
SELECT DISTINCT s.* FROM spans s WHERE EXISTS (SELECT 1 FROM added a WHERE a.file = s.file AND a.line BETWEEN least(s.line, s.end_line) AND greatest(s.line, s.end_line))""",
)
def changed_lines_only(spark, sf):
    found = op.lint_properties(load(spark, sf, "properties"))
    spans = found.select("rule_id", "file", "line", "col", "path", (F.col("line") + (F.col("col") - 3) * 5).alias("end_line"))
    return op.changed_lines_only(spans, spark.sql(_ADDED, orders=load(spark, sf, "orders")))


@query(
    "lnt17_dedupe_findings",
    cte("findings") + "SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY rule_id, file, line, col ORDER BY seq) = 1",
)
def dedupe_findings(spark, sf):
    return op.dedupe_findings(load(spark, sf, "findings"))


@query("lnt18_sort_findings", cte("findings") + "SELECT * FROM findings ORDER BY file, line, col, rule_id")
def sort_findings(spark, sf):
    return op.sort_findings(load(spark, sf, "findings"))


@query(
    "lnt19_finding_counts",
    cte("findings") + """SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity <> 'error') AS warnings,
  bool_or(severity = 'error') AS has_errors, count(*) FILTER (rename_from IS NULL) AS unfixed FROM findings""",
)
def finding_counts(spark, sf):
    return op.finding_counts(load(spark, sf, "findings"))


_FILES = "SELECT CAST(doc_id AS STRING) AS file, replace(text, ' ', '\"') AS text, lang FROM {documents}"
_RENAMES = """SELECT CAST(doc_id AS STRING) AS file, CAST(1 AS INT) AS seq, 'the' AS rename_from, 'thorn' AS rename_to FROM {documents}
UNION ALL SELECT CAST(doc_id AS STRING), CAST(2 AS INT), 'the', 'never' FROM {documents} WHERE doc_id % 2 = 0
UNION ALL SELECT CAST(doc_id AS STRING), CAST(3 AS INT), 'thorn', 'rose' FROM {documents} WHERE doc_id % 3 = 0
UNION ALL SELECT CAST(doc_id AS STRING), CAST(4 AS INT), 'de', 'de' FROM {documents}
UNION ALL SELECT CAST(doc_id AS STRING), CAST(5 AS INT), 'of', 'from' FROM {documents}"""


@query(
    "lnt20_apply_renames",
    ("WITH f AS (" + _FILES + """),
a AS (SELECT *, regexp_replace(text, '([".])the([".])', '\\1thorn\\2', 'g') AS t1 FROM f),
b AS (SELECT *, CASE WHEN t1 = text AND CAST(file AS INT) % 2 = 0 THEN regexp_replace(t1, '([".])the([".])', '\\1never\\2', 'g') ELSE t1 END AS t2 FROM a),
c AS (SELECT *, CASE WHEN CAST(file AS INT) % 3 = 0 THEN regexp_replace(t2, '([".])thorn([".])', '\\1rose\\2', 'g') ELSE t2 END AS t3 FROM b),
d AS (SELECT *, regexp_replace(t3, '([".])of([".])', '\\1from\\2', 'g') AS t4 FROM c)
SELECT file, t4 AS text, concat_ws(',', CASE WHEN t1 <> text THEN 'the>thorn' END, CASE WHEN t3 <> t2 THEN 'thorn>rose' END, CASE WHEN t4 <> t3 THEN 'of>from' END) AS applied
FROM d WHERE t4 <> text""").replace("{documents}", "documents"),
)
def apply_renames(spark, sf):
    docs = load(spark, sf, "documents")
    out = op.apply_renames(spark.sql(_FILES, documents=docs).select("file", "text"), spark.sql(_RENAMES, documents=docs))
    return out.withColumn(
        "applied",
        F.array_join(F.transform("applied", lambda a: F.concat(a["rename_from"], F.lit(">"), a["rename_to"])), ","),
    )
