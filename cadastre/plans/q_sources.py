"""Source and sink queries. Files are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.plans.inputs import cte, load
from cadastre.plans.registry import query
from cadastre.session import scratch_path
from cadastre.sources import snapshots, text
from cadastre.sources.symbol_index import scan_symbol_index


@query(
    "src01_scan_symbol_index",
    "SELECT source, lang, CAST(sum(length(text) + 1) AS BIGINT) AS chars FROM documents GROUP BY ALL",
)
def scan_index(spark, sf):
    path = scratch_path(spark, "index")
    load(spark, sf, "documents").select("text", "source", "lang").write.partitionBy("source", "lang").text(path)
    files = scan_symbol_index(spark, [path, path], suffix=".txt")
    return (
        files.select(
            F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"),
            F.regexp_extract("path", "lang=([^/]+)/", 1).alias("lang"),
            F.length("text").alias("n"),
        )
        .groupBy("source", "lang")
        .agg(F.sum("n").alias("chars"))
    )


def written_snapshots(spark, sf):
    path = scratch_path(spark, "snapshot")
    load(spark, sf, "snapshots").select("text").write.text(path)
    return snapshots.read_schema_snapshot(spark, path)


@query(
    "src04_read_schema_snapshot",
    """SELECT 'sample' AS provider, o_orderpriority AS version, CASE WHEN o_orderstatus = 'P' THEN 'data source' ELSE 'resource' END AS kind,
  'res_' || o_orderkey AS resource, 30 AS create_minutes, 3 AS properties FROM orders""",
)
def read_schema_snapshot(spark, sf):
    return written_snapshots(spark, sf).select(
        "provider",
        "version",
        "kind",
        "resource",
        F.expr("variant_get(node, '$.timeouts.create', 'int')").alias("create_minutes"),
        F.expr("size(variant_get(node, '$.schema', 'map<string,variant>'))").alias("properties"),
    )


@query(
    "src05_decode_schema_node",
    """SELECT p_partkey AS row_key, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'TypeList' END AS type, '' AS config_mode,
  p_size % 3 <> 0 AS optional, FALSE AS required, FALSE AS computed, FALSE AS force_new, p_name AS description,
  CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_size END AS max_items, 2 AS min_items,
  CASE WHEN p_size % 2 <> 0 THEN p_brand END AS default_value,
  CASE p_size % 6 WHEN 0 THEN 'TypeInt' WHEN 1 THEN 'block' END AS elem FROM part""",
)
def decode_schema_node(spark, sf):
    nodes = load(spark, sf, "node_texts").select("row_key", "node_json")
    return snapshots.decode_schema_node(nodes).drop("node_json")


@query(
    "src05_config_mode",
    "SELECT p_partkey AS row_key, CASE p_size % 6 WHEN 1 THEN 'Auto' WHEN 2 THEN 'Block' WHEN 4 THEN 'Attribute' ELSE '' END AS config_mode FROM part",
)
def config_mode(spark, sf):
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("row_key"), snapshots.config_mode_name(F.col("p_size") % 6).alias("config_mode")
    )


@query("src06_read_markdown_pages", cte("text_lines") + "SELECT doc_id, line_no, raw AS text FROM text_lines")
def read_markdown_pages(spark, sf):
    return text.page_lines(load(spark, sf, "documents"), "doc_id")


_RESOURCES = """
SELECT 'sample_' || CAST(p_partkey AS STRING) AS resource, '/docs/' || CAST(p_partkey AS STRING) AS convention_path FROM {part}
UNION ALL SELECT regexp_extract(html, '<title>([^<]*)</title>', 1), '/docs/none' FROM {pages}
"""
_PAGES = """
SELECT '/docs/' || CAST(page_id AS STRING) AS path, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM {pages}
"""


@query(
    "src07_map_resource_to_page",
    f"""WITH r AS ({_RESOURCES}), p AS ({_PAGES}), t AS (SELECT title, max(path) AS path FROM p GROUP BY title)
SELECT r.resource, coalesce(p.path, t.path) AS page FROM r LEFT JOIN p ON p.path = r.convention_path LEFT JOIN t ON t.title = r.resource
""".replace("{part}", "part").replace("{pages}", "pages"),
)
def map_resource_to_page(spark, sf):
    part, pages = load(spark, sf, "part"), load(spark, sf, "pages")
    return text.map_resource_to_page(
        spark.sql(_RESOURCES, part=part, pages=pages), spark.sql(_PAGES, pages=pages)
    )


def unified_diffs(spark, sf):
    """Diff texts, put together from the derived lines of each document."""
    return (
        load(spark, sf, "diff_lines")
        .groupBy("doc_id")
        .agg(F.array_join(F.expr("sort_array(collect_list(struct(line_no, text)))").getField("text"), "\n").alias("text"))
    )


_DIFF_SQL = cte("diff_lines") + """, marked AS (
  SELECT *, last_value(CASE WHEN text LIKE '+++ %' THEN regexp_extract(text, '^\\+\\+\\+ [^/]*/(.*)$', 1) END IGNORE NULLS) OVER w AS file,
         last_value(CASE WHEN text LIKE '@@%' THEN line_no END IGNORE NULLS) OVER w AS hunk_at,
         last_value(CASE WHEN text LIKE '@@%' THEN CAST(regexp_extract(text, '\\+(\\d+)', 1) AS BIGINT) END IGNORE NULLS) OVER w AS start
  FROM diff_lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
added AS (SELECT * FROM marked WHERE text LIKE '+%' AND text NOT LIKE '+++ %')
SELECT doc_id, file, start + row_number() OVER (PARTITION BY doc_id, hunk_at ORDER BY line_no) - 1 AS line FROM added WHERE hunk_at IS NOT NULL"""


@query("src08_read_unified_diff", _DIFF_SQL)
def read_unified_diff(spark, sf):
    return text.read_unified_diff(unified_diffs(spark, sf), "doc_id")


@query(
    "src09_read_exceptions",
    cte("exception_rows")
    + """SELECT trim(module) AS module, trim(service) AS service, trim(version) AS version,
 trim(target_date) AS "stableVersionTargetDate", trim(owner) AS "responsibleIndividual", FALSE AS historical FROM exception_rows""",
)
def read_exceptions(spark, sf):
    path = scratch_path(spark, "exceptions")
    load(spark, sf, "exception_rows").withColumnsRenamed(
        {"target_date": "stableVersionTargetDate", "owner": "responsibleIndividual"}
    ).write.json(path)
    return text.read_exceptions(spark, path)


@query(
    "src10_read_changelog",
    cte("changelog_lines") + """, f AS (SELECT *, regexp_matches(text, '## \\d*\\.\\d*\\.\\d* \\(\\w* \\d{1,2}, \\d{4}\\)') AS is_version,
   CASE WHEN text LIKE 'BREAKING CHANGES%' THEN 'BREAKING CHANGES' WHEN text LIKE 'FEATURES%' THEN 'FEATURES'
        WHEN text LIKE 'ENHANCEMENTS%' THEN 'ENHANCEMENTS' WHEN text LIKE 'BUG FIXES%' THEN 'BUG FIXES' END AS s FROM changelog_lines)
SELECT doc_id, line_no, text, is_version, s IS NOT NULL AS is_section,
  last_value(CASE WHEN is_version THEN text END IGNORE NULLS) OVER w AS version,
  last_value(CASE WHEN s IS NOT NULL THEN s WHEN is_version THEN 'UNKNOWN' END IGNORE NULLS) OVER w AS section
FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)""",
)
def read_changelog(spark, sf):
    return text.read_changelog(load(spark, sf, "changelog_lines"), "doc_id")


@query("snk01_write_findings_json", cte("findings") + "SELECT * FROM findings")
def write_findings_json(spark, sf):
    findings = load(spark, sf, "findings")
    path = scratch_path(spark, "findings")
    text.write_findings_json(findings, path)
    return spark.read.schema(findings.schema).json(path)


@query(
    "snk02_format_findings_text",
    cte("findings") + """
SELECT replace(file, 'src_', '') || ':' || line || ':' || col || ': ' || severity || ' [' || rule_id || '] '
  || CASE WHEN resource IS NOT NULL THEN resource || ': ' ELSE '' END || message
  || CASE WHEN fix IS NOT NULL THEN chr(10) || '    → fix: ' || fix ELSE '' END AS text, FALSE AS is_total FROM findings
UNION ALL SELECT count(*) || ' finding(s): ' || (count(*) FILTER (severity = 'error')) || ' error(s), '
  || (count(*) FILTER (severity <> 'error')) || ' warning(s)', TRUE FROM findings""",
)
def format_findings_text(spark, sf):
    return text.format_findings_text(load(spark, sf, "findings"), root="src_")


@query(
    "snk03_write_schema_snapshot",
    """SELECT CASE WHEN p_size % 2 = 0 THEN 'resource' ELSE 'data source' END AS kind, p_brand AS resource, count(*) AS properties FROM part GROUP BY ALL""",
)
def write_schema_snapshot(spark, sf):
    nodes = load(spark, sf, "node_texts").join(
        load(spark, sf, "part").selectExpr("p_partkey AS row_key", "p_brand AS resource"), "row_key"
    )
    path = scratch_path(spark, "snapshot")
    snapshots.write_schema_snapshot(
        nodes.selectExpr(
            "CASE WHEN p_size % 2 = 0 THEN 'resource' ELSE 'data source' END AS kind",
            "resource",
            "'p' || row_key AS name",
            "node_json",
        ),
        path,
    )
    back = snapshots.read_schema_snapshot(spark, path)
    return (
        back.select("kind", "resource", F.explode(F.expr("variant_get(node, '$.schema', 'map<string,variant>')")))
        .groupBy("kind", "resource")
        .agg(F.count("*").alias("properties"))
    )


@query(
    "snk04_rewrite_documents",
    cte("text_lines") + """SELECT doc_id, string_agg(replace(raw, 'ing', 'ING'), chr(10) ORDER BY line_no) AS text FROM text_lines
GROUP BY doc_id HAVING bool_or(contains(raw, 'ing'))""",
)
def rewrite_documents(spark, sf):
    before = load(spark, sf, "text_lines").select("doc_id", "line_no", F.col("raw").alias("text"))
    return text.rewrite_documents(before, before.withColumn("text", F.replace("text", F.lit("ing"), F.lit("ING"))), "doc_id")
