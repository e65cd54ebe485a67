"""API version queries."""

from __future__ import annotations

from cadastre.operators import api_versions as op
from cadastre.plans.inputs import cte, load
from cadastre.plans.registry import query

# Versioned import paths out of page addresses and line items.
_PATHS = """
SELECT 'vendor/example.org/sdk/manager/' || split_part(url, '/', 4) || '/202' || CAST(page_id % 5 AS STRING) || '-0' || CAST(1 + page_id % 9 AS STRING) || '-01'
   || CASE WHEN page_id % 3 = 0 THEN '-Preview' ELSE '' END || '/things' AS import_path FROM {pages}
UNION ALL SELECT 'vendor/example.org/old/services/svc' || CAST(l_suppkey % 20 AS STRING) || '/mgmt/2023-0' || CAST(l_linenumber AS STRING) || '-01-preview/svc' FROM {lineitem}
"""
MODULES = {
    "example.org/sdk/manager": r"(?i)manager/([^/]+)/([^/]+-preview)",
    "example.org/old/services": r"(?i)services/([^/]+)/mgmt/([^/]+-preview)",
}
VERSIONS = "WITH paths AS (" + _PATHS.replace("{pages}", "pages").replace("{lineitem}", "lineitem") + """),
versions AS (SELECT DISTINCT 'example.org/sdk/manager' AS module, lower(split_part(import_path, '/', 5)) AS service, lower(split_part(import_path, '/', 6)) AS version FROM paths WHERE import_path LIKE '%/manager/%' AND lower(import_path) LIKE '%-preview/%'
 UNION SELECT DISTINCT 'example.org/old/services', lower(split_part(import_path, '/', 5)), lower(split_part(import_path, '/', 7)) FROM paths WHERE import_path LIKE '%/services/%'),
exc AS (SELECT DISTINCT 'example.org/old/services' AS module, 'svc' || (s_suppkey % 30) AS service, '2023-0' || (1 + s_nationkey % 9) || '-01-preview' AS version FROM supplier),
hist AS (SELECT DISTINCT 'example.org/sdk/manager' AS module, lang AS service, '202' || (doc_id % 5) || '-0' || (1 + doc_id % 9) || '-01-preview' AS version FROM documents)
"""


def _paths(spark, sf):
    return spark.sql(_PATHS, pages=load(spark, sf, "pages"), lineitem=load(spark, sf, "lineitem"))


def _current(spark, sf):
    return load(spark, sf, "supplier").selectExpr(
        "'example.org/old/services' AS module", "'svc' || (s_suppkey % 30) AS service", "'2023-0' || (1 + s_nationkey % 9) || '-01-preview' AS version"
    ).distinct()


def _historical(spark, sf):
    return load(spark, sf, "documents").selectExpr(
        "'example.org/sdk/manager' AS module", "lang AS service", "'202' || (doc_id % 5) || '-0' || (1 + doc_id % 9) || '-01-preview' AS version"
    ).distinct()


@query("api01_extract_versions", VERSIONS + "SELECT * FROM versions")
def extract_versions(spark, sf):
    return op.extract_versions(_paths(spark, sf), MODULES)


@query("api02_preview_not_excepted", VERSIONS + "SELECT * FROM versions EXCEPT SELECT * FROM exc EXCEPT SELECT * FROM hist")
def preview_not_excepted(spark, sf):
    versions = op.extract_versions(_paths(spark, sf), MODULES)
    return op.preview_not_excepted(versions, _current(spark, sf), _historical(spark, sf))


@query("api03_unused_exceptions", VERSIONS + "SELECT * FROM exc EXCEPT SELECT * FROM versions")
def unused_exceptions(spark, sf):
    return op.unused_exceptions(_current(spark, sf), op.extract_versions(_paths(spark, sf), MODULES))


@query(
    "api04_validate_exceptions",
    cte("exception_rows") + """, t AS (SELECT trim(service) AS service, trim(version) AS version, trim(target_date) AS d, trim(owner) AS o FROM exception_rows)
SELECT service, version, coalesce(regexp_full_match(d, '\\d{4}-\\d{2}-\\d{2}') AND TRY_CAST(d AS DATE) IS NOT NULL, FALSE) AS valid_date,
  coalesce(regexp_full_match(o, '[^\\s<>@]+@[^\\s<>@]+|[^<>@]*<[^\\s<>@]+@[^\\s<>@]+>') OR regexp_full_match(o, '(?i)github\\.com/[a-z0-9-_]+'), FALSE) AS valid_owner FROM t""",
)
def validate_exceptions(spark, sf):
    rows = load(spark, sf, "exception_rows").selectExpr(
        "trim(service) AS service", "trim(version) AS version", "trim(target_date) AS stableVersionTargetDate",
        "trim(owner) AS responsibleIndividual", "false AS historical",
    )
    return op.validate_exceptions(rows).select("service", "version", "valid_date", "valid_owner")


@query(
    "api05_rewrite_api_version",
    VERSIONS + "SELECT import_path, replace(import_path, '/svc3/mgmt/', '/svc3/core/') AS rewritten FROM paths WHERE contains(import_path, '/svc3/mgmt/')",
)
def rewrite_api_version(spark, sf):
    return op.rewrite_api_version(_paths(spark, sf), "svc3", "mgmt", "core")


_ID_PATHS = """SELECT l_orderkey AS resource, '/subscriptions/x/providers/Sample.S' || CAST(l_suppkey % 7 AS STRING) || '/kinds/202' || CAST(l_linenumber AS STRING) || '-01-01'
  || CASE WHEN l_returnflag = 'R' THEN '-preview' ELSE '' END || '/items' AS path FROM {lineitem}"""


@query(
    "api06_apis_by_resource",
    """SELECT DISTINCT l_orderkey AS resource, 'Sample.S' || (l_suppkey % 7) AS api, '202' || l_linenumber || '-01-01' || CASE WHEN l_returnflag = 'R' THEN '-preview' ELSE '' END AS version FROM lineitem""",
)
def apis_by_resource(spark, sf):
    return op.apis_by_resource(spark.sql(_ID_PATHS, lineitem=load(spark, sf, "lineitem")))
