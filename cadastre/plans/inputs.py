"""Inputs of the registered queries, derived from the driver's tables.

Each derivation is one SQL text in the dialect that Spark and the checking
engine share, so that both sides start from the same rows. The operators
themselves are written twice: with DataFrames, and as SQL in the plan modules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Property names that reach every naming rule.
WORDS = (
    "sku_name,sku_tier,vm_size,timeout_seconds,is_enabled,network_profile,subnet_id,"
    "description,enabled,retention_in_days,max_count,storage_mb,tags_config,mode,"
    "zone_id,level,disk_gb,location,is_public"
)


def _word(n: str) -> str:
    return f"split_part('{WORDS}', ',', CAST((l_orderkey + {n}) % 19 AS INT) + 1)"


def _pick(words: str, key: str) -> str:
    count = len(words.split(","))
    return f"split_part('{words}', ',', CAST({key} % {count} AS INT) + 1)"


_SHARED: dict[str, tuple[tuple[str, ...], str]] = {}

# One registration per line item: the supplier is the service, the part the type.
_SHARED["registrations"] = (
    ("lineitem",),
    """
SELECT 'svc_' || CAST(l_suppkey AS STRING) AS service,
       CASE WHEN l_linestatus = 'O' THEN 'resource' ELSE 'data_source' END AS object_kind,
       CASE l_returnflag WHEN 'A' THEN 'legacy' WHEN 'N' THEN 'modern' ELSE 'ephemeral' END AS style,
       'type_' || CAST(l_partkey AS STRING) AS resource_type,
       'resourceType' || CAST(l_partkey AS STRING) AS registration_method
FROM {lineitem}
""",
)

# One declaration text per order: a map literal, a slice literal or a constructor list.
_SHARED["registration_texts"] = (
    ("orders",),
    """
SELECT 'internal/services/svc' || CAST(o_custkey AS STRING) || '/method.Registration.' || method
         || '.' || CAST(o_orderkey AS STRING) AS path,
       'svc' || CAST(o_custkey AS STRING) AS service, method,
       'func (r Registration) ' || method || '() {' || chr(10) || '    return {' || chr(10)
         || CASE WHEN method LIKE 'Supported%' THEN
              '        "type_' || CAST(o_orderkey AS STRING) || '": resourceA' || CAST(o_orderkey AS STRING) || '(),' || chr(10)
              || '        "type_' || CAST(o_custkey AS STRING) || '_x":   resourceB' || CAST(o_custkey AS STRING) || '(),' || chr(10)
            WHEN method IN ('Resources', 'DataSources') THEN
              '        Recv' || CAST(o_orderkey AS STRING) || 'Resource{},' || chr(10)
              || '        Recv' || CAST(o_custkey AS STRING) || 'Resource{},' || chr(10)
            ELSE
              '        NewThing' || CAST(o_orderkey AS STRING) || ',' || chr(10) END
         || '    }' || chr(10) || '}' || chr(10) AS body
FROM (SELECT *, CASE o_orderstatus
                  WHEN 'F' THEN CASE WHEN o_orderpriority < '3' THEN 'SupportedResources' ELSE 'SupportedDataSources' END
                  WHEN 'O' THEN CASE WHEN o_orderpriority < '3' THEN 'Resources' ELSE 'DataSources' END
                  ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'EphemeralResources'
                         WHEN '2-HIGH' THEN 'ListResources' WHEN '3-MEDIUM' THEN 'Actions'
                         WHEN '5-LOW' THEN 'FrameworkResources' ELSE 'FrameworkDataSources' END
                END AS method FROM {orders}) o
""",
)

# One property per (order, line); repeated lines are folded into one.
_SHARED["properties"] = (
    ("lineitem",),
    f"""
SELECT kind, resource, order_id, n, name, parent_path,
       CASE WHEN parent_path = '' THEN name ELSE parent_path || '.' || name END AS path,
       CAST(CASE WHEN n <= 3 THEN 1 WHEN n <= 6 THEN 2 ELSE 3 END AS INT) AS depth,
       n <= 3 AS top_level,
       CASE WHEN n <= 2 THEN CASE WHEN p % 2 = 0 THEN 'TypeList' ELSE 'TypeSet' END
            ELSE {_pick('TypeString,TypeInt,TypeBool,TypeFloat,TypeList,TypeSet,TypeMap', 'p')} END AS type,
       CASE WHEN n <= 4 AND s % 3 < 2 THEN 'block' WHEN s % 3 = 2 THEN 'scalar' END AS elem,
       CASE s % 3 WHEN 0 THEN 'Auto' WHEN 1 THEN 'Block' END AS config_mode,
       flag = 'A' AS optional, flag = 'N' AS required,
       (flag = 'R' OR (flag = 'A' AND p % 3 = 0)) AS computed, status = 'F' AS force_new,
       CASE WHEN p % 4 = 0 THEN CAST(CAST(q AS INT) AS STRING) END AS default_value,
       CASE WHEN p % 5 = 0 THEN '' WHEN p % 5 > 1 THEN 'about ' || name END AS description,
       CAST(p % 3 AS INT) AS max_items, CAST(s % 2 AS INT) AS min_items,
       CASE s % 4 WHEN 1 THEN 'StringInSlice' WHEN 2 THEN 'StringIsNotEmpty' WHEN 3 THEN 'IsUUID' END AS validate_func,
       CASE WHEN s % 4 = 1 THEN {_pick('None,Standard,Off,Premium,Default,Basic,Disabled', 'p')}
            || ',' || {_pick('Fast,ModeNone,SlowOff,Cold', 'p')} END AS enum_values,
       p % 2 = 0 AS enum_literal,
       s % 11 = 0 AS at_least_one_of, s % 17 = 0 AS exactly_one_of, p % 13 = 0 AS opaque,
       'src_' || CAST(order_id % 100 AS STRING) || '.x' AS file,
       CAST(order_id * 10 + n AS BIGINT) AS line, CAST(order_id * 10 + n + q % 5 AS BIGINT) AS end_line,
       CAST(1 + p % 7 AS INT) AS col
FROM (SELECT l_orderkey AS order_id, l_linenumber AS n,
             CASE WHEN l_orderkey % 4 = 0 THEN 'data source' ELSE 'resource' END AS kind,
             'res_' || CAST(l_orderkey AS STRING) AS resource,
             {_word('l_linenumber')} AS name,
             CASE WHEN l_linenumber <= 3 THEN '' WHEN l_linenumber <= 6 THEN {_word('l_linenumber - 3')}
                  ELSE {_word('1')} || '.' || {_word('4')} END AS parent_path,
             p, s, flag, status, q
      FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s,
                   min(l_returnflag) AS flag, min(l_linestatus) AS status, min(l_quantity) AS q
            FROM {{lineitem}} GROUP BY l_orderkey, l_linenumber) a) b
""",
)

# The same properties one release later: some gone, some changed, some new.
_SHARED["properties_current"] = (
    ("properties", "orders"),
    """
SELECT kind, resource, path, parent_path, name, depth, top_level,
       CASE WHEN order_id % 7 = 1 THEN 'TypeString' ELSE type END AS type, elem,
       CASE WHEN order_id % 7 IN (2, 4) THEN FALSE ELSE optional END AS optional,
       CASE WHEN order_id % 7 = 2 THEN FALSE WHEN order_id % 7 = 4 THEN TRUE ELSE required END AS required,
       CASE WHEN order_id % 7 = 2 THEN TRUE WHEN order_id % 7 = 3 THEN FALSE ELSE computed END AS computed,
       CASE WHEN order_id % 7 = 5 THEN NOT force_new ELSE force_new END AS force_new,
       CASE WHEN order_id % 7 = 6 THEN '0' ELSE default_value END AS default_value,
       description, max_items, min_items
FROM {properties} WHERE (order_id + n) % 11 <> 0
UNION ALL
SELECT CASE WHEN o_orderkey % 4 = 0 THEN 'data source' ELSE 'resource' END,
       'res_' || CAST(o_orderkey AS STRING), 'new_prop', '', 'new_prop', CAST(1 AS INT), TRUE, 'TypeString', NULL,
       o_orderstatus = 'O', o_orderstatus = 'F', o_orderstatus = 'P', FALSE, NULL, 'fresh', CAST(0 AS INT), CAST(0 AS INT)
FROM {orders} WHERE o_orderkey % 13 = 0
""",
)

_SHARED["findings"] = (
    ("events",),
    """
SELECT event_id AS seq, 'SL0' || lpad(CAST(1 + event_id % 13 AS STRING), 2, '0') AS rule_id,
       'rule-' || CAST(1 + event_id % 13 AS STRING) AS rule_name,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity,
       CASE WHEN event_type <> 'view' THEN 'res_' || CAST(user_id AS STRING) END AS resource,
       CASE WHEN event_type = 'signup' THEN 'data source' ELSE 'resource' END AS kind,
       'prop_' || CAST(event_id % 37 AS STRING) AS path,
       'src_' || CAST(user_id % 40 AS STRING) || '.x' AS file,
       CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS line, CAST(event_id % 3 AS INT) AS col,
       event_type || ' seen' AS message,
       CASE WHEN event_id % 3 = 0 THEN 'rename it' END AS fix,
       CASE WHEN event_id % 3 = 0 THEN 'prop_' || CAST(event_id % 37 AS STRING) END AS rename_from,
       CASE WHEN event_id % 3 = 0 THEN 'property_' || CAST(event_id % 37 AS STRING) END AS rename_to
FROM {events}
""",
)

_SHARED["resource_ids"] = (
    ("customer",),
    """
SELECT c_custkey AS row_key,
       CASE c_custkey % 8
         WHEN 1 THEN '/Subscriptions/' || k || '/resourcegroups/rg-' || n || '/providers/sample.org/Customers/' || c_name
         WHEN 2 THEN '/subscriptions/' || k || '/resourceGroups/rg-' || n || '/customers/' || c_name
         WHEN 3 THEN '/subscriptions/' || k || '/resourceGroups//providers/Sample.Org/customers/' || c_name
         WHEN 4 THEN '/subscriptions/' || k || '/resourceGroups/rg-' || n || '/providers/Sample.Org/customers'
         WHEN 5 THEN '/resourceGroups/rg-' || n || '/providers/Sample.Org/customers/' || c_name
         WHEN 6 THEN '/subscriptions/' || k || '/resourceGroups/rg-' || n || '/providers/Sample.Org/customers/' || c_name || '/notes/n' || n
         WHEN 7 THEN '/subscriptions/' || k || '/resourceGroups/rg-' || n || '/providers/Sample.Org/Customers/' || c_name
         ELSE '/subscriptions/' || k || '/resourceGroups/rg-' || n || '/providers/Sample.Org/customers/' || c_name END AS id
FROM (SELECT c_custkey, replace(c_name, '#', '-') AS c_name, CAST(c_custkey AS STRING) AS k,
             CAST(c_nationkey AS STRING) AS n FROM {customer}) c
""",
)

_SHARED["state_rows"] = (
    ("orders",),
    """
SELECT o_orderkey AS row_key, CAST(o_orderkey % 3 AS INT) AS version, CASE WHEN o_orderkey % 7 = 0 THEN 'sale' ELSE 'order' END AS type,
       '/subscriptions/' || CAST(o_custkey AS STRING) || CASE WHEN o_orderkey % 2 = 0 THEN '/resourcegroups/' ELSE '/resourceGroups/' END
         || 'rg-1/providers/Sample.Org/orders/' || CAST(o_orderkey AS STRING) AS id,
       o_orderpriority AS tier, o_orderstatus AS status,
       CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING) AS price,
       CASE WHEN o_orderkey % 5 <> 0 THEN 'v' || CAST(o_custkey % 10 AS STRING) END AS old_name
FROM {orders}
""",
)

_SHARED["cidrs"] = (
    ("customer",),
    """
SELECT c_custkey AS row_key, 'grp_' || CAST(c_nationkey AS STRING) AS list_name,
       CASE WHEN c_custkey % 97 = 0 THEN '10.1.2.3/0' WHEN c_custkey % 89 = 0 THEN '0.0.0.0/0'
            ELSE '10.' || CAST(CAST(floor(c_custkey / 256) AS BIGINT) % 256 AS STRING) || '.' || CAST(c_custkey % 256 AS STRING)
                 || '.0/' || CAST(20 + c_custkey % 9 AS STRING) END AS cidr
FROM {customer}
""",
)

_LINES_DUCK = """
SELECT doc_id, source, lang, CAST(line_no AS INT) AS line_no, raw
FROM (SELECT doc_id, source, lang, unnest(generate_series(0, len(a) - 1)) AS line_no, unnest(a) AS raw
      FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS a FROM {documents}) d) e
"""

# Markdown pages: every ninth line is a heading, others are field, block, note
# and timeout lines that carry the words of the document's own text.
_SHARED["page_lines"] = (
    ("text_lines",),
    """
SELECT page, line_no, word,
       CASE WHEN line_no = 0 THEN '---'
            WHEN line_no % 9 = 1 THEN CASE CAST(floor(line_no / 9) AS BIGINT) % 6
                 WHEN 0 THEN '# sample_' || page WHEN 1 THEN '## Example Usage' WHEN 2 THEN '## Arguments Reference'
                 WHEN 3 THEN '## Attribute Reference' WHEN 4 THEN '## Timeouts' ELSE '## Import' END
            WHEN line_no % 9 = 2 THEN '* `' || word || '` - (Required) The ' || raw || ' Possible values are `One`, `Two` and `' || word
                 || '`. Defaults to `One`. Changing this forces a new resource to be created.'
            WHEN line_no % 9 = 3 THEN '* `' || word || '_block` - (Optional) A `' || word || '` block as defined below.'
            WHEN line_no % 9 = 4 THEN 'A `' || word || '` block supports the following:'
            WHEN line_no % 9 = 5 THEN CASE WHEN doc_id % 3 = 0 THEN '-> **NOTE:** ' WHEN doc_id % 3 = 1 THEN '~> **Note:** ' ELSE '> **note** ' END || raw
            WHEN line_no % 9 = 6 THEN '* `' || split_part('read,create,delete,update', ',', CAST(1 + doc_id % 4 AS INT))
                 || '` - (Defaults to ' || CAST(1 + line_no % 60 AS STRING) || CASE WHEN line_no % 2 = 0 THEN ' hours' ELSE ' minutes' END
                 || ') Used when handling the ' || word || '.'
            WHEN line_no % 9 = 7 THEN '*  `' || word || '_id` - ' || raw
            ELSE raw END AS text
FROM (SELECT doc_id, line_no, raw, 'page_' || CAST(doc_id AS STRING) AS page,
             coalesce(nullif(lower(regexp_extract(raw, '[A-Za-z]+', 0)), ''), 'blank') AS word FROM {text_lines}) x
""",
)

# Declaration texts: one symbol per document.
_SHARED["symbols_raw"] = (
    ("documents",),
    """
SELECT 'internal/services/' || source || CASE WHEN doc_id % 2 = 0 THEN '/' ELSE '/' || lang || '/' END
         || CASE doc_id % 4 WHEN 0 THEN 'func.' WHEN 1 THEN 'method.' || 'Recv' || CAST(doc_id % 5 AS STRING) || '.'
              WHEN 2 THEN 'type.' ELSE 'var.' END || 'Decl' || CAST(doc_id AS STRING) || '.goindex' AS path,
       'package example.org/x/' || source || chr(10) || 'import (' || chr(10) || '    "fmt"' || chr(10)
         || '    al' || lang || ' "example.org/sdk/' || lang || '/2024-0' || CAST(1 + doc_id % 9 AS STRING) || '-01/'
         || 'things' || CAST(doc_id % 7 AS STRING) || '"' || chr(10)
         || '    "example.org/lib/w' || CAST(doc_id % 11 AS STRING) || '"' || chr(10) || ')' || chr(10)
         || 'func Decl' || CAST(doc_id AS STRING) || '() {' || chr(10)
         || CASE WHEN doc_id % 3 = 0 THEN '    fmt.Print(al' || lang || '.Go(Decl' || CAST(doc_id % 50 AS STRING) || '()))' || chr(10) ELSE '' END
         || text || chr(10) || '}' || chr(10) AS text
FROM {documents}
""",
)

_SHARED["struct_fields_raw"] = (
    ("part",),
    """
SELECT p_partkey AS row_key, 'type_' || CAST(p_partkey AS STRING) AS type_name,
       'type T' || CAST(p_partkey AS STRING) || ' struct {' || chr(10)
         || '    Name string `tfschema:"' || replace(p_name, ' ', '_') || '"`' || chr(10)
         || '    Size int64 `json:"size,omitempty"`' || chr(10)
         || CASE WHEN p_size % 3 = 0 THEN '    Items []T' || CAST(p_partkey + 1 AS STRING) || ' `tfschema:"items"`' || chr(10) ELSE '' END
         || CASE WHEN p_size % 2 = 0 THEN '    Brand string' || chr(10) ELSE '' END
         || CASE WHEN p_size % 5 = 0 THEN '    low, High float64 `tfsdk:"span"`' || chr(10) ELSE '' END
         || CASE WHEN p_size % 7 = 0 THEN '    lib.Embedded' || chr(10) ELSE '' END
         || '}' AS body
FROM {part}
""",
)


# Snapshot documents, one per order. The texts use <> for braces, which the
# shared dialect then translates.
_SHARED["snapshots"] = (
    ("orders",),
    """
SELECT o_orderkey AS order_id, o_orderstatus AS status, o_orderpriority AS priority,
       translate('<"providerName":"sample","schemaVersion":"' || o_orderpriority || '","providerSchema":<"schema":<>,"'
         || CASE WHEN o_orderstatus = 'P' THEN 'dataSources' ELSE 'resources' END || '":<"res_' || CAST(o_orderkey AS STRING)
         || '":<"schema":<"name":<"type":"TypeString","required":true,"forceNew":true>,'
         || '"sku":<"type":"TypeList","optional":true,"maxItems":1,"elem":<"schema":<"tier":<"type":"TypeString","optional":true,"default":"'
         || o_orderpriority || '">,'
         || CASE WHEN o_orderstatus = 'F' THEN '"limits":<"type":"TypeSet","optional":true,"elem":<"schema":<"cpu":<"type":"TypeInt","computed":true>>>>,' ELSE '' END
         || '"size":<"type":"TypeInt","required":true>>>>,"tags":<"type":"TypeMap","elem":<"type":"TypeString">>>,'
         || '"timeouts":<"create":30>>>>>', '<>', chr(123) || chr(125)) AS text
FROM {orders}
""",
)

# Property nodes with fields of a wrong type now and then.
_SHARED["node_texts"] = (
    ("part",),
    """
SELECT p_partkey AS row_key, p_size AS p_size, p_name AS p_name,
       translate('<"type":' || CASE WHEN p_size % 5 = 0 THEN '7' ELSE '"TypeList"' END
         || ',"optional":' || CASE WHEN p_size % 3 = 0 THEN '"yes"' ELSE 'true' END
         || ',"description":"' || p_name || '","maxItems":' || CASE WHEN p_size % 4 = 0 THEN '"3"' ELSE CAST(p_size AS STRING) END
         || ',"minItems":2,"default":' || CASE WHEN p_size % 2 = 0 THEN '<"a":1>' ELSE '"' || p_brand || '"' END
         || CASE WHEN p_size % 6 = 0 THEN ',"elem":<"type":"TypeInt">' WHEN p_size % 6 = 1 THEN ',"elem":<"schema":<"x":<"type":"TypeInt">>>' ELSE '' END
         || '>', '<>', chr(123) || chr(125)) AS node_json
FROM {part}
""",
)

# Unified diffs: one per document, from its own lines.
_SHARED["diff_lines"] = (
    ("text_lines",),
    """
SELECT doc_id, line_no,
       CASE WHEN line_no % 11 = 0 THEN '+++ b/src/f' || CAST(line_no AS STRING) || '.x'
            WHEN line_no % 11 = 1 THEN '--- a/src/old.x'
            WHEN line_no % 11 IN (2, 6) THEN '@@ -1,2 +' || CAST(line_no * 3 + doc_id % 7 AS STRING) || CASE WHEN doc_id % 2 = 0 THEN ',4' ELSE '' END || ' @@ ctx'
            WHEN line_no % 11 = 4 THEN '-' || raw ELSE '+' || raw END AS text
FROM {text_lines}
""",
)

# Changelogs: document lines with headings between them.
_SHARED["changelog_lines"] = (
    ("text_lines",),
    """
SELECT doc_id, line_no,
       CASE WHEN line_no % 17 = 0 THEN '## 4.' || CAST(line_no AS STRING) || '.' || CAST(doc_id % 10 AS STRING) || ' (May 0' || CAST(1 + doc_id % 9 AS STRING) || ', 2024)'
            WHEN line_no % 17 IN (2, 6, 11) THEN split_part('BREAKING CHANGES:,FEATURES:,ENHANCEMENTS:,BUG FIXES:', ',', CAST(1 + line_no % 4 AS INT))
            ELSE raw END AS text
FROM {text_lines}
""",
)

# API version exceptions, as a table with blanks around the values.
_SHARED["exception_rows"] = (
    ("supplier",),
    """
SELECT ' example.org/sdk ' AS module, ' svc' || CAST(s_nationkey AS STRING) || ' ' AS service,
       '2023-0' || CAST(1 + s_suppkey % 9 AS STRING) || '-01-preview ' AS version,
       CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN ' 2024-02-30' ELSE '2024-02-' || CAST(10 + s_suppkey % 15 AS STRING) || ' ' END AS target_date,
       CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' github.com/user-' || CAST(s_suppkey AS STRING) WHEN 2 THEN 'u' || CAST(s_suppkey AS STRING) || '@example.org' ELSE 'someone' END AS owner
FROM {supplier}
""",
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a derived input."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name == "text_lines":
        docs = load(spark, sf_dir, "documents")
        return docs.select(
            "doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line_no", "raw")
        )
    needs, text = _SHARED[name]
    text = text.replace("{", "{{").replace("}", "}}")
    for need in needs:
        text = text.replace("{{" + need + "}}", "{" + need + "}")
    return spark.sql(text, **{need: load(spark, sf_dir, need) for need in needs})


def cte(*names: str) -> str:
    """``WITH`` clause that defines the same inputs for the checking engine."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in TABLES or name in order:
            return
        for need in ("documents",) if name == "text_lines" else _SHARED[name][0]:
            visit(need)
        order.append(name)

    for name in names:
        visit(name)
    parts = []
    for name in order:
        text = _LINES_DUCK if name == "text_lines" else _SHARED[name][1]
        for ref in [*TABLES, *order]:
            text = text.replace("{" + ref + "}", ref)
        parts.append(f"{name} AS ({text.strip()})")
    return "WITH " + ",\n".join(parts) + "\n"
