"""Jobs over resource IDs: parsing, formatting, re-casing and checking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastre.functions.names import snake_by_capital

# Error texts, and segment names that are written otherwise.
ODD = "The number of path segments is not divisible by 2"
EMPTY = "Key/Value cannot be empty strings"
NO_SUBSCRIPTION = "ID was missing the 'subscriptions' element"
NO_GROUP = "ID was missing the 'resourceGroups' element"
NO_SEGMENT = "ID was missing the `%s` element"
TOO_MANY = "ID contained more segments than a Resource ID requires"
COLUMN_NAMES = {"signal_r_name": "signalr_name", "web_pub_sub_name": "web_pubsub_name"}
SEGMENT_KINDS = ("constant", "subscription_id", "resource_group", "user_specified")
KNOWN_KEYS = ("subscriptions", "resourceGroups", "providers")


def _segments(id_column: Column) -> Column:
    return F.split(F.regexp_replace(id_column, "^/+|/+$", ""), "/")


def _every_second(segments: Column, first: int) -> Column:
    return F.filter(segments, lambda _, i: i % 2 == first)


def parsed_id(id_column: Column) -> Column:
    """The eight fields of any resource ID, as a struct."""
    tail = F.split(F.regexp_extract(id_column, r"(?i)^.*/providers/[^/]+/(.+)$", 1), "/")
    types, names = _every_second(tail, 0), _every_second(tail, 1)
    provider = F.regexp_extract(id_column, r"(?i)^.*/providers/([^/]+)", 1)
    parents = F.slice(F.arrays_zip(types.alias("k"), names.alias("v")), F.lit(1), F.greatest(F.size(names) - 1, F.lit(0)))
    scope = F.regexp_extract(id_column, r"(?i)^(.*/providers/.*)/providers/[^/]+", 1)
    return F.struct(
        F.regexp_extract(id_column, r"(?i)^/subscriptions/([^/]*)", 1).alias("subscription_id"),
        F.regexp_extract(id_column, r"(?i)^/(?:subscriptions/[^/]*/)?resourceGroups/([^/]*)", 1).alias("resource_group_name"),
        provider.alias("resource_provider"),
        F.coalesce(F.try_element_at(types, F.lit(-1)), F.lit("")).alias("resource_type"),
        F.array_join(F.concat(F.array(provider), types), "/").alias("full_resource_type"),
        F.coalesce(F.try_element_at(names, F.size(types)), F.lit("")).alias("resource_name"),
        scope.alias("resource_scope"),
        # of several parents of one type the last counts
        F.map_from_entries(
            F.filter(
                parents,
                lambda p, i: p["v"].isNotNull() & ~F.exists(F.slice(parents, i + 2, F.size(parents)), lambda q: q["k"] == p["k"]),
            )
        ).alias("parent_resources"),
    )


def parse_resource_id(ids: DataFrame, column: str = "id") -> DataFrame:
    """Add the fields of each ID."""
    return ids.withColumn("parsed", parsed_id(F.col(column))).select(*ids.columns, "parsed.*")


def templates(spark: SparkSession, rows: list[tuple[str, str, list[str], list[str]]]) -> DataFrame:
    """Template table: type, provider, segment keys, and a label per segment."""
    return spark.createDataFrame(rows, "type STRING, provider STRING, keys ARRAY<STRING>, labels ARRAY<STRING>")


def parse_by_template(ids: DataFrame, template_rows: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Match IDs (id, type) against the template of their type.

    Adds subscription_id, resource_group, names (in key order) and error, which
    names the first thing wrong. The small template table is joined, and Spark
    broadcasts it while its size allows.
    """
    segments = _segments(F.col("id"))
    pairs = F.arrays_zip(_every_second(segments, 0).alias("k"), _every_second(segments, 1).alias("v"))
    rows = ids.join(template_rows, "type").withColumn("segments", segments).withColumn("pairs", pairs)

    def value(key: Column | str, exact: bool = True, place: int = -1) -> Column:
        wanted = F.lit(key) if isinstance(key, str) else key
        same = (lambda p: p["k"] == wanted) if exact else (lambda p: F.lower(p["k"]) == F.lower(wanted))
        return F.try_element_at(F.filter("pairs", same), F.lit(place))["v"]

    group = F.coalesce(value("resourceGroups"), value("resourcegroups"))
    # the first subscription counts: later ones belong to nested types of that name
    rows = rows.select(
        "*",
        value("subscriptions", place=1).alias("subscription_id"),
        group.alias("resource_group"),
        F.transform("keys", lambda k: value(k, exact=not ignore_case)).alias("names"),
    )
    lacking = F.try_element_at(
        F.filter(F.arrays_zip("keys", "names"), lambda p: p["names"].isNull()), F.lit(1)
    )["keys"]
    error = (
        F.when(F.size("segments") % 2 == 1, ODD)
        .when(F.exists("segments", lambda s: s == ""), EMPTY)
        .when(F.col("subscription_id").isNull(), NO_SUBSCRIPTION)
        .when(F.col("resource_group").isNull(), NO_GROUP)
        .when(lacking.isNotNull(), F.format_string(NO_SEGMENT, lacking))
        .when(F.size("pairs") > F.size("keys") + 3, TOO_MANY)
    )
    return rows.withColumn("error", error).drop("segments", "pairs")


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those put in quarantine for their error."""
    return parsed.where("error IS NULL"), parsed.where("error IS NOT NULL")


def formatted_id() -> Column:
    """Canonical ID out of the columns of ``parse_by_template``."""
    tail = F.zip_with("keys", "names", lambda k, n: F.concat(F.lit("/"), k, F.lit("/"), n))
    return F.concat(
        F.lit("/subscriptions/"), F.col("subscription_id"), F.lit("/resourceGroups/"), F.col("resource_group"),
        F.lit("/providers/"), F.col("provider"), F.array_join(tail, ""),
    )


def format_resource_id(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("formatted", formatted_id())


def describe_resource_id(parsed: DataFrame, title: str) -> DataFrame:
    """Text of an ID, the most specific segment first."""
    def quoted(label: Column, text: Column) -> Column:
        return F.concat(label, F.lit(' "'), text, F.lit('"'))

    named = F.reverse(F.zip_with("labels", "names", quoted))
    group = F.array(quoted(F.lit("Resource Group"), F.col("resource_group")))
    return parsed.withColumn(
        "description", F.concat(F.lit(title + ": ("), F.array_join(F.concat(named, group), " / "), F.lit(")"))
    )


def normalised_id(id_column: Column, known: list[str]) -> Column:
    """Re-case known keys and namespaces of an ID; everything else stays."""
    case = F.create_map(*(F.lit(x) for word in dict.fromkeys((*KNOWN_KEYS, *known)) for x in (word.lower(), word)))
    parts = F.split(id_column, "/")
    # keys stand at odd places, as the ID begins with a slash; so does the
    # namespace's key, and the namespace itself follows it
    return F.array_join(
        F.transform(
            parts,
            lambda s, i: F.when(
                (i % 2 == 1) | (F.lower(F.get(parts, i - 1)) == "providers"), F.coalesce(F.try_element_at(case, F.lower(s)), s)
            ).otherwise(s),
        ),
        "/",
    )


def normalise_resource_id(ids: DataFrame, known: list[str], column: str = "id") -> DataFrame:
    return ids.withColumn("normalised", normalised_id(F.col(column), known))


def check_legacy_casing(ids: DataFrame) -> DataFrame:
    """First segment of ``id`` that differs from ``canonical`` in more than tolerated case."""
    given, wanted = _segments(F.col("id")), _segments(F.col("canonical"))
    rows = F.transform(
        F.arrays_zip(given.alias("s"), wanted.alias("c")),
        lambda p, i: F.struct(
            p["s"].alias("s"),
            p["c"].alias("c"),
            (
                (p["s"] == p["c"])
                | ((p["c"] == "resourceGroups") & (p["s"] == "resourcegroups"))
                | ((F.get(wanted, i - 1) == "providers") & (F.lower(p["s"]) == F.lower(p["c"])))
            ).alias("ok"),
        ),
    )
    bad = F.try_element_at(F.filter(rows, lambda p: ~F.coalesce(p["ok"], F.lit(False))), F.lit(1))
    error = F.when(
        F.size(given) != F.size(wanted), F.format_string('expected the ID to be in the format "%s"', "canonical")
    ).when(bad.isNotNull(), F.format_string('the segment "%s" should be "%s"', bad["s"], bad["c"]))
    return ids.withColumn("error", error)


def compose_ids(pairs: DataFrame) -> DataFrame:
    """``first|second`` association IDs."""
    return pairs.withColumn("id", F.concat_ws("|", "first", "second"))


def split_composite_ids(ids: DataFrame) -> DataFrame:
    """The two IDs of an association ID, or an error if there are not two."""
    parts = F.split("id", r"\|")
    ok = F.size(parts) == 2
    return ids.select(
        "*",
        F.when(ok, parts[0]).alias("first"),
        F.when(ok, F.get(parts, F.lit(1))).alias("second"),
        F.when(~ok, "expected two IDs joined by `|`").alias("error"),
    )


def data_plane_ids(urls: DataFrame, item_type: str, require_version: bool = False, column: str = "url") -> DataFrame:
    """Name and version of URL IDs ``/type/name[/version]``, or what is wrong."""
    path = F.coalesce(F.try_parse_url(F.col(column), F.lit("PATH")), F.lit(""))
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    wanted = 3 if require_version else 2
    name, version = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    checked = [name, version] if require_version else [name]
    error = F.when(F.size(parts) != wanted, "wrong number of segments").when(
        F.get(parts, F.lit(0)) != item_type, F.format_string('expected the Nested Item Type to be "' + item_type + '" but got "%s"', F.get(parts, F.lit(0)))
    )
    for part in checked:
        error = error.when(F.trim(part) == "", "unexpected empty value").when(F.trim(part) != part, "contained extra whitespace")
    return urls.withColumn("error", error).select(
        *urls.columns,
        F.when(F.col("error").isNull(), name).alias("item_name"),
        F.when(F.col("error").isNull() & F.lit(require_version), version).alias("item_version"),
        "error",
    )


# a format text, given to a variable or a constant, or straight to the formatter
TEMPLATE = r'(?m)^(?!\s*//).*?(?:=\s*|Sprintf\(\s*)"([^"\n]*%[a-z][^"\n]*)"'


def template_catalogue(texts: DataFrame, column: str = "body") -> DataFrame:
    """ID templates named in declaration texts, counted per provider namespace.

    Every format text of a declaration counts once, whatever its variable is called;
    comments do not count.
    """
    template = F.explode(F.array_distinct(F.regexp_extract_all(column, F.lit(TEMPLATE), F.lit(1))))
    return (
        texts.select(template.alias("template"))
        .groupBy(F.regexp_extract("template", r"/providers/([^/]+)/", 1).alias("namespace"), "template")
        .agg(F.count("*").alias("uses"))
    )


def identity_columns(segments: DataFrame) -> DataFrame:
    """Column name per ID segment (id_type, idx from 0, name, kind, virtual).

    Only the four supported kinds count. The last ``*Name`` segment is called
    ``name`` unless the ID is virtual.
    """
    kept = segments.where(F.col("kind").isin(*SEGMENT_KINDS))
    last = segments.groupBy("id_type").agg(F.max("idx").alias("last_idx"))
    snake = snake_by_capital(F.col("name"))
    fixed = F.create_map(*(F.lit(x) for pair in COLUMN_NAMES.items() for x in pair))
    is_name = ~F.col("virtual") & (F.col("idx") == F.col("last_idx")) & F.col("name").endswith("Name")
    return kept.join(last, "id_type").select(
        *segments.columns,
        F.when(is_name, "name").otherwise(F.coalesce(F.try_element_at(fixed, snake), snake)).alias("column_name"),
    )


def register_functions(spark: SparkSession, known: list[str]) -> None:
    """Offer both ID functions to SQL, as temporary SQL functions."""
    keys = ", ".join(f"'{w.lower()}', '{w}'" for w in dict.fromkeys((*KNOWN_KEYS, *known)))
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION normalise_resource_id(id STRING) RETURNS STRING RETURN "
        "array_join(transform(split(id, '/'), (s, i) -> CASE WHEN i % 2 = 1 OR lower(get(split(id, '/'), i - 1)) = 'providers' "
        f"THEN coalesce(try_element_at(map({keys}), lower(s)), s) ELSE s END), '/')"
    )
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION parse_resource_id(id STRING) RETURNS {PARSED_TYPE} RETURN {_PARSED_SQL}")


PARSED_TYPE = (
    "STRUCT<subscription_id: STRING, resource_group_name: STRING, resource_provider: STRING, resource_type: STRING, "
    "full_resource_type: STRING, resource_name: STRING, resource_scope: STRING, parent_resources: MAP<STRING, STRING>>"
)
# the fields of ``parsed_id`` as one SQL expression; the list of one binds the parts of the ID
_PARSED_SQL = """transform(
  transform(array(split(regexp_extract(id, '(?i)^.*/providers/[^/]+/(.+)$', 1), '/')), tail -> named_struct(
    'provider', regexp_extract(id, '(?i)^.*/providers/([^/]+)', 1),
    'types', filter(tail, (s, i) -> i % 2 = 0),
    'names', filter(tail, (s, i) -> i % 2 = 1))),
  p -> named_struct(
    'subscription_id', regexp_extract(id, '(?i)^/subscriptions/([^/]*)', 1),
    'resource_group_name', regexp_extract(id, '(?i)^/(?:subscriptions/[^/]*/)?resourceGroups/([^/]*)', 1),
    'resource_provider', p.provider,
    'resource_type', coalesce(try_element_at(p.types, -1), ''),
    'full_resource_type', array_join(concat(array(p.provider), p.types), '/'),
    'resource_name', coalesce(try_element_at(p.names, size(p.types)), ''),
    'resource_scope', regexp_extract(id, '(?i)^(.*/providers/.*)/providers/[^/]+', 1),
    'parent_resources', map_from_entries(filter(
      transform(slice(p.names, 1, greatest(size(p.names) - 1, 0)), (n, i) -> struct(get(p.types, i) AS k, n AS v)),
      (e, i) -> NOT exists(slice(p.types, i + 2, greatest(size(p.names) - 2 - i, 0)), t -> t = e.k)))))[0]"""
