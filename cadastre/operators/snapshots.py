"""Flattening, querying and comparing schema snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.session import materialise
from cadastre.sources.snapshots import property_columns

KEY = ["kind", "resource", "path"]
ATTRIBUTES = ["type", "optional", "required", "computed", "force_new", "default_value", "max_items", "min_items"]
COLLECTIONS = ("TypeList", "TypeSet")

def flatten_properties(resources: DataFrame) -> DataFrame:
    """Nested properties as rows (kind, resource, path, name, parent_path, depth, top_level, node).

    Level by level: the rows of the deepest level that hold a schema bring forth
    their children, without a shuffle, until no row does. Each level is written to
    the shared folder, so a shallow row is read once however deep others go.
    """

    def inner(schema: str, *columns) -> list:
        return [*columns, F.explode(F.expr(f"variant_get(node, '{schema}', 'map<string,variant>')")).alias("name", "node")]

    level = resources.select(*inner("$.schema", "kind", "resource")).select(
        "kind", "resource", F.col("name").alias("path"), "name", F.lit("").alias("parent_path"), F.lit(1).alias("depth"), "node"
    )
    level = materialise(level, "properties")
    out = level
    while True:
        children = level.where("variant_get(node, '$.elem.schema') IS NOT NULL").select(
            *inner("$.elem.schema", "kind", "resource", F.col("path").alias("parent_path"), (F.col("depth") + 1).alias("depth"))
        )
        level = materialise(
            children.select("kind", "resource", F.concat_ws(".", "parent_path", "name").alias("path"), "name", "parent_path", "depth", "node"), "properties"
        )
        if level.isEmpty():
            return out.select("kind", "resource", "path", "name", "parent_path", "depth", (F.col("depth") == 1).alias("top_level"), "node")
        out = out.unionByName(level)


def property_attributes(flat: DataFrame) -> DataFrame:
    """Typed attributes of flattened nodes, and what kind of collection each one is."""
    typed = flat.select("*", *property_columns())
    collection = F.col("type").isin(*COLLECTIONS)
    return typed.select(
        "*",
        collection.alias("is_collection"),
        (collection & (F.coalesce("elem", F.lit("")) == "block")).alias("is_block"),
        (F.col("elem").isNotNull() & (F.col("elem") != "block")).alias("elem_is_scalar"),
        F.expr("variant_get(node, '$.maxItems') IS NOT NULL").alias("declares_max_items"),
    ).drop("node")


def children_by_parent(properties: DataFrame) -> DataFrame:
    """Per level: number of properties, and the name and type of an only child."""
    return properties.groupBy("kind", "resource", "parent_path").agg(
        F.count("*").alias("n_children"),
        F.when(F.count("*") == 1, F.min("name")).alias("only_child"),
        F.when(F.count("*") == 1, F.min("type")).alias("only_child_type"),
    )


def children_and_siblings(properties: DataFrame) -> DataFrame:
    """Every property with its child count, only child and sibling count (itself included)."""
    levels = children_by_parent(properties).drop("only_child_type")
    siblings = levels.select("kind", "resource", "parent_path", F.col("n_children").alias("n_siblings"))
    children = levels.withColumnRenamed("parent_path", "path")
    return (
        properties.select("kind", "resource", "parent_path", "path", "name")
        .join(siblings, ["kind", "resource", "parent_path"])
        .join(children, KEY, "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    )


def lookup_schema(resources: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted (kind, resource) with their node; an unknown name gives an error row."""
    found = resources.withColumn("hit", F.lit(True))
    return wanted.join(found, ["kind", "resource"], "left").withColumn(
        "error", F.when(F.col("hit").isNull(), F.lit("resource not found"))
    ).drop("hit")


def property_path_exists(wanted: DataFrame, properties: DataFrame) -> DataFrame:
    """Mark wanted (resource, path) rows that exist among the properties."""
    have = properties.select("resource", "path").distinct().withColumn("hit", F.lit(True))
    return wanted.join(have, ["resource", "path"], "left").select(
        *wanted.columns, F.col("hit").isNotNull().alias("exists")
    )


def combine_schemas(arguments: DataFrame, attributes: DataFrame) -> DataFrame:
    """Arguments and attributes as one schema, with an error text per bad row.

    Both have (resource, name, optional, required, computed). Attributes are
    forced to computed.
    """
    def q(text: str) -> Column:
        return F.format_string('"%s"' + text, "name")

    settable = F.col("optional") | F.col("required")
    taken = arguments.select("resource", "name").distinct().withColumn("taken", F.lit(True))
    args = arguments.select(
        "resource", "name", "optional", "required", "computed", F.lit("argument").alias("side"),
        F.when(
            F.col("computed") & ~settable,
            q(" is a Computed-only field - this should be specified as an Attribute"),
        ).alias("error"),
    )
    attrs = attributes.join(taken, ["resource", "name"], "left").select(
        "resource", "name", "optional", "required", F.lit(True).alias("computed"), F.lit("attribute").alias("side"),
        F.when(F.col("taken"), q(" already exists in the schema"))
        .when(settable, q(" is a user-specifyable field - this should be specified as an Argument"))
        .alias("error"),
    )
    return args.unionByName(attrs)


def timeouts_in_minutes(timeouts: DataFrame, key: str) -> DataFrame:
    """Columns create, read, update, delete in seconds to rows (key, action, minutes)."""
    return timeouts.unpivot(key, ["create", "read", "update", "delete"], "action", "seconds").select(
        key, "action", F.expr("seconds div 60").alias("minutes")
    )


def snapshot_diff(base: DataFrame, current: DataFrame) -> DataFrame:
    """Full outer match on (kind, resource, path): added, removed, changed or same.

    ``b`` and ``c`` hold both sides' attributes.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*KEY, F.struct(*ATTRIBUTES, "name", "depth").alias(name))

    joined = side(base, "b").join(side(current, "c"), KEY, "full_outer")
    differs = F.lit(False)
    for attribute in ATTRIBUTES:
        differs = differs | ~F.col(f"b.{attribute}").eqNullSafe(F.col(f"c.{attribute}"))
    status = (
        F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "removed").when(differs, "changed").otherwise("same")
    )
    return joined.withColumn("status", status)


def _flag(side: str, attribute: str) -> Column:
    return F.coalesce(F.col(f"{side}.{attribute}"), F.lit(False))


def _text(side: str, attribute: str) -> Column:
    return F.coalesce(F.col(f"{side}.{attribute}"), F.lit(""))


def rule_conditions() -> dict[str, tuple[Column, str, tuple[Column, ...]]]:
    """Breaking-change rules over a diff row: condition, message format and its values.

    The message formats are fixed values, except that of ``default_value_change``:
    that rule is off by default and its usual text belongs to another rule, so it
    has one of its own here.
    """
    name = F.coalesce("b.name", "c.name")
    base_set = _flag("b", "optional") | _flag("b", "required")
    current_set = _flag("c", "optional") | _flag("c", "required")
    base_type, current_type = _text("b", "type"), _text("c", "type")
    return {
        "become_computed_only": (
            base_set & ~current_set & _flag("c", "computed"),
            'Cannot change property "%s" to Computed only',
            (name,),
        ),
        "new_required_property": (
            (base_type == "") & _flag("c", "required"),
            'new property "%s" is Required',
            (name,),
        ),
        "optional_remove_computed": (
            _flag("b", "optional") & _flag("b", "computed") & _flag("c", "optional") & ~_flag("c", "computed"),
            'cannot remove Computed from the Optional property "%s" as the user config may not supply the value, thus causing a diff',
            (name,),
        ),
        "optional_to_required": (
            _flag("b", "optional") & _flag("c", "required"),
            'Cannot change property "%s" from Optional to Required',
            (name,),
        ),
        "property_type": (
            (base_type != "") & (current_type != "") & (base_type != "TypeSet") & (base_type != current_type),
            'schema type has changed for "%s" (%s to %s)',
            (name, base_type, current_type),
        ),
        "default_value_change": (
            ~F.col("b.default_value").eqNullSafe(F.col("c.default_value")),
            'default of property "%s" has changed',
            (name,),
        ),
    }


ACTIVE_RULES = (
    "become_computed_only", "new_required_property", "optional_remove_computed", "optional_to_required", "property_type",
)
DATA_SOURCE_RULES = ("property_type",)


def breaking_changes(
    diff: DataFrame,
    rules: tuple[str, ...] = ACTIVE_RULES,
    data_source_rules: tuple[str, ...] = DATA_SOURCE_RULES,
    visit_new: bool = False,
) -> DataFrame:
    """One row (kind, resource, path, rule, message) per rule that a change breaks.

    All rules are tested in one pass over the diff. Below the top level only
    properties that the base has are visited, unless ``visit_new``.
    """
    conditions = rule_conditions()
    hits = []
    for rule in dict.fromkeys((*rules, *data_source_rules)):
        condition, text, values = conditions[rule]
        kinds = [k for k, chosen in (("resource", rules), ("data source", data_source_rules)) if rule in chosen]
        hits.append(
            F.when(
                F.col("kind").isin(kinds) & condition,
                F.struct(F.lit(rule).alias("rule"), F.format_string(text, *values).alias("message")),
            )
        )
    visited = diff if visit_new else diff.where("b IS NOT NULL OR c.depth = 1")
    return visited.select(*KEY, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(*KEY, "hit.*")


def path_segments(paths: DataFrame, column: str = "path") -> DataFrame:
    """Segments of a dotted path (integers are list indexes), its parent and its leaf.

    A path without a dot is its own parent.
    """
    segments = F.transform(
        F.split(column, r"\."),
        lambda s: F.struct(
            F.when(F.regexp_like(s, F.lit("^[+-]?[0-9]+$")), "index").otherwise("attribute").alias("kind"),
            s.alias("value"),
        ),
    )
    return paths.select(
        "*",
        segments.alias("segments"),
        F.regexp_replace(column, r"\.[^.]*$", "").alias("parent"),
        F.substring_index(column, ".", -1).alias("leaf"),
    )
