"""Lint rules over the property table, and what is done with their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Rule id -> (name, severity, fixable).
RULES = {
    "SL001": ("property-description-required", "warning", False),
    "SL002": ("single-property-block", "warning", True),
    "SL003": ("limits-on-non-collection", "error", True),
    "SL004": ("avoid-none-value", "warning", False),
    "SL005": ("validation-required", "warning", False),
    "SL006": ("block-needs-constraint", "warning", False),
    "SL007": ("array-limits", "warning", False),
    "SL008": ("sku-field-naming", "warning", False),
    "SL009": ("unit-in-naming", "warning", True),
    "SL010": ("no-abbreviations", "warning", True),
    "SL011": ("redundant-is-prefix", "warning", True),
    "SL012": ("redundant-suffix", "warning", True),
    "SL013": ("id-reference-validation", "warning", False),
}

# Dictionaries of the naming rules.
NONE_VALUES = ("None", "Off", "Default", "Disabled")
REDUNDANT_SUFFIXES = ("_properties", "_config", "_profile")
UNIT_SUFFIXES = (
    "bytes", "kib", "mib", "gib", "tib", "kb", "mb", "gb", "tb", "pb", "kbps", "mbps", "gbps",
    "ms", "seconds", "secs", "sec", "minutes", "hours", "hrs", "days",
)
ABBREVIATIONS = {
    "vm": "virtual_machine",
    "vmss": "virtual_machine_scale_set",
    "rg": "resource_group",
    "vnet": "virtual_network",
    "nsg": "network_security_group",
    "nic": "network_interface",
    "fqdn": "fully_qualified_domain_name",
    "rt": "route_table",
    "lb": "load_balancer",
    "waf": "web_application_firewall",
    "sec": "seconds",
    "addr": "address",
    "msg": "message",
    "num": "number",
    "cfg": "configuration",
    "db": "database",
    "dbs": "databases",
    "mgmt": "management",
    "min": "minimum",
    "hr": "hours",
    "max": "maximum",
    "svc": "service",
    "src": "source",
    "dest": "destination",
    "pwd": "password",
    "passwd": "password",
    "pct": "percentage",
    "percent": "percentage",
    "email_address": "email",
}

# Message and suggestion formats.
TEXTS = {
    "SL001": 'property "%s" is missing a description',
    "SL002": 'block "%s" has a single nested property "%s" (MaxItems 1); consider flattening it',
    "SL002.fix": 'flatten "%s" into a single top-level "%s" property',
    "SL002.fix.enabled": 'replace the block "%s" with a single top-level boolean "%s"',
    "SL003": 'property "%s" (%s) sets MinItems/MaxItems, which only apply to TypeList/TypeSet',
    "SL003.fix": 'remove MinItems/MaxItems from "%s"',
    "SL004": 'property "%s" accepts %s via validation; omit these values (leave the property unset) and normalise in Create/Read',
    "SL005.string": 'string property "%s" has no validation; add a ValidateFunc (StringIsNotEmpty at minimum)',
    "SL005.number": 'numeric property "%s" has no validation; specify a valid range at minimum',
    "SL006": 'block "%s" has no required fields and no AtLeastOneOf/ExactlyOneOf; add conditional validation so it cannot be configured empty',
    "SL007": 'array property "%s" does not set MaxItems; declare MinItems/MaxItems based on the API constraints',
    "SL008": 'argument "%s" uses the sku_* format; with multiple sku_* arguments, prefer a single `sku` block',
    "SL009": 'property "%s" uses a bare unit suffix; prefer the "%s" naming convention ("%s")',
    "SL010": 'property "%s" uses an abbreviation; prefer full words ("%s")',
    "SL011": 'boolean property "%s" has a redundant "is_" prefix ("%s")',
    "SL012": 'property "%s" has a redundant "%s" suffix ("%s")',
    "SL013.none": 'ID reference "%s" has no validation; use a resource-specific ID validator (e.g. a commonids Validate...ID function) or validation.IsUUID',
    "SL013.weak": 'ID reference "%s" uses weak validation (accepts arbitrary strings); use a resource-specific ID validator or validation.IsUUID',
    "rename": 'rename "%s" to "%s"',
}

LOCATION = ["resource", "kind", "path", "file", "line", "end_line", "col"]
FINDING_KEY = ["rule_id", "file", "line", "col"]


_NO_CONTEXT = {
    "n_sku": 0, "n_children": 0, "child": "", "child_type": "", "child_opaque": False, "constrained": False,
}


def _literals(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def active_rules(only: str = "", disable: str = "") -> list[str]:
    """Rule ids to run: comma lists, trimmed and upper-cased; ``disable`` wins."""
    chosen, dropped = (
        {part.strip().upper() for part in text.split(",") if part.strip()} for text in (only, disable)
    )
    return [r for r in RULES if r not in dropped and (not chosen or r in chosen)]


def with_tree_context(properties: DataFrame, children: bool = True, siblings: bool = True) -> DataFrame:
    """Add what rules need to know of children and of sku siblings.

    Properties are shuffled once, by resource. Levels are summed up over a window; the first
    property of a level brings its sums to the property that holds the level, over a second window by path.
    """
    if not (children or siblings):
        return properties.select("*", *(F.lit(zero).alias(c) for c, zero in _NO_CONTEXT.items()))
    constrained = ~F.col("opaque") & (F.col("required") | F.col("at_least_one_of") | F.col("exactly_one_of"))
    sku = F.col("top_level") & F.col("name").startswith("sku_")
    # a number first: sorting by it takes far less time than by names that begin alike
    one_resource = [F.xxhash64("kind", "resource"), "kind", "resource"]
    by_path = Window.partitionBy(*one_resource, "parent_path").orderBy("path")
    level = by_path.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = F.col("kind").isNotNull() & F.col("resource").isNotNull()
    context = {c: F.lit(zero) for c, zero in _NO_CONTEXT.items()}
    out = properties.repartition("kind", "resource")
    if siblings:
        out = out.withColumn("n_sku", F.count(F.when(sku, 1)).over(level))
        context["n_sku"] = F.when(named & F.col("parent_path").isNotNull(), F.col("n_sku")).otherwise(0)
    if children:
        sums = {
            "n_children": F.count("*"), "child": F.min("name"), "child_type": F.min("type"),
            "child_opaque": F.bool_or("opaque"), "constrained": F.bool_or(constrained),
        }
        out = out.withColumns({c: f.over(level) for c, f in sums.items()} | {"at_level": F.row_number().over(by_path)})
        brings = named & (F.col("parent_path") != "") & (F.col("at_level") == 1)
        out = out.withColumn("brought", F.explode(F.when(brings, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        out = out.withColumn("at", F.when(F.col("brought"), F.col("parent_path")).otherwise(F.col("path")))
        own = F.max(F.when(F.col("brought"), F.struct(*sums))).over(Window.partitionBy(*one_resource, "at"))
        out = out.withColumn("own", own).where(~F.col("brought"))
        context |= {c: F.coalesce(F.col(f"own.{c}"), F.lit(_NO_CONTEXT[c])) for c in sums}
    return out.select(*properties.columns, *(c.alias(n) for n, c in context.items()))


def _say(rule: str, *values) -> Column:
    """The text of a rule with its values; a null reads as the word, as in a format."""
    first, *rest = TEXTS[rule].split("%s")
    filled = [F.concat(F.coalesce(v, F.lit("null")), F.lit(t)) for v, t in zip((F.col(v) if isinstance(v, str) else v for v in values), rest, strict=True)]
    return F.concat(F.lit(first), *filled)


def _rule_hits() -> dict[str, Column]:
    """Each rule as a column: null, or struct(rule_id, rule_name, severity, message, fix, rename_to). Reads ``spelt``."""
    path, name, kind = F.col("path"), F.col("name"), F.col("type")
    has_schema = ~F.col("opaque")
    settable = has_schema & (F.col("optional") | F.col("required"))
    collection = kind.isin("TypeList", "TypeSet")
    limits = (F.coalesce("min_items", F.lit(0)) != 0) | (F.coalesce("max_items", F.lit(0)) != 0)
    validated = F.col("validate_func").isNotNull()
    tail = F.substring_index(name, "_", -1)

    def hit(rule, condition, message, fix=None, rename_to=None) -> Column:
        rule_name, severity, _ = RULES[rule]
        return F.when(
            condition,
            F.struct(
                F.lit(rule).alias("rule_id"), F.lit(rule_name).alias("rule_name"), F.lit(severity).alias("severity"),
                message.alias("message"),
                (F.lit(None).cast("string") if fix is None else fix).alias("fix"),
                (F.lit(None).cast("string") if rename_to is None else rename_to).alias("rename_to"),
            ),
        )

    def renaming(rule, condition, message, preferred) -> Column:
        return hit(rule, condition, message, _say("rename", name, preferred), preferred)

    block_name = F.concat_ws("_", name, F.col("child"))
    enums = F.split("enum_values", ",")
    accepted = F.filter(
        _literals(NONE_VALUES),
        lambda v: F.exists(enums, lambda e: F.when(F.col("enum_literal"), e == v).otherwise(e.endswith(v))),
    )
    in_unit = F.concat(F.expr("left(name, length(name) - length(substring_index(name, '_', -1)))"), F.lit("in_"), tail)
    spelt = F.col("spelt")
    suffix = F.regexp_extract(name, "(" + "|".join(REDUNDANT_SUFFIXES) + ")$", 1)
    stem = F.expr("left(name, length(name) - length(regexp_extract(name, '(" + "|".join(REDUNDANT_SUFFIXES) + ")$', 1)))")
    return {
        "SL001": hit("SL001", has_schema & (F.coalesce("description", F.lit("")) == ""), _say("SL001", path)),
        "SL002": hit(
            "SL002", has_schema & (F.col("max_items") == 1) & (F.col("n_children") == 1),
            _say("SL002", path, "child"),
            F.when(
                (F.col("child") == "enabled") & (F.col("child_type") == "TypeBool") & ~F.col("child_opaque"),
                _say("SL002.fix.enabled", path, block_name),
            ).otherwise(_say("SL002.fix", path, block_name)),
        ),
        "SL003": hit("SL003", has_schema & ~collection & limits, _say("SL003", path, kind), _say("SL003.fix", path)),
        "SL004": hit(
            "SL004", settable & (F.col("validate_func") == "StringInSlice") & (F.size(accepted) > 0),
            _say("SL004", path, F.array_join(accepted, ", ")),
        ),
        "SL005": hit(
            "SL005", settable & ~validated & kind.isin("TypeString", "TypeInt", "TypeFloat"),
            F.when(kind == "TypeString", _say("SL005.string", path)).otherwise(_say("SL005.number", path)),
        ),
        "SL006": hit(
            "SL006", settable & (F.col("n_children") > 0) & ~F.col("child_opaque") & ~F.col("constrained"), _say("SL006", path)
        ),
        "SL007": hit(
            "SL007", settable & collection & (F.col("elem") == "scalar") & (F.coalesce("max_items", F.lit(0)) == 0),
            _say("SL007", path),
        ),
        "SL008": hit("SL008", F.col("top_level") & name.startswith("sku_") & (F.col("n_sku") > 1), _say("SL008", path)),
        "SL009": renaming(
            "SL009", name.rlike("._[a-z]+$") & tail.isin(*UNIT_SUFFIXES) & ~name.rlike("_in_[a-z]+$"),
            _say("SL009", path, F.concat(F.lit("_in_"), tail), in_unit),
            in_unit,
        ),
        "SL010": renaming("SL010", spelt != name, _say("SL010", path, spelt), spelt),
        "SL011": renaming(
            "SL011", has_schema & (kind == "TypeBool") & name.rlike("^is_."),
            _say("SL011", path, F.substr(name, F.lit(4))),
            F.substr(name, F.lit(4)),
        ),
        "SL012": renaming("SL012", (suffix != "") & (stem != ""), _say("SL012", path, suffix, stem), stem),
        "SL013": hit(
            "SL013", settable & (kind == "TypeString") & name.endswith("_id")
            & (~validated | (F.col("validate_func") == "StringIsNotEmpty")),
            F.when(~validated, _say("SL013.none", path)).otherwise(_say("SL013.weak", path)),
        ),
    }


def _spelt() -> Column:
    """The name in full words; several parts of a rule read it, so it is taken once for a row."""
    # every key of the dictionary is one segment, but for one that can never match
    full = F.create_map(*(F.lit(x) for pair in ABBREVIATIONS.items() for x in pair))
    return F.array_join(F.transform(F.split("name", "_"), lambda w: F.coalesce(F.try_element_at(full, w), w)), "_")


def lint_properties(properties: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Findings of the chosen rules, all tested in one pass over the table.

    The tree context is only computed if a rule asks for it.
    """
    chosen = list(RULES) if rules is None else rules
    properties = with_tree_context(
        properties, children=bool({"SL002", "SL006"} & set(chosen)), siblings="SL008" in chosen
    )
    if "SL010" in chosen:
        properties = properties.withColumn("spelt", _spelt())
    hits = _rule_hits()
    return properties.select(
        *LOCATION, "name", F.explode(F.array_compact(F.array(*(hits[rule] for rule in chosen)))).alias("r")
    ).select(
        "r.rule_id", "r.rule_name", "r.severity", *LOCATION, "r.message", "r.fix",
        F.when(F.col("r.rename_to").isNotNull(), F.col("name")).alias("rename_from"), "r.rename_to",
    )


def rule_dictionaries(spark: SparkSession) -> DataFrame:
    """The naming dictionaries as one literal table (dictionary, key, value)."""
    rows = [("abbreviation", k, v) for k, v in ABBREVIATIONS.items()]
    rows += [("unit", u, "in_" + u) for u in UNIT_SUFFIXES]
    rows += [("suffix", s, "") for s in REDUNDANT_SUFFIXES]
    rows += [("none_value", v, "") for v in NONE_VALUES]
    return spark.createDataFrame(rows, "dictionary STRING, key STRING, value STRING")


def select_rules(findings: DataFrame, only: str = "", disable: str = "") -> DataFrame:
    """Findings of active rules only."""
    return findings.where(F.col("rule_id").isin(active_rules(only, disable)))


def changed_lines_only(findings: DataFrame, added: DataFrame, bucket: int = 64) -> DataFrame:
    """Findings whose span [line, end_line] holds an added line.

    A range join has no equality to shuffle on, so lines are put into buckets:
    a span meets only the buckets it touches, and even one huge file spreads
    over many tasks. Spans with swapped ends count too. Equal findings fold.
    """
    lo, hi = F.least("line", "end_line"), F.greatest("line", "end_line")
    spans = findings.select(
        *findings.columns,
        lo.alias("lo"), hi.alias("hi"),
        F.explode(F.sequence(F.floor(lo / bucket), F.floor(hi / bucket))).alias("bucket"),
    )
    lines = added.select(
        F.col("file").alias("a_file"), F.col("line").alias("a_line"), F.floor(F.col("line") / bucket).alias("a_bucket")
    ).distinct()
    return (
        spans.join(
            lines,
            (F.col("file") == F.col("a_file")) & (F.col("bucket") == F.col("a_bucket"))
            & F.col("a_line").between(F.col("lo"), F.col("hi")),
            "left_semi",
        )
        .select(*findings.columns)
        .distinct()
    )


def dedupe_findings(findings: DataFrame, order: str = "seq") -> DataFrame:
    """First finding per (rule, file, line, column), by least ``order``.

    An aggregate rather than a window: copies fold before the shuffle.
    """
    rest = [c for c in findings.columns if c not in FINDING_KEY]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("first")
    return findings.groupBy(*FINDING_KEY).agg(first).select(*FINDING_KEY, "first.*").select(*findings.columns)


def sort_findings(findings: DataFrame) -> DataFrame:
    """Findings by file, line, column and rule."""
    return findings.orderBy("file", "line", "col", "rule_id")


def finding_counts(findings: DataFrame) -> DataFrame:
    """Errors, everything else as warnings, whether any error, and how many lack a rename."""
    error = F.col("severity") == "error"
    return findings.agg(
        F.count(F.when(error, 1)).alias("errors"),
        F.count(F.when(~error, 1)).alias("warnings"),
        F.coalesce(F.bool_or(error), F.lit(False)).alias("has_errors"),
        F.count(F.when(F.col("rename_from").isNull(), 1)).alias("unfixed"),
    )


def apply_renames(files: DataFrame, renames: DataFrame) -> DataFrame:
    """Rename quoted or dotted names in file texts.

    ``files`` has (file, text), ``renames`` (file, seq, rename_from, rename_to).
    Renames of a file are applied in order, and the first one of a name that
    changed something wins. Returns (file, text, applied) of changed files.

    Only a file's own renames are gathered. Repeats of a rename are folded first unless its
    name can come from another rename, where the order of the repeats matters. Names between the
    marks of a text are met with the names of its renames as sets, so a rename
    whose name is neither in the text nor made by another costs no pass over the text.
    """
    marks = r'[".]'
    wanted = renames.where("rename_from <> '' AND rename_to <> '' AND rename_from <> rename_to")
    made = F.concat(F.array("rename_to"), F.split("rename_to", marks))
    targets = wanted.select("file", F.explode(made).alias("rename_from")).distinct()
    key = ["file", "rename_from", "rename_to"]
    plain = ~F.col("rename_from").rlike(marks)
    once = (
        wanted.where(plain).join(targets, ["file", "rename_from"], "left_anti")
        .groupBy(*key).agg(F.min("seq").alias("seq")).withColumn("chained", F.lit(False))
    )
    chained = wanted.where(plain).join(targets, ["file", "rename_from"], "left_semi").unionByName(wanted.where(~plain))
    per_name = (
        once.unionByName(chained.select(*key, "seq", F.lit(True).alias("chained")))
        .groupBy("file", "chained", "rename_from")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "rename_from", "rename_to"))).alias("renames"))
    )
    per_file = per_name.groupBy("file").agg(
        F.map_from_entries(F.collect_list(F.when(~F.col("chained"), F.struct("rename_from", "renames")))).alias("by_name"),
        F.flatten(F.collect_list(F.when(F.col("chained"), F.col("renames")))).alias("always"),
    )
    present = F.array_intersect(F.map_keys("by_name"), F.split("text", marks))
    found = F.flatten(F.transform(present, lambda name: F.element_at("by_name", name)))

    def step(state: Column, rename: Column) -> Column:
        old, new = rename["rename_from"], rename["rename_to"]
        pattern = F.concat(F.lit('([".])\\Q'), old, F.lit('\\E([".])'))
        target = F.concat(F.lit("$1"), F.regexp_replace(new, r"([\\$])", r"\\$1"), F.lit("$2"))
        text = F.when(F.contains(state["text"], old), F.regexp_replace(state["text"], pattern, target)).otherwise(state["text"])
        seen = F.exists(state["applied"], lambda a: a["rename_from"] == old)
        done = F.struct(
            text.alias("text"),
            F.concat(
                state["applied"], F.array(F.struct(old.alias("rename_from"), new.alias("rename_to")))
            ).alias("applied"),
        )
        return F.when(seen | (text == state["text"]), state).otherwise(done)

    start = F.struct(
        F.col("text").alias("text"),
        F.array().cast("array<struct<rename_from:string,rename_to:string>>").alias("applied"),
    )
    return (
        files.join(per_file, "file")
        .withColumn("renames", F.sort_array(F.concat("always", found)))
        .where(F.size("renames") > 0)
        .select("file", F.aggregate("renames", start, step).alias("out"))
        .where(F.size("out.applied") > 0)
        .select("file", "out.text", "out.applied")
    )
