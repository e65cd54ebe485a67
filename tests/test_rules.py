"""Every rule with a row that passes, one that fails, and early exits."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from cadastre.operators import lint, snapshots

BASE = dict(
    kind="resource", resource="r", path="p", parent_path="", name="p", top_level=True, type="TypeString", elem=None,
    optional=True, required=False, computed=False, description="d", max_items=0, min_items=0, validate_func="IsUUID",
    enum_values=None, enum_literal=True, at_least_one_of=False, exactly_one_of=False, opaque=False,
    file="f", line=1, end_line=2, col=1,
)
SCHEMA = (
    "kind string, resource string, path string, parent_path string, name string, top_level boolean, type string, elem string,"
    " optional boolean, required boolean, computed boolean, description string, max_items int, min_items int, validate_func string,"
    " enum_values string, enum_literal boolean, at_least_one_of boolean, exactly_one_of boolean, opaque boolean,"
    " file string, line int, end_line int, col int"
)


def findings(spark, rule, *rows):
    table = spark.createDataFrame([Row(**{**BASE, **r}) for r in rows], SCHEMA)
    return [(r["path"], r["message"], r["rename_to"]) for r in lint.lint_properties(table, [rule]).orderBy("path").collect()]


def paths(spark, rule, *rows):
    return [p for p, _, _ in findings(spark, rule, *rows)]


def child(parent, name, **more):
    return dict(path=f"{parent}.{name}", parent_path=parent, name=name, top_level=False, **more)


def test_description(spark):
    assert paths(spark, "SL001", dict(path="a", description=None), dict(path="b", description=""), dict(path="c"), dict(path="d", description="", opaque=True)) == ["a", "b"]


def test_single_property_block(spark):
    rows = [
        dict(path="a", name="a", type="TypeList", max_items=1), child("a", "enabled", type="TypeBool"),
        dict(path="b", name="b", type="TypeList", max_items=1), child("b", "x"),
        dict(path="c", name="c", type="TypeList", max_items=1), child("c", "x"), child("c", "y"),
        dict(path="d", name="d", type="TypeList", max_items=2), child("d", "x"),
    ]
    table = spark.createDataFrame([Row(**{**BASE, **r}) for r in rows], SCHEMA)
    got = {r["path"]: r["fix"] for r in lint.lint_properties(table, ["SL002"]).collect()}
    assert got == {
        "a": 'replace the block "a" with a single top-level boolean "a_enabled"',
        "b": 'flatten "b" into a single top-level "b_x" property',
    }


def test_limits(spark):
    assert paths(spark, "SL003", dict(path="a", min_items=1), dict(path="b", max_items=1, type="TypeSet"), dict(path="c"), dict(path="d", min_items=1, opaque=True)) == ["a"]
    assert paths(spark, "SL007", dict(path="a", type="TypeList", elem="scalar"), dict(path="b", type="TypeList", elem="block"), dict(path="c", type="TypeList", elem="scalar", max_items=3), dict(path="d", type="TypeList", elem="scalar", optional=False)) == ["a"]


def test_none_values(spark):
    got = findings(
        spark, "SL004",
        dict(path="a", validate_func="StringInSlice", enum_values="Off,None,Fast"),
        dict(path="b", validate_func="StringInSlice", enum_values="ModeNone", enum_literal=True),
        dict(path="c", validate_func="StringInSlice", enum_values="ModeNone", enum_literal=False),
        dict(path="d", validate_func="IsUUID", enum_values="None"),
    )
    assert [p for p, _, _ in got] == ["a", "c"] and "accepts None, Off via" in got[0][1]


def test_validation(spark):
    assert paths(spark, "SL005", dict(path="a", validate_func=None), dict(path="b", validate_func=None, type="TypeInt"), dict(path="c", validate_func=None, type="TypeBool"), dict(path="d")) == ["a", "b"]
    rows = [dict(path=p, name="x_id", validate_func=v) for p, v in (("a", None), ("b", "StringIsNotEmpty"), ("c", "IsUUID"))]
    got = findings(spark, "SL013", *rows, dict(path="d", name="x", validate_func=None))
    assert [p for p, _, _ in got] == ["a", "b"] and "no validation" in got[0][1] and "weak" in got[1][1]


def test_block_constraint(spark):
    rows = []
    for name, extra in (("a", {}), ("b", {"required": True}), ("c", {"at_least_one_of": True}), ("d", {"opaque": True})):
        rows += [dict(path=name, name=name, type="TypeList"), child(name, "x"), child(name, "y", **extra)]
    assert paths(spark, "SL006", *rows, dict(path="e", name="e")) == ["a"]


def test_sku(spark):
    rows = [dict(path="sku_a", name="sku_a"), dict(path="sku_b", name="sku_b"), dict(path="sku_c", name="sku_c", resource="other")]
    assert paths(spark, "SL008", *rows, child("x", "sku_d"), child("x", "sku_e")) == ["sku_a", "sku_b"]


@pytest.mark.parametrize(
    ("rule", "name", "new"),
    [
        ("SL009", "timeout_seconds", "timeout_in_seconds"), ("SL009", "timeout_in_seconds", None), ("SL009", "seconds", None),
        ("SL009", "_gb", None), ("SL009", "disk_size_gb", "disk_size_in_gb"), ("SL010", "vm_size", "virtual_machine_size"),
        ("SL010", "max_vm", "maximum_virtual_machine"), ("SL010", "vmx", None), ("SL012", "tags_config", "tags"), ("SL012", "_profile", None),
        ("SL012", "config", None), ("SL012", "a_config_profile", "a_config"),
    ],
)
def test_naming(spark, rule, name, new):
    got = findings(spark, rule, dict(path=name, name=name, opaque=True))
    assert [r for _, _, r in got] == ([new] if new else [])


def test_is_prefix(spark):
    rows = [dict(path=n, name=n, type=t) for n, t in (("is_on", "TypeBool"), ("is_", "TypeBool"), ("is_x", "TypeString"))]
    assert [(p, r) for p, _, r in findings(spark, "SL011", *rows)] == [("is_on", "on")]


def test_active_rules():
    assert lint.active_rules(only=" sl001 ,SL002", disable="sl002") == ["SL001"]
    assert len(lint.active_rules()) == 13 and "SL005" not in lint.active_rules(disable="SL005")


def test_changed_lines_with_swapped_and_long_spans(spark):
    found = spark.createDataFrame([("f", 10, 5), ("f", 1, 1), ("f", 20, 900), ("g", 5, 6)], "file string, line int, end_line int")
    added = spark.createDataFrame([("f", 7), ("f", 7), ("f", 899)], "file string, line int")
    assert {tuple(r) for r in lint.changed_lines_only(found, added).collect()} == {("f", 10, 5), ("f", 20, 900)}


def test_renames_in_order(spark):
    files = spark.createDataFrame([("f", '"a" .a. "b" xa "c.d"'), ("g", "none")], "file string, text string")
    rows = [("f", 1, "b", "a"), ("f", 2, "a", "z"), ("f", 3, "a", "y"), ("f", 4, "c", "c"), ("f", 5, "c", "$1"), ("f", 6, None, "q")]
    out = lint.apply_renames(files, spark.createDataFrame(rows, "file string, seq int, rename_from string, rename_to string")).collect()
    assert len(out) == 1 and out[0]["text"] == '"z" .z. "z" xa "$1.d"'
    assert [(a["rename_from"], a["rename_to"]) for a in out[0]["applied"]] == [("b", "a"), ("a", "z"), ("c", "$1")]


def test_rename_that_opens_the_way_for_an_earlier_one(spark):
    files = spark.createDataFrame([("f", '"x"')], "file string, text string")
    rows = [("f", 1, "a", "b"), ("f", 2, "x", "a"), ("f", 3, "a", "b")]
    out = lint.apply_renames(files, spark.createDataFrame(rows, "file string, seq int, rename_from string, rename_to string")).collect()
    assert out[0]["text"] == '"b"'


def test_rename_that_makes_a_part_of_a_name(spark):
    files = spark.createDataFrame([("f", '"a"')], "file string, text string")
    rows = [("f", 1, "b", "c"), ("f", 2, "a", "x.b"), ("f", 3, "b", "c"), ("f", 4, "x.c", "q")]
    out = lint.apply_renames(files, spark.createDataFrame(rows, "file string, seq int, rename_from string, rename_to string")).collect()
    assert out[0]["text"] == '"q"'


def test_many_renames_of_one_file(spark):
    """10,000 renames, of which 300 find their name, against plain replacement."""
    import re
    import time

    text = "\n".join(f'x"n{i}"y' for i in range(0, 30_000, 100))
    rows = [("f", i, f"n{i}", f"m{i}") for i in range(10_000)] + [("g", 1, "n1", "q")]
    want = re.sub(r'"n(\d{1,4})"', r'"m\1"', text)
    files = spark.createDataFrame([("f", text), ("g", "none"), ("h", '"n1"')], "file string, text string")
    start = time.perf_counter()
    out = lint.apply_renames(files, spark.createDataFrame(rows, "file string, seq int, rename_from string, rename_to string")).collect()
    assert time.perf_counter() - start < 30
    assert [(r["file"], r["text"], len(r["applied"])) for r in out] == [("f", want, 100)]


PROPERTY = (
    "kind string, resource string, path string, name string, depth int, type string, optional boolean, required boolean,"
    " computed boolean, force_new boolean, default_value string, max_items int, min_items int"
)


def prop(path, kind="resource", type="TypeString", optional=False, required=False, computed=False, default=None):
    return (kind, "r", path, path.split(".")[-1], path.count(".") + 1, type, optional, required, computed, False, default, 0, 0)


def broken(spark, base, current, **options):
    diff = snapshots.snapshot_diff(spark.createDataFrame(base, PROPERTY), spark.createDataFrame(current, PROPERTY))
    return {(r["path"], r["rule"]) for r in snapshots.breaking_changes(diff, **options).collect()}


def test_breaking_changes(spark):
    base = [
        prop("a", optional=True), prop("b", optional=True, computed=True), prop("c", optional=True), prop("d"), prop("e", type="TypeSet"),
        prop("gone", required=True), prop("blk.x", optional=True), prop("ds", kind="data source", optional=True),
    ]
    current = [
        prop("a", computed=True), prop("b", optional=True), prop("c", required=True), prop("d", type="TypeInt"), prop("e", type="TypeList"),
        prop("new", required=True), prop("blk.new", required=True), prop("blk.x", optional=True, default="1"),
        prop("ds", kind="data source", required=True, type="TypeInt"),
    ]
    expected = {
        ("a", "become_computed_only"), ("b", "optional_remove_computed"), ("c", "optional_to_required"), ("d", "property_type"),
        ("new", "new_required_property"), ("ds", "property_type"),
    }
    assert broken(spark, base, current) == expected
    assert broken(spark, base, current, visit_new=True) == expected | {("blk.new", "new_required_property")}
    assert ("blk.x", "default_value_change") in broken(spark, base, current, rules=("default_value_change",))


def test_combined_schema_errors(spark):
    schema = "resource string, name string, optional boolean, required boolean, computed boolean"
    arguments = spark.createDataFrame([("r", "a", True, False, False), ("r", "b", False, False, True)], schema)
    attributes = spark.createDataFrame([("r", "a", False, False, False), ("r", "c", True, False, False), ("r", "d", False, False, False)], schema)
    got = {(r["name"], r["side"]): r for r in snapshots.combine_schemas(arguments, attributes).collect()}
    assert got["a", "argument"]["error"] is None and "Computed-only" in got["b", "argument"]["error"]
    assert "already exists" in got["a", "attribute"]["error"] and "user-specifyable" in got["c", "attribute"]["error"]
    assert got["d", "attribute"]["error"] is None and got["d", "attribute"]["computed"] is True


def test_paths(spark):
    rows = spark.createDataFrame([("a.0.b",), ("a",), ("a.-1",)], "path string")
    got = {r["path"]: r for r in snapshots.path_segments(rows).collect()}
    assert [s["kind"] for s in got["a.0.b"]["segments"]] == ["attribute", "index", "attribute"]
    assert got["a.0.b"]["parent"] == "a.0" and got["a"]["parent"] == "a" and got["a.-1"]["segments"][1]["kind"] == "index"


def test_count_of_no_findings(spark):
    empty = spark.createDataFrame([], "severity string, rename_from string")
    row = lint.finding_counts(empty).collect()[0]
    assert (row["errors"], row["warnings"], row["has_errors"]) == (0, 0, False)


def test_dedupe_keeps_first(spark):
    rows = [(2, "R", "f", 1, 1, "late"), (1, "R", "f", 1, 1, "early"), (3, "R", "f", 2, 1, "other")]
    df = spark.createDataFrame(rows, "seq int, rule_id string, file string, line int, col int, message string")
    assert {r["message"] for r in lint.dedupe_findings(df).collect()} == {"early", "other"}
    assert [r["line"] for r in lint.sort_findings(df.where(F.col("seq") > 1)).collect()] == [1, 2]


def _property(path, parent="", kind="resource", resource="r", **more):
    name = path.rsplit(".", 1)[-1] if path is not None else ""
    row = BASE | dict(kind=kind, resource=resource, path=path, parent_path=parent, name=name, top_level=parent == "")
    return row | more


def test_tree_context_shuffles_properties_once(spark):
    rows = [
        _property("sku_a"), _property("sku_b"), _property("sku_b"), _property("box", type="TypeList"), _property("box", type="TypeList", line=9), _property("other"),
        _property("box.x", "box", type="TypeInt"), _property("box.w", "box", required=True), _property("box.w.deep", "box.w", opaque=True),
        _property("sku_a", resource="s"), _property("box", resource="s"), _property("box", kind="data source"),
        _property("sku_a", resource=None), _property("sku_b", resource=None), _property("box", resource=None), _property("box.x", "box", resource=None),
        _property("box.x", None, resource="s"), _property(None, resource="s"), _property("", resource="s"),
    ]
    fields = [t.split()[0] for t in SCHEMA.split(", ")]
    frame = spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], SCHEMA)
    found = lint.with_tree_context(frame)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    want = []
    for r in rows:
        inside = [c for c in rows if None not in (r["kind"], r["resource"]) and (c["kind"], c["resource"]) == (r["kind"], r["resource"])]
        kids = [c for c in inside if c["parent_path"] and c["parent_path"] == r["path"]]
        level = [c for c in inside if c["parent_path"] is not None and c["parent_path"] == r["parent_path"] and c["top_level"] and c["name"].startswith("sku_")]
        want.append((
            r["kind"], r["resource"], r["path"], r["line"], len(level), len(kids), min((c["name"] for c in kids), default=""), min((c["type"] for c in kids), default=""),
            any(c["opaque"] for c in kids), any(not c["opaque"] and c["required"] for c in kids),
        ))
    got = found.select("kind", "resource", "path", "line", "n_sku", "n_children", "child", "child_type", "child_opaque", "constrained").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_rule_texts_read_nulls_as_words(spark):
    got = spark.range(1).select(lint._say("SL003", F.lit("p"), F.lit(None).cast("string"))).first()[0]
    assert got == 'property "p" (null) sets MinItems/MaxItems, which only apply to TypeList/TypeSet'
