"""Readers and writers on small files."""

import json

from pyspark.sql import functions as F

from cadastre.operators import registry, symbols
from cadastre.operators import snapshots as schema_ops
from cadastre.operators.snapshots import flatten_properties
from cadastre.sources import snapshots, text
from cadastre.sources.symbol_index import parse_symbol_path, parse_symbol_text, scan_symbol_index

BODY = """package example.org/x
import (
    "fmt"
    al "example.org/sdk/2024-01-01/things"
)
func expandPlan(input []any) *things.Plan {
    return al.New(fmt.Sprint(flattenPlan(input)), x.fmtless())
}
"""


def _index(tmp_path):
    files = {
        "internal/services/lake/func.expandPlan.goindex": BODY,
        "internal/services/lake/func.flattenPlan.goindex": "package example.org/x\nfunc flattenPlan() {}\n",
        "internal/services/lake/parse/method.LakeId.ID.goindex": 'package p\nimport "fmt"\nfunc (id LakeId) ID() string {\n}\n',
        "internal/Services/pond/type.Pond.goindex": "package p\ntype Pond struct{}\n",
        "internal/tools/var.x.goindex": "package p\nvar x = 1\n",
        "internal/tools/notes.txt": "no symbol",
    }
    for name, body in files.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body)
    return str(tmp_path)


def test_scan_and_parse(spark, tmp_path):
    root = _index(tmp_path)
    found = scan_symbol_index(spark, [root, root + "/internal/tools"])
    assert found.count() == 5
    rows = {r["name"]: r for r in parse_symbol_text(parse_symbol_path(found)).collect()}
    assert rows["expandPlan"]["service"] == "lake" and rows["expandPlan"]["subpackage"] == ""
    assert rows["ID"]["receiver"] == "LakeId" and rows["ID"]["kind"] == "method"
    assert rows["ID"]["subpackage"] == "parse" and rows["ID"]["decl_line"] == 3
    assert rows["Pond"]["service"] == "pond" and rows["x"]["service"] is None
    assert rows["expandPlan"]["decl_line"] == 6 and rows["expandPlan"]["loc"] == 3
    assert rows["flattenPlan"]["body"] == "func flattenPlan() {}\n"


def test_imports_and_calls(spark, tmp_path):
    parsed = parse_symbol_text(parse_symbol_path(scan_symbol_index(spark, _index(tmp_path)))).cache()
    imports = symbols.explode_imports(parsed).where("path LIKE '%expandPlan%'").orderBy("pos").collect()
    assert [(r["alias"], r["import_path"]) for r in imports] == [(None, "fmt"), ("al", "example.org/sdk/2024-01-01/things")]
    used = {r["used_as"] for r in symbols.used_imports(parsed).collect() if "expandPlan" in r["path"]}
    assert used == {"fmt", "al"}
    calls = symbols.local_call_graph(parsed).collect()
    assert len(calls) == 1 and calls[0]["callee"].endswith("func.flattenPlan.goindex")


def test_snapshot_merges_documents(spark, tmp_path):
    path = str(tmp_path / "snap")
    node = '{"type":"TypeList","elem":{"schema":{"b":{"type":"TypeInt"}}}}'
    rows = [("resource", "r", "a", node), ("resource", "r", "c", '{"type":"TypeBool"}'), ("data source", "d", "a", node)]
    snapshots.write_schema_snapshot(spark.createDataFrame(rows, "kind string, resource string, name string, node_json string"), path)
    flat = flatten_properties(snapshots.read_schema_snapshot(spark, path))
    assert {(r["kind"], r["path"]) for r in flat.collect()} == {
        ("resource", "a"), ("resource", "a.b"), ("resource", "c"), ("data source", "a"), ("data source", "a.b"),
    }


def test_no_level_is_cut_off(spark, tmp_path):
    path = str(tmp_path / "snap")
    node = "{}"
    for depth in range(11, 0, -1):
        node = '{"elem":{"schema":{"p%d":%s}}}' % (depth, node)
    rows = [("resource", "r", "p0", node), ("resource", "r", "q", "{}")]
    snapshots.write_schema_snapshot(spark.createDataFrame(rows, "kind string, resource string, name string, node_json string"), path)
    flat = flatten_properties(snapshots.read_schema_snapshot(spark, path))
    assert flat.count() == 13
    paths = {(r["path"], r["depth"], r["parent_path"]) for r in flat.select("path", "depth", "parent_path").collect()}
    chain = [".".join(f"p{i}" for i in range(d)) for d in range(13)]
    assert paths == {(chain[d], d, chain[d - 1]) for d in range(1, 13)} | {("q", 1, "")}


def test_unified_diff(spark):
    diff = (
        "diff --git a/x b/x\n--- a/dir/x.go\n+++ b/dir/x.go\n@@ -1,0 +5,2 @@ func\n+one\n+two\n@@ -9 +12 @@\n-old\n+new\n"
        "--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-bye\n--- /dev/null\n+++ b/y.go\n@@ -0,0 +1 @@\n+first"
    )
    rows = text.read_unified_diff(spark.createDataFrame([(1, diff)], "id int, text string"), "id", root="/r/").collect()
    assert {(r["file"], r["line"]) for r in rows} == {
        ("/r/dir/x.go", 5), ("/r/dir/x.go", 6), ("/r/dir/x.go", 12), ("/r/y.go", 1),
    }


def test_empty_findings_report(spark):
    schema = "file string, line int, col int, severity string, rule_id string, resource string, message string, fix string"
    rows = text.format_findings_text(spark.createDataFrame([], schema)).collect()
    assert [r["text"] for r in rows] == ["0 finding(s): 0 error(s), 0 warning(s)"]


def test_resource_to_page(spark):
    resources = spark.createDataFrame([("a", "/d/a"), ("b", "/d/b"), ("c", "/d/c")], "resource string, convention_path string")
    pages = spark.createDataFrame([("/d/a", "z"), ("/x/1", "b"), ("/x/2", "b")], "path string, title string")
    got = {r["resource"]: r["page"] for r in text.map_resource_to_page(resources, pages).collect()}
    assert got == {"a": "/d/a", "b": "/x/2", "c": None}


def test_read_pages_and_lines(spark, tmp_path):
    (tmp_path / "p.markdown").write_text("a\nb")
    pages = text.read_pages(spark, str(tmp_path))
    assert [r["text"] for r in text.page_lines(pages, "page").orderBy("line_no").collect()] == ["a", "b"]


def test_struct_fields(spark):
    body = 'type T struct {\n    A string `json:"a,omitempty"`\n    b int\n    C []U `tfschema:"c"`\n    D bool\n}'
    inner = "type U struct {\n    E string\n}"
    fields = symbols.struct_fields(spark.createDataFrame([("T", body), ("U", inner)], "type_name string, body string"))
    got = {(r["type_name"], r["field"]): r for r in fields.collect()}
    assert got["T", "A"]["json_tag"] == "a" and got["T", "C"]["tfschema_tag"] == "c" and got["T", "b"]["field_type"] == "int"
    missing = {(r["root"], r["field_path"]) for r in symbols.model_tag_check(fields).collect()}
    assert missing == {("T", "A"), ("T", "b"), ("T", "D"), ("T", "C.E"), ("U", "E")}


SHAPES = """package example.org/x
import (
    "fmt"
)
type Shapes[K comparable] struct {
\tName, Tier, Family string // several names
\tlib.Meta
\t*lib.Base `json:"base"`
\tGeneric[lib.T, int]
\tsize int64 "tfschema:\\"size\\""
\tInner struct {
\t\tA int `json:"a"`
\t\tB, C map[string][]lib.X
\t} `json:"inner,omitempty"`
\tRun func(ctx lib.Context, n ...int) (string, error)
\tMaps map[string]map[int]*lib.Y; Wait <-chan struct{}
\tData [16]byte /* a
\tcomment */
\tAny interface{ Get(k string) int }
}
func after() { x := T{a: 1} }
"""


def test_struct_fields_of_all_shapes(spark):
    rows = [("Shapes", SHAPES), ("F", "type F func(a int) error"), ("I", "type I interface {\n    Get() string\n}"), ("E", "type E struct{}"), ("N", None)]
    got = symbols.struct_fields(spark.createDataFrame(rows, "type_name string, body string")).orderBy("type_name", "pos").collect()
    assert {r["type_name"] for r in got} == {"Shapes"} and [r["pos"] for r in got] == list(range(len(got)))
    assert [(r["field"], r["field_type"]) for r in got] == [
        ("Name", "string"), ("Tier", "string"), ("Family", "string"), ("Meta", "lib.Meta"), ("Base", "*lib.Base"), ("Generic", "Generic[lib.T, int]"),
        ("size", "int64"), ("Inner", 'struct{A int `json:"a"`; B, C map[string][]lib.X}'), ("Run", "func(ctx lib.Context, n ...int) (string, error)"),
        ("Maps", "map[string]map[int]*lib.Y"), ("Wait", "<-chan struct{}"), ("Data", "[16]byte"), ("Any", "interface{Get(k string) int}"),
    ]
    by = {r["field"]: r for r in got}
    assert (by["Base"]["json_tag"], by["size"]["tfschema_tag"], by["Inner"]["json_tag"], by["Name"]["json_tag"]) == ("base", "size", "inner", None)


def test_config_modes(spark):
    rows = spark.range(5).select(snapshots.config_mode_name(F.col("id")).alias("m")).collect()
    assert [r["m"] for r in rows] == ["", "Auto", "Block", "", "Attribute"]


def test_statistics_from_an_index(spark, tmp_path):
    """The whole way from files to the six counts."""
    def method(service, receiver, name, body):
        target = tmp_path / f"internal/services/{service}/method.{receiver}.{name}.goindex"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(f"package {service}\nfunc (r {receiver}) {name}() X {{\n{body}\n}}\n")

    method("lake", "Registration", "SupportedResources", '\treturn map[string]*R{\n\t\t"s_lake":  resourceLake(),\n\t\t"s_old": resourceOld(),\n\t}')
    method("lake", "Registration", "SupportedDataSources", '\treturn map[string]*R{\n\t\t"s_lake": dataSourceLake(),\n\t}')
    method("pond", "Registration", "Resources", "\treturn []R{\n\t\tPondResource{},\n\t\tFrogResource{},\n\t}")
    method("pond", "Registration", "EphemeralResources", "\treturn []E{\n\t\tNewPondKey,\n\t\tnewPondSecret,\n\t}")
    method("pond", "PondResource", "ResourceType", '\treturn "s_old"')
    parsed = parse_symbol_text(parse_symbol_path(scan_symbol_index(spark, str(tmp_path)))).cache()
    found = registry.registrations_from_texts(registry.registration_texts(parsed), registry.resource_type_names(parsed))
    assert registry.provider_statistics(found).collect()[0].asDict() == {
        "service_count": 2, "total_data_sources": 1, "total_resources": 3, "legacy_resources": 2, "modern_resources": 2, "ephemeral_resources": 2,
    }
    assert {(r["resource_type"], r["services"]) for r in registry.duplicate_registrations(found.where("object_kind = 'resource'")).collect()} == {("s_old", 2)}


def test_snapshot_round_trip(spark, tmp_path):
    """Properties, timeouts and provider schema come back as one node a resource, however many documents hold them."""
    properties = spark.createDataFrame(
        [("resource", "a", "x", '{"type":"TypeString","optional":true}'), ("resource", "a", "y", '{"type":"TypeInt"}'), ("data source", "a", "x", '{"type":"TypeBool"}'),
         ("resource", "b", "z", '{"type":"TypeList","elem":{"schema":{"q":{"type":"TypeInt"}}}}'), ("resource", "bare", None, None)],
        "kind string, resource string, name string, node_json string",
    )
    timeouts = spark.createDataFrame([("resource", "a", 30, 5, None, 60), ("resource", "bare", None, 1, None, None)], "kind string, resource string, `create` int, `read` int, `update` int, `delete` int")
    provider = spark.createDataFrame([("features", '{"type":"TypeList"}'), ("token", '{"type":"TypeString"}')], "name string, node_json string")
    path = f"file://{tmp_path}/s"
    snapshots.write_schema_snapshot(properties, path, "sample", "7", timeouts=timeouts, provider_schema=provider)
    snapshots.write_schema_snapshot(properties.where("resource = 'b'"), path, "sample", "8", mode="append")
    back = snapshots.read_schema_snapshot(spark, path)
    got = {(r["version"], r["kind"], r["resource"]): json.loads(r["node"]) for r in back.withColumn("node", F.to_json("node")).collect()}
    assert len(got) == back.count() == 6
    assert got["7", "resource", "a"] == {"schema": {"x": {"type": "TypeString", "optional": True}, "y": {"type": "TypeInt"}}, "timeouts": {"create": 30, "read": 5, "delete": 60}}
    assert got["7", "data source", "a"]["schema"] == {"x": {"type": "TypeBool"}}
    assert got["7", "resource", "bare"] == {"schema": {}, "timeouts": {"read": 1}}
    assert set(got["7", "provider", "sample"]["schema"]) == {"features", "token"}
    assert got["8", "resource", "b"]["schema"]["z"]["elem"]["schema"]["q"] == {"type": "TypeInt"}
    wanted = spark.createDataFrame([("resource", "a"), ("resource", "nope")], "kind string, resource string")
    found = schema_ops.lookup_schema(back.where("version = '7'"), wanted).collect()
    assert sorted((r["resource"], r["error"]) for r in found) == [("a", None), ("nope", "resource not found")]


def test_snapshot_documents_are_read_once(spark, tmp_path):
    """Whole resources come without a shuffle of nodes or a second look at the JSON; those in parts are folded, without a provider's name too."""
    def text(resource, schema, provider='"providerName":"p",'):
        return f'{{{provider}"schemaVersion":"1","providerSchema":{{"resources":{{"{resource}":{schema}}}}}}}'

    whole = '{"schema":{"a":{"type":"TypeInt"}},"timeouts":{"create":30}}'
    texts = [text("whole", whole), text("split", '{"schema":{"a":{"type":"TypeInt"}}}'), text("split", '{"schema":{"b":{"type":"TypeInt"}},"timeouts":{"create":5}}')]
    spark.createDataFrame([(t,) for t in texts], "text string").write.text(str(tmp_path / "few"))
    found = snapshots.read_schema_snapshot(spark, str(tmp_path / "few"))
    assert not any("/few/" in f for f in found.inputFiles())
    names = F.expr("array_sort(map_keys(variant_get(node, '$.schema', 'map<string,variant>')))").alias("names")
    got = found.select("resource", names, F.expr("variant_get(node, '$.timeouts.create', 'int')").alias("create"))
    assert sorted(map(tuple, got.collect())) == [("split", ["a", "b"], 5), ("whole", ["a"], 30)]
    nameless = [text("r", '{"schema":{"a":{"type":"TypeInt"}}}', ""), text("r", '{"schema":{"b":{"type":"TypeInt"}}}', ""), text("s", whole, "")]
    spark.createDataFrame([(t,) for t in nameless], "text string").write.text(str(tmp_path / "nameless"))
    assert sorted(r.resource for r in snapshots.read_schema_snapshot(spark, str(tmp_path / "nameless")).collect()) == ["r", "s"]
