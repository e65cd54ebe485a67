"""Validators, comparators, keys, IDs and migrations on single values."""

import ipaddress
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cadastre.functions import collections as c
from cadastre.functions import compare as cmp
from cadastre.functions import names
from cadastre.functions import validators as v
from cadastre.functions.patterns import is_pattern
from cadastre.operators import collections as sets
from cadastre.operators import ids, migrate, validate


def errors(spark, kind, values, args=None, sql_type="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {sql_type}")
    return [r["e"] is None for r in df.select("i", v.check(kind, F.col("x"), "x", args).alias("e")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("kind", "good", "bad", "args"),
    [
        ("not_empty", ["a"], [""], None), ("empty", [""], ["a"], None), ("not_white_space", ["a "], [" ", ""], None),
        ("length_between", ["ab", "é"], ["a", "abcd"], {"min": 2, "max": 3}), ("in_list", ["A"], ["b"], {"values": ["a"], "ignore_case": True}),
        ("in_list", ["a"], ["A"], {"values": ["a"]}), ("not_in_list", ["b"], ["a"], {"values": ["a"]}),
        ("contains_none_of", ["ab"], ["a/b", "a]b"], {"chars": "/]"}), ("starts_with", ["xa"], ["ax"], {"values": ["x", "y"]}),
        ("uuid", ["123e4567-e89b-12d3-a456-426614174000"], ["123e4567e89b12d3a456426614174000", ""], None),
        ("json", ["1", "{}", '"a"'], ["{", "a"], None), ("base64", ["QUI=", "QUJD"], ["QUI", "", "Q=I="], None),
        ("regex", ["a+", ""], ["(", "[a"], None), ("email", ["a@b", "A B <a@b.c>"], ["a", "a@", "@b"], None),
        ("rfc3339", ["2024-02-29T00:00:00Z", "2024-02-29T00:00:00.5+02:00"], ["2024-02-30T00:00:00Z", "2024-02-29"], None),
        ("weekday", ["Friday"], ["friday"], None), ("month", ["MAY"], ["mai"], {"ignore_case": True}),
        ("https_url", ["https://a/b"], ["http://a", "a"], None), ("url_with_path", ["http://a/b"], ["http://a/", "http://a", ""], None),
        ("time_span", ["1.02:03:04", "0:0:0"], ["02:03", "x.1:1:1", "-1:1:1"], None),
        ("ipv4", ["0.0.0.0", "255.1.2.3"], ["256.1.1.1", "1.2.3", "01.2.3.4"], None),
        ("cidr", ["10.0.0.0/8", "1.2.3.4/32"], ["10.0.0.0/33", "10.0.0.0"], None),
        ("ipv4_range", ["1.1.1.1-1.1.1.2"], ["1.1.1.2-1.1.1.1", "1.1.1.1"], None), ("port", ["1", "65535"], ["0", "65536", "x"], None),
        ("port_range", ["0-1"], ["1-1", "2-1", "0-70000", "1"], None), ("reserved_range", ["169.254.21.0", "169.254.22.255"], ["169.254.20.255", "169.254.23.0", "x"], None),
        ("public_ip_rule", ["1.2.3.4", "172.15.0.1", "1.2.3.0/30"], ["10.1.1.1", "172.16.0.1", "192.168.1.1", "1.2.3.0/31"], None),
        ("power_of_two", ["1", "16", str(2**127)], ["0", "-2", "3", str(2**128), "x"], None),
    ],
)
def test_text_rules(spark, kind, good, bad, args):
    assert errors(spark, kind, [*good, *bad], args) == [True] * len(good) + [False] * len(bad)


@pytest.mark.parametrize(
    ("kind", "good", "bad", "args"),
    [
        ("between", [1.0, 2.0], [0.9, 2.1], {"min": 1, "max": 2}), ("at_least", [1.0], [0.0], {"min": 1}), ("at_most", [1.0], [2.0], {"max": 1}),
        ("divisible_by", [6.0], [7.0], {"by": 3}), ("number_in", [2.0], [3.0], {"values": [1, 2]}), ("non_zero", [1.0], [0.0], None),
        ("price_or_minus_one", [-1.0, 0.00001], [0.0, -2.0], None),
    ],
)
def test_number_rules(spark, kind, good, bad, args):
    assert errors(spark, kind, [*good, *bad], args, "double") == [True] * len(good) + [False] * len(bad)


def test_ipv6_against_the_standard_library(spark):
    rng = random.Random(3)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", "1::2::3", "1:2:3", "g::", ":::", "1:2:3:4:5:6:7:8:9", "12345::"]
    for _ in range(300):
        parts = [rng.choice(["", "0", "a", "FFFF", "1f"]) for _ in range(rng.randint(2, 9))]
        texts.append(":".join(parts))

    def good(text):
        try:
            ipaddress.IPv6Address(text)
        except ValueError:
            return False
        return True

    assert errors(spark, "ipv6", texts) == [good(t) for t in texts]


def test_null_is_a_violation_and_good_rows_split(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "")], "k int, x string")
    rules = [validate.Rule("r1", "x", "not_empty"), validate.Rule("r2", "x", "in_list", {"values": ["a", ""]})]
    got = {(r["k"], r["rule_id"]) for r in validate.validate_columns(rows, "k", rules).collect()}
    assert got == {(2, "r1"), (2, "r2"), (3, "r1")}
    good, bad = validate.split_by_validity(rows, rules)
    assert [r["k"] for r in good.collect()] == [1] and bad.count() == 2


def test_reference_list_without_a_table(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "")], "k int, x string")
    assert [r["k"] for r in validate.reference_list_check(rows, "k", "x", None).collect()] == [2]


def test_hash_keys(spark):
    rows = spark.createDataFrame([("Foo", "10.0.0.1", "2001:DB8:0:0::1")], "a string, b string, d string").select(
        c.hash_key(F.col("a")), c.hash_key(F.col("a"), ignore_case=True), c.hash_key(F.lit(42)), c.hash_ipv4(F.col("b")),
        c.hash_ipv4(F.lit("10.0.0.0/8")), c.hash_ipv6(F.col("d")), c.hash_ipv6(F.lit("::ffff:1.2.3.4")),
    ).collect()[0]
    texts = ["Foo", "foo", "42", "10.0.0.1/32", "10.0.0.0/8", "2001:db8::1", "1.2.3.4"]
    assert list(rows) == [zlib.crc32(t.encode()) for t in texts]


@pytest.mark.parametrize(
    ("text", "run", "capital"),
    [("IotHubName", "iot_hub_name", "iot_hub_name"), ("ID", "id", "i_d"), ("VMName", "vm_name", "v_m_name"), ("keyID", "key_id", "key_id"),
     ("A", "a", "a"), ("a1B", "a1_b", "a1_b"), ("", "", "")],
)
def test_snake_case(spark, text, run, capital):
    row = spark.createDataFrame([(text,)], "x string").select(names.snake_by_run(F.col("x")), names.snake_by_capital(F.col("x"))).collect()[0]
    assert tuple(row) == (run, capital)


def test_camel_case_and_prefix(spark):
    row = spark.createDataFrame([("a__bc_D", "abcd", "abx")], "x string, a string, b string").select(
        names.camel_case(F.col("x")), names.common_prefix(F.col("a"), F.col("b")), names.common_prefix(F.lit(""), F.col("b"))
    ).collect()[0]
    assert tuple(row) == ("ABcD", "ab", "")


@pytest.mark.parametrize(
    ("fn", "old", "new", "same"),
    [
        (cmp.same_instant, "2024-01-01T10:00:00Z", "2024-01-01T12:00:00+02:00", True), (cmp.same_instant, "soon", "soon", False),
        (cmp.same_minute, "2024-01-01T10:00:01Z", "2024-01-01T10:00:59Z", True), (cmp.same_json, '{"a":{"y":1,"x":2}}', '{"a": {"x":2, "y":1}}', True),
        (cmp.same_json, "{", "{", False), (cmp.same_metadata, '{"createdBy":"x"}', "", True), (cmp.same_metadata, "", "", False),
        (cmp.same_metadata, '{"a":1,"updatedOn":2}', '{"a":1}', True), (cmp.same_xml, "<a> <b/>\n</a>", "<a><b/></a>", True),
        (cmp.same_xml, "<a>x y</a>", "<a>xy</a>", False), (cmp.same_xml_text, "<a>x y</a>", "<a>xy</a>", True),
        (cmp.same_ssh_key, "<<~EOTssh a\r\n b\nEOT", "ssh a\nb", True), (cmp.same_ssh_key, "", "", False),
        (cmp.same_connection_string, "B=1;a=2;", "A=2;b=1;Password=x", True), (cmp.same_connection_string, "a=1;password=x", "a=1", False),
        (cmp.same_versioned_url, "https://v/keys/k/1", "https://v/keys/k/2", True), (cmp.same_versioned_url, "https://v/keys/k/1", "https://w/keys/k/1", False),
        (cmp.same_versioned_url, "x", "x", False),
    ],
)
def test_comparators(spark, fn, old, new, same):
    row = spark.createDataFrame([(old, new)], "o string, n string").select(fn(F.col("o"), F.col("n"))).collect()[0]
    assert row[0] is same


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("/subscriptions/s/resourceGroups/g/providers/P/things/t", None), ("/subscriptions/s/resourcegroups/g/providers/P/things/t", None),
        ("/subscriptions/s/resourceGroups/g/providers/P/things", ids.ODD), ("/subscriptions/s/resourceGroups//providers/P/things/t", ids.EMPTY),
        ("/x/s/resourceGroups/g/providers/P/things/t", ids.NO_SUBSCRIPTION), ("/subscriptions/s/providers/P/things/t", ids.NO_GROUP),
        ("/subscriptions/s/resourceGroups/g/providers/P/Things/t", ids.NO_SEGMENT % "things"),
        ("/subscriptions/s/resourceGroups/g/providers/P/things/t/more/m", ids.TOO_MANY),
    ],
)
def test_template_errors(spark, text, error):
    templates = ids.templates(spark, [("t", "P", ["things"], ["Thing"]), ("u", "Q", ["x", "y"], ["X", "Y"])])
    row = ids.parse_by_template(spark.createDataFrame([(text, "t")], "id string, type string"), templates).collect()[0]
    assert row["error"] == error


def test_nested_ids(spark):
    text = "/subscriptions/s/resourceGroups/g/providers/P/a/1/b/2/c/3"
    row = ids.parse_resource_id(spark.createDataFrame([(text,)], "id string")).collect()[0]
    assert row["full_resource_type"] == "P/a/b/c" and row["resource_name"] == "3" and row["parent_resources"] == {"a": "1", "b": "2"}
    scoped = ids.parse_resource_id(spark.createDataFrame([("/subscriptions/s/providers/P/a/1/providers/Q/b/2",)], "id string")).collect()[0]
    assert scoped["resource_scope"] == "/subscriptions/s/providers/P/a/1" and scoped["resource_provider"] == "Q"


def test_migration_steps(spark):
    rows = spark.createDataFrame([(1, "t", 0, {"a": "1"}), (2, "t", 1, {"a": "1"}), (3, "other", 0, {"a": "1"}), (4, "t", 0, {"x": "y"})], "k int, type string, version int, state map<string,string>")
    steps = {"t": [migrate.rename_field("a", "b"), migrate.no_change, migrate.set_field("c", "2")]}
    got = {r["k"]: (r["version"], r["state"]) for r in migrate.migrate_chain(rows, steps).collect()}
    assert got == {1: (3, {"b": "1", "c": "2"}), 2: (3, {"a": "1", "c": "2"}), 3: (0, {"a": "1"}), 4: (3, {"x": "y", "c": "2"})}


def test_gaps(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("c", 0), ("c", 2), ("c", 2)], "type string, version int")
    assert {r["type"]: r["missing_version"] for r in migrate.chain_gap_check(rows).collect()} == {"b": 0, "c": 1}


def test_cidr_overlaps_against_brute_force(spark):
    rng = random.Random(5)
    def block():
        return f"{rng.choice([10, 11])}.{rng.randint(0, 3)}.{rng.choice([0, 64, 128])}.{rng.randint(0, 255)}/{rng.choice([0, 8, 15, 16, 17, 18, 24, 32])}"
    left, right = [block() for _ in range(40)], [block() for _ in range(40)] + ["bad", "1.2.3.4/40"]
    frames = [spark.createDataFrame([(x,) for x in side], "cidr string") for side in (left, right)]
    got = [tuple(r) for r in sets.cidr_overlaps(*frames).collect()]
    net = lambda t: ipaddress.ip_network(t, strict=False)
    want = {(a, b) for a in left for b in right[:40] if net(a).overlaps(net(b))}
    assert set(got) == want and len(got) == len(want)


def test_tiers_and_versions(spark):
    row = spark.createDataFrame([("Basic", "s1", "weird")], "a string, b string, d string").select(
        c.higher_tier(F.col("b"), F.col("a")), c.higher_tier(F.col("a"), F.col("b")), c.higher_tier(F.col("a"), F.col("d")), c.tier_rank(F.lit("BC_1"))
    ).collect()[0]
    assert tuple(row) == (True, False, False, 5)
    rows = spark.createDataFrame([("1.10.0",), ("1.9",), ("x",), ("1.2.0",), ("latest",)], "v string")
    assert [r["v"] for r in sets.semver_sort(rows, "v").collect()] == ["1.2.0", "1.9", "1.10.0", "latest", "x"]
    with pytest.raises(ValueError):
        sets.tier_members(spark.createDataFrame([("core", "n")], "tier string, name string"), "huge")


def test_duplicates_ignore_case(spark):
    rows = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "B", 3), (1, "A", 4), (2, "a", 1)], "p int, v string, o int")
    assert [tuple(r) for r in sets.first_duplicates(rows, "p", "v", "o").collect()] == [(1, 3, "B")]


def test_ipv6_short_form_against_another_library(spark):
    rng = random.Random(3)

    def address():
        groups = [rng.choice(["0", "0", "0000", "1", "00Ab", "ffff"]) for _ in range(8)]
        if rng.random() < 0.5:
            at, size = rng.randint(0, 6), rng.randint(1, 8)
            groups[at : at + size] = [""]
            text = ":".join(groups)
            return (":" if text.startswith(":") else "") + text + (":" if text.endswith(":") else "")
        return ":".join(groups)

    texts = [address() for _ in range(300)] + [
        "::", "::1", "1::", "::ffff:1.2.3.4", "::FFFF:0102:0304", "1:2:3:4:5:6:1.2.3.4", "::1.2.3", "1.2.3.4", "", "x", ":", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "::256.1.1.1",
    ]

    def wanted(text):
        try:
            parsed = ipaddress.ip_address(text)
        except ValueError:
            return text
        return str(getattr(parsed, "ipv4_mapped", None) or parsed)

    rows = spark.createDataFrame(list(enumerate([*texts, None])), "i int, x string").select("i", c.canonical_ipv6(F.col("x")).alias("y"))
    assert [r["y"] for r in rows.orderBy("i").collect()] == [*map(wanted, texts), None]


def test_regular_expressions_of_the_linear_dialect(spark):
    good = ["", "a+?b*", r"\z", r"\pL\p{Greek}\PN", "(?i)a", "(?P<x>a)(?<y>b)", "(?i:a)|b", "[[:alpha:]_-]", "[]a]", "[^]]", r"[\]\[]", r"\Q(\E", "a{2,3}", "a{,3}", "{", "^*", "()", r"\x{10FFFF}\x41", "a|", r"\.\-", "}"]
    bad = ["(", ")", "a)(", "[a", "*", "a**", "a*+", "(?=a)", "(?!a)", "(?<=a)", r"(a)\1", "a{3,2}", "a{1001}", "[z-a]", "(?P<x>a)(?P<x>b)", "\\", r"\Z", r"\h", "|*", "(?i)*", "[[:nope:]]", None]
    assert errors(spark, "regex", good) == [True] * len(good)
    assert [r["g"] for r in spark.createDataFrame(list(enumerate(bad)), "i int, x string").select("i", is_pattern(F.col("x")).alias("g")).orderBy("i").collect()] == [False] * len(bad)


def test_templates_whatever_holds_them(spark):
    bodies = ['x := "/providers/A.B/c/%s"\nreturn fmt.Sprintf(x, r)', 'return fmt.Sprintf("%s/k/%s", a, b)', '// y := "/z/%s"\nz := "no template"', None]
    got = ids.template_catalogue(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert {tuple(r) for r in got} == {("A.B", "/providers/A.B/c/%s", 1), ("", "%s/k/%s", 1)}


def test_sql_function_gives_what_the_column_gives(spark):
    texts = ["/subscriptions/s/resourceGroups/g/providers/P.Q/a/1/b/2/c/3", "/subscriptions/s/providers/P.Q/a/1/a/2/a/3", "/x/providers/P.Q/a/1/providers/R.S/b/2", "/providers/P.Q", "", "/a", None]
    ids.register_functions(spark, [])
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, id string")
    got = rows.select("i", F.expr("parse_resource_id(id)").alias("p"), ids.parsed_id(F.col("id")).alias("q")).orderBy("i").collect()
    assert all(r["p"] == r["q"] for r in got)
    assert got[1]["q"]["parent_resources"] == {"a": "2"} and got[0]["p"]["resource_name"] == "3"


def test_cidr_overlaps_with_a_network_that_holds_all(spark):
    left = [f"10.{i}.0.{j}/{b}" for i in range(12) for j, b in ((1, 32), (2, 16), (0, 0))]
    right = ["0.0.0.0/0", "9.9.9.9/0", "10.3.0.0/16", "10.0.0.0/8", "11.0.0.0/8"]
    frames = [spark.createDataFrame([(x,) for x in side], "cidr string") for side in (left, right)]
    net = lambda t: ipaddress.ip_network(t, strict=False)
    want = sorted((a, b) for a in set(left) for b in right if net(a).overlaps(net(b)))
    assert sorted(tuple(r) for r in sets.cidr_overlaps(*frames, most=3).collect()) == want


def test_plan_positions(spark):
    rows = [("g", f"m{i:03}", ("add", "keep", "remove")[i % 3]) for i in range(200)] + [("h", "x", "add"), ("i", "x", "remove")]
    got = sets.plan_positions(spark.createDataFrame(rows, "group string, member string, action string")).collect()
    want = {}
    for group in "gh":
        linked = sorted((a == "add", m) for g, m, a in rows if g == group and a != "remove")
        want |= {(group, i): m for i, (_, m) in enumerate(linked, start=1)}
    assert {(r["group"], r["position"]): r["member"] for r in got} == want and len(got) == len(want)


def test_name_rules_of_the_user(spark):
    rules = spark.createDataFrame(
        [("a", "r1", "match", "^x", None, None, "must start with x"), ("a", "r2", "length_between", None, 2, 3, "too long"), ("a", "r3", "contains_none_of", "/]", None, None, "odd"),
         ("a", "r4", "not_match", "y$", None, None, "end"), ("a", "r5", "not_white_space", None, None, None, "blank"), ("b", "r6", "unknown", None, None, None, "?")],
        validate.NAME_RULE,
    )
    names = spark.createDataFrame([(1, "a", "xab"), (2, "a", "q/]y"), (3, "a", " "), (4, "a", None), (5, "b", "z"), (6, "c", "z"), (7, None, "z")], "k int, kind string, name string")
    got = {}
    for r in validate.validate_names(names, "k", rules).collect():
        got.setdefault(r["k"], set()).add(r["rule_id"])
    assert got == {2: {"r1", "r2", "r3", "r4"}, 3: {"r1", "r2", "r5"}, 5: {"r6"}}
