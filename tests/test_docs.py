"""Page checks: line expressions, fixes, and name pairing against brute force; status feeds."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from cadastre.functions import pages as px
from cadastre.operators import docs, status
from cadastre.streaming import status as stream


def one(spark, expression, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], names).select(expression(*[F.col(n) for n in names]).alias("x")).collect()[0]["x"]


@pytest.mark.parametrize(
    ("line", "miss", "fixed"),
    [
        ("* `a` - (Optional) text", "should_be_required", "* `a` - (Required) text"),
        ("* `a` - (Required) text", "should_be_optional", "* `a` - (Optional) text"),
        ("* `a` - text", "should_be_required", "* `a` - (Required) text"),
        ("* `a` text", "should_be_optional", "* `a` (Optional) text"),
        ("* `a` - (Required) text", "should_be_computed", "* `a` - text"),
        ("* `a` - (Optional)text", "should_be_computed", "* `a` - text"),
        ("* `a` - text", "should_be_computed", "* `a` - text"),
        ("(Required) a (Optional) b", "should_be_computed", "(Required) a b"),
        ("(Required) a", "should_be_computed", "(Required) a"),
        ("* `a` - (Required) text", "ok", "* `a` - (Required) text"),
    ],
)
def test_fix_required(spark, line, miss, fixed):
    assert one(spark, px.fix_required, line, miss) == fixed


@pytest.mark.parametrize(
    ("line", "value", "fixed"),
    [
        ("* `a` - text. Defaults to `x`.", "y", "* `a` - text. Defaults to `y`."),
        ("* `a` - text. Defaults to `x`.", "", "* `a` - text."),
        ("* `a` - text.", "y", "* `a` - text. Defaults to `y`."),
        ("* `a` - text.", "", "* `a` - text."),
        ("* `a` - text, the default is \"x\".", "y", "* `a` - text, the default is `y`."),
    ],
)
def test_fix_default(spark, line, value, fixed):
    assert one(spark, px.fix_default, line, value) == fixed


@pytest.mark.parametrize(
    ("line", "should", "fixed"),
    [
        ("a,", True, "a. Changing this forces a new resource to be created."),
        ("a  ", True, "a. Changing this forces a new resource to be created."),
        ("a. Changing this forces a new thing to be created.", False, "a."),
    ],
)
def test_fix_force_new(spark, line, should, fixed):
    assert one(spark, px.fix_force_new, line, should) == fixed


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("-> **Note:** text", "-> **Note:** text"), ("> note: text", "-> **Note:** text"), ("~> **NOTE** text", "~> **Note:** text"),
        ("!>text", "!> **Note:** text"), ("~> **Note:** Note: text ", "~> **Note:** text"), ("plain", None), ("- > x", None),
    ],
)
def test_notes(spark, line, expected):
    assert one(spark, px.expected_note, line) == expected


def test_durations(spark):
    got = [one(spark, px.timeout_text, s) for s in (60, 1800, 3600, 7200, 5400)]
    assert got == ["1 minute", "30 minutes", "60 minutes", "2 hours", "90 minutes"]
    assert [one(spark, px.duration_text, m) for m in (1, 60, 90, 120)] == ["1 minute", "1 hour", "90 minutes", "2 hours"]
    assert one(spark, px.timeout_seconds, "* `read` - (Defaults to 2 hours) Used") == 7200
    assert one(spark, px.timeout_seconds, "no value") is None
    assert one(spark, px.fix_timeout, "* `read` - (Defaults to 5 minutes x) Used", 7200) == "* `read` - (Defaults to 2 hours) Used"


@pytest.mark.parametrize(
    ("values", "shown"),
    [
        (["b"], "`b`"), (["b", "A"], "`A` and `b`"), (["c", "B", "a"], "`a`, `B` and `c`"),
        (["Sunday", "Monday", "Friday"], "`Monday`, `Friday` and `Sunday`"), (["Sunday", "Apple"], "`Apple` and `Sunday`"),
    ],
)
def test_possible_values_text(spark, values, shown):
    assert one(spark, px.values_text, values) == shown


def test_field_lines(spark):
    lines = [
        "* `a` - (Required) The thing. Possible values are `X`, `Y` and `X`. Defaults to `Y`. Changing this forces a new resource to be created.",
        "* `b` - (Optional) One or more `c_block` blocks as defined below.",
        "- `d` - text. Changing this forces a new thing to be created when x.",
        "no field",
    ]
    rows = docs.parse_field_lines(spark.createDataFrame([("p", i, t) for i, t in enumerate(lines)], "page string, line_no int, text string")).orderBy("line_no").collect()
    assert [(r["name"], r["requirement"], r["default_value"], r["force_new"]) for r in rows] == [
        ("a", "required", "Y", True), ("b", "optional", "", False), ("d", "", "", False),
    ]
    assert rows[0]["enums"] == ["X", "Y"] and rows[1]["block_type"] == "c_block" and rows[2]["block_type"] is None


def test_block_heads_and_fixes(spark):
    assert one(spark, px.block_names, "A `x` and `y` block supports:") == ["x", "y"]
    assert one(spark, px.block_names, "nothing") is None
    assert one(spark, px.fix_block_head, "* `x` supports the following:") == "The `x` block supports the following:"
    assert one(spark, px.normalise_line, "* `x`  -   (optional) a b") == "* `x` - (Optional) a b"
    assert one(spark, px.normalise_line, "plain  text") == "plain  text"


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_close_names(spark):
    rng = random.Random(7)
    words = lambda n: ["".join(rng.choice("ab_") for _ in range(rng.randint(0, 9))) for _ in range(n)]
    left = [(r, w) for r in ("r", "s") for w in words(40)]
    right = [(r, w) for r in ("r", "s", "t") for w in words(40)]
    frames = [spark.createDataFrame(rows, "resource string, leaf string") for rows in (left, right)]
    got = {tuple(r) for r in docs.close_names(*frames).collect()}
    assert got == {(r, a, b) for r, a in left for q, b in right if r == q and _distance(a, b) <= 3}


def test_circular_blocks(spark):
    edges = [("p", "a", "b"), ("p", "b", "c"), ("p", "c", "b"), ("q", "a", "b"), ("q", "b", "c"), ("s", "z", "z"), ("s", "z", "y")]
    got = {r["page"]: r["block"] for r in docs.circular_blocks(spark.createDataFrame(edges, "page string, block string, child string")).collect()}
    assert got == {"p": "b", "s": "z"}


def test_insert_before_and_after(spark):
    rows = spark.createDataFrame([("p", 1, "title", "T"), ("p", 2, "arguments", "A"), ("q", 1, "title", "T")], "page string, section_no long, section_type string, heading string")
    for after, places in ((True, {"T": 1, "A": 2, "New": 3}), (False, {"T": 1, "A": 3, "New": 2})):
        out = docs.insert_section(rows, "New", "arguments", after=after)
        assert {r["heading"]: r["section_no"] for r in out.where("page = 'p'").collect()} == places
        assert out.where("page = 'q'").count() == 1


def test_possible_values(spark):
    rows = spark.createDataFrame([(1, ["A", "b"], ["a", "c"]), (2, [], ["x"]), (3, ["A"], ["A"])], "k int, want array<string>, got array<string>")
    assert [(r["missed"], r["spare"]) for r in docs.possible_values_diff(rows).collect()] == [(["A", "b"], ["a", "c"])]
    assert [(r["missed"], r["spare"]) for r in docs.possible_values_diff(rows, ignore_case=True).collect()] == [(["b"], ["c"])]


EVENTS = "op long, ts timestamp, seq long, state string"


def _events(spark, seed, ops=3, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice([0, 0, 0, *range(ops)]), i) for i in range(n)]
    df = spark.createDataFrame([(op, i, rng.choice(["Hit", "hit", "miss"])) for op, i in rows], "op long, seq long, state string")
    return df.selectExpr("op", "timestamp_seconds(1700000000 + seq * 977) AS ts", "seq", "state")


def _first_run(rows, times):
    run = {}
    first = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        run[r["op"]] = run.get(r["op"], 0) + 1 if r["state"].lower() == "hit" else 0
        if run[r["op"]] == times + 1:
            first.setdefault(r["op"], r["seq"])
    return first


@pytest.mark.parametrize("times", [0, 2, 5])
def test_consecutive_target_over_segments(spark, times):
    events = _events(spark, times)
    got = {r["op"]: r["seq"] for r in status.consecutive_target(events, "HIT", times).collect()}
    assert got == _first_run(events.collect(), times)


def _feed(spark, events, folder, parts):
    """One file for each part of the events, taken one at a time in this order."""
    for at, part in enumerate(parts):
        events.where(part).coalesce(1).write.parquet(f"{folder}/w{at}")
        (file,) = (folder / f"w{at}").glob("*.parquet")
        moved = folder / f"e{at:03d}.parquet"
        file.rename(moved)
        os.utime(moved, (1_700_000_000 + at, 1_700_000_000 + at))
    return stream.event_stream(spark, str(folder), events.schema, "e*.parquet", files_per_trigger=1)


def _results(spark, feed, late, progress=None):
    run = lambda name, found: stream.run_to_end(found, "update", name, progress)
    return {
        "status": stream.operation_status_of(run("status", stream.operation_status(feed, late=late)), {"HIT": "succeeded"}),
        "runs": stream.consecutive_target_of(run("runs", stream.consecutive_target(feed, "hit", 3, "6 hours", late)), 3),
        "budget": stream.retry_budget_of(run("budget", stream.retry_budget(feed, "hit", "6 hours", late)), 2),
        "expected": stream.expected_set_of(run("expected", stream.expected_set(feed, ["hit", "other", "never"], late=late)), ["hit", "other", "never"]),
    }


def _twins(events):
    return {
        "status": status.operation_status(events, {"HIT": "succeeded"}),
        "runs": status.consecutive_target(events, "hit", 3),
        "budget": status.retry_budget(events, "hit", 2, "day"),
        "expected": status.expected_set_arrived(events, ["hit", "other", "never"]),
    }


def _rows(frames):
    return {k: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect()) for k, df in frames.items()}


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [2, 0, 3, 1], [3, 2, 1, 0]])
def test_files_in_any_order_equal_the_batch_form(spark, tmp_path, order):
    """Runs and budgets span files, and files come out of the order of time."""
    events = _events(spark, 3).cache()
    feed = _feed(spark, events, tmp_path, [f"seq BETWEEN {i * 100} AND {i * 100 + 99}" for i in order])
    assert _rows(_results(spark, feed, "30 days")) == _rows(_twins(events))


def test_late_and_early_events_are_mixed_inside_files(spark, tmp_path):
    events = _events(spark, 5).cache()
    feed = _feed(spark, events, tmp_path, [f"pmod(hash(seq), 5) = {i}" for i in range(5)])
    got = _rows(_results(spark, feed, "30 days"))
    assert got == _rows(_twins(events))
    assert dict((op, seq) for op, seq in got["runs"]) == _first_run(events.collect(), 3)


def test_state_leaves(spark, tmp_path):
    """Files in the order of time: the state is that of the last segments only, and results stay the same."""
    events = _events(spark, 3).cache()
    span = events.agg((F.max("seq") - F.min("seq")).alias("n")).first().n // 8 + 1
    feed = _feed(spark, events, tmp_path, [f"seq DIV {span} = {i}" for i in range(9)])
    progress = []
    updates = stream.run_to_end(stream.consecutive_target(feed, "hit", 3, "1 minute", "1 second"), "update", "runs", progress)
    assert _rows({"runs": stream.consecutive_target_of(updates, 3)}) == _rows({"runs": _twins(events)["runs"]})
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    written = updates.select("op", "segment").distinct().count()
    assert held[-1] < max(held) and max(held) < written


def test_timeouts_follow_the_watermark(spark, tmp_path):
    rows = [(1, 0, "open"), (1, 500, "end"), (2, 0, "open"), (2, 4000, "end"), (3, 10, "open"), (4, 9000, "open"), (5, 9999, "x")]
    events = spark.createDataFrame([(op, datetime.datetime(2024, 5, 1) + datetime.timedelta(seconds=s), i, st) for i, (op, s, st) in enumerate(rows)], "op long, ts timestamp, seq long, state string")
    feed = _feed(spark, events, tmp_path, [f"pmod(seq, 3) = {i}" for i in (2, 0, 1)])
    updates = stream.run_to_end(stream.operation_timeout(feed, ["END"], late="5 hours"), "update", "timeout")
    assert {r.op for r in stream.operation_timeout_of(updates, 3600, "10 minutes").collect()} == {2, 3}


def test_changelog_ranks_over_segments(spark):
    rows = [(k, i, s, t) for k in (1, 2) for i, (s, t) in enumerate([("BUG FIXES", "* x"), ("FEATURES", "* x"), ("BUG FIXES", "* provider: y"), ("FEATURES", "* **New Data Source** z")] * 5)]
    entries = spark.createDataFrame(rows, "log int, line_no int, section string, text string")
    small = {tuple(r) for r in docs.changelog_group(entries, "log", segment=3).collect()}
    assert small == {tuple(r) for r in docs.changelog_group(entries, "log").collect()} and len(small) == 40


def test_circular_blocks_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(f"p{p}", f"b{rng.randint(0, 7)}", f"b{rng.randint(0, 7)}") for p in range(40) for _ in range(rng.randint(1, 11))]
    # a long chain from a cycle into another of lesser names
    rows += [("q", "y", "z"), ("q", "z", "y"), ("q", "z", "x"), ("q", "x", "c"), ("q", "c", "b"), ("q", "b", "c")]
    want = {}
    for page in {r[0] for r in rows}:
        follow = {}
        for p, a, b in rows:
            if p == page:
                follow.setdefault(a, set()).add(b)

        def reached(block, follow=follow):
            seen, todo = set(), [block]
            while todo:
                for child in follow.get(todo.pop(), ()):
                    if child not in seen:
                        seen.add(child)
                        todo.append(child)
            return seen

        cyclic = [b for b in follow if b in reached(b)]
        if cyclic:
            want[page] = min(cyclic)
    got = docs.circular_blocks(spark.createDataFrame(rows, "page string, block string, child string")).collect()
    assert {r["page"]: r["block"] for r in got} == want and len(got) == len(want)
    assert docs.circular_blocks(spark.createDataFrame([], "page string, block string, child string")).count() == 0


def test_skip_entries_of_every_form(spark):
    found = [("r", "a"), ("r", "b.c"), ("s.t", "a"), ("s", "t.a"), ("s", "t"), ("u", "x.leaf"), ("u", "leaf.x"), ("v", "p"), ("w", "*"), ("y", None), ("y", "")]
    entries = [("r.b.c",), ("s.t",), ("all.leaf",), ("v.*",), ("y",), ("r.b.c",), ("w.q",), (None,)]
    named = {e for (e,) in entries}
    kept = [
        (r, p) for r, p in found
        if not named & {r, f"{r}.{p}", f"{r}.*", "all." + (p or "-").split(".")[-1]} and not (p or "").startswith("leaf")
    ]
    out = docs.skip_rules(spark.createDataFrame(found, "resource string, path string"), spark.createDataFrame(entries, "entry string"), [r"\.leaf\."])
    assert sorted(tuple(r) for r in out.collect()) == sorted(kept)


def test_a_table_that_is_a_folder_of_part_files_streams(spark, tmp_path):
    """``documents.parquet`` may be one file or a folder of them; a table without rows gives none."""
    from cadastre.plans import QUERIES

    row = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "> a", "en", "s", 3), (2, "plain\n> **note** b", "de", "s", 18), (3, None, "de", "s", None)], row)
    docs.repartition(3).write.parquet(str(tmp_path / "folder/documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "parts"))
    (tmp_path / "file").mkdir()
    (part,) = (tmp_path / "parts").glob("*.parquet")
    part.rename(tmp_path / "file/documents.parquet")
    got = [sorted(map(tuple, QUERIES["str06_incremental_validation"](spark, str(tmp_path / d)).collect())) for d in ("folder", "file")]
    assert got[0] == got[1]
    assert [(r[0], r[1]) for r in got[0]] == [(1, 0), (1, 2), (2, 0), (2, 3)]


def test_a_feed_without_files_gives_no_rows(spark, tmp_path):
    schema = "page long, text string"
    feed = stream.event_stream(spark, str(tmp_path), schema, "*.parquet")
    assert stream.run_to_end(stream.page_findings(feed), "append", "pages").collect() == []


def test_names_of_few_are_measured_and_of_many_meet_by_keys(spark, monkeypatch):
    """Both ways give the same pairs, also where a resource has more names than are measured one by one."""
    rng = random.Random(5)
    names = ["".join(rng.choice("ab_") for _ in range(rng.randint(1, 9))) for _ in range(160)]
    rows = [("big" if i % 4 else "small", n) for i, n in enumerate(names)] + [(None, "a"), ("small", None)]
    left, right = (spark.createDataFrame(rows[i::2], "resource string, leaf string") for i in (0, 1))
    pairs = []
    for few in (0, 12, 1000):
        monkeypatch.setattr(docs, "FEW_NAMES", few)
        found = [tuple(r) for r in docs.close_names(left, right).collect()]
        assert len(found) == len(set(found))
        pairs.append(set(found))
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) > 100
