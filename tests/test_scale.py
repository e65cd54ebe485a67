"""Properties of the plans and of the code that matter on a cluster."""

import pathlib
import re

import pytest

from cadastre import session
from cadastre.plans import QUERIES

SF = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent / "cadastre"
NARROW = ["val05_numeric_rules", "mig06_migrate_chain", "rid06_normalise_resource_id", "src08_read_unified_diff", "idx03_used_imports"]


def plan(spark, name):
    return QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name", [n for n in QUERIES if n.startswith(("reg", "lnt", "sch0", "doc", "rng", "rid", "cmp", "set", "val", "api"))]
)
def test_no_pair_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["val05_numeric_rules", "mig06_migrate_chain", "rid06_normalise_resource_id", "idx03_used_imports"])
def test_row_jobs_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_scan_reads_only_what_is_used(spark):
    text = plan(spark, "reg06_provider_statistics")
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert scans and all("l_extendedprice" not in s and "l_shipdate" not in s for s in scans)


def test_code_keeps_to_the_rules():
    for path in ROOT.rglob("*.py"):
        if "llm" in path.parts:
            continue
        text = path.read_text()
        for word in ("localCheckpoint", "crossJoin", ".rdd", "toPandas", ".collect()"):
            assert word not in text, f"{word} in {path}"


def test_scratch_is_released_and_scoped(spark):
    import pathlib as pl

    folder = pl.Path(session.shared_dir(spark).removeprefix("file://"))
    kept = session.materialise(spark.range(5), "kept")
    gone = session.materialise(spark.range(5), "gone")
    session.release(gone)
    assert kept.count() == 5 and not list(folder.glob("gone-*"))
    with session.scratch_scope(spark) as scope:
        assert session.materialise(spark.range(7), "inside").count() == 7
        assert pl.Path(scope.removeprefix("file://")).exists()
    assert not pl.Path(scope.removeprefix("file://")).exists() and kept.count() == 5


def test_a_session_without_shared_folder_is_told_so():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Session())
