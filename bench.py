"""Benchmark: seconds per headline query, median of three after one warm-up.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all]

Each run writes its whole result to the no-op sink, so nothing is pruned and
nothing is collected. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from cadastre.plans import QUERIES
from cadastre.session import local_session

HEADLINE = [
    "reg06_provider_statistics", "reg07_service_rollup", "reg08_duplicate_registrations", "reg05_all_registrations", "reg13_prefix_conflicts",
    "idx01_symbol_counts", "idx03_used_imports", "idx05_local_call_graph", "idx06_reachability",
    "sch01_flatten_properties", "sch08_snapshot_diff", "sch15_breaking_changes",
    "lnt_all_rules", "lnt16_changed_lines_only", "lnt17_dedupe_findings", "lnt20_apply_renames",
    "doc01_sectionise_page", "doc03_parse_field_lines", "doc08_cross_check", "doc09_merge_misspellings", "doc22_fix_lines",
    "api02_preview_not_excepted", "rid02_parse_by_template", "mig06_migrate_chain", "val05_numeric_rules", "val11_reference_list_check",
    "cmp01_compare_snapshots", "set07_set_delta", "rng01_cidr_overlap_join", "str02_consecutive_target_batch",
]


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cores, shuffle_partitions=cores, shared=f"file://{tempfile.mkdtemp(prefix='bench-')}")
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    times = {}
    for name in names:
        seconds(spark, name, sf_dir)
        times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(3)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
