"""Run registered queries beside their SQL twins and compare whole results.

    python -m tests.compare [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import tempfile
import time
import traceback

import duckdb

from cadastre.plans import QUERIES, SQL
from cadastre.plans.inputs import TABLES


def _plain(value):
    if value is None or isinstance(value, (bool, str, int, bytes)):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return (type(value).__name__, str(value))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in SQL:
        return None if got else "no rows"
    cur = con.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else []
        lost = [r for r in want if r not in set(got)][:2] if len(got) < 20000 else []
        return f"{len(got)} rows against {len(want)}; only ours {extra}; only theirs {lost}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference over {sorted(columns)}\n   ours   {a}\n   theirs {b}"
    return None if got else "both sides are empty"


def main() -> int:
    from cadastre.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.001")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session(shared=f"file://{tempfile.mkdtemp(prefix='compare-')}")
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(args.sf)
    bad = 0
    chosen = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    for name in chosen:
        start = time.time()
        try:
            problem = compare(spark, con, name, args.sf)
        except Exception as error:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(error))[:900]
        bad += problem is not None
        if problem or args.names:
            print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree, {sum(n in SQL for n in chosen)} with SQL")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
