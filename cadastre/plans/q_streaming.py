"""Streaming queries, run to the end of what is there, and their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cadastre.operators import status as batch
from cadastre.plans.inputs import load
from cadastre.plans.registry import query
from cadastre.streaming import status as stream

OUTCOMES = {"PURCHASE": "succeeded", "error": "failed"}
COLUMNS = ["user_id AS op", "CAST(ts AS TIMESTAMP) AS ts", "event_id AS seq", "event_type AS state"]
EVENTS = "WITH e AS (SELECT user_id AS op, ts, event_id AS seq, event_type AS state FROM events)"


def _events(spark, sf):
    return load(spark, sf, "events").selectExpr(*COLUMNS)


def _stream(spark, sf):
    schema = load(spark, sf, "events").schema
    return stream.event_stream(spark, sf, schema, "events.parquet").selectExpr(*COLUMNS)


STATUS = EVENTS + """ SELECT op, arg_max(seq, (ts, seq)) AS seq, CASE arg_max(state, (ts, seq)) WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'in_progress' END AS status FROM e GROUP BY op"""


@query("str01_operation_status", STATUS)
def operation_status(spark, sf):
    updates = stream.run_to_end(stream.operation_status(_stream(spark, sf)), "update", "status")
    return stream.operation_status_of(updates, OUTCOMES)


@query("str01_operation_status_batch", STATUS)
def operation_status_batch(spark, sf):
    return batch.operation_status(_events(spark, sf), OUTCOMES)


RUNS = EVENTS + """, n AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY ts, seq) - row_number() OVER (PARTITION BY op, state = 'click' ORDER BY ts, seq) AS island FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY op, state = 'click', island ORDER BY ts, seq) AS run FROM n)
SELECT op, arg_min(seq, (ts, seq)) AS seq FROM r WHERE state = 'click' AND run = 3 GROUP BY op"""


@query("str02_consecutive_target", RUNS)
def consecutive_target(spark, sf):
    updates = stream.run_to_end(stream.consecutive_target(_stream(spark, sf), "Click", 2), "update", "runs")
    return stream.consecutive_target_of(updates, 2)


@query("str02_consecutive_target_batch", RUNS)
def consecutive_target_batch(spark, sf):
    return batch.consecutive_target(_events(spark, sf), "Click", 2)


BUDGET = EVENTS + """, n AS (SELECT *, row_number() OVER (PARTITION BY op ORDER BY ts, seq) AS n FROM e),
f AS (SELECT op, min(n) FILTER (state = 'signup') AS first_hit, count(*) AS polls FROM n GROUP BY op)
SELECT op, coalesce(first_hit - 1, polls) AS misses, CASE WHEN first_hit <= 4 THEN 'succeeded' WHEN polls > 4 THEN 'cancelled' ELSE 'in_progress' END AS status FROM f"""


@query("str03_retry_budget", BUDGET)
def retry_budget(spark, sf):
    updates = stream.run_to_end(stream.retry_budget(_stream(spark, sf), "SignUp"), "update", "budget")
    return stream.retry_budget_of(updates, 4)


@query("str03_retry_budget_batch", BUDGET)
def retry_budget_batch(spark, sf):
    return batch.retry_budget(_events(spark, sf), "SignUp", 4)


TIMEOUT = EVENTS + """, s AS (SELECT op, min(ts) AS started, min(ts) FILTER (state IN ('purchase', 'error')) AS ended, (SELECT max(ts) FROM e) AS now FROM e GROUP BY op)"""


@query(
    "str04_operation_timeout",
    TIMEOUT + " SELECT op, TRUE AS timed_out FROM s WHERE (ended IS NULL OR ended > started + INTERVAL 12 HOUR) AND started + INTERVAL 12 HOUR < now - INTERVAL 10 MINUTE",
)
def operation_timeout(spark, sf):
    updates = stream.run_to_end(stream.operation_timeout(_stream(spark, sf), ["purchase", "error"]), "update", "timeout")
    return stream.operation_timeout_of(updates, 12 * 3600)


@query("str04_operation_timeout_batch", TIMEOUT + " SELECT op, ended IS NULL OR ended > started + INTERVAL 12 HOUR AS timed_out FROM s")
def operation_timeout_batch(spark, sf):
    return batch.operation_timeout(_events(spark, sf), ["purchase", "error"], 12 * 3600)


ARRIVED = EVENTS + " SELECT op, CAST(count(DISTINCT state) FILTER (state IN ('click', 'view', 'purchase')) AS INT) AS arrived, count(DISTINCT state) FILTER (state IN ('click', 'view', 'purchase')) = 3 AS complete FROM e GROUP BY op"


@query("str05_expected_set_stream", ARRIVED)
def expected_set(spark, sf):
    expected = ["click", "view", "purchase"]
    return stream.expected_set_of(stream.run_to_end(stream.expected_set(_stream(spark, sf), expected), "update", "expected"), expected)


@query("str05_expected_set_batch", ARRIVED)
def expected_set_batch(spark, sf):
    return batch.expected_set_arrived(_events(spark, sf), ["click", "view", "purchase"])


@query(
    "str06_incremental_validation",
    """WITH l AS (SELECT doc_id AS page, unnest(generate_series(0, len(a) - 1)) AS line_no, unnest(a) AS text FROM (SELECT doc_id, string_split('> note: first' || chr(10) || '~> **Note:** ' || lang || chr(10) || text, chr(10)) AS a FROM documents))
SELECT page, CAST(line_no AS INT) AS line_no, text, '-> **Note:** first' AS expected FROM l WHERE line_no = 0
UNION ALL SELECT page, CAST(line_no AS INT), text, '-> **Note:** ' || trim(regexp_replace(trim(substr(ltrim(text), 2)), '(?i)^(?:note)?:?', '')) FROM l WHERE line_no > 1 AND regexp_matches(text, '^\\s*>')""",
)
def incremental_validation(spark, sf):
    schema = load(spark, sf, "documents").schema
    pages = stream.event_stream(spark, sf, schema, "documents.parquet").select(
        F.col("doc_id").alias("page"),
        F.concat(F.lit("> note: first\n~> **Note:** "), F.col("lang"), F.lit("\n"), F.col("text")).alias("text"),
    )
    return stream.run_to_end(stream.page_findings(pages), "append", "pages").drop("batch_id")
