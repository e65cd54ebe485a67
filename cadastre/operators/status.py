"""Status events in batch form: twins of the streaming jobs.

Events are rows (op, ts, seq, state); ``seq`` breaks ties of ``ts``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Which states end an operation; all others are in progress.
OUTCOMES = {"succeeded": "succeeded", "failed": "failed", "cancelled": "failed"}


def outcome(state, outcomes: dict[str, str] = OUTCOMES):
    """Outcome of a state, ignoring case."""
    known = F.create_map(*(F.lit(x) for k, v in outcomes.items() for x in (k.lower(), v)))
    return F.coalesce(F.try_element_at(known, F.lower(state)), F.lit("in_progress"))


def operation_status(events: DataFrame, outcomes: dict[str, str] = OUTCOMES) -> DataFrame:
    """Outcome of the latest event of each operation."""
    latest = events.groupBy("op").agg(F.max(F.struct("ts", "seq", "state")).alias("last"))
    return latest.select("op", "last.seq", outcome(F.col("last.state"), outcomes).alias("status"))


def consecutive_target(events: DataFrame, target: str, times: int, segment: str = "hour") -> DataFrame:
    """First event of each operation at which the target state has been seen ``times`` + 1 times in a row.

    Any other state starts the count anew. An operation may hold any share of
    the events, so its events are not put in order in one task: they are
    numbered inside time segments, the segments' sums are added up (one row per
    segment), and the offsets are joined back.
    """
    numbered = events.select(
        "op", "ts", "seq", (F.lower("state") == target.lower()).alias("hit"), F.date_trunc(segment, "ts").alias("segment")
    )
    inside = Window.partitionBy("op", "segment").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    numbered = numbered.withColumn("n", F.count("*").over(inside)).withColumn(
        "reset", F.max(F.when(~F.col("hit"), F.col("n"))).over(inside)
    )
    # count(*) runs on with the rows, so n is the place inside the segment
    sums = numbered.groupBy("op", "segment").agg(F.max("n").alias("rows"), F.max("reset").alias("reset_in"))
    before = Window.partitionBy("op").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    offsets = offsets.withColumn(
        "reset_before", F.coalesce(F.max(F.col("offset") + F.col("reset_in")).over(before), F.lit(0))
    ).select("op", "segment", "offset", "reset_before")
    placed = numbered.where("hit").join(offsets, ["op", "segment"]).withColumn(
        "run", F.col("offset") + F.col("n") - F.coalesce(F.col("offset") + F.col("reset"), F.col("reset_before"))
    )
    return placed.where(F.col("run") == times + 1).groupBy("op").agg(F.min(F.struct("ts", "seq")).alias("first")).select(
        "op", F.col("first.seq").alias("seq")
    )


def retry_budget(events: DataFrame, target: str, max_retries: int, segment: str = "hour") -> DataFrame:
    """succeeded, cancelled or in_progress per operation.

    Success must come before ``max_retries`` other states; an event after the
    last retry cancels. Events are counted by time segment on the map side; only those of the
    segment of an operation's first hit are looked at one by one.
    """
    hit = F.lower("state") == target.lower()
    place = F.struct("ts", "seq")
    cut = events.withColumn("segment", F.date_trunc(segment, "ts"))
    sums = cut.groupBy("op", "segment").agg(F.count("*").alias("n"), F.min(F.when(hit, place)).alias("hit"))
    before = Window.partitionBy("op").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    first = F.min(F.when(F.col("hit").isNotNull(), F.struct("segment", "offset", "hit")))
    counted = sums.groupBy("op").agg(F.sum("n").alias("polls"), first.alias("first"))
    inside = (
        cut.join(counted.where("first IS NOT NULL").select("op", F.col("first.segment").alias("segment"), F.col("first.hit").alias("hit")), ["op", "segment"])
        .where(place < F.col("hit")).groupBy("op").agg(F.count("*").alias("inside"))
    )
    misses = F.when(F.col("first").isNotNull(), F.col("first.offset") + F.coalesce("inside", F.lit(0))).otherwise(F.col("polls"))
    status = (
        F.when(F.col("first").isNotNull() & (F.col("misses") < max_retries), "succeeded")
        .when(F.col("polls") > max_retries, "cancelled")
        .otherwise("in_progress")
    )
    return counted.join(inside, "op", "left").withColumn("misses", misses).select("op", "misses", status.alias("status"))


def operation_timeout(events: DataFrame, end_states: list[str], seconds: int) -> DataFrame:
    """Operations without an end state inside ``seconds`` of their first event."""
    ends = [s.lower() for s in end_states]
    spans = events.groupBy("op").agg(
        F.min("ts").alias("started"), F.min(F.when(F.lower("state").isin(ends), F.col("ts"))).alias("ended")
    )
    limit = F.col("started") + F.make_interval(secs=F.lit(seconds))
    return spans.select("op", (F.col("ended").isNull() | (F.col("ended") > limit)).alias("timed_out"))


def expected_set_arrived(events: DataFrame, expected: list[str]) -> DataFrame:
    """Operations of which every expected state has arrived, and the number that came."""
    wanted = F.collect_set(F.when(F.col("state").isin(expected), F.col("state")))
    return events.groupBy("op").agg(F.size(wanted).alias("arrived")).withColumn(
        "complete", F.col("arrived") == len(set(expected))
    )
