"""Status feeds as Structured Streaming jobs.

Events are rows (op, ts, seq, state). Each job is a streaming aggregate by operation and
segment of event time: a segment's summary is a few numbers (counts, the length of the
run it ends in, its first hit), put in order of time and not of arrival, so files may come
in any order within ``late``. When the watermark has passed the end of a segment, its state leaves; what
is written stays. So state is bounded by the events of the last segments, and an operation that holds
any share of all events is spread over its segments.

A job writes summaries in update mode. The function ``..._of`` beside it puts the summaries of an
operation together, in order of time, to the same result as the batch twin. Events that
come later than ``late`` after their segment are dropped, as the watermark says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastre.functions import pages as px
from cadastre.operators.status import OUTCOMES, outcome
from cadastre.session import scratch_path

SEGMENT, LATE = "1 hour", "10 minutes"
#: Members of an expected set that one number holds.
BITS = 60


def event_stream(spark: SparkSession, path: str, schema, glob: str, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream; what ``glob`` names may also be a table's folder of part files.

    Braces make a plain name a pattern too: without a pattern, Spark takes the path to be a folder.
    """
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path.rstrip('/')}/{{{glob}}}")


def run_to_end(stream: DataFrame, output_mode: str, label: str, progress: list | None = None) -> DataFrame:
    """Process what is there, and read back the rows of all micro-batches.

    A micro-batch overwrites its own folder, so one that is run again after a
    failure leaves no copies. ``progress`` takes the reports of the last micro-batches.
    A feed without files gives no rows.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    written = set()

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")
        written.add(batch_id)

    query = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    if progress is not None:
        progress.extend(query.recentProgress)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{base}/out") if written else spark.createDataFrame([], schema)


def last_update(updates: DataFrame, *keys: str) -> DataFrame:
    """Last row per key of an update-mode result."""
    rest = [c for c in updates.columns if c not in keys and c != "batch_id"]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_id").alias("u")).select(*keys, "u.*")


def _by_segment(events: DataFrame, segment: str, late: str, *summary: Column) -> DataFrame:
    """Summaries by operation and segment; update mode."""
    found = events.withWatermark("ts", late).groupBy("op", F.window("ts", segment)).agg(*summary)
    return found.select("op", F.col("window.start").alias("segment"), *_names(summary))


def _names(columns: tuple[Column, ...]) -> list[str]:
    return [f"s{i}" for i in range(len(columns))]


def _numbered(*summary: Column) -> list[Column]:
    return [c.alias(n) for c, n in zip(summary, _names(summary))]


def _latest(updates: DataFrame) -> DataFrame:
    """The last summary of each segment."""
    return last_update(updates, "op", "segment")


def _in_order() -> Column:
    """The events of a segment as numbers (ts, seq, hit), by time."""
    return F.array_sort(F.collect_list(F.struct("ts", "seq", "hit")))


def _with_hit(events: DataFrame, target: str) -> DataFrame:
    return events.select("op", "ts", "seq", F.coalesce(F.lower("state") == target.lower(), F.lit(False)).alias("hit"))


def _offsets(segments: DataFrame) -> DataFrame:
    """Segments with the number of events of the operation before each."""
    before = Window.partitionBy("op").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))


def operation_status(events: DataFrame, segment: str = SEGMENT, late: str = LATE) -> DataFrame:
    """Latest event (ts, seq, state) of each segment; update mode."""
    return _by_segment(events, segment, late, *_numbered(F.max(F.struct("ts", "seq", "state")))).withColumnRenamed("s0", "last")


def operation_status_of(updates: DataFrame, outcomes: dict[str, str] = OUTCOMES) -> DataFrame:
    """Outcome of the latest event per operation."""
    last = _latest(updates).groupBy("op").agg(F.max("last").alias("last"))
    return last.select("op", "last.seq", outcome(F.col("last.state"), outcomes).alias("status"))


def consecutive_target(events: DataFrame, target: str, times: int, segment: str = SEGMENT, late: str = LATE) -> DataFrame:
    """Per segment: events ``n``, the run of hits it ends in, whether it is all hits, the first hits it begins with, and where a run inside it is long enough; update mode."""
    wanted = times + 1

    def step(s, e):
        run = F.when(e["hit"], s["run"] + 1).otherwise(0)
        return F.struct(
            (s["n"] + 1).alias("n"), run.alias("run"), (s["clean"] & e["hit"]).alias("clean"),
            F.when(s["clean"] & e["hit"] & (F.size(s["lead"]) < wanted), F.array_append(s["lead"], e["seq"])).otherwise(s["lead"]).alias("lead"),
            F.coalesce(s["inside"], F.when(~s["clean"] & (run == wanted), e["seq"])).alias("inside"),
        )

    start = F.struct(
        F.lit(0).alias("n"), F.lit(0).alias("run"), F.lit(True).alias("clean"), F.array().cast("array<bigint>").alias("lead"), F.lit(None).cast("bigint").alias("inside")
    )
    found = _by_segment(_with_hit(events, target), segment, late, *_numbered(_in_order()))
    return found.select("op", "segment", F.aggregate("s0", start, step).alias("s")).select("op", "segment", "s.*")


def consecutive_target_of(updates: DataFrame, times: int) -> DataFrame:
    """First event of each operation at which the target was seen ``times`` + 1 times in a row.

    A run goes on from one segment into the next: what it brings along is the number of
    events since the last one that was no hit.
    """
    before = Window.partitionBy("op").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    start = F.when(~F.col("clean"), F.col("offset") + F.col("n") - F.col("run"))
    carried = _offsets(_latest(updates)).withColumn("start", start).withColumn("carry", F.col("offset") - F.coalesce(F.max("start").over(before), F.lit(0)))
    place = (times + 1 - F.col("carry")).cast("int")
    reached = F.coalesce(F.when(place >= 1, F.get("lead", place - 1)), F.col("inside"))
    return carried.withColumn("reached", reached).where("reached IS NOT NULL").groupBy("op").agg(F.min_by("reached", "segment").alias("seq"))


def retry_budget(events: DataFrame, target: str, segment: str = SEGMENT, late: str = LATE) -> DataFrame:
    """Per segment: events ``n``, and how many of them come before its first hit (null without one); update mode."""
    found = _by_segment(_with_hit(events, target), segment, late, *_numbered(_in_order()))
    place = F.array_position(F.transform("s0", lambda e: e["hit"]), True)
    return found.select("op", "segment", F.size("s0").alias("n"), F.when(place > 0, place - 1).alias("misses"))


def retry_budget_of(updates: DataFrame, max_retries: int) -> DataFrame:
    """succeeded, cancelled or in_progress per operation."""
    first = F.min(F.when(F.col("misses").isNotNull(), F.struct("segment", (F.col("offset") + F.col("misses")).alias("misses"))))
    found = _offsets(_latest(updates)).groupBy("op").agg(F.sum("n").alias("polls"), first.alias("first"))
    status = (
        F.when(F.col("first.misses") < max_retries, "succeeded").when(F.col("polls") > max_retries, "cancelled").otherwise("in_progress")
    )
    return found.select("op", F.coalesce("first.misses", "polls").alias("misses"), status.alias("status"))


def operation_timeout(events: DataFrame, end_states: list[str], segment: str = SEGMENT, late: str = LATE) -> DataFrame:
    """First, last and first ending event of each segment; update mode."""
    over = F.when(F.lower("state").isin([s.lower() for s in end_states]), F.col("ts"))
    found = _by_segment(events, segment, late, *_numbered(F.min("ts"), F.max("ts"), F.min(over)))
    return found.withColumnsRenamed({"s0": "started", "s1": "last", "s2": "ended"})


def operation_timeout_of(updates: DataFrame, seconds: int, late: str = LATE) -> DataFrame:
    """Operations that passed their time limit without an end state, as far as the watermark has come."""
    spans = _latest(updates)
    now = spans.agg(F.max("last")).first()[0]
    limit = F.col("started") + F.make_interval(secs=F.lit(seconds))
    found = spans.groupBy("op").agg(F.min("started").alias("started"), F.min("ended").alias("ended"))
    passed = limit < F.lit(now) - F.expr(f"INTERVAL {late}")
    return found.where((F.col("ended").isNull() | (F.col("ended") > limit)) & passed).select("op", F.lit(True).alias("timed_out"))


def expected_set(events: DataFrame, expected: list[str], segment: str = SEGMENT, late: str = LATE) -> DataFrame:
    """Which expected states came in each segment, as bits of numbers; update mode."""
    wanted = sorted(set(expected))
    masks = []
    for low in range(0, max(len(wanted), 1), BITS):
        bit = F.lit(0).cast("long")
        for i, state in enumerate(wanted[low : low + BITS]):
            bit = F.when(F.col("state") == state, F.lit(1 << i).cast("long")).otherwise(bit)
        masks.append(F.bit_or(bit))
    found = _by_segment(events, segment, late, *_numbered(*masks))
    return found.select("op", "segment", F.array(*_names(tuple(masks))).alias("bits"))


def expected_set_of(updates: DataFrame, expected: list[str]) -> DataFrame:
    """How many of the expected states arrived per operation, and whether all did."""
    wanted = len(set(expected))
    parts = [F.bit_or(F.get("bits", F.lit(i))).alias(f"b{i}") for i in range(max(1, -(-wanted // BITS)))]
    found = _latest(updates).groupBy("op").agg(*parts)
    arrived = F.lit(0)
    for i in range(len(parts)):
        arrived = arrived + F.bit_count(f"b{i}")
    return found.select("op", arrived.cast("int").alias("arrived")).withColumn("complete", F.col("arrived") == wanted)


def page_findings(pages: DataFrame) -> DataFrame:
    """Findings on note lines of pages (page, text) as they arrive; append mode.

    Narrow, so it runs on a stream or a table. A file source hands each file
    over once, and repeated batches overwrite themselves, so findings are
    appended once.
    """
    lines = pages.select("page", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.withColumn("expected", px.expected_note(F.col("text"))).where(
        "expected IS NOT NULL AND expected <> text"
    )
