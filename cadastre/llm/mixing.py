"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents are shuffled by a hash and laid end to end as a cyclic stream of
words, cut into blocks of ``block`` words. Slot i of the mix takes the golden-ratio point
i * 2654435769 mod 2**32, mapped through the cumulative targets to a source; slots are
ranked per source, and the slot of rank r takes the source's block r. Any stretch of the
mix therefore holds the sources nearly in proportion. The last slot of a source is
trimmed to its target; the few slots that the points leave missing are appended, so every
source's words are its target, rounded down.

Targets: sources in order of code points, null last, weigh 3, 1, 2, repeating, and share
``share`` of all words; none gets more than ``most`` times its size, the excess goes to the
others by weight.

Only DataFrame functions are used. A null or empty text has size 0 and is never taken; a
null source is a source of its own, a null id is kept and shuffled like any other; rows
that repeat are rows of their own. Without words all targets are 0. Extra columns are not
read. A source that holds most rows is ranked in stretches; one table of the sources is
all that meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastre.llm.ranks import running, unit
from cadastre.session import materialise

GOLDEN = 2654435769
CELLS = 4096
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Mix:
    """What a mix consists of.

    ``sources``: k, source_size, target; ``slots``: slot, k, rank, first, n (words of the
    stream); ``taken``: doc_id, k, size, tie, taken, first_slot, n_slots, one row for each document: the
    words that its slots take, the first of these slots (null: none) and their number.
    """

    sources: DataFrame
    slots: DataFrame
    taken: DataFrame


def _identity() -> list[Column]:
    """Id, source (``t`` for null, else after an ``s``), words and hash of the text."""
    text = F.col("text").cast("string")
    return [
        F.col("doc_id").cast("long"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"),
        F.xxhash64(text),
    ]


def sized(docs: DataFrame) -> DataFrame:
    """``(doc_id, k, size, tie)``: what a row is known by."""
    return docs.select(*(c.alias(n) for c, n in zip(_identity(), ("doc_id", "k", "size", "tie"))))


def targets(rows: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``(k, source_size, target)``: water-filling of the shares below the caps."""
    sizes = rows.groupBy("k").agg(F.sum("size").alias("source_size"))
    one = Window.orderBy("k")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(F.row_number().over(one) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # sources in the order in which they reach their cap as the level rises
    rise = Window.orderBy(F.col("cap") / F.col("w"), "k")
    every = rise.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("cap").over(rise.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(rise.rowsBetween(0, Window.unboundedFollowing))
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - capped) / left
    levels = named.withColumn("level", F.when(F.col("cap") / F.col("w") > level, level))
    final = levels.withColumn("level", F.max("level").over(Window.partitionBy()))
    return final.select("k", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """``(slot, k, rank, first, n)``: which words of which source's stream each slot takes."""
    needs = sources.select("k", F.floor("target").alias("words")).withColumn("need", F.ceil(F.col("words") / block))
    total = needs.agg(F.coalesce(F.sum("need"), F.lit(0))).first()[0]
    order = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    span = needs.where("need > 0").withColumn("high", F.sum("need").over(order)).withColumn("low", F.col("high") - F.col("need"))
    scale = F.lit(float(max(total, 1)))
    cells = span.select(
        "k", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / scale * CELLS), F.least(F.floor(F.col("high") / scale * CELLS), F.lit(CELLS - 1).cast("long")))).alias("cell")
    )
    point = F.pmod(F.pmod("id", F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(1 << 32)) / F.lit(float(1 << 32))
    points = sources.sparkSession.range(total).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.floor(F.col("x") * CELLS))
    at = F.col("x") * scale
    drawn = points.join(cells, "cell").where((at >= F.col("low")) & (at < F.col("high"))).select("slot", "k")
    ranked = running(drawn, ["k"], F.col("slot") / scale, [F.col("slot")], F.lit(1), total, "rank")
    known = materialise(ranked.select("slot", "k", "rank"), "slots")
    got = needs.join(known.groupBy("k").agg(F.count("*").alias("got")), "k", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    # the appended slots go on where the schedule ends, source after source
    short = got.where("got < need").withColumn("lack", F.col("need") - F.col("got"))
    short = short.withColumn("begin", F.lit(total) + F.sum("lack").over(order) - F.col("lack"))
    missing = short.select("begin", "got", "k", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("rank"))
    missing = missing.select((F.col("begin") + F.col("rank") - F.col("got")).alias("slot"), "k", "rank")
    first = F.col("rank") * block
    return (
        known.union(missing).join(needs, "k").where("rank < need")
        .select("slot", "k", "rank", first.alias("first"), F.least(F.lit(block).cast("long"), F.col("words") - first).alias("n"))
    )


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 1024, seed: int = 11
) -> Mix:
    """Schedule of the mix and the words it takes of each document."""
    rows = materialise(sized(docs), "sized")
    count = rows.count()
    sources = materialise(targets(rows, weights, share, most), "sources")
    slots = materialise(schedule(sources, block), "slots")
    # rows of one id, or without, are spread by their size and text
    h = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "size", "tie", F.lit(seed))
    stream = running(rows.where("size > 0"), ["k"], unit(h), [F.col("doc_id"), F.col("size"), F.col("tie")], F.col("size"), count, "begin")
    stream = materialise(stream.select("doc_id", "k", "size", "tie", "begin"), "stream")
    passes = (
        stream.join(sources.select("k", "source_size", "target"), "k")
        # a stream is run through as often as the target needs; each pass puts the document further on
        .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("target") / F.col("source_size")) - 1, F.lit(0).cast("long")))))
        .withColumn("at", F.col("begin") + F.col("turn") * F.col("source_size")).where("at < target")
        .withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
        .select("k", "begin", "at", "size", "rank")
    )
    overlap = F.least(F.col("at") + F.col("size"), F.col("first") + F.col("n")) - F.greatest("at", "first")
    met = passes.join(slots.select("slot", "k", "rank", "first", "n"), ["k", "rank"]).withColumn("words", overlap).where("words > 0")
    # each slot of each pass that takes words of the document
    taken = met.groupBy("k", "begin").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count("*").alias("n_slots"))
    no = F.lit(0).cast("long")
    out = stream.join(taken, ["k", "begin"], "left").select(
        "doc_id", "k", "size", "tie", F.coalesce("taken", no).cast("long").alias("taken"), "first_slot", F.coalesce("n_slots", no).alias("n_slots")
    )
    none = rows.where("size = 0").select(
        "doc_id", "k", "size", "tie", no.alias("taken"), F.lit(None).cast("long").alias("first_slot"), no.alias("n_slots")
    )
    return Mix(sources, slots, out.union(none))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix holds them: each row as often as its words are taken, a part of half or more as a whole.

    Only the two ends of what a source gives are parts of a document. A row is found by its
    id, source, size and text; equal rows are taken alike, as often as the first of them.
    """
    times = F.round(F.col("taken") / F.col("size")).cast("int")
    names = ["doc_id", "k", "size", "tie"]
    marks = [f"__{n}" for n in names]
    taken = (
        mix(docs, **options).taken.where("size > 0").groupBy(*names).agg(F.max(times).alias("__times")).where("__times > 0")
        .select(*(F.col(n).alias(m) for n, m in zip(names, marks)), "__times")
    )
    taken = materialise(taken, "taken")
    # a table of checked size spares the texts a shuffle; a longer one is joined
    if taken.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        taken = F.broadcast(taken)
    marked = docs.select("*", *(c.alias(m) for c, m in zip(_identity(), marks)))
    same = [F.col(f"d.{m}").eqNullSafe(F.col(f"t.{m}")) for m in marks]
    joined = marked.alias("d").join(taken.alias("t"), same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return joined.select(*(F.col(f"d.`{c}`") for c in docs.columns))
