"""Sharding by balanced label propagation: documents move towards the shards of those they are linked with.

Documents of equal text are linked. They are interchangeable, so the propagation runs on
one row a text: how many of its documents each shard holds. Texts begin laid end to end over the shards. A round lets every text ask
to move its smaller parts to the open shard that holds most of it; requests are summed per
pair of shards, and the quota of a pair is what comes back the other way: requests first,
then documents without a link. A part in a full shard may also follow a smaller part out of
it, if it can go whole. Rows of a pair are served in hash order up to its quota
(running sums, never a list), so every shard keeps its count, at most one apart from
the others (law ``rows``). Rounds end when nothing moves. Cut links can only fall.

A text with more documents than a shard fills one shard after another; its documents are
ranked in stretches, so no task holds them all. The driver sees only sums per pair of
shards.

A null text has size 1 and is linked with other nulls; null ids are rows like others;
rows that repeat are rows of their own; an empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.llm.ranks import running, unit
from cadastre.session import materialise


def _stretch(begin: Column, n: Column, ends: list[int]) -> Column:
    """Per shard how many of n documents from a position on it gets, the shards filled one after another."""
    bounds = zip([0, *ends[:-1]], ends)
    none = F.lit(0).cast("long")
    return F.array(*(F.greatest(F.least(begin + n, F.lit(high)) - F.greatest(begin, F.lit(low)), none).cast("long") for low, high in bounds))


def _quotas(wants: dict[tuple[int, int], int], free: list[int], exchange: bool = True) -> dict[tuple[int, int], int]:
    """What each pair of shards may move so that counts stay; ``free`` changes along.

    Without ``exchange`` a move counts on documents without a link only, not on what is asked for the other way.
    """
    allowed = {}
    shards = range(len(free))
    for a in shards:
        for b in range(a + 1, len(free)):
            ab, ba = wants.get((a, b), 0), wants.get((b, a), 0)
            both = min(ab, ba) if exchange else 0
            for x, y, more in ((a, b, ab - both), (b, a, ba - both)):
                swap = min(more, free[y])
                free[y] -= swap
                free[x] += swap
                allowed[(x, y)] = both + swap
    return allowed


def _sums(moves: DataFrame, amount: str) -> dict[tuple[int, int], int]:
    """Sums per pair of shards, shards * shards rows at most."""
    return {(r["from"], r["to"]): r.n for r in moves.groupBy("from", "to").agg(F.sum(amount).alias("n")).collect()}


def propagate(groups: DataFrame, shards: int, total: int, free: list[int]) -> tuple[DataFrame, list[int]]:
    """``(g1, g2, parts)`` when nothing moves any more, and the unlinked documents of each shard.

    Every move brings a part to one that is at least as large, or a part as a whole to another: the sum of the
    squares of all parts rises with each, so the rounds end.
    """
    spark = groups.sparkSession
    # the ways to move, tried one after another until one moves something: any part to a larger one; parts as a whole; such against free documents only
    state, way = groups, 0
    while way < 3:
        whole = way > 0
        open_now = [j for j in range(shards) if free[j] > 0] or list(range(shards))
        open_shards = F.array(*(F.lit(j) for j in open_now))
        best = F.array_max(F.transform(open_shards, lambda j: F.struct(F.get("parts", j).alias("n"), (-j).alias("j"))))
        if whole:
            room = F.element_at(F.array(*(F.lit(n) for n in free)), F.col("to") + 1)
            wanted = ~F.col("from").isin(open_now) & (F.col("there") > 0) & (F.col("m") > F.col("there")) & (F.col("m") <= room)
        else:
            wanted = F.col("m") <= F.col("there")
        asks = (
            state.withColumn("best", best).withColumn("to", -F.col("best.j"))
            .select("g1", "g2", "to", F.col("best.n").alias("there"), F.posexplode("parts").alias("from", "m"))
            .where((F.col("m") > 0) & (F.col("from") != F.col("to")) & wanted)
        )
        asks = materialise(asks.select("g1", "g2", "from", "to", "m"), "asks")
        wants = _sums(asks, "m")
        left = list(free)
        allowed = {k: v for k, v in _quotas(wants, left, way < 2).items() if v > 0}
        if not allowed:
            way += 1
            continue
        quota = spark.createDataFrame([(a, b, n) for (a, b), n in allowed.items()], "from int, to int, quota long")
        served = running(asks, ["from", "to"], unit(F.xxhash64("g1", "g2")), [F.col("g1"), F.col("g2")], F.col("m"), total, "before").join(quota, ["from", "to"])
        moved = served.withColumn("x", F.least(F.col("m"), F.col("quota") - F.col("before"))).where("x = m" if whole else "x > 0")
        moved = materialise(moved.select("g1", "g2", "from", "to", "x"), "moved")
        after, done = list(free), _sums(moved, "x")
        for (x, y), n in done.items():
            after[x] += n
            after[y] -= n
        if not done or min(after) < 0:
            way += 1  # parts that had to go whole found no room, and what was to go against them is too much
            continue
        free, way = after, 0
        change = moved.groupBy("g1", "g2").agg(F.collect_list(F.struct("from", "to", "x")).alias("moves"))  # at most one a shard
        state = materialise(
            state.join(change, ["g1", "g2"], "left").select(
                "g1", "g2",
                F.transform("parts", lambda n, j: n + F.aggregate(
                    F.coalesce("moves", F.array().cast("array<struct<from:int,to:int,x:bigint>>")), F.lit(0).cast("long"),
                    lambda s, v: s + F.when(v["to"] == j, v["x"]).when(v["from"] == j, -v["x"]).otherwise(0),
                )).alias("parts"),
            ),
            "parts",
        )
    return state, free


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.col("text").cast("string")
    rows = materialise(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit(1), text, F.octet_length(text)).alias("g2"),
        ),
        "rows",
    )
    total = rows.count()
    counts = materialise(rows.groupBy("g1", "g2").agg(F.count("*").alias("n")), "counts")
    linked = counts.where("n > 1")
    placed = running(linked, [], unit(F.xxhash64("g1", "g2")), [F.col("g1"), F.col("g2")], F.col("n"), max(total, 1), "p")
    n_linked = linked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # texts are laid end to end over even shares of the shards, so that a text is cut at a bound only
    share = [(n_linked - 1 - j) // shards + 1 for j in range(shards)]
    start = materialise(placed.select("g1", "g2", _stretch(F.col("p"), F.col("n"), list(accumulate(share))).alias("parts")), "parts")
    # the unlinked go on where the linked end, in turn
    free = [(total - 1 - j) // shards + 1 - share[j] for j in range(shards)]
    parts, free = propagate(start, shards, total, free)
    single = F.col("n") == 1
    known = (
        rows.join(counts, ["g1", "g2"]).join(parts, ["g1", "g2"], "left")
        .withColumn("parts", F.when(single, F.array(*(F.lit(n).cast("long") for n in free))).otherwise(F.col("parts")))
        .withColumn("g1", F.when(single, 0).otherwise(F.col("g1"))).withColumn("g2", F.when(single, 0).otherwise(F.col("g2")))
        .withColumn("single", single)
    )
    # rows of one id, or without, are spread by their text
    h = unit(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "text_crc32", "size", F.lit(3)))
    tie = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = running(known, ["single", "g1", "g2"], h, tie, F.lit(1), total, "r")
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.aggregate(F.slice("parts", 1, j), F.lit(0).cast("long"), lambda s, x: s + x))
    named = ranked.select("doc_id", "size", "text_crc32", F.size(F.filter(ends, lambda e: e <= F.col("r"))).alias("shard"))
    named = materialise(named, "sharded")
    out = running(named, ["shard"], h, tie, F.lit(1), total, "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
