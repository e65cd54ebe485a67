"""N-gram Jaccard join: an exact similarity join in the metric space of Jaccard distance.

A document is the set of its word shingles; two are linked when their similarity
reaches the threshold, that is when their Jaccard distance is at most ``t``. The join
narrows in three exact levels:

1. **Cells of the shingle universe as pivots.** The distance of a set to a cell counts
   their common shingles. Linked sets differ in at most D shingles (D follows from the
   sizes and the threshold), so of D + 1 or more disjoint cells at least one holds the
   same shingles of both. A document therefore goes into the region of each of its
   cells' contents; linked documents always meet in a region. Contents that many documents
   hold say little: a document leaves out its most frequent ones, as many as the distance
   allows, and of those that still meet the most frequent shingles, in the same way. So a
   passage that very many documents share makes none of them meet unless it is most of them.
2. **Documents as pivots.** Documents that meet form a district. A district that is too
   large is cut again by other cells of the universe, where few meet twice, or by
   documents as pivots into Voronoi regions: a document lives in the region of its
   nearest pivot and, by the triangle inequality, visits every region in which a linked
   document could live (distance at most that of the nearest pivot plus 2t, and at most
   the region's radius plus t). That goes on while it halves the comparisons.
3. **Rings.** A region that no pivot can cut is put in the order of distance to its pivot
   and split into blocks; two blocks meet only if their distances are within t.

Distances inside the last pieces are exact set sizes. Only linked documents come out,
never all pairs of a group, and groups of copies are first folded to one set.

Nulls and empty texts have no shingle and no link; a row without id has no component.
Rows that repeat an id share a component. Columns other than the id and the text are
not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastre.llm.graph import connected_components
from cadastre.llm.words import U, Words, blocks, mix, mix_int, shingle_sets, tidy
from cadastre.session import materialise, release

SEEDS = 3
BROADCAST_ROWS = 1_000_000


@functools.cache
def _classes(percent: int, most: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Size classes: their least sizes, and per class the number of cells, how many of them linked sets share at
    least, and how many shingles a cell must hold to count.

    Linked sets fall in the same or in neighbouring classes. Light cells say little and
    are not used: there are so many cells that, as a rule, linked sets share a heavy one.
    """
    lows, cells = [1], []
    while lows[-1] <= most:
        low = lows[-1]
        high = max(low + 1, -(-low * 100 // percent))
        a, b = high - 1, (high - 1) * 100 // percent
        differ = (100 - percent) * (a + b) // (100 + percent)
        m, heavy = differ + 1, 1
        if differ:
            for heavy in (3, 2, 1):
                m = differ + 1
                for _ in range(60):
                    load = low / m
                    light = m * sum(math.exp(-load) * load**k / math.factorial(k) for k in range(heavy))
                    want = differ + 1 + math.ceil(light + 2.5 * math.sqrt(light))
                    if want <= m:
                        break
                    m += max(1, (want - m) // 4)
                if want <= m <= max(1.4 * (differ + 1), differ + 4):
                    break
            else:
                m, heavy = differ + 2, 1
        cells.append((m, m - differ, heavy))
        lows.append(high)
    return lows, cells


@functools.lru_cache(4096)
def _edges(m: int) -> np.ndarray:
    return np.array([(k << 64) // m for k in range(m)], dtype=U)


def _families(s: np.ndarray, percent: int, salt: int = 0) -> tuple[np.ndarray, int]:
    """Keys of a set of shingles (sorted, distinct), and how many of each family may be left out.

    A family is the cells of one class and one cut of the universe; the last three bits of a key name it.
    Of d + 1 cells of a family at least one is the same in every linked set, d being the shingles in which
    linked sets may differ. So under one order of all keys the first d + 1 of either set hold a common one,
    and the rest may go. The second result has that rest, 255 at most, in eight bits a family.
    """
    n = len(s)
    if n == 0:
        return s, 0
    lows, cells = _classes(percent, 1 << max(10, n.bit_length() + 1))
    own = int(np.searchsorted(lows, n, side="right")) - 1
    out, spare = [], 0

    def add(keys, family):
        out.append(keys & U(2**64 - 8) | U(family))

    with np.errstate(over="ignore"):
        for c in {own, max(own - 1, 0)}:
            m, shared, heavy = cells[c]
            for seed in range(SEEDS):
                family = (c & 1) * 4 + seed
                v = s if seed + salt == 0 else np.sort(mix(s ^ U(mix_int(seed + salt * SEEDS + 77))))
                sums = np.zeros(n + 1, dtype=U)
                np.cumsum(mix(v), out=sums[1:])
                at = np.append(np.searchsorted(v, _edges(m)), n)
                full = at[1:] - at[:-1] >= heavy
                key = mix((sums[at[1:]] - sums[at[:-1]]) ^ mix(np.arange(m, dtype=U) + U(mix_int((c * SEEDS + seed) * 64 + salt))))
                add(key[full], family)
                # a set with so many light cells may share only those with a linked one
                if m - int(full.sum()) < shared:
                    spare |= min(255, int(full.sum()) - (m - shared + 1)) << 8 * family
                    break
            else:
                add(key[~full], family - seed + SEEDS)
    return np.concatenate(out), spare


def signatures(s: np.ndarray, percent: int, salt: int = 0) -> np.ndarray:
    """Keys of the regions that a set of shingles (sorted, distinct) belongs to; each ``salt`` cuts the universe anew."""
    return _families(s, percent, salt)[0]


def _set_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return mix_int(int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U)) ^ len(s)) if len(s) else 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


_DOC = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.int64()), ("spare", pa.int64()), ("keys", pa.list_(pa.int64()))])


def keyed_documents(docs: DataFrame, n: int, percent: int, lower: bool) -> DataFrame:
    """One row per document: size and key of its set, its region keys, and how many of them may be left out; of equal sets of a block the first alone has keys."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                ids, sizes, sets, spares, keys, seen = part.column("doc_id").to_pylist(), [], [], [], [], set()
                for i, s in zip(ids, shingle_sets(Words(part.column("text")), n, lower)):
                    name = _set_key(s)
                    k, spare = _families(s, percent) if i is not None and name not in seen else (s[:0], 0)
                    if i is not None:
                        seen.add(name)
                    sizes.append(len(s))
                    sets.append(name)
                    spares.append(spare)
                    keys.append(k)
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))), pa.int32())
                flat = np.concatenate(keys) if keys else np.zeros(0, dtype=U)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(_signed(np.array(sets, dtype=U)), pa.int64()),
                        pa.array(_signed(np.array(spares, dtype=U)), pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(_signed(flat), pa.int64())),
                    ],
                    schema=_DOC,
                )

    schema = "doc_id long, n_shingles long, set_key long, spare long, keys array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema)


def _shingled(members: DataFrame, n: int, lower: bool) -> DataFrame:
    """``(doc_id, text)`` to ``(doc_id, s)``, s sorted as unsigned numbers."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                sets = shingle_sets(Words(part.column("text")), n, lower)
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                flat = np.concatenate(sets) if sets else np.zeros(0, dtype=U)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(_signed(flat), pa.int64()))],
                    names=["doc_id", "s"],
                )

    return members.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, s array<long>")


def _shared(rows: DataFrame, who: str) -> DataFrame:
    """Rows whose ``key`` more than one ``who`` has."""
    of_key = Window.partitionBy("key")
    ends = rows.withColumn("__low", F.min(who).over(of_key)).withColumn("__high", F.max(who).over(of_key))
    return ends.where("__low <> __high").drop("__low", "__high")


def _rarest(shared: DataFrame, who: list, spare) -> DataFrame:
    """Rows of ``shared`` without the ``spare`` most frequent keys of each ``who``; a key that one alone has is rarer than all of these."""
    counted = shared.join(shared.groupBy("key").agg(F.count("*").alias("__n")), "key")
    place = F.row_number().over(Window.partitionBy(*who).orderBy(F.col("__n").desc(), "key"))
    return counted.withColumn("__place", place).where(F.col("__place") > spare).drop("__place", "__n")


def _meeting_sets(keyed: DataFrame) -> DataFrame:
    """Names ``set_key`` of the sets that meet another in a cell of the universe."""
    held = materialise(_shared(keyed.select("set_key", F.explode("keys").alias("key")), "set_key").distinct(), "held")
    spares = keyed.where("spare <> 0").select("set_key", "spare").distinct()
    family = F.col("key").bitwiseAND(F.lit(7).cast("long"))
    spare = F.call_function("shiftrightunsigned", F.coalesce("spare", F.lit(0).cast("long")), (8 * family).cast("int")).bitwiseAND(F.lit(255).cast("long"))
    kept = _rarest(held.join(spares, "set_key", "left"), ["set_key", family], spare)
    met = materialise(_shared(kept.select("set_key", "key"), "set_key").select("set_key").distinct(), "meeting")
    release(held)
    return met


def _meetings(shingles: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: documents of ``(doc_id, h, s)`` that share one of their rarest shingles, each with the smallest it so meets."""
    # a linked set holds all but w - ceil(percent w / 100) of w shingles; of one more at least one is shared
    spare = F.ceil(F.col("w") * percent / 100) - 1
    rows = shingles.select("doc_id", "h", F.size("s").alias("w"), F.explode("s").alias("key"))
    shared = materialise(_shared(rows.select("h", "w", "key"), "h"), "shared")
    kept = _rarest(shared, ["h"], spare).select("h", "key")
    first = kept.join(shingles.select("h", "doc_id"), "h").withColumn("first", F.min("doc_id").over(Window.partitionBy("key")))
    met = materialise(first.where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct(), "met")
    release(shared)
    return met


def _links_within(percent: int):
    """Task that compares the two sides of a piece: rows ``(piece, side, doc_id, s)`` to links."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("side").to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        side = table.column("side").to_numpy()
        docs = table.column("doc_id").to_numpy()
        lists = table.column("s").combine_chunks()
        size = np.diff(np.asarray(lists.offsets)).astype(np.int64)
        flat = np.asarray(lists.flatten())
        owner = np.repeat(np.arange(len(docs)), size)
        # shingles that one document alone has count for its size and nothing else
        _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[inverse] > 1
        column = np.cumsum(count > 1)[inverse[shared]] - 1
        owner = owner[shared]
        n, width = len(docs), int((count > 1).sum())
        common = np.zeros((n, n), dtype=np.float32)
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for low in range(0, width, 4096):
            a, b = np.searchsorted(column, [low, low + 4096])
            dense = np.zeros((n, min(4096, width - low)), dtype=np.float32)
            dense[owner[a:b], column[a:b] - low] = 1
            common += dense @ dense.T
        common = common.astype(np.int64)
        union = size[:, None] + size[None, :] - common
        i, j = np.nonzero((100 * common >= percent * union) & (union > 0))
        # blocks of one side (0), or of two (1 against 2)
        good = np.where((side[i] == 0) | (side[j] == 0), i < j, (side[i] == 1) & (side[j] == 2))
        i, j = i[good], j[good]
        a, b = np.minimum(docs[i], docs[j]), np.maximum(docs[i], docs[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _distance(a: str, b: str):
    """Jaccard distance of two arrays of distinct numbers, none empty."""
    common = F.size(F.array_intersect(a, b))
    return 1 - common / (F.size(a) + F.size(b) - common)


def _weights(members: DataFrame, piece: int, piece_docs: int) -> DataFrame:
    """Per region its documents, and whether one task may compare them; a pair is never cut."""
    n, weight = F.count("*"), F.sum(F.col("w").cast("long"))
    return members.groupBy("region").agg(n.alias("n_docs"), ((n <= 2) | (n <= piece_docs) & (weight <= piece)).alias("fits"))


def _by_cells(large: DataFrame, percent: int, salt: int) -> DataFrame:
    """Cut regions by a new set of cells: ``(region, cell, doc_id)``; of cells with the same documents one is kept."""

    def run(batches):
        for batch in batches:
            lists = batch.column("s")
            flat, at = np.asarray(lists.flatten()).view(U), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
            keys = [signatures(flat[a:b], percent, salt) for a, b in zip(at[:-1], at[1:])]
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(k) for k in keys]))), pa.int32())
            values = pa.array(_signed(np.concatenate(keys)) if keys else np.zeros(0, dtype=np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], names=["region", "doc_id", "keys"])

    keyed = materialise(large.select("region", "doc_id", "s").mapInArrow(tidy(run), "region long, doc_id long, keys array<long>"), "keyed")
    rows = keyed.select("region", "doc_id", F.explode("keys").alias("key"))
    mark = lambda n: F.sum(F.xxhash64("doc_id", F.lit(n)).cast("decimal(20,0)"))
    groups = rows.groupBy("region", "key").agg(F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y")).where("n > 1")
    kept = groups.groupBy("region", "n", "x", "y").agg(F.min("key").alias("key"))
    cells = materialise(
        rows.join(kept.select("region", "key"), ["region", "key"]).select("region", F.xxhash64("region", "key", F.lit(salt)).alias("cell"), "doc_id"), "cells"
    )
    release(keyed)
    return cells


def _worthwhile(large: DataFrame, cells: DataFrame) -> DataFrame:
    """Regions whose cells need at most half the comparisons of the region itself."""
    square = F.col("n").cast("double") * F.col("n")
    cost = cells.groupBy("region", "cell").agg(F.count("*").alias("n")).groupBy("region").agg(F.sum(square).alias("cost"))
    n_docs = large.groupBy("region").agg(F.first("n_docs").cast("double").alias("n"))
    judged = n_docs.join(cost, "region", "left").where(F.coalesce("cost", F.lit(0.0)) <= 0.5 * square).select("region")
    return materialise(judged, "judged")


def _to_pivots(large: DataFrame, pivots_per_region: int, salt: int) -> DataFrame:
    """Distances ``(region, doc_id, cell, far)`` of every member to every pivot of its region."""
    slot = F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(pivots_per_region))
    pivots = (
        large.groupBy("region", slot.alias("slot"))
        .agg(F.min_by("s", F.xxhash64("doc_id", F.lit(salt + 1))).alias("pivot"))
        .select("region", F.xxhash64("region", "slot", F.lit(salt)).alias("cell"), "pivot")
    )
    far = large.join(pivots, "region").select("region", "doc_id", "cell", _distance("s", "pivot").alias("far"))
    return materialise(far, "distances")


def _voronoi(large: DataFrame, far: DataFrame, t: float) -> DataFrame:
    """Who lives in or visits which cell: ``(region, cell, doc_id)``."""
    slack = 1e-9
    near = far.groupBy("region", "doc_id").agg(F.min(F.struct("far", "cell")).alias("n"))
    placed = far.join(near, ["region", "doc_id"])
    radius = placed.where(F.col("cell") == F.col("n.cell")).groupBy("cell").agg(F.max("far").alias("radius"))
    return (
        placed.join(radius, "cell")
        .where((F.col("far") <= F.col("n.far") + 2 * t + slack) & (F.col("far") <= F.col("radius") + t + slack))
        .select("region", "cell", "doc_id")
    )


def _rings(stuck: DataFrame, far: DataFrame, piece: int, piece_docs: int, t: float) -> DataFrame:
    """Blocks of a region in the order of distance to its most central pivot; blocks within ``t`` of each other meet.

    Rows ``(piece, side, doc_id)``. A block is a stretch of distances, or, where many
    documents have one distance, a share of them by hash.
    """
    # a document weighs its share of what a block may hold
    share_of = F.greatest(F.col("w") / F.lit(piece / 2), F.lit(2 / piece_docs))
    bins = 512
    centre = far.groupBy("region", "cell").agg(F.avg("far").alias("mean")).groupBy("region").agg(F.min_by("cell", F.struct("mean", "cell")).alias("cell"))
    placed = (
        stuck.join(far.join(centre, ["region", "cell"]).select("region", "doc_id", "far"), ["region", "doc_id"])
        .withColumn("bin", F.floor(F.col("far") * bins))
    )
    weights = placed.groupBy("region", "bin").agg(F.sum(share_of).alias("load"))
    before = weights.withColumn("c", F.sum("load").over(Window.partitionBy("region").orderBy("bin")) - F.col("load"))
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / (1 << 20)
    blocked = placed.join(before, ["region", "bin"]).withColumn("block", F.floor(F.col("c") + share * F.col("load")))
    blocked = materialise(blocked.select("region", "block", "doc_id", "far"), "blocks")
    span = blocked.groupBy("region", "block").agg(F.min("far").alias("low"), F.max("far").alias("high"))
    right = span.select("region", F.col("block").alias("other"), F.col("low").alias("low2"))
    pairs = (
        span.join(right, "region")
        .where((F.col("block") <= F.col("other")) & (F.col("low2") - F.col("high") <= t + 1e-9))
        .select("region", "block", "other", F.xxhash64("region", "block", "other").alias("piece"))
    )
    same = F.col("block") == F.col("other")
    use = pairs.select("region", "block", "piece", F.when(same, 0).otherwise(1).alias("side")).union(
        pairs.where(~same).select("region", F.col("other").alias("block"), "piece", F.lit(2).alias("side"))
    )
    return blocked.join(use, ["region", "block"]).select("piece", "side", "doc_id")


def _pieces(members: DataFrame, sets: DataFrame, percent: int, piece: int, piece_docs: int, pivots_per_region: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pieces ``(piece, side, doc_id)`` that together hold every linked pair of a region, and the tables they are read from.

    ``members`` are ``(region, doc_id, w)`` with the number of shingles, ``sets`` the shingles themselves. A region is
    cut by new cells of the universe, else by pivots, as long as that halves
    the comparisons; what cannot be cut so is split into rings. Only regions that are cut carry
    sets from step to step.
    """
    t = 1 - percent / 100
    out, salt, read = None, 0, []
    while True:
        salt += 1
        sized = members.join(_weights(members, piece, piece_docs), "region")
        small = sized.where("fits").select(F.xxhash64("region", F.lit(salt)).alias("piece"), F.lit(0).alias("side"), "doc_id")
        out = small if out is None else out.union(small)
        large = materialise(sized.where("not fits").join(sets, "doc_id"), "large")
        if large.limit(1).count() == 0:
            return out, read
        inside = lambda cells, chosen, rows: rows.join(cells.join(chosen, "region", "left_semi"), ["region", "doc_id"]).select(F.col("cell").alias("region"), "doc_id", "w")
        by_cells = _by_cells(large, percent, salt)
        good = _worthwhile(large, by_cells)
        parts = inside(by_cells, good, large)
        rest = large.join(good, "region", "left_anti")
        far = _to_pivots(rest, pivots_per_region, salt)
        by_pivots = materialise(_voronoi(rest, far, t), "cells")
        good = _worthwhile(rest, by_pivots)
        parts = parts.union(inside(by_pivots, good, rest))
        out = out.union(materialise(_rings(rest.join(good, "region", "left_anti"), far, piece, piece_docs, t), "rings"))
        members = materialise(parts.distinct(), "members")
        read.append(members)
        release(large)


def jaccard_links(
    docs: DataFrame, n: int = 4, percent: int = 85, lower: bool = True, piece: int = 32_000, piece_docs: int = 128, pivots_per_region: int = 8
) -> tuple[DataFrame, DataFrame]:
    """Links ``(a, b)`` between documents of different sets, and ``(doc_id, n_shingles, set_key)`` of every row.

    ``percent`` is the least similarity, ``n`` the words of a shingle. ``piece`` bounds the
    shingles, ``piece_docs`` the documents that a task compares at a time (two long documents
    are still compared whole).
    Of documents with equal sets the smallest id stands for all.
    """
    keyed = materialise(keyed_documents(docs, n, percent, lower), "keyed")
    rows = materialise(keyed.select("doc_id", "n_shingles", "set_key"), "rows")
    meeting = _meeting_sets(keyed)
    release(keyed)
    named = rows.where("n_shingles > 0 and doc_id is not null").join(meeting, "set_key")
    chosen_ids = chosen = materialise(named.groupBy("n_shingles", "set_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "chosen")
    # a list of ids of checked size spares the texts a shuffle; a longer one is joined
    if chosen.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = _shingled(chosen.join(texts, "doc_id"), n, lower).where("size(s) > 0")
    # rows that repeat an id: the set of the chosen one may come twice, and another one's beside it
    shingles = materialise(members.groupBy(F.xxhash64("s").alias("h")).agg(F.first("s").alias("s"), F.min("doc_id").alias("doc_id")), "members")
    met = _meetings(shingles, percent)
    # whom a document meets hangs on the smallest of them: far fewer links, the same districts
    hung = met.withColumn("least", F.min("b").over(Window.partitionBy("a")))
    links = hung.select(F.col("a"), F.col("least").alias("b")).union(hung.select(F.col("b").alias("a"), F.col("least").alias("b"))).where("a <> b").distinct()
    district = materialise(connected_components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("region")), "districts")
    of_id = shingles.select("doc_id", "s")
    placed = of_id.join(district, "doc_id").select("region", "doc_id", F.size("s").alias("w"))
    pieces, read = _pieces(placed, of_id, percent, piece, piece_docs, pivots_per_region)
    found = materialise(pieces.join(of_id, "doc_id").groupBy("piece").applyInArrow(_links_within(percent), "a long, b long").distinct(), "found")
    release(shingles, meeting, chosen_ids, met, district, *read)
    return found, rows


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and n_links, its different partners.

    Equal sets are linked; n_links counts links between different sets, of the set's
    smallest document, and is null for the others.
    """
    found, rows = jaccard_links(docs, **options)
    same = rows.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "set_key").agg(F.min("doc_id").alias("least"))
    copies = (
        rows.where("n_shingles > 0 and doc_id is not null").join(same, ["n_shingles", "set_key"])
        .where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    )
    component = connected_components(found.select("a", "b").union(copies))
    degree = found.select(F.explode(F.array("a", "b")).alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n_links"))
    return (
        rows.join(component.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .join(degree, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), "n_links")
    )


def one_of_each_group(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the document of smallest id of each component; rows without an id stay, of rows that repeat an id one stays."""
    found = jaccard_components(docs, **options)
    gone = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct(), "followers")
    # a list of ids of checked size spares the texts a shuffle; a longer one is joined
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    twice = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("__twice"))
    twice = materialise(twice, "twice")
    if twice.limit(1).count() == 0:
        return kept
    once = kept.join(twice, F.col("doc_id") == F.col("__twice"), "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, F.col("doc_id") == F.col("__twice"), "left_anti").unionByName(once)
