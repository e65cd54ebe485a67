"""Hard negatives of anchors: vectors of another label that score nearly as high as a positive.

An anchor's positives are the rows of its label with the highest inner products. A positive
of score p opens a window of scores, from ``least`` to ``most`` percent of p, and the best
rows of other labels inside it are its hard negatives.

Both searches prune by coordinates, in the manner of LEMP:

- **Length buckets.** Vectors are put into buckets by length (powers of 2 ** 1/2), and a
  bucket into blocks of bounded size. A block holds its vectors in order of length and, for every coordinate,
  the sorted list of its normalised values.
- **Local threshold.** A score that an anchor must reach, divided by its length and by the
  longest vector of the block, is a cosine that a partner in this block must have. Above 1 the block is
  skipped, and vectors too short for it are left out.
- **Feasible ranges.** At the anchor's largest (focus) coordinates, such a cosine leaves a range of
  values: if the coordinates are cosines of angles, the angles differ by no more than that of
  the threshold. Binary search in the sorted lists gives the candidates of each
  range, and the sets are intersected.
- **Partial products.** The survivors' products over a quarter, then half of the
  coordinates, with the Cauchy-Schwarz bound of the rest, leave out those that cannot reach the threshold.
- Exact integer products verify what is left.

The threshold rises during the search: the first block of each bucket gives each window the
score of its k-th best row so far, which the other blocks must reach. Bounds carry a
margin for rounding and equal scores are never pruned, so results are exact.

- A row whose label or vector is null, or that has a null or non-finite component, or no id, takes no part.
- Vectors of different lengths (numbers of components) do not meet.
- Rows that repeat an id are candidates each, but never for the anchor of that id; as anchors
  they are one, with the smallest of their vectors.
- A positive whose score is below 0 has an empty window, and so has no negative.
- Components beyond a long count as the largest long, scores likewise.
- Fewer rows than asked for give all there are; an empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastre.llm.codes import kept_vectors
from cadastre.session import materialise

BLOCK = 2048
ANCHORS = 256
FOCUS = 6
MARGIN = 1e-9
LONG = 2**63 - 1


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of a with rows of b; beyond a long, the largest or smallest long."""
    most = int(np.abs(a.astype(np.float64)).max(initial=0) + 1) * int(np.abs(b.astype(np.float64)).max(initial=0) + 1) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.array([[max(-LONG - 1, min(LONG, int(x))) for x in r] for r in exact], dtype=np.int64).reshape(len(a), len(b))


def lengths(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))


class Bucket:
    """Vectors by falling length, with a sorted list of normalised values for every coordinate."""

    def __init__(self, matrix: np.ndarray, lists: np.ndarray | None = None):
        self.length = lengths(matrix)
        self.units = matrix / np.maximum(self.length, 1e-300)[:, None]
        # place of each value of a coordinate in rising order: one list a row
        self.lists = np.argsort(self.units, axis=0, kind="stable").T if lists is None else lists

    def survivors(self, anchor: np.ndarray, floor: float) -> np.ndarray:
        """Places of the vectors that may have a product of ``floor`` or more with the anchor."""
        n = len(self.length)
        size = float(np.sqrt((anchor.astype(np.float64) ** 2).sum()))
        if floor <= 0 or not n:
            return np.arange(n)
        if size == 0:
            return np.zeros(0, dtype=np.int64)
        need = floor * (1 - MARGIN) / size
        longest = float(self.length[0])
        if need > longest:
            return np.zeros(0, dtype=np.int64)
        n = int(np.searchsorted(-self.length, -need, side="right"))
        q = anchor / size
        order = np.argsort(-np.abs(q), kind="stable")
        angle = math.acos(min(1.0, need / longest)) + 1e-7
        slices = []
        for f in order[:FOCUS]:
            at = math.acos(max(-1.0, min(1.0, float(q[f]))))
            low, high = math.cos(min(at + angle, math.pi)), math.cos(max(at - angle, 0.0))
            places = self.lists[f]
            values = self.units[places, f]
            a, b = np.searchsorted(values, low - MARGIN, side="left"), np.searchsorted(values, high + MARGIN, side="right")
            if b - a < len(values):
                slices.append(places[a:b])
        if slices:
            met = np.bincount(np.concatenate(slices), minlength=len(self.length))
            keep = np.flatnonzero(met[:n] == len(slices))
        else:
            keep = np.arange(n)
        for share in (4, 2):
            head = order[: max(1, len(order) // share)]
            if len(keep) < 16 or len(head) == len(order):
                break
            c = self.units[np.ix_(keep, head)]
            rest = math.sqrt(max(0.0, 1 - float((q[head] ** 2).sum())))
            bound = c @ q[head] + rest * np.sqrt(np.maximum(0.0, 1 - (c * c).sum(axis=1)))
            keep = keep[bound + MARGIN >= need / self.length[keep]]
        return keep


def _pack(matrix: np.ndarray) -> bytes:
    small = not matrix.size or np.abs(matrix.astype(np.float64)).max() < 2**31 - 1
    return matrix.astype(np.int32 if small else np.int64).tobytes()


def _unpack(data: bytes, rows: int, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((rows, 0), dtype=np.int64)
    kind = np.int32 if len(data) == 4 * rows * dim else np.int64
    return np.frombuffer(data, dtype=kind).reshape(rows, dim).astype(np.int64)


def _matrix(table: pa.Table) -> np.ndarray:
    dim = table.column("dim")[0].as_py()
    return np.asarray(table.column("v").combine_chunks().flatten(), dtype=np.int64).reshape(table.num_rows, dim)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64)


def labelled_vectors(table: DataFrame, label: str = "label", scale: int = 256) -> DataFrame:
    """``(vec_id, label, lab, dim, v)`` of the rows that take part; ``lab`` tells labels apart as a long."""
    rows = kept_vectors(table, label).where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    whole = isinstance(rows.schema["label"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    lab = F.col("label").cast("long") if whole else F.xxhash64("label")
    return rows.select("vec_id", "label", lab.alias("lab"), F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _buckets(vectors: DataFrame, by: list[str], size: int) -> DataFrame:
    """Packed blocks of the length buckets of each group ``by``, with sorted coordinate lists; ``first`` is true for one block of each bucket."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    rows = vectors.withColumn("bucket", F.floor(F.log2(square + 1)))
    counts = rows.groupBy("dim", "bucket", *by).agg(F.count("*").alias("many"))
    salt = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("many") / size))
    placed = rows.join(counts, ["dim", "bucket", *by]).select(
        "vec_id", "lab", "dim", "v", (salt == 0).alias("first"), F.xxhash64("dim", "bucket", *by, salt).alias("block")
    )

    def pack(table: pa.Table) -> pa.Table:
        ids, lab, matrix = _numbers(table, "vec_id"), _numbers(table, "lab"), _matrix(table)
        length = lengths(matrix)
        order = np.lexsort((ids, -length))
        lists = Bucket(matrix[order]).lists.astype(np.uint16 if len(ids) < 2**16 else np.uint32)
        return pa.table({
            "block": table.column("block").slice(0, 1), "first": table.column("first").slice(0, 1), "dim": table.column("dim").slice(0, 1),
            "lab": pa.array([lab[0]], pa.int64()), "n": pa.array([len(ids)], pa.int32()), "longest": pa.array([float(length.max())], pa.float64()),
            "ids": pa.array([ids[order].tobytes()], pa.binary()), "labs": pa.array([lab[order].tobytes()], pa.binary()),
            "data": pa.array([_pack(matrix[order])], pa.binary()), "lists": pa.array([np.ascontiguousarray(lists).tobytes()], pa.binary()),
        })

    schema = "block long, first boolean, dim int, lab long, n int, longest double, ids binary, labs binary, data binary, lists binary"
    return materialise(placed.groupBy("block").applyInArrow(pack, schema), "buckets")


def _asked(anchors: DataFrame, by: list[str], size: int) -> DataFrame:
    """Packed blocks of anchors ``(vec_id, lab, dim, v, lows, highs)``: ids, labels, vectors and windows of scores."""
    counts = anchors.groupBy("dim", *by).agg(F.count("*").alias("many"))
    salt = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("many") / size))
    placed = anchors.join(counts, ["dim", *by]).withColumn("ask", F.xxhash64("dim", *by, salt))

    def pack(table: pa.Table) -> pa.Table:
        matrix, lows = _matrix(table), table.column("lows").to_pylist()
        width = max(len(w) for w in lows)
        # an anchor with fewer windows has empty ones
        low, high = np.full((len(lows), width), LONG, dtype=np.int64), np.full((len(lows), width), -LONG, dtype=np.int64)
        for i, (a, b) in enumerate(zip(lows, table.column("highs").to_pylist())):
            low[i, : len(a)], high[i, : len(b)] = a, b
        reach = np.where(low <= high, low, LONG).min(axis=1).astype(np.float64) / np.maximum(lengths(matrix), 1e-300)
        return pa.table({
            "dim": table.column("dim").slice(0, 1), "a_lab": table.column("lab").slice(0, 1), "a_n": pa.array([len(lows)], pa.int32()),
            "width": pa.array([width], pa.int32()), "reach": pa.array([float(reach.min()) * (1 - MARGIN)], pa.float64()),
            "a_ids": pa.array([_numbers(table, "vec_id").tobytes()], pa.binary()), "a_labs": pa.array([_numbers(table, "lab").tobytes()], pa.binary()),
            "a_data": pa.array([_pack(matrix)], pa.binary()), "low": pa.array([low.tobytes()], pa.binary()), "high": pa.array([high.tobytes()], pa.binary()),
        })

    schema = "dim int, a_lab long, a_n int, width int, reach double, a_ids binary, a_labs binary, a_data binary, low binary, high binary"
    return materialise(placed.groupBy("ask").applyInArrow(pack, schema), "asked")


def _searched(same: bool, k: int):
    """Task over pairs of blocks: the k best rows of the block in each window of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                longs = lambda c: np.frombuffer(r[c], dtype=np.int64)  # noqa: B023, E731
                ids, labs, a_ids, a_labs = longs("ids"), longs("labs"), longs("a_ids"), longs("a_labs")
                matrix, anchors = _unpack(r["data"], r["n"], r["dim"]), _unpack(r["a_data"], r["a_n"], r["dim"])
                low, high = longs("low").reshape(r["a_n"], r["width"]), longs("high").reshape(r["a_n"], r["width"])
                kind = np.uint16 if r["n"] < 2**16 else np.uint32
                bucket = Bucket(matrix, np.frombuffer(r["lists"], dtype=kind).reshape(r["dim"], r["n"]))
                out = []
                for i in range(r["a_n"]):
                    open_ = low[i] <= high[i]
                    if not open_.any():
                        continue
                    keep = bucket.survivors(anchors[i], float(low[i][open_].min()))
                    keep = keep[((labs[keep] == a_labs[i]) == same) & (ids[keep] != a_ids[i])]
                    if not len(keep):
                        continue
                    score = scores(anchors[i : i + 1], matrix[keep])[0]
                    order = np.lexsort((ids[keep], -score))
                    keep, score = ids[keep][order], score[order]
                    for w in np.flatnonzero(open_).tolist():
                        # scores fall, so a window is a stretch of them
                        inside = np.flatnonzero((score <= high[i, w]) & (score >= low[i, w]))[:k]
                        if len(inside):
                            out.append((np.full(len(inside), a_ids[i]), np.full(len(inside), w, dtype=np.int64), keep[inside], score[inside]))
                if out:
                    columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)]
                    yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "window", "vec_id", "score"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_in_windows(anchors: DataFrame, buckets: DataFrame, k: int, same: bool, size: int = ANCHORS) -> DataFrame:
    """The k best rows of the same label, or of other labels, in each window: ``(anchor_id, window, vec_id, score, rank)``.

    Blocks are dealt over slots, and anchors sent to every slot, so a block travels once.
    """
    by = ["lab"] if same else []
    n = buckets.count()
    slots = max(1, min(n, 16), math.isqrt(n))

    def met(rows: DataFrame, chosen: DataFrame) -> DataFrame:
        asked = _asked(rows, by, size).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        blocks = chosen.withColumn("slot", F.pmod("block", F.lit(slots)).cast("int"))
        if same:
            asked = asked.withColumnRenamed("a_lab", "lab")
        pairs = blocks.join(asked, ["dim", "slot", *by]).where("longest >= reach")
        columns = ["dim", "n", "ids", "labs", "data", "lists", "a_n", "width", "a_ids", "a_labs", "a_data", "low", "high"]
        return pairs.select(*columns).mapInArrow(_searched(same, k), "anchor_id long, window long, vec_id long, score long")

    early = materialise(met(anchors, buckets.where("first")), "early")
    kth = _best(early, k).where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    raised = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("kth", w.cast("long")), low)))
    risen = anchors.join(kth, F.col("vec_id") == F.col("anchor_id"), "left").withColumn("lows", F.when(F.col("kth").isNull(), F.col("lows")).otherwise(raised))
    late = met(risen.drop("anchor_id", "kth"), buckets.where("not first"))
    return _best(early.unionByName(late), k)


def hard_negatives(
    table: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, label: str = "label", block: int = BLOCK
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the anchors (rows whose id is divisible by ``every``)."""
    vectors = materialise(labelled_vectors(table, label), "vectors")
    anchors = (
        vectors.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "lab")).alias("a"))
        .select("vec_id", "a.lab", "a.dim", "a.v")
    )
    own = vectors.join(anchors.select("lab").distinct(), "lab", "left_semi")
    open_ended = anchors.withColumn("lows", F.array(F.lit(-LONG - 1))).withColumn("highs", F.array(F.lit(LONG)))
    chosen = materialise(best_in_windows(open_ended, _buckets(own, ["lab"], block), positives, True), "positives")
    p, whole, rest = F.col("score"), F.expr("score div 100"), F.expr("score % 100")
    windowed = chosen.where(p >= 0).select(
        "anchor_id", "rank", F.col("vec_id").alias("positive_id"), p.alias("positive_score"),
        (whole * least + F.ceil(rest * least / 100)).alias("low"), (whole * most + F.floor(rest * most / 100)).alias("high"),
    )
    windows = materialise(windowed.withColumn("window", F.row_number().over(Window.partitionBy("anchor_id").orderBy("rank")).cast("long") - 1).drop("rank"), "windows")
    bounds = windows.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("w")).select(
        F.col("anchor_id").alias("vec_id"), F.col("w.low").alias("lows"), F.col("w.high").alias("highs")
    )
    found = best_in_windows(anchors.join(bounds, "vec_id"), _buckets(vectors, [], block), negatives, False)
    return found.join(windows, ["anchor_id", "window"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
