"""Exact top-k inner products by norm buckets.

Vectors are grouped by length into buckets (powers of 2 ** 1/4), a bucket into blocks of
about ``BLOCK`` by hash; queries likewise. A first product with the longest blocks gives each
query a floor theta for its k-th score. From it follows, for each query and block, a
local cosine threshold theta / (|q| * longest of the block):

- above 1, no vector of the block can reach the floor, and the query skips it;
- if it is high, coordinate pruning by ranges: a vector that close to the query must lie, at
  the query's largest coordinates, inside a narrow range of values;
- otherwise length pruning, which leaves out vectors too short for the floor, and coordinate
  pruning by partial products: the product over the coordinates in which the queries are largest,
  plus the product of the lengths of what remains (Cauchy and Schwarz), must reach the floor. It is
  tested after one, two and three quarters of the coordinates.

What is left is verified by exact integer products. Bounds carry a margin for rounding,
and equal scores are never pruned, so the answer is exact. Pairs of blocks in which no
query can find anything are dropped before their vectors are joined.

A vector that is null, or that holds a null or non-finite component, takes no part, nor does
a row without id. Vectors of different lengths (numbers of components) do not meet. Rows
that repeat an id are candidates each, but never for a query of that id; as queries they
are one, with the smallest of their vectors. A score beyond the range of a
long is the end of that range. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastre.session import materialise

BLOCK = 2048
COSINE = 0.8
FOCUS = 3
PARTS = 64


def _pack(matrix: np.ndarray) -> bytes:
    small = not matrix.size or np.abs(matrix).max() < 2**31
    return matrix.astype(np.int32 if small else np.int64).tobytes()


def _unpack(data: bytes, rows: int, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((rows, 0), dtype=np.int64)
    kind = np.int32 if len(data) == 4 * rows * dim else np.int64
    return np.frombuffer(data, dtype=kind).reshape(rows, dim).astype(np.int64)


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of a with rows of b."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    ends = np.iinfo(np.int64)
    return np.array([min(max(int(x), ends.min), ends.max) for x in exact.ravel()], dtype=np.int64).reshape(exact.shape)


def surviving(queries: np.ndarray, floors: np.ndarray, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places ``(query, vector)`` of the pairs whose product may reach the query's floor, in order, and their exact products.

    Partial products grow by quarters of the coordinates, the queries' largest first. As soon as few pairs are left,
    only those get the rest of their product.
    """
    dim = queries.shape[1]
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(matrix).max(initial=0)) * max(dim, 1)
    if most >= 2**53 or dim < 4:
        full = products(queries, matrix)
        q, c = np.nonzero(full >= floors[:, None])
        return q, c, full[q, c]
    a, b = queries.astype(np.float64), matrix.astype(np.float64)
    order = np.argsort(-(a * a).sum(axis=0), kind="stable")
    a, b = np.ascontiguousarray(a[:, order]), np.ascontiguousarray(b[:, order])
    rest_a, rest_b = (a * a).sum(axis=1), (b * b).sum(axis=1)
    # rounding of the bound, never of the product, which is of whole numbers
    slack = 1e-9 * np.sqrt(rest_a.max(initial=0) * rest_b.max(initial=0)) + 1e-6
    low = np.where(np.isfinite(floors), floors, -1e300) - slack
    part = np.zeros((len(a), len(b)))
    done = 0
    for step in (dim // 4, dim // 2, 3 * dim // 4):
        x, y = a[:, done:step], b[:, done:step]
        part += x @ y.T
        rest_a = np.maximum(rest_a - (x * x).sum(axis=1), 0)
        rest_b = np.maximum(rest_b - (y * y).sum(axis=1), 0)
        done = step
        alive = part + np.sqrt(rest_a)[:, None] * np.sqrt(rest_b)[None, :] >= low[:, None]
        if 16 * np.count_nonzero(alive) <= alive.size:
            break
    q, c = np.nonzero(alive)
    scores = part[q, c]
    if 4 * len(q) > alive.size:
        scores = scores + (a[:, done:] @ b[:, done:].T)[q, c]
    else:
        for at in range(0, len(q), 1 << 16):
            i, j = q[at : at + (1 << 16)], c[at : at + (1 << 16)]
            scores[at : at + (1 << 16)] += np.einsum("ij,ij->i", a[i, done:], b[j, done:])
    return q, c, scores.astype(np.int64)


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, dim, v)``: floor(scale * x) of each component, x as double, of vectors that take part."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: c)
    whole = table.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull()
        & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    )
    return whole.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda c: F.floor(c * F.lit(float(scale)))).alias("v"))


def _blocks(vectors: DataFrame, size: int, by_norm: bool) -> DataFrame:
    """Packed blocks ``(block, dim, n, ids, data, longest)``."""
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    bucket = F.floor(F.log2(square + 1) * 2) if by_norm else F.lit(0).cast("long")
    rows = vectors.withColumn("bucket", bucket)
    counts = rows.groupBy("dim", "bucket").agg(F.count("*").alias("many"))
    salt = F.pmod(F.xxhash64("vec_id"), F.ceil(F.col("many") / size))
    placed = rows.join(counts, ["dim", "bucket"]).select("vec_id", "dim", "v", F.xxhash64("dim", "bucket", salt).alias("block"))

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        dim = table.column("dim")[0].as_py()
        matrix = np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(ids), dim)
        norm = _norms(matrix)
        order = np.lexsort((ids, -norm))
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int64()), "dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()),
            "ids": pa.array([ids[order].astype(np.int64).tobytes()], pa.binary()), "data": pa.array([_pack(matrix[order])], pa.binary()),
            "longest": pa.array([float(norm.max())], pa.float64()),
        })

    schema = "block long, dim int, n int, ids binary, data binary, longest double"
    return materialise(placed.groupBy("block").applyInArrow(pack, schema), "blocks")


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(ids) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(ids))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _near(query: np.ndarray, norm: float, units: np.ndarray, cosine: float) -> np.ndarray:
    """Candidates whose largest coordinates allow the cosine (coordinate pruning)."""
    unit = query / norm
    keep = np.ones(len(units), dtype=bool)
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        # with coordinate u of the query, c of the candidate: cosine <= u c + sqrt((1 - u u) (1 - c c))
        u = unit[f]
        c = units[:, f]
        keep &= u * c + np.sqrt(np.maximum((1 - u * u) * (1 - c * c), 0)) >= cosine - 1e-9
    return np.flatnonzero(keep)


def search_block(q_ids, queries, floors, ids, matrix, k: int):
    """Best k of a block for each query: ``(query, id, score)`` arrays; ``floors`` are lower bounds of the k-th score."""
    q_norm, norm = _norms(queries), _norms(matrix)
    longest = norm[0] if len(norm) else 0.0
    units = matrix / np.maximum(norm, 1e-300)[:, None]
    out_q, out_i, out_s = [], [], []
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = floors * (1 - 1e-9) / (q_norm * longest)
    dense = np.flatnonzero(~(cosine > COSINE))
    at, column, score = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if len(dense):
        # length pruning: norms fall, so the vectors long enough are a prefix
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(floors[dense] > 0, floors[dense] * (1 - 1e-9) / q_norm[dense], 0.0)
        length = np.searchsorted(-norm, -np.nan_to_num(need, posinf=np.inf), side="right")
        row, column, score = surviving(queries[dense], floors[dense], matrix[: int(length.max(initial=0))])
        at = np.searchsorted(row, np.arange(len(dense) + 1))
    row_of = {int(q): r for r, q in enumerate(dense)}
    for q in range(len(q_ids)):
        if q in row_of:
            r = row_of[q]
            keep, scores = column[at[r] : at[r + 1]], score[at[r] : at[r + 1]]
            short = np.searchsorted(keep, length[r])
            keep, scores = keep[:short], scores[:short]
        elif cosine[q] > 1:
            continue
        else:
            keep = _near(queries[q], q_norm[q], units, cosine[q])
            scores = products(queries[q : q + 1], matrix[keep])[0]
        good = (scores >= floors[q]) & (ids[keep] != q_ids[q])
        keep, scores = keep[good], scores[good]
        top = _best(ids[keep], scores, k)
        out_q.append(np.full(len(top), q_ids[q]))
        out_i.append(ids[keep][top])
        out_s.append(scores[top])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return join(out_q), join(out_i), join(out_s)


def _both(batch: pa.RecordBatch, i: int):
    get = lambda c: batch.column(c)[i].as_py()
    dim = get("dim")
    return (
        np.frombuffer(get("q_ids"), dtype=np.int64), _unpack(get("q_data"), get("q_n"), dim),
        np.frombuffer(get("ids"), dtype=np.int64), _unpack(get("data"), get("n"), dim),
    )


def top_k(table: DataFrame, k: int = 5, every: int = 50, block: int = BLOCK) -> DataFrame:
    """The k best candidates of each query (rows whose id is divisible by ``every``): query_id, rank, vec_id, score."""
    vectors = materialise(integer_vectors(table), "vectors")
    candidates = _blocks(vectors, block, True)
    asked = vectors.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("q")).select("vec_id", "q.dim", "q.v")
    queries = _blocks(asked, max(block // 4, 1), False).select(
        F.col("block").alias("q_block"), "dim", F.col("n").alias("q_n"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data")
    )
    # floors from the longest blocks
    longest = candidates.groupBy("dim").agg(F.max_by("block", F.struct("longest", "n", "block")).alias("block"))
    first = queries.join(candidates.join(longest.select("block"), "block", "left_semi"), "dim")

    def floor(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, ids, m = _both(batch, i)
                scores = products(q, m)
                low = np.full(len(q_ids), -np.inf)
                norm = _norms(q)
                for r in range(len(q_ids)):
                    s = scores[r][ids != q_ids[r]]
                    if len(s) >= k:
                        low[r] = np.nextafter(float(np.partition(s, len(s) - k)[len(s) - k]), -np.inf)
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where((low > 0) & (norm > 0), low * (1 - 1e-9) / norm, 0.0)
                yield pa.RecordBatch.from_pydict({
                    "q_block": pa.array([batch.column("q_block")[i].as_py()], pa.int64()), "floors": pa.array([low.tobytes()], pa.binary()),
                    "need": pa.array([float(need.min())], pa.float64()),
                })

    floors = materialise(first.mapInArrow(floor, "q_block long, floors binary, need double"), "floors")
    # names of blocks meet by dimension; it is one key, so it is dealt in parts
    part = F.pmod("block", F.lit(PARTS)).alias("part")
    asking = queries.select("q_block", "dim").join(floors.select("q_block", "need"), "q_block")
    met = (
        asking.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("part"))
        .join(candidates.select("block", "dim", "longest", part), ["dim", "part"]).where("longest >= need")
        .select("q_block", "block")
    )
    work = (
        met.join(queries.join(floors, "q_block"), "q_block").join(candidates.drop("dim", "longest"), "block")
        .select("dim", "q_n", "q_ids", "q_data", "floors", "n", "ids", "data")
    )

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, ids, m = _both(batch, i)
                low = np.frombuffer(batch.column("floors")[i].as_py(), dtype=np.float64)
                a, b, s = search_block(q_ids, q, low, ids, m, k)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(s, pa.int64())})

    found = work.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
