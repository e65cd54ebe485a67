"""Compression of vectors to short codes: one codebook per part of a vector.

A vector is cut into consecutive parts; a part's code is the index of the nearest entry of
that part's codebook. Codebooks start from the vectors of smallest id and are moved to the
mean of their parts in a fixed number of rounds. All numbers are integers.

The work of a round is done on a **trie**. The distinct parts of a batch, each with the
number of vectors that have it, are put in lexicographic order, which is the order of a
depth-first traversal: parts that begin alike stand together, below one node for each
common prefix. A node holds, for every entry, the distance accumulated so far, so a prefix
is measured once for all parts below it, and each level adds one dimension. The traversal
goes on in stretches of leaves and carries the accumulated distances of its current path
from one stretch to the next, so its memory does not grow with the number of parts. A leaf
takes the argmin, and adds its part to the sums of that entry, weighted by its count.

Spark partitions the vectors and adds up the sums of all tasks; they, and the
codebooks, are as large as the model (entries x dimensions), whatever the number of vectors.

- A vector that is null, or holds a null or non-finite component, is dropped.
- The vector of smallest id sets the length. Rows of another length, and those of an empty
  table, are outside the model: their code and errors are null.
- A length that the parts do not divide gives parts that differ by one dimension; a part without
  dimensions has code 0 and error 0.
- Fewer vectors than entries make smaller codebooks. Rows that repeat an id are rows of
  their own, in the order of their components; rows without id come after all others.
- Integers are exact. Components beyond 10**28 count as that, an error beyond a long as the largest long.
- Columns other than the id, the vector and the label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.session import materialise

LEAVES = 4096
CELLS = 1 << 20
LARGEST = 10**28
LONG = 2**63 - 1


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x): 64-bit integers where squares of differences fit in them, else Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(x * float(scale))
    if not x.size or np.abs(scaled).max() < 2**24:
        return scaled.astype(np.int64)
    return np.array([[max(-LARGEST, min(LARGEST, int(v) if np.isfinite(v) else int(u) * scale)) for v, u in zip(a, b)] for a, b in zip(scaled, x)], dtype=object)


def bounds(dim: int, parts: int) -> list[tuple[int, int]]:
    """First and last (excluded) dimension of each part."""
    return [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]


def distinct_parts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows in lexicographic order, how often each comes, and which of them every row is."""
    if rows.dtype == object:
        order = np.array(sorted(range(len(rows)), key=lambda i: tuple(rows[i])), dtype=np.int64)
    else:
        order = np.lexsort(rows.T[::-1])
    ordered = rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    which = np.empty(len(rows), dtype=np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], np.bincount(which), which


def traverse(leaves: np.ndarray, book: np.ndarray, stretch: int = LEAVES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Depth-first walk over the trie of ordered distinct parts: ``(nearest entry, squared distance)`` of a stretch of leaves.

    Level by level, a node's distances to all entries are those of its parent plus one
    dimension; node 0 of a level is the one the stretch before ended in.
    """
    last, path = None, [None] * leaves.shape[1]
    for low in range(0, len(leaves), stretch):
        part = leaves[low : low + stretch]
        differs = np.ones(part.shape, dtype=bool)
        differs[1:] = part[1:] != part[:-1]
        if last is not None:
            differs[0] = part[0] != last
        new = np.logical_or.accumulate(differs, axis=1)
        above, parent = np.zeros((1, len(book)), dtype=book.dtype), np.zeros(len(part), dtype=np.int64)
        for d in range(part.shape[1]):
            first = np.flatnonzero(new[:, d])
            node = np.cumsum(new[:, d])
            sums = np.empty((len(first) + 1, len(book)), dtype=book.dtype)
            sums[0] = 0 if last is None else path[d]
            step = part[first, d][:, None] - book[:, d][None, :]
            sums[1:] = above[parent[first]] + step * step
            above, parent, path[d] = sums, node, sums[-1]
        last = part[-1]
        best = above.argmin(axis=1)
        yield best[parent], above[np.arange(len(above)), best][parent]


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nearest entry and squared distance of every row, and ``(distinct parts, counts, their entries)``; ties to the lower index."""
    if rows.dtype != book.dtype:
        rows, book = rows.astype(object), book.astype(object)
    if not rows.shape[1]:
        zero = np.zeros(len(rows), dtype=np.int64)
        return zero, zero, (rows[:1], np.array([len(rows)]), zero[:1])
    leaves, counts, which = distinct_parts(rows)
    found = list(traverse(leaves, book))
    entry, distance = np.concatenate([e for e, _ in found]), np.concatenate([d for _, d in found])
    return entry[which], distance[which], (leaves, counts, entry)


def kept_vectors(table: DataFrame, label: str | None = None) -> DataFrame:
    """``(vec_id, label, x)`` of the rows whose vector is whole and finite."""
    rows = table.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col(label) if label else F.lit(None).cast("int")).alias("label"),
        F.col("embedding").cast("array<double>").alias("x"),
    )
    return rows.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))


def _matrices(batch: pa.RecordBatch, dim: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch, which of their rows have the model's length, and these as integers."""
    step = max(1, CELLS // max(dim, 1))
    for low in range(0, batch.num_rows, step):
        part = batch.slice(low, step)
        x = part.column("x")
        fits = x.value_lengths().to_numpy(zero_copy_only=False) == dim
        flat = x.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
        yield part, fits, integers(flat.reshape(int(fits.sum()), dim), scale)


def _sums(vectors: DataFrame, books: list[np.ndarray], dim: int, scale: int) -> DataFrame:
    """``(part, entry, d, total, many)`` over all vectors: sums of dimensions and number of parts of every entry in use."""
    cuts = bounds(dim, len(books))

    def run(batches):
        total = [np.zeros(b.shape, dtype=object) for b in books]
        many = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            for _, _, rows in _matrices(batch, dim, scale):
                if not len(rows):
                    continue
                for p, (a, b) in enumerate(cuts):
                    _, _, (leaves, counts, entry) = nearest(rows[:, a:b], books[p])
                    many[p] += np.bincount(entry, weights=counts, minlength=len(books[p])).astype(np.int64)
                    inside = np.zeros(books[p].shape, dtype=leaves.dtype)
                    np.add.at(inside, entry, leaves * counts[:, None])
                    total[p] += inside
        rows = [
            (p, e, d, int(total[p][e, d]), int(many[p][e]))
            for p in range(len(books)) for e in np.flatnonzero(many[p]).tolist() for d in range(books[p].shape[1])
        ]
        column = lambda i, kind: pa.array([r[i] for r in rows], kind)
        if rows:
            yield pa.RecordBatch.from_arrays(
                [column(0, pa.int32()), column(1, pa.int32()), column(2, pa.int32()), column(3, pa.decimal128(38, 0)), column(4, pa.int64())],
                names=["part", "entry", "d", "total", "many"],
            )

    rows = vectors.select("x").mapInArrow(run, "part int, entry int, d int, total decimal(38,0), many long")
    return rows.groupBy("part", "entry", "d").agg(F.sum("total").alias("total"), F.sum("many").alias("many"))


def _as_book(rows: list[list[int]], width: int) -> np.ndarray:
    small = all(abs(v) < 2**24 for r in rows for v in r)
    return np.array(rows, dtype=np.int64 if small else object).reshape(len(rows), width)


def fit(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[int, list[np.ndarray]]:
    """Length of the vectors, and the codebook of every part; of no vectors, length 0 and no codebook.

    The driver holds ``entries`` vectors and, per round, one sum for every entry and dimension.
    """
    first = vectors.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    if not first:
        return 0, []
    dim = len(first[0].x)
    start = integers(np.array([r.x for r in first if len(r.x) == dim], dtype=np.float64).reshape(-1, dim), scale)
    cuts = bounds(dim, parts)
    books = [_as_book([[int(v) for v in r[a:b]] for r in start], b - a) for a, b in cuts]
    for _ in range(rounds):
        moved = [[[int(v) for v in e] for e in b] for b in books]
        for r in _sums(vectors, books, dim, scale).collect():
            moved[r.part][r.entry][r.d] = int(r.total) // r.many
        books = [_as_book(m, b - a) for m, (a, b) in zip(moved, cuts)]
    return dim, books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in the order of part, entry and position, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for e in b for v in e).encode()).hexdigest()


def encode(vectors: DataFrame, dim: int, books: list[np.ndarray], scale: int = 256) -> DataFrame:
    """``(vec_id, label, code, error)`` of every vector: two hex digits a part, and the squared distances added up."""
    cuts = bounds(dim, len(books))
    digits = np.array([f"{e:02x}" for e in range(max((len(b) for b in books), default=0))], dtype=object)

    def run(batches):
        for batch in batches:
            for part, fits, rows in _matrices(batch, dim, scale):
                code, error = np.full(len(fits), None, dtype=object), np.full(len(fits), None, dtype=object)
                if len(rows):
                    text, total = np.full(len(rows), "", dtype=object), np.zeros(len(rows), dtype=object)
                    for p, (a, b) in enumerate(cuts):
                        entry, distance, _ = nearest(rows[:, a:b], books[p])
                        text, total = text + digits[entry], total + distance
                    code[fits], error[fits] = text, [min(int(t), LONG) for t in total]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                    names=["vec_id", "label", "code", "error"],
                )

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(table: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, label: str = "label") -> DataFrame:
    """vec_id, code, error, label_error (error over rows of the same label, nulls together) and codebooks_sha256 of every kept vector."""
    vectors = kept_vectors(table, label)
    dim, books = fit(vectors, parts, entries, rounds, scale)
    coded = materialise(encode(vectors, dim, books, scale), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("same")).agg(total.alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("same"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
