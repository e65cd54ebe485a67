"""Passages that documents share: paragraph MinHash banding, verified, clustered by components.

Paragraphs are of two sizes. A line of ``least`` words or more is one; its MinHash
signature over 5-word shingles is cut into bands, tuned so that paragraphs at the
threshold collide with the wanted recall, and all pairs that collide are verified by their
exact Jaccard similarity (in blocks, where many collide). Since a passage may stand in the
middle of a line, every text is also cut at the local minima of its words' hashes: such
pieces depend on a few words around them only, so a passage of over fifty words holds
whole pieces wherever it stands; they collide by their whole content.

Linked paragraphs form components. A component that occurs in two documents or more marks
its places; touching places of a document are joined to a passage, and passages of ``span``
words or more are reported, with the first document that holds any part of it. All others
are to be removed.

Texts without words and null texts have no passage; null ids take no part; rows that
repeat an id are one document. Extra columns are not read. Equal paragraphs are folded
before anything is paired, and a component is known by its smallest and largest document,
so a passage of very many documents is never gathered.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastre.llm.graph import connected_components
from cadastre.llm.jaccard_join import _links_within
from cadastre.llm.words import U, Words, blocks, mix, mix_int, n_grams
from cadastre.session import materialise

SHINGLE = 5
REACH = 4
BLOCK = 64
BROADCAST_ROWS = 1_000_000


def tune_bands(percent: int, recall: float = 0.99, most: int = 32) -> tuple[int, int]:
    """``(rows, bands)``: the most rows a band with which the recall at the threshold is reached, and the fewest bands for it.

    Of ``rows`` equal hashes a band agrees with a chance of s ** rows, so the bands follow
    from the recall. ``most`` bounds the hashes; where not even bands of one row fit it, it is
    widened to what they need, so the recall is reached at every threshold.
    """
    s, best = percent / 100, None
    for rows in range(1, most + 1):
        chance = s**rows
        bands = 1 if chance >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-chance) - 1e-9))
        if best is None or rows * bands <= most:
            best = (rows, bands)
    return best


def _pieces(h: np.ndarray, first: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the pieces of all rows: cut before each word whose hash is least among ``reach`` on both sides."""
    n = len(h)
    cut = np.ones(n + 1, dtype=bool)
    if n:
        far = np.concatenate((np.full(reach, np.iinfo(np.uint64).max, dtype=U), h, np.full(reach, np.iinfo(np.uint64).max, dtype=U)))
        low = np.ones(n, dtype=bool)
        for k in range(1, reach + 1):
            low &= h < far[reach - k : reach - k + n]
            low &= h <= far[reach + k : reach + k + n]
        cut[:n] = low
        cut[first] = True
    at = np.flatnonzero(cut)
    return at[:-1], at[1:]


def _content(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the words from begin to end (spans in order, without overlap)."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate(([1], np.full(int((end - begin).max(initial=1)), 0x9E3779B97F4A7C15 | 1, dtype=U))), dtype=U)
        inside = np.arange(len(h), dtype=np.int64)
        own = np.repeat(begin, end - begin)
        index = np.repeat(begin - np.concatenate(([0], np.cumsum(end - begin)[:-1])), end - begin) + np.arange(int((end - begin).sum()))
        terms = mix(h[index]) * up[inside[index] - own]
        sums = np.concatenate((np.zeros(1, dtype=U), np.cumsum(terms, dtype=U)))
        edge = np.concatenate(([0], np.cumsum(end - begin)))
        return mix((sums[edge[1:]] - sums[edge[:-1]]) ^ mix((end - begin).astype(U)))


def _lines(words: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last word of each line of at least so many words."""
    breaks = np.flatnonzero(words.data == 10)
    at = np.unique(np.concatenate((words.first, np.searchsorted(words.start, breaks))))
    begin, end = at[:-1], at[1:]
    long = end - begin >= least
    return begin[long], end[long]


def _units(docs: DataFrame, least: int) -> DataFrame:
    """``(doc_id, h, begin, n)`` of every piece and long line, by word places; lines have an odd h, pieces an even one."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                w = Words(part.column("text"))
                h = w.hashes()
                ids = part.column("doc_id").to_numpy()
                for kind, (begin, end) in enumerate((_pieces(h, w.first), _lines(w, least))):
                    if not len(begin):
                        continue
                    if kind == 0:
                        keep = end - begin >= SHINGLE
                        begin, end = begin[keep], end[keep]
                    name = (_content(h, begin, end) & ~U(1)) | U(kind)
                    row = np.searchsorted(w.first, begin, side="right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[row], pa.int64()), pa.array(name.view(np.int64)), pa.array(begin - w.first[row], pa.int64()), pa.array(end - begin, pa.int64())],
                        names=["doc_id", "h", "begin", "n"],
                    )

    return docs.mapInArrow(run, "doc_id long, h long, begin long, n long")


def _line_sets(docs: DataFrame, least: int, rows: int, bands: int, sets: bool) -> DataFrame:
    """``(h, keys)`` of long lines, the band keys; or ``(h, s)``, the shingles. A line comes once a batch."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                w = Words(part.column("text"))
                h = w.hashes()
                begin, end = _lines(w, least)
                if not len(begin):
                    continue
                name, at = np.unique((_content(h, begin, end) & ~U(1)) | U(1), return_index=True)
                begin, count = begin[at], (end - begin)[at] - SHINGLE + 1
                grams = n_grams(h, SHINGLE)
                index = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
                flat, heads = grams[index], np.concatenate(([0], np.cumsum(count)[:-1]))
                if sets:
                    lists = [np.unique(x).view(np.int64) for x in np.split(flat, heads[1:])]
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
                    values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(lists)))
                else:
                    keys = np.empty((len(name), bands), dtype=U)
                    with np.errstate(over="ignore"):
                        for b in range(bands):
                            key = np.full(len(name), U(mix_int(b)))
                            for r in range(rows):
                                key = mix(key * U(31) + np.minimum.reduceat(flat * U(mix_int(1000 + b * rows + r) | 1), heads))
                            keys[:, b] = key
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(name) + 1) * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), values], names=["h", "s" if sets else "keys"])

    return docs.mapInArrow(run, "h long, s array<long>" if sets else "h long, keys array<long>")


def similar_lines(docs: DataFrame, percent: int, least: int) -> DataFrame:
    """Links ``(a, b)`` between names of different long lines of at least the similarity."""
    rows, bands = tune_bands(percent)
    keyed = _line_sets(docs, least, rows, bands, False).select("h", F.explode("keys").alias("key"))
    spread = Window.partitionBy("key")
    met = keyed.withColumn("low", F.min("h").over(spread)).withColumn("high", F.max("h").over(spread)).where("low <> high").select("key", "h").distinct()
    met = materialise(met, "met")
    mark = lambda n: F.sum(F.xxhash64("h", F.lit(n)).cast("decimal(20,0)"))
    buckets = met.groupBy("key").agg(F.count("*").alias("m"), mark(1).alias("x"), mark(2).alias("y"))
    buckets = buckets.groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / BLOCK).alias("n_blocks"))
    placed = met.join(buckets, "key").withColumn("i", F.pmod(F.xxhash64("h", "key"), F.col("n_blocks")))
    asked = materialise(placed.select("h").distinct(), "asked")
    # a list of names of checked size spares the shingles a shuffle; a longer one is joined
    few = F.broadcast(asked) if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else asked
    sets = materialise(_line_sets(docs, least, rows, bands, True).join(few, "h").dropDuplicates(["h"]), "sets")
    i, j = F.col("i"), F.col("j")
    pieces = (
        placed.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
        .select(F.xxhash64("key", F.least(i, j), F.greatest(i, j)).alias("piece"), F.when(i == j, 0).when(i < j, 1).otherwise(2).alias("side"), "h")
        .join(sets, "h").select("piece", "side", F.col("h").alias("doc_id"), "s")
    )
    # (i, i) of a bucket in one block is a piece of its own; a piece of two blocks compares across
    return materialise(pieces.groupBy("piece").applyInArrow(_links_within(percent), "a long, b long").distinct(), "links")


def repeated_passages(docs: DataFrame, percent: int = 80, least: int = 20, span: int = 16) -> DataFrame:
    """``(doc_id, begin, end, n_words, cluster_id, removed)``: passages shared with other documents, by word places.

    ``cluster_id`` is the first document (smallest id) that holds any part of the passage.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    units = materialise(_units(texts, least), "units")
    component = connected_components(similar_lines(texts, percent, least)).withColumnRenamed("node", "h")
    component = materialise(component, "component")
    folded = units.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    near = folded.join(component, "h").groupBy("component").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    shared = (
        folded.join(component.select("h"), "h", "left_anti").where("low <> high").select("h", "low")
        .union(component.join(near, "component").where("low <> high").select("h", "low"))
    )
    places = units.join(materialise(shared, "shared"), "h").select("doc_id", "begin", (F.col("begin") + F.col("n")).alias("end"), "low")
    order = Window.partitionBy("doc_id").orderBy("begin", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = places.withColumn("new", F.when(F.col("begin") <= reach, 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return (
        runs.groupBy("doc_id", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("low").alias("cluster_id"))
        .withColumn("n_words", F.col("end") - F.col("begin")).where(F.col("n_words") >= span)
        .select("doc_id", "begin", "end", "n_words", "cluster_id", (F.col("cluster_id") != F.col("doc_id")).alias("removed"))
    )
