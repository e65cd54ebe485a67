"""Quality classifier: logistic regression over hashed word n-grams, fitted by FTRL-proximal.

A text's features are its words and word pairs, once as they are (A-Z lowered) and once
by shape (runs of letters, capitals and digits folded to one sign each), with a mark for
a word that repeats the one before. Each is hashed into ``2**BITS`` slots; its value is
its count over the number of words, so length does not matter. A score is the logistic
function of one sparse dot product over the whole text.

Fitting takes at most ``MAX_TRAIN`` labelled rows (in expectation: labels are kept by a
hash of their id with probability MAX_TRAIN / count). They are dealt to ``SHARDS`` tasks
by hash; each runs follow-the-regularised-leader updates over its rows in hash order,
and the weights are averaged. Everything is decided by the rows, so a rerun agrees. The
weights are at most ``2**BITS`` numbers, which is what is sent to the tasks.

Null and empty texts have no feature and score by the bias alone. Rows with a null label
or id are no training rows; without any, all scores are 0.5. Repeated rows are scored
each; an id labelled twice is taken once, by its smallest label. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.llm.words import U, Words, _LOWER, blocks, mix, span_hashes, tidy

BITS = 18
SHARDS = 8
MAX_TRAIN = 24_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.4, 1.0, 0.002, 0.05
SCALE = 8.0
BIAS = 1 << BITS

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48


def _shape_hashes(words: Words) -> np.ndarray:
    """Hash of each word's shape."""
    if not len(words.start):
        return np.zeros(0, dtype=U)
    shape = _SHAPE[words.data]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = shape[1:] != shape[:-1]
    keep[words.start] = True
    before = np.concatenate(([0], np.cumsum(keep)))
    return span_hashes(shape[keep], before[words.start], before[words.end])


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of all n-grams of a column, four to a word, with the first word and number of words of each row."""
    words = Words(column)
    h, s = span_hashes(_LOWER[words.data], words.start, words.end), _shape_hashes(words)
    slots = np.empty((len(h), 4), dtype=np.int64)
    if len(h):
        begins = np.zeros(len(h) + 1, dtype=bool)
        begins[words.first] = True
        begins = begins[: len(h)]
        with np.errstate(over="ignore"):
            before, s_before = np.roll(h, 1), np.roll(s, 1)
            pair = np.where(h == before, U(1), mix(before * U(3) + h))
            s_pair = mix(s_before * U(5) + s + U(11))
            pair[begins] = mix(h[begins] + U(2))
            s_pair[begins] = mix(s[begins] + U(4))
            for k, x in enumerate((h, pair, mix(s + U(7)), s_pair)):
                slots[:, k] = (x >> U(64 - BITS)).view(np.int64)
    return slots, words.first, words.count


def _fit(table: pa.Table) -> pa.Table:
    """FTRL over one shard's rows ``(doc_id, text, label)``."""
    order = np.lexsort((table.column("doc_id").to_numpy(), table.column("h").to_numpy()))
    table = table.take(pa.array(order))
    label = table.column("label").to_numpy()
    rows = []
    for part in blocks(pa.RecordBatch.from_arrays([table.column("text").combine_chunks()], names=["text"]), "text"):
        slots, first, count = features(part.column("text"))
        for a, n in zip(first[:-1].tolist(), count.tolist()):
            at, times = np.unique(slots[a : a + n], return_counts=True)
            rows.append((np.append(at, BIAS), np.append(times * (SCALE / max(n, 1)), 1.0).astype(np.float32)))
    z, n2, w = np.zeros(BIAS + 1), np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    l1 = np.full(BIAS + 1, L1)
    l1[BIAS] = 0
    for _ in range(EPOCHS):
        for (at, x), y in zip(rows, label):
            zi, ni, x = z[at], n2[at], x.astype(float)
            wi = np.where(np.abs(zi) <= l1[at], 0.0, -(zi - np.sign(zi) * l1[at]) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi @ x, -35, 35)))
            g = (p - y) * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * wi
            n2[at] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n2)) / ALPHA + L2))
    at = np.flatnonzero(w)
    return pa.table({"slot": pa.array(at, pa.int64()), "w": pa.array(w[at], pa.float64())})


def held_out(doc_id):
    """Whether a row is kept from fitting: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_train: int = MAX_TRAIN) -> np.ndarray:
    """Weights by slot; the last is the bias."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out("doc_id"))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("double").alias("label"))
    )
    total = known.count()
    weights = np.zeros(BIAS + 1)
    if total:
        share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(min(1.0, max_train / total) * (1 << 30)))
        rows = (
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(F.broadcast(known.where(share)), "doc_id")  # at most about max_train rows of two numbers
            .withColumn("h", F.xxhash64("doc_id", F.lit(1)))
            .withColumn("shard", F.pmod("h", F.lit(SHARDS)))
        )
        found = rows.groupBy("shard").applyInArrow(_fit, "slot long, w double").groupBy("slot").agg(F.sum("w").alias("w"))
        # at most 2**BITS + 1 rows
        for r in found.collect():
            weights[r.slot] = r.w / SHARDS
    return weights


def score(docs: DataFrame, weights: np.ndarray, out: str = "score") -> DataFrame:
    """``docs`` (any columns, among them ``text``) with the score of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    text = docs.withColumn("text", F.col("text").cast("string"))
    schema = [f for f in text.schema.fields if f.name != out]

    def run(batches):
        w = shared.value
        for batch in batches:
            for part in blocks(batch, "text"):
                slots, first, count = features(part.column("text"))
                each = np.append(w[slots].sum(axis=1), 0.0)
                sums = np.where(count > 0, np.add.reduceat(each, first[:-1]), 0.0)
                z = w[BIAS] + sums * SCALE / np.maximum(count, 1)
                values = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in schema), pa.array(values)], names=[*(f.name for f in schema), out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return text.select(*(f"`{f.name}`" for f in schema)).mapInArrow(tidy(run), StructType([*schema, StructField(out, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    weights = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), weights).select("doc_id", "score")
    return scored.select(
        "doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
