"""Hard negatives: pruning is exact and acts, and the operator agrees with all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("spread", [0.05, 0.5, 5.0])
def test_survivors_hold_all_that_reach_the_floor(spread):
    rng = np.random.default_rng(8)
    centre = rng.normal(size=24)
    matrix = np.floor(100 * (centre + spread * rng.normal(size=(400, 24))) * rng.choice([0.5, 1, 2], (400, 1))).astype(np.int64)
    matrix = matrix[np.argsort(-negatives.lengths(matrix), kind="stable")]
    bucket = negatives.Bucket(matrix)
    left = 0
    for anchor in matrix[::40]:
        products = matrix @ anchor
        for floor in np.quantile(products, [0, 0.5, 0.9, 0.99, 1]).tolist() + [1e30, -5.0]:
            keep = set(bucket.survivors(anchor, floor).tolist())
            assert {i for i, p in enumerate(products) if p >= floor} <= keep
            left += len(matrix) - len(keep)
    assert left > 0


def test_feasible_ranges_alone_prune_where_vectors_are_close():
    """At a high threshold the sorted lists leave few candidates before any product."""
    rng = np.random.default_rng(1)
    matrix = np.floor(256 * np.eye(8)[rng.integers(0, 8, 500)] + rng.normal(size=(500, 8))).astype(np.int64)
    bucket = negatives.Bucket(matrix)
    anchor = matrix[0]
    floor = 0.9 * float(anchor @ anchor)
    assert len(bucket.survivors(anchor, floor)) <= 2 * int((matrix @ anchor >= floor).sum())


def brute(rows, every, n_positives, n_negatives, least, most):
    kept = [(i, [max(-(2**63), min(2**63 - 1, int(np.floor(x * 256)))) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, v, label in kept:
        if i % every == 0 and (i not in anchors or (len(v), v, label) < anchors[i]):
            anchors[i] = (len(v), v, label)
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    out = []
    for a, (dim, v, label) in anchors.items():
        near = sorted((-clip(sum(p * q for p, q in zip(v, w))), i, lab == label) for i, w, lab in kept if i != a and len(w) == dim)
        for s, i, _ in [x for x in near if x[2]][:n_positives]:
            inside = [(t, j) for t, j, same in near if not same and least * -s <= 100 * -t and 100 * -t <= most * -s]
            out += [(a, i, r + 1, j, -s, -t) for r, (t, j) in enumerate(inside[:n_negatives])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("scale,block,spread", [(1.0, 16, 1.0), (300.0, 40, 0.2), (1e-2, 2048, 1.0)])
def test_hard_negatives_against_all_products(spark, scale, block, spread):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(4, 8))
    rows = []
    for i in range(300):
        v = (centre[rng.integers(4)] + spread * rng.normal(size=8)) * scale * rng.choice([0.3, 1, 3])
        rows.append((i, [float(x) for x in v], [None, 0, 1, 1, 1, 1, 2][rng.integers(7)]))
    # ties, copies, repeated ids, zero vectors, other lengths
    rows += [(300 + i, rows[7][1], i % 3) for i in range(20)] + [(50, rows[3][1], 1), (400, [0.0] * 8, 1), (450, [1.0, 2.0], 1), (451, [1.0, 1.9], 1), (452, [1.0, 1.0], 2)]
    bad = [(500, None, 1), (550, [1.0] * 7 + [None], 1), (501, [float("nan")] + [1.0] * 7, 1), (502, [float("inf")] * 8, 2), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumn("score", F.lit(0)).withColumn("slot", F.lit("z"))
    want = brute(rows + bad, 50, 5, 3, 50, 95)
    assert len(want) > 20
    assert result(negatives.hard_negatives(df, block=block)) == want


def test_hard_negatives_of_text_labels_few_rows_and_huge_vectors(spark):
    rows = [(0, [1.0], 1), (50, [2.0], 1), (7, [1.5], 2), (8, [-1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert result(negatives.hard_negatives(df)) == brute(rows, 50, 5, 3, 50, 95)
    assert result(negatives.hard_negatives(df.withColumn("label", F.concat(F.lit("l"), "label")))) == brute(rows, 50, 5, 3, 50, 95)
    huge = rows + [(100, [1e15], 1), (101, [0.9e15], 2), (102, [-1e300], 1)]
    negatives.hard_negatives(spark.createDataFrame(huge, SCHEMA)).collect()
    assert negatives.hard_negatives(df.limit(0)).collect() == []


def test_pruning_acts_on_vectors_without_clusters():
    """Even where all directions are alike, half of a block does not reach the full product."""
    rng = np.random.default_rng(2)
    units = rng.normal(size=(2000, 64))
    matrix = np.floor(256 * units / negatives.lengths(units)[:, None]).astype(np.int64)
    bucket = negatives.Bucket(matrix[np.argsort(-negatives.lengths(matrix))])
    kept = []
    for anchor in matrix[:40]:
        third = float(np.sort(matrix @ anchor)[-4])
        kept.append(len(bucket.survivors(anchor, third)) / len(matrix))
    assert np.mean(kept) < 0.5
