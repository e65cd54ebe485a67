"""Vector codes: the trie against plain distances, and the operator against a plain computation."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.llm import codes


@pytest.mark.parametrize("width,values,stretch", [(1, 4, 3), (4, 3, 5), (4, 200, 4096), (7, 2, 16)])
def test_trie_against_plain_distances(width, values, stretch, monkeypatch):
    rng = np.random.default_rng(width)
    rows, book = rng.integers(-values, values, (300, width)), rng.integers(-values, values, (9, width))
    monkeypatch.setattr(codes, "LEAVES", stretch)
    leaves, counts, which = codes.distinct_parts(rows)
    assert (leaves[which] == rows).all() and counts.sum() == len(rows)
    assert [tuple(x) for x in leaves] == sorted({tuple(r) for r in rows.tolist()})
    found = list(codes.traverse(leaves, book, stretch))
    entry, distance = np.concatenate([e for e, _ in found]), np.concatenate([d for _, d in found])
    plain = ((leaves[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
    assert (entry == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()


def test_prefixes_are_measured_once(monkeypatch):
    """Parts that differ in the last dimension only cost one node for each dimension before it."""
    measured = []

    leaves = np.array([[1, 2, 3, x] for x in range(50)])
    book = np.zeros((2, 4), dtype=np.int64)
    empty = np.empty

    def counted(shape, *args, **kwargs):
        measured.append(shape[0] - 1)
        return empty(shape, *args, **kwargs)

    monkeypatch.setattr(codes.np, "empty", counted)
    list(codes.traverse(leaves, book, 10))
    # the second stretch goes on from the path of the first
    assert measured[:4] == [1, 1, 1, 10] and measured[4:8] == [0, 0, 0, 10]


def plain(rows, parts, entries, rounds):
    """The whole job with Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dim = len(kept[0][1])
    cut = [(p * dim // parts, (p + 1) * dim // parts) for p in range(parts)]
    whole = lambda x: max(-codes.LARGEST, min(codes.LARGEST, math.floor(x * 256) if math.isfinite(x * 256) else int(x) * 256))
    vectors = [(i, [whole(x) for x in v], label) for i, v, label in kept]
    books = [[v[a:b] for _, v, _ in vectors[:entries] if len(v) == dim] for a, b in cut]
    distance = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))
    near = lambda x, book: min((distance(x, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        moved = []
        for (a, b), book in zip(cut, books):
            of = defaultdict(list)
            for _, v, _ in vectors:
                if len(v) == dim:
                    of[near(v[a:b], book)[1]].append(v[a:b])
            moved.append([[sum(c) // len(of[j]) for c in zip(*of[j])] if of[j] else e for j, e in enumerate(book)])
        books = moved
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out, total = [], defaultdict(int)
    for i, v, label in vectors:
        if len(v) == dim:
            found = [near(v[a:b], book) for (a, b), book in zip(cut, books)]
            error = min(sum(d for d, _ in found), codes.LONG)
            total[label] += error
            out.append((i, "".join(f"{j:02x}" for _, j in found), error, label))
        else:
            out.append((i, None, None, label))
    return sorted(((i, c, e, min(total[label], codes.LONG), sha) for i, c, e, label in out), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int"


@pytest.mark.parametrize("dim,levels", [(32, 3), (35, 1000), (5, 4)])
def test_codes_against_plain(spark, dim, levels):
    rng = random.Random(dim)
    rows = [(i, [rng.randrange(-levels, levels) / 100 for _ in range(dim)], rng.choice([None, 1, 2, 2, 2])) for i in range(150)]
    rows += [(7, rows[9][1], 3), (None, rows[4][1], 3), (200, rows[5][1], None)]
    bad = [(1000, None, 1), (1001, [1.0] * (dim - 1) + [None], 1), (-5, [float("nan")] * dim, 2), (1002, [float("inf")] * dim, 1)]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumn("code", F.lit("z")).withColumn("part", F.lit(0)).repartition(3)
    got = codes.compress(df, parts=16, entries=20, rounds=2)
    assert result(got) == plain(rows + bad, 16, 20, 2)


def test_codes_of_few_of_other_lengths_and_of_huge_vectors(spark):
    few = [(3, [1.0, 2.0], 1), (4, [1.5, -2.0], None), (5, [1.0], 1), (6, [], 1)]
    assert result(codes.compress(spark.createDataFrame(few, SCHEMA))) == plain(few, 16, 64, 2)
    huge = [(i, [x, 1.0, -x], 1) for i, x in enumerate([1e15, 1e300, 3.0, -1e300, 1e15, 0.0, 1.7e308])]
    assert result(codes.compress(spark.createDataFrame(huge, SCHEMA), parts=2, entries=3)) == plain(huge, 2, 3, 2)
    assert codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect() == []
