"""Near duplicates by SetSketch registers: the sketch itself, and the operator against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cadastre.llm import setsketch
from cadastre.llm.words import U, mix


def elements(numbers):
    return np.sort(mix(np.array(sorted(numbers), dtype=U)))


def test_registers_of_a_union_are_merged():
    a, b = set(range(900)), set(range(600, 5000))
    ka, kb, kab = setsketch.registers([elements(a), elements(b), elements(a | b)])
    assert (setsketch.merge(ka, kb) == kab).all()
    assert (setsketch.registers([elements(a)])[0] == ka).all()
    assert not setsketch.registers([np.zeros(0, dtype=U)]).any()


@pytest.mark.parametrize("sizes", [(1, 0), (3, 1), (400, 40), (3000, 1200)])
def test_registers_agree_as_often_as_sets_are_similar(sizes):
    common, own = sizes
    rng = random.Random(common)
    pairs = []
    for _ in range(40):
        numbers = rng.sample(range(10**12), common + 2 * own)
        pairs.append((set(numbers[: common + own]), set(numbers[:common]) | set(numbers[common + own :])))
    ka = setsketch.registers([elements(a) for a, _ in pairs])
    kb = setsketch.registers([elements(b) for _, b in pairs])
    true = common / (common + 2 * own)
    assert abs((ka == kb).mean() - true) < 0.02
    n = np.full(len(pairs), common + own)
    value, _ = setsketch.estimate((ka > kb).sum(axis=1), (ka < kb).sum(axis=1), n, n, 80)
    assert abs(value.mean() - true) < 0.02


def test_estimate_spares_verification_and_loses_nothing():
    rng = random.Random(3)
    likely = {}
    for true, common, own in ((0.8, 800, 100), (0.5, 500, 250), (0.3, 300, 350)):
        sets = []
        for _ in range(200):
            numbers = rng.sample(range(10**12), common + 2 * own)
            sets += [elements(numbers[: common + own]), elements(numbers[:common] + numbers[common + own :])]
        k = setsketch.registers(sets)
        a, b = k[::2], k[1::2]
        n = np.full(200, common + own)
        likely[true] = setsketch.estimate((a > b).sum(axis=1), (a < b).sum(axis=1), n, n, 80)[1].mean()
        if true == 0.8:
            x, y = setsketch.band_keys(a), setsketch.band_keys(b)
            assert all((p == q).any() for p, q in zip(x, y))
    assert likely[0.8] == 1 and likely[0.5] == 0 and likely[0.3] == 0


def brute(rows, n, percent):
    """doc_id to (n_shingles, component) by all pairs; rows of one id share a component."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for d, text in rows:
        w = word.findall((text or "").translate(upper))
        sets.append((d, {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if None not in (a, b) and s and t and 100 * len(s & t) >= percent * len(s | t) and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return Counter((d, len(s), find(d) if d is not None else None, d is None or find(d) == d) for d, s in sets)


def result(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("n,percent,broadcast_bytes", [(2, 80, 0), (5, 60, 1 << 20)])
def test_near_duplicates_against_all_pairs(cluttered, rows, n, percent, broadcast_bytes):
    want = brute([(r[0], r[1]) for r in rows], n, percent)
    assert result(setsketch.near_duplicates(cluttered, n, percent, broadcast_bytes)) == want


def test_a_large_group_that_hangs_together_in_chains(spark, monkeypatch):
    """Copies around the threshold: one first document does not reach them all, so rounds and blocks must."""
    monkeypatch.setattr(setsketch, "TOGETHER", 8)
    rng = random.Random(11)
    docs, i = [], 0
    for family in range(3):
        base = [f"f{family}w{k}" for k in range(60)]
        for _ in range(70):
            w = list(base)
            for at in rng.sample(range(60), rng.choice([1, 2, 3, 4])):
                w[at] = f"x{rng.randrange(10**9)}"
            docs.append((i, " ".join(w)))
            i += 1
    docs += [(900, docs[3][1]), (900, "another text of the same id"), (901, "another text of the same id"), (902, None), (None, docs[0][1])]
    rng.shuffle(docs)
    got = result(setsketch.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    want = brute(docs, 2, 80)
    assert len({c for _, _, c, _ in want}) > 10
    assert got == want


def test_buckets_that_first_documents_do_not_settle(spark, monkeypatch):
    """Pairs of which neither is the first of its bucket are found block by block."""
    inner = setsketch._linked_blocks(80)
    rng = random.Random(2)
    sets = [elements(rng.sample(range(10**9), 50)) for _ in range(3)]
    sets.append(np.sort(np.append(sets[2][1:], U(5))))
    k = setsketch.registers(sets)
    table = pa.table({
        "piece": pa.array([1] * 4, pa.int64()), "side": pa.array([1, 1, 1, 2], pa.int32()), "rid": pa.array([1, 2, 3, 4], pa.int64()), "component": pa.array([1, 2, 3, 4], pa.int64()),
        "registers": pa.array([r.tobytes() for r in k], pa.binary()), "s": setsketch._lists(sets),
    })
    assert inner(table).to_pydict() == {"a": [3], "b": [4]}


def test_nothing(nothing):
    assert setsketch.near_duplicates(nothing).collect() == []
