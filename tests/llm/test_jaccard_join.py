import re

import numpy as np
import pytest

from cadastre.llm import jaccard_join as J
from cadastre.llm.words import U, mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(rows, n, percent):
    """(size, component) by row, over all pairs; rows that repeat an id are one node."""
    sets = []
    for row in rows:
        w = WORD.findall((row[1] or "").translate(LOWER))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                up[max(x, y)] = min(x, y)
    return sorted(((r[0] if r[0] is not None else -1), len(s), (find(r[0]) if r[0] is not None else -1)) for r, s in zip(rows, sets))


@pytest.mark.parametrize("n,percent,options", [(4, 85, {}), (5, 80, {}), (4, 85, dict(piece=400, piece_docs=4, pivots_per_region=3)), (4, 60, dict(piece=900, piece_docs=6))])
def test_components_against_all_pairs(spark, documents, rows, n, percent, options):
    got = J.jaccard_components(documents, n=n, percent=percent, **options).collect()
    none = lambda x: -1 if x is None else x
    assert sorted((none(r.doc_id), r.n_shingles, none(r.component_id)) for r in got) == brute(rows, n, percent)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(4)
    seen = 0
    for trial in range(1500):
        n = int(rng.integers(1, 150))
        a = np.unique(mix(rng.integers(0, 2**62, n).astype(U)))
        drop = int(rng.integers(0, n * 0.16 + 1))
        add = int(rng.integers(0, n * 0.16 + 1))
        b = np.unique(np.concatenate((a[drop:], mix(rng.integers(0, 2**62, add).astype(U)))))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 85 * (len(a) + len(b) - common):
            seen += 1
            for salt in (0, 1):
                assert set(J.signatures(a, 85, salt).tolist()) & set(J.signatures(b, 85, salt).tolist())
    assert seen > 500


def test_a_shared_passage_makes_no_district(spark):
    """Documents that share a passage, a quarter of each, do not meet; near copies among them are found all the same."""
    import random

    rng = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(180)]), None, None, None) for i in range(120)]
    # the first five come again with the last words changed
    rows += [(200 + i, rows[i][1].rsplit(" ", 4)[0] + " a b c d", None, None, None) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    keyed = J.keyed_documents(docs, 5, 80, True)
    meeting = {r.set_key for r in J._meeting_sets(J.materialise(keyed, "keyed")).collect()}
    pairs = {r.set_key for r in keyed.where("doc_id < 5 or doc_id >= 200").collect()}
    assert pairs <= meeting and len(meeting) < 40
    got = J.jaccard_components(docs, n=5, percent=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows, 5, 80)


def test_rarest_shingles_of_linked_sets_meet(spark):
    """Of sets that all share most shingles those at the threshold still meet, and those that share common shingles only do not."""
    common = list(range(1000, 1080))
    sets = [common + list(range(20 * i, 20 * i + 20)) for i in range(1, 12)] + [list(range(1000, 1080)), [1, 2, 3]]
    shingles = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "doc_id long, h long, s array<long>")
    # 80 of 100 are shared: at 0.8 the set of the 80 alone is linked to each, these among themselves are not
    met = {x for r in J._meetings(shingles, 80).collect() for x in (r.a, r.b)}
    assert met == set(range(12))
    assert {x for r in J._meetings(shingles, 85).collect() for x in (r.a, r.b)} == set()


def test_one_of_each_group_keeps_columns(spark, cluttered, rows):
    got = J.one_of_each_group(cluttered, n=5, percent=80)
    assert got.columns == cluttered.columns
    ids = [r.doc_id for r in got.select("doc_id").collect()]
    known = brute(rows, 5, 80)
    assert sorted(i for i in ids if i is not None) == sorted({c for i, _, c in known if i >= 0})
    assert ids.count(None) == 2


def test_empty(spark, nothing):
    assert J.jaccard_components(nothing).collect() == []
    assert J.one_of_each_group(nothing).collect() == []
