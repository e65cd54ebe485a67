"""Operators over the whole corpus: mixing, sharding, line dedup, passages, top-k, pipeline."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastre.llm import line_dedup, mixing, paragraph_dedup, sharding, topk


def water_filling(sizes, share, most):
    order = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        rest = {k: w for k, w in weight.items() if k not in fixed}
        level = {k: (total - sum(fixed.values())) * w / sum(rest.values()) for k, w in rest.items()}
        over = {k: most * sizes[k] for k in rest if level[k] > most * sizes[k] + 1e-9}
        if not over:
            return fixed | level
        fixed |= over


def test_mix(spark, cluttered, rows):
    m = mixing.mix(cluttered.drop("k").withColumn("target", F.lit(0)), block=16)
    got = m.taken.join(m.sources, "k").collect()
    assert len(got) == len(rows)
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = water_filling(sizes, 1.5, 2.0)
    name = lambda k: None if k == "t" else k[1:]
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[name(r.k)] and r.target == pytest.approx(want[name(r.k)])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[name(r.k)] += r.taken
    for k, n in taken.items():
        assert abs(n - want[k]) <= 1
    slots = m.slots.collect()
    assert len({(s.k, s["rank"]) for s in slots}) == len(slots) and sum(s.n for s in slots) == sum(taken.values())
    # low discrepancy: any prefix of the schedule holds the sources nearly in proportion
    slots.sort(key=lambda s: s.slot)
    half = Counter(s.k for s in slots[: len(slots) // 2])
    for k, n in Counter(s.k for s in slots).items():
        assert abs(half[k] - n / 2) <= 4
    again = mixing.mix(cluttered.drop("k").repartition(3), block=16).taken.collect()
    assert Counter((r.doc_id, r.k, r.taken) for r in again) == Counter((r.doc_id, r.k, r.taken) for r in got)


def test_schedule_reaches_the_documents(spark, monkeypatch):
    """Each row's slots are those that the schedule gives its words; appended slots are numbered on."""
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 40)), rng.choice("aaab")) for i in range(60)] + [(None, "x y z", "c")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.mix(docs, block=16)
    slots = m.slots.collect()
    assert len({s.slot for s in slots}) == len(slots)
    got = m.taken.collect()
    names = {s.slot for s in slots}
    assert all((r.first_slot is None) == (r.taken == 0) == (r.n_slots == 0) for r in got)
    assert {r.first_slot for r in got if r.taken} <= names and all(r.taken <= 16 * r.n_slots for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.k] += r.taken
    assert taken == {k: sum(s.n for s in slots if s.k == k) for k in taken}
    monkeypatch.setattr(mixing, "GOLDEN", 1)
    other = mixing.mix(docs, block=16).taken.collect()
    assert Counter((r.doc_id, r.first_slot) for r in other) != Counter((r.doc_id, r.first_slot) for r in got)


def test_mixed_documents(spark, cluttered, nothing):
    out = mixing.mixed_documents(cluttered, block=16)
    assert out.columns == cluttered.columns and out.count() > 0
    assert out.where("text is null or trim(text) = ''").count() == 0
    assert mixing.mixed_documents(nothing).collect() == []


def test_mix_without_words(spark, nothing):
    assert mixing.mix(nothing).taken.collect() == []
    m = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string"))
    assert [(r.target, r.taken) for r in m.taken.join(m.sources, "k").collect()] == [(0.0, 0)] * 2


def test_no_python_in_native_plans(spark, documents):
    for df in (mixing.mix(documents).taken, line_dedup.removed_lines(documents)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shards(spark, cluttered, rows):
    got = sharding.shard(cluttered).collect()
    assert len(got) == len(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(8)) and max(counts.values()) - min(counts[s] for s in range(8)) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    parts = defaultdict(set)
    for r in got:
        parts[(r.text_crc32, r["size"])].add(r.shard)
    assert all(len(p) == 1 for p in parts.values())
    assert all(r.law == "rows" and r.grown_shard is None for r in got)


def test_shards_of_a_text_that_fills_several(spark, nothing):
    rows = [(i, "same") for i in range(50)] + [(100 + i, f"t{i // 2}") for i in range(30)] + [(200 + i, f"u{i}") for i in range(41)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    counts = Counter(r.shard for r in got)
    assert sorted(counts.values()) == [15] * 7 + [16]
    text = dict(rows)
    where = defaultdict(Counter)
    for r in got:
        where[text[r.doc_id]][r.shard] += 1
    assert sum(len(w) > 1 for t, w in where.items() if t != "same") <= 2
    assert len(where["same"]) <= 6
    assert sharding.shard(nothing).collect() == []


def test_shards_of_linked_texts_only(spark):
    rng = random.Random(8)
    rows = [(t * 100 + i, f"text {t}") for t in range(60) for i in range(rng.randint(2, 33))] + [(None, None)] * 9
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), shards=8).collect()
    counts, where = Counter(r.shard for r in got), defaultdict(set)
    for r in got:
        where[(r.text_crc32, r["size"])].add(r.shard)
    assert len(got) == len(rows) and max(counts.values()) - min(counts[s] for s in range(8)) <= 1
    assert sum(len(w) > 1 for w in where.values()) <= 7


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        q = [i + 1]
        for j, y in enumerate(b):
            q.append(min(p[j] + (x != y), p[j + 1] + 1, q[-1] + 1))
        p = q
    return p[-1]


def typo(s, k, rng):
    for _ in range(k):
        i = rng.randrange(len(s) + 1)
        s = (s[:i] + rng.choice("abé ") + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice("abé") + s[i + 1 :])[rng.randrange(3)]
    return s


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_banded_edit_distance(spark, tau):
    rng = random.Random(tau)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 30)))
        b = typo(a, rng.randint(0, 5), rng)
        rows.append((a, b, levenshtein(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, d int")
    assert [r for r in df.withColumn("w", line_dedup.within_edits(F.col("a"), F.col("b"), tau)).collect() if r.w != (r.d <= tau)] == []


def test_shared_segments_lose_no_pair(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(500):
        a = "".join(rng.choice("abcé ") for _ in range(rng.randint(10, 120)))
        b = typo(a, rng.randint(0, 2), rng)
        rows.append((a, b) if len(a) <= len(b) else (b, a))
    far = [("".join(rng.choice("abc") for _ in range(90)), "".join(rng.choice("abc") for _ in range(90))) for _ in range(50)]
    df = spark.createDataFrame(rows + far, "a string, b string").withColumn("s", line_dedup.shared_segments(F.col("a"), F.col("b"), 2))
    got = [r.s for r in df.collect()]
    assert all(got[: len(rows)]) and not any(got[len(rows) :])


@pytest.mark.parametrize("broadcast_bytes", [0, 1 << 20])
def test_variants_of_one_line_that_share_a_third(spark, broadcast_bytes):
    """All meet under the key of the part they share; only those within the edits come out."""
    rng = random.Random(13)
    some = lambda k: "".join(rng.choice("abcdefghijklmnop") for _ in range(k))
    head = some(60)
    lines = [head + some(120) for _ in range(150)]
    lines += [typo(x, 2, rng) for x in lines[:20]]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    ids = {r.id: r.line for r in df.select("line", F.xxhash64("line").alias("id")).collect()}
    got = {tuple(sorted((ids[r.x], ids[r.y]))) for r in line_dedup.near_lines(df, 2, 16, broadcast_bytes).collect()}
    want = {tuple(sorted((a, b))) for i, a in enumerate(lines) for b in lines[:i] if a != b and abs(len(a) - len(b)) <= 2 and (i >= 150) and levenshtein(a, b) <= 2}
    assert got == want


def test_line_classes_against_all_pairs(spark):
    rng = random.Random(9)
    docs = []
    for i in range(25):
        lines = ["".join(rng.choice("abcdefghij ") for _ in range(rng.randint(3, 50))) for _ in range(4)]
        if docs:
            lines += [typo(rng.choice(docs[rng.randrange(len(docs))][1].split("\n")), rng.randint(0, 3), rng) for _ in range(3)]
        lines += ["", " "]
        rng.shuffle(lines)
        docs.append((i, "\n".join(x.replace("\n", " ") for x in lines)))
    docs += [(50, None), (51, ""), (52, "\n \n"), docs[3], (None, docs[0][1])]
    places = [(-1 if d is None else d, p, x) for d, t in docs[:-2] + docs[-1:] if t for p, x in enumerate(t.split("\n")) if x.strip()]
    names = sorted({x for *_, x in places})
    up = {x: x for x in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if len(a) >= 16 and len(b) >= 16 and abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2:
                up[find(a)] = find(b)
    first = {}
    for d, p, x in sorted(places, key=lambda v: (v[0], v[1])):
        first.setdefault(find(x), (d, p))
    want = defaultdict(list)
    for d, p, x in places:
        want[d] += [p] if first[find(x)] != (d, p) else []
    got = {(-1 if r.doc_id is None else r.doc_id): (r.n_lines, r.removed) for r in line_dedup.removed_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    n = Counter(d for d, *_ in places)
    assert got == {d: (n[d], sorted(want[d])) for d in n}


def test_dedup_lines(spark, nothing):
    rows = [(1, "alpha\nbeta", "x"), (2, "beta\n\ngamma", "x"), (3, "alpha", "x"), (4, "", "x"), (5, None, "x"), (2, "beta\n\ngamma", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, removed string").withColumn("n_chars", F.length("text").cast("long"))
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got.collect() if r.text is not None) == [(1, "alpha\nbeta", 10), (2, "\ngamma", 6), (2, "\ngamma", 6), (4, "", 0)]
    assert line_dedup.dedup_lines(nothing).collect() == []


def test_passages(spark, cluttered, nothing):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    docs = {i: some(rng.randint(60, 200)) for i in range(120)}
    planted = set()
    for k in range(0, 60, 2):
        passage = some(55)
        for d in (k, k + 1):
            at = rng.randrange(len(docs[d]) + 1)
            docs[d] = docs[d][:at] + passage + docs[d][at:]
            planted.add(d)
    rows = [(d, " ".join(w)) for d, w in docs.items()]
    line = some(60)
    near = line[:]
    near[30] = "other"
    rows += [(500, " ".join(some(30)) + "\n" + " ".join(line)), (501, " ".join(near) + "\n" + " ".join(some(30)))]
    common = " ".join(some(12))
    rows += [(600 + i, " ".join(some(40)) + "\n" + common + "\n" + " ".join(some(40))) for i in range(30)]
    rows += [(700, ""), (701, None), (None, rows[0][1]), (702, " ".join(line)), (702, " ".join(line))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("low", F.lit(1))
    got = paragraph_dedup.repeated_passages(df).collect()
    hit = {r.doc_id for r in got}
    assert len(planted - hit) <= 2 and hit - planted == {500, 501, 702}
    by = {r.doc_id: r for r in got if r.doc_id in (500, 501, 702)}
    assert (by[501].begin, by[501].end, by[501].cluster_id, by[501].removed) == (0, 60, 500, True)
    assert not by[500].removed and by[702].removed
    assert paragraph_dedup.repeated_passages(nothing).collect() == []
    paragraph_dedup.repeated_passages(cluttered).collect()


def test_bands_reach_the_recall():
    for percent in range(10, 100):
        rows, bands = paragraph_dedup.tune_bands(percent)
        assert 1 - (1 - (percent / 100) ** rows) ** bands >= 0.99
        assert rows * bands <= 32 or rows == 1
    assert paragraph_dedup.tune_bands(80) == (3, 7)


def best(vectors, every, k):
    out = []
    for q, v in vectors.items():
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale,block", [(1.0, 16), (3000.0, 40), (1e-3, 2048)])
def test_top_k(spark, scale, block):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=8) * scale * rng.choice([0.1, 1, 3])]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(20)] + [(400, [0.0] * 8), (450, [1.0, 2.0])]
    bad = [(500, None), (550, [1.0] * 7 + [None]), (501, [float("nan")] + [1.0] * 7), (502, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    vectors = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, k=5, every=50, block=block).collect())
    assert got == best(vectors, 50, 5)


@pytest.mark.parametrize("seed", range(6))
def test_partial_products_lose_nothing(seed):
    rng = np.random.default_rng(seed)
    dim = [1, 3, 4, 7, 64, 64][seed]
    a, b = (rng.normal(size=(n, dim)) * rng.choice([1, 40, 3000], size=(n, 1)) for n in (20, 400))
    a, b = np.floor(a).astype(np.int64), np.floor(b).astype(np.int64)
    full = a @ b.T
    floors = np.sort(full, axis=1)[:, -7].astype(np.float64)
    floors[0] = -np.inf
    q, c, s = topk.surviving(a, floors, b)
    assert (s == full[q, c]).all()
    assert {(i, j) for i, j in zip(*np.nonzero(full >= floors[:, None]))} <= set(zip(q, c))


def test_partial_products_leave_out_most_of_the_given_table(spark):
    """On vectors of one length without clusters, such as the given ones, most pairs end before their whole product."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 64))
    v = np.floor(256 * v / np.linalg.norm(v, axis=1)[:, None]).astype(np.int64)
    floors = np.sort(v[:50] @ v[50:].T, axis=1)[:, -5].astype(np.float64)
    q, _, _ = topk.surviving(v[:50], floors, v[50:])
    assert len(q) < 0.5 * 50 * 2950


def test_top_k_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e15, 1.0]), (50, [-1e15, 2.0]), (7, [1e15, 1e14]), (8, [2e15, 0.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df).collect()}
    assert got[0, 1] == (7, 2**63 - 1) and got[0, 2] == (8, 2**63 - 1) and got[0, 3] == (50, -(2**63))


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0]), (7, [-1.0])], "vec_id long, embedding array<float>")
    assert len(topk.top_k(df).collect()) == 4
    assert topk.top_k(df.limit(0)).collect() == []


def test_pipeline(spark, documents, tmp_path):
    import corpus_pipeline

    labels = documents.where("doc_id is not null").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    documents.write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"file://{tmp_path}")
        assert docs.columns == documents.columns
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.count() == docs.count() > 0
    assert out.where("not pieces_lossless").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(names) == sorted([f"op{i}_{n}" for i, n in enumerate(
        "html_extraction mixing quality_classifier sentencepiece sharding quality_rules line_dedup ngram_jaccard_join substring_dedup exact_top_k minhash_near_dedup vector_codes hard_negatives".split(), 1)] + ["pipeline"])
