import random

from cadastre.llm.graph import connected_components
from cadastre.llm.ranks import running
from pyspark.sql import functions as F


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 202), (202, 200)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(up)}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_running_sums(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), rng.random(), i, rng.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, p double, i int, x int")
    for total in (1, 300, 100_000):
        got = {r.i: r.before for r in running(df, ["k"], F.col("p"), [F.col("i")], F.col("x"), total, "before").collect()}
        assert got == {i: sum(y for c, q, j, y in rows if c == k and (q, j) < (p, i)) for k, p, i, _ in rows}
