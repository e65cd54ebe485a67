"""Near-duplicate documents by SetSketch registers.

**Sketch.** Every shingle drives a Poisson process: points in time, each in one of ``m``
registers. A register of a set holds the earliest time of any of its shingles, an
exponential minimum, truncated and told on an exponential scale: K = 1 - log_b(time),
rounded down, within 0 and q + 1. So the sketch of a union is the greatest of the two
register by register (``merge``), and equal registers are the likelier, the more similar the
sets are. A set of n shingles needs only the points before the time at which all registers
are full, about (ln m) / n, so nearly all shingles of a long text cost one comparison.

**Bands.** Documents that agree in all registers of a band share a bucket. With 42 bands of
6 registers, a pair of similarity 0.8 meets with a chance of 1 - 3e-6.

**Joint estimate.** Of two sketches, the registers in which the one is greater, the other is
greater, and both agree, with both set sizes known, give the likelihood of every similarity.
A pair goes on to verification unless the threshold is less likely than the best
estimate by a factor of e**-``SLACK``.

**Verification** counts the common shingles of the whole sets.

Pairs of a bucket are never listed. (1) Each document is held against the least of all first
documents of its buckets; (2) buckets whose documents are not yet all in one component
hold two documents, the first and one by hash, which differs from bucket to bucket, against those of other components; (3) what then still has
several components is cut into blocks of bounded size, and blocks meet block by block within tasks:
the blocks of the largest component of a bucket (its hub) with those of all documents that share any
bucket with it, and the others of a bucket with one another. Two blocks of one component never meet: there
every link is known to change nothing. So a group of n near copies that hangs together costs about n
comparisons, and every pair that meets in a band is either compared or already in one
component. Tasks give back spanning links only.

- Texts that are null, empty or without words have no shingle and no link; a text of fewer words than a
  shingle has one, of all its words.
- A row without id has no component and is kept. Rows that repeat an id share a component.
- Columns other than the id and the text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastre.llm.graph import connected_components
from cadastre.llm.words import U, Words, blocks, mix, mix_int, shingle_sets, tidy
from cadastre.session import materialise

M, BASE, RATE, Q = 256, 1.001, 20.0, 65534
BANDS, ROWS = 42, 6
SLACK = 12.0
TEXTS = 1 << 20
TOGETHER = 64
#: Ids are broadcast up to this many bytes; beyond, texts are joined by shuffle.
BROADCAST_BYTES = 4 << 20
_STEP = 0x9E3779B97F4A7C15


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """Sketches of sets of 64-bit shingle hashes, one row each; an empty set has only zeros."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    least = np.full((len(sets), M), np.inf)
    todo, share = np.flatnonzero(size), math.log(M) + 5
    while len(todo):
        owner = np.repeat(np.arange(len(todo)), size[todo])
        element = np.concatenate([sets[i] for i in todo])
        # time runs M times as fast as in one register
        limit = M * share / size[todo]
        found = np.full(len(todo) * M, np.inf)
        time, j = np.zeros(len(owner)), 0
        while len(owner):
            j += 1
            with np.errstate(over="ignore"):
                h = mix(element + U(j * _STEP & (2**64 - 1)))
            time = time - np.log(((h >> U(11)).astype(np.float64) + 1) * 2.0**-53)
            early = time <= limit[owner]
            owner, element, time = owner[early], element[early], time[early]
            np.minimum.at(found, owner * M + (h[early] & U(M - 1)).astype(np.int64), time)
        least[todo] = found.reshape(-1, M)
        todo, share = todo[np.isinf(least[todo]).any(axis=1)], 2 * share
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(least / (M * RATE)) / math.log(BASE))
    k[size == 0] = 0
    return np.clip(k, 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def band_keys(k: np.ndarray) -> np.ndarray:
    """Bucket of every band of every sketch."""
    odd = mix(np.arange(ROWS, dtype=U) + U(mix_int(101))) | U(1)
    with np.errstate(over="ignore"):
        sums = (k[:, : BANDS * ROWS].reshape(len(k), BANDS, ROWS).astype(U) * odd).sum(axis=2, dtype=U)
        return mix(sums ^ mix(np.arange(BANDS, dtype=U) + U(mix_int(102))))


@functools.cache
def _grid() -> np.ndarray:
    return np.linspace(0, 1, 101)


def likelihoods(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, jaccard: np.ndarray) -> np.ndarray:
    """Log-likelihood of each similarity (columns) for each pair (rows): ``above`` registers greater in a, ``below`` in b."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    j = np.minimum(jaccard[None, :], np.minimum(u / v, v / u)[:, None])
    p = lambda x: -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / math.log(BASE)
    a, b = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    part = lambda n, q: np.where(n[:, None] > 0, n[:, None] * np.log(np.maximum(q, 1e-300)), 0.0)
    return part(above, a) + part(below, b) + part(M - above - below, 1 - a - b)


def estimate(above: np.ndarray, below: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest similarity of each pair (where it is far off, the share of equal registers), and whether ``percent`` or more is likely enough to verify."""
    t, equal = percent / 100, M - above - below
    value = equal / M
    # far fewer equal registers than the threshold gives (9 deviations) need no likelihood
    good = (equal >= M * t - 9 * math.sqrt(M * t * (1 - t))) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))
    near = np.flatnonzero(good)
    if len(near):
        grid = np.sort(np.append(_grid(), t))
        level = likelihoods(above[near], below[near], n_a[near].astype(np.float64), n_b[near].astype(np.float64), grid)
        good[near] = level[:, grid >= t].max(axis=1) >= level.max(axis=1) - SLACK
        value[near] = grid[level.argmax(axis=1)]
    return value, good


def _set_key(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return mix_int(int(mix(s ^ U(0x2545F4914F6CDD1D)).sum(dtype=U)) ^ len(s))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate(([0], np.cumsum([len(a) for a in arrays])))
    flat = np.concatenate(arrays) if arrays else np.zeros(0, dtype=U)
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))


def sketched(docs: DataFrame, n: int) -> DataFrame:
    """Per row: doc_id, n_shingles, set_key, ``lead`` (the least id among equal sets of its block of texts) and, for leads, registers and bands."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text", TEXTS):
                ids = part.column("doc_id").to_pylist()
                sets = shingle_sets(Words(part.column("text")), n)
                keys = [_set_key(s) if len(s) else 0 for s in sets]
                lead: dict[int, int] = {}
                for i in sorted((i for i, d in enumerate(ids) if d is not None and len(sets[i])), key=lambda i: ids[i]):
                    lead.setdefault(keys[i], i)
                chosen = sorted(lead.values())
                k = registers([sets[i] for i in chosen])
                bands = band_keys(k)
                place = dict(zip(chosen, range(len(chosen))))
                of = [lead.get(keys[i]) if ids[i] is not None and len(sets[i]) else None for i in range(len(ids))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.array(keys, dtype=U).view(np.int64), pa.int64()),
                        pa.array([None if i is None else ids[i] for i in of], pa.int64()),
                        pa.array([k[place[i]].tobytes() if i in place else None for i in range(len(ids))], pa.binary()),
                        pa.array([bands[place[i]].view(np.int64) if i in place else None for i in range(len(ids))], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "lead", "registers", "bands"],
                )

    schema = "doc_id long, n_shingles long, set_key long, lead long, registers binary, bands array<long>"
    return _texts(docs).mapInArrow(tidy(run), schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _shingles(docs: DataFrame, ids: DataFrame, n: int, broadcast_bytes: int) -> DataFrame:
    """``(rid, s)`` for the ids; an id of several texts has a row for each."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text", TEXTS):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(shingle_sets(Words(part.column("text")), n))], names=["rid", "s"])

    if ids.count() * 8 <= broadcast_bytes:
        ids = F.broadcast(ids)
    rows = _texts(docs).join(ids.select(F.col("rid").alias("doc_id")), "doc_id", "left_semi").mapInArrow(tidy(run), "rid long, s array<long>")
    return materialise(rows.where("size(s) > 0"), "shingles")


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a > b).sum(axis=-1), (a < b).sum(axis=-1)


def _sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), M)


def verified(pairs: DataFrame, reps: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that are similar enough: estimated on their sketches, then counted on whole sets."""

    def run(batches):
        for batch in batches:
            above, below = _counted(_sketches_of(batch.column("r_a")), _sketches_of(batch.column("r_b")))
            _, good = estimate(above, below, batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    side = lambda x: reps.select(F.col("rid").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(close)
    likely = materialise(both.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(tidy(run), "a long, b long").distinct(), "likely")
    sets = lambda x: shingles.select(F.col("rid").alias(x), F.col("s").alias(f"s_{x}"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    met = likely.join(sets("a"), "a").join(sets("b"), "b").select("a", "b", common.alias("c"), (F.size("s_a") + F.size("s_b")).alias("n"))
    return materialise(met.where(F.col("c") * 100 >= (F.col("n") - F.col("c")) * percent).select("a", "b").distinct(), "links")


def _linked_blocks(percent: int):
    """Task over the one or two blocks of a piece: links that join components, the likeliest first."""

    def run(table: pa.Table) -> pa.Table:
        side, ids, comp = (table.column(c).to_numpy() for c in ("side", "rid", "component"))
        sets = [np.asarray(s.values) for s in table.column("s").combine_chunks()]
        n, k = np.array([len(s) for s in sets]), _sketches_of(table.column("registers").combine_chunks())
        found, root = [], {c: c for c in comp.tolist()}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        pairs = []
        for i in range(len(ids)):
            other = np.flatnonzero((comp != comp[i]) & (ids != ids[i]) & (((side == 0) & (np.arange(len(ids)) > i)) | ((side == 2) & (side[i] == 1))))
            if len(other):
                above, below = _counted(k[i][None, :], k[other])
                value, good = estimate(above, below, np.full(len(other), n[i]), n[other], percent)
                pairs += [(-v, i, j) for v, j in zip(value[good].tolist(), other[good].tolist())]
        for _, i, j in sorted(pairs):
            a, b = top(int(comp[i])), top(int(comp[j]))
            if a != b:
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if common * 100 >= (int(n[i]) + int(n[j]) - common) * percent:
                    root[a] = b
                    found.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def _components(links: DataFrame) -> DataFrame:
    return materialise(connected_components(links).select(F.col("node").alias("rid"), "component"), "components")


def _with_component(rows: DataFrame, components: DataFrame) -> DataFrame:
    return rows.join(components, "rid", "left").withColumn("component", F.coalesce("component", "rid"))


def _dealt(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with a block of about ``TOGETHER`` rows inside each group ``by``."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("__many"))
    return rows.join(counts, by).withColumn(name, F.pmod(F.xxhash64("rid"), F.ceil(F.col("__many") / TOGETHER))).drop("__many")


def _searched(use: DataFrame, reps: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links inside pieces ``(piece, side, rid, component)``."""
    pieces = use.join(reps.select("rid", "registers"), "rid").join(shingles, "rid").select("piece", "side", "rid", "component", "registers", "s")
    return pieces.groupBy("piece").applyInArrow(_linked_blocks(percent), "a long, b long").distinct()


def _against_hubs(placed: DataFrame, reps: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links between the largest component of a bucket, its hub, and the others: each pair of blocks once, however many buckets it shares."""
    hub = _dealt(placed.where("component = hub").select("hub", "rid", "component").distinct(), ["hub"], "x")
    others = _dealt(placed.where("component <> hub").select("hub", "rid", "component").distinct(), ["hub"], "y")
    pairs = hub.select("hub", "x").distinct().join(others.select("hub", "y").distinct(), "hub").withColumn("piece", F.xxhash64("hub", "x", "y"))
    use = hub.join(pairs, ["hub", "x"]).select("piece", F.lit(1).alias("side"), "rid", "component").union(
        others.join(pairs, ["hub", "y"]).select("piece", F.lit(2).alias("side"), "rid", "component")
    )
    return _searched(use, reps, shingles, percent)


def _besides_hubs(rows: DataFrame, reps: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets ``(key, rid, component)``, block by block, but for two blocks of one component."""
    counts = rows.groupBy("key", "component").agg(F.count("*").alias("many"))
    small = counts.where(F.col("many") < TOGETHER).groupBy("key").agg(F.sum("many").alias("rest"))
    pure = F.col("many") >= TOGETHER
    block = F.when(pure, F.xxhash64("component", F.pmod(F.xxhash64("rid"), F.ceil(F.col("many") / TOGETHER)))).otherwise(
        F.pmod(F.xxhash64("component"), F.ceil(F.col("rest") / TOGETHER))
    )
    blocked = materialise(
        rows.join(counts, ["key", "component"]).join(small, "key", "left")
        .select("key", "rid", "component", block.alias("block"), F.when(pure, F.col("component")).alias("pure")), "blocked"
    )
    spans = blocked.select("key", "block", "pure").distinct()
    others = spans.select("key", F.col("block").alias("other"), F.col("pure").alias("other_pure"))
    same = F.col("block") == F.col("other")
    pairs = spans.join(others, "key").where((F.col("block") <= F.col("other")) & ~F.coalesce(F.col("pure") == F.col("other_pure"), F.lit(False)))
    pairs = pairs.withColumn("piece", F.xxhash64("key", "block", "other"))
    use = pairs.select("key", "block", "piece", F.when(same, 0).otherwise(1).alias("side")).union(
        pairs.where(~same).select("key", F.col("other").alias("block"), "piece", F.lit(2).alias("side"))
    )
    return _searched(blocked.join(use, ["key", "block"]).select("piece", "side", "rid", "component"), reps, shingles, percent)


def _rest(met: DataFrame, components: DataFrame, reps: DataFrame, shingles: DataFrame, percent: int) -> DataFrame:
    """Links inside buckets that still hold several components besides that of their first document."""
    placed = materialise(_with_component(met.where("rid <> first"), components), "placed")
    sizes = placed.groupBy("key", "mark", "component").agg(F.count("*").alias("many"))
    several = sizes.groupBy("key", "mark").agg(F.count("*").alias("n"), F.max(F.struct("many", "component"))["component"].alias("hub")).where("n > 1")
    # buckets of the same documents are searched once
    keys = several.groupBy("mark").agg(F.min(F.struct("key", "hub")).alias("k")).select("k.key", "k.hub")
    rest = materialise(placed.join(keys, "key").select("key", "rid", "component", "hub"), "rest")
    besides = _besides_hubs(rest.where("component <> hub").drop("hub"), reps, shingles, percent)
    return materialise(_against_hubs(rest, reps, shingles, percent).union(besides), "links")


def near_duplicates(docs: DataFrame, n: int = 2, percent: int = 80, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept."""
    rows = materialise(sketched(docs, n), "sketches")
    leads = rows.where("registers is not null")
    least = F.min("doc_id").over(Window.partitionBy("n_shingles", "set_key"))
    leading = materialise(leads.select("doc_id", "n_shingles", "set_key").withColumn("rid", least).distinct(), "leading")
    own = leading.where("doc_id = rid").select("rid", "set_key")
    reps = materialise(
        leads.withColumnRenamed("doc_id", "rid").join(own, ["rid", "set_key"]).dropDuplicates(["rid", "set_key"]).select("rid", "n_shingles", "registers", "bands"), "reps"
    )
    keyed = reps.select("rid", F.explode("bands").alias("key"))
    mark = lambda i: F.sum(F.xxhash64("rid", F.lit(i)).cast("decimal(20,0)"))
    by_hash = F.min(F.struct(F.xxhash64("rid", "key").alias("h"), "rid"))["rid"]
    buckets = keyed.groupBy("key").agg(F.count("*").alias("many"), F.min("rid").alias("first"), by_hash.alias("other")).where("many > 1")
    met = keyed.join(buckets, "key").select("key", "rid", "first", "other")
    met = materialise(met, "met")
    marks = met.groupBy("key").agg(F.xxhash64(F.count("*"), mark(1), mark(2)).alias("mark"))
    shingles = _shingles(docs, materialise(met.select("rid").distinct(), "chosen"), n, broadcast_bytes)
    # (1) each document against one first document
    stars = met.where("rid <> first")
    once = materialise(stars.groupBy("rid").agg(F.min("first").alias("b")).select(F.col("rid").alias("a"), "b"), "pairs")
    links = verified(once, reps, shingles, percent)
    components = _components(links)
    # (2) two documents of a bucket against those of other components
    heads = components.select(F.col("rid").alias("b"), F.col("component").alias("c"))
    held = met.select("rid", F.explode(F.array("first", "other")).alias("b")).where("rid <> b").distinct()
    apart = _with_component(held, components).join(heads, "b", "left").where(F.col("component") != F.coalesce("c", "b"))
    more = apart.select(F.col("rid").alias("a"), "b").join(once, ["a", "b"], "left_anti")
    links = links.union(verified(more, reps, shingles, percent))
    # (3) the rest, block by block
    links = links.union(_rest(met.join(marks, "key"), _components(links), reps, shingles, percent))
    # an id of several texts links their sets
    of_lead = leading.select(F.col("doc_id").alias("lead"), "set_key", "rid")
    named = materialise(
        rows.select("doc_id", "n_shingles", "set_key", "lead").join(of_lead, ["lead", "set_key"], "left").select("doc_id", "n_shingles", F.coalesce("rid", "doc_id").alias("rid")), "named"
    )
    repeated = named.groupBy("doc_id").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low <> high").select("doc_id", "low")
    links = links.union(named.join(repeated, "doc_id").select(F.col("rid").alias("a"), F.col("low").alias("b")))
    component_id = F.col("component")
    return _with_component(named, _components(links)).select(
        "doc_id", "n_shingles", component_id.alias("component_id"), F.col("doc_id").eqNullSafe(component_id).alias("kept")
    )
