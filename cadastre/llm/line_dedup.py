"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines that are equal, or within ``tau`` edits of each other, are of one class (linked
ones share a class); the first line of a class, by document and place, stays and the
others are removed. Blank lines are left alone, and lines of fewer than
``least`` characters are compared for equality only: two edits would change most of them.

The join: every distinct line is split into tau + 1 segments. Of two lines within tau
edits the longer one holds a segment of the shorter one, shifted only as far as the edits
allow (the multi-match-aware windows of Pass-Join). So each line is indexed under its
segments with length and number, and probes the index of every length from its own down
to tau less. Lines without a partner under any key, nearly all, end there, known by numbers only. Those
that meet are compared by how often each holds eight common letters, which tau edits change by 2 tau
at most, and split again into ``FINE`` segments, of which tau edits spare all but tau; a pair
that holds fewer in common goes no further. So of many variants of one line that all share a
third of it, few pairs are left. They go on to a banded bit-parallel computation of the edit
distance (Hyyrö 2003). Every step is exact.

Equal lines are folded before anything is paired, so a line of very many documents is one
row. Null ids are ids of their own; null and empty texts have no lines; rows that repeat
id and text are one document; extra columns are not read. Each line is split and compared
whole, however long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastre.llm.graph import connected_components
from cadastre.session import materialise, release

FINE = 12
LETTERS = "enatirso"
#: Ids are broadcast up to this many bytes; beyond, texts are joined by shuffle.
BROADCAST_BYTES = 8 << 20


def document_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A row's identity: its id and text."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.col(text).cast("string"))


def lines_of(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, key, pos, line)`` of every line with a word; ``row`` tells rows apart."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    texts = docs.where(text.isNotNull()).select(F.monotonically_increasing_id().alias("row"), doc_id, document_key().alias("key"), text.alias("text"))
    lines = texts.select("row", "doc_id", "key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _name(line: Column) -> list[Column]:
    """Name of a line: two hashes, together far beyond chance."""
    return [F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line, F.octet_length(line)).alias("b")]


def _segment(length: Column, i: int, tau: int) -> tuple[Column, Column]:
    """Start (from 1) and length of segment i (from 0) of a line; the later ones are longer by one where it does not divide."""
    short = F.floor(length / (tau + 1))
    longer = F.pmod(length, F.lit(tau + 1))
    shift = F.greatest(F.lit(0), F.lit(i) - (F.lit(tau + 1) - longer))
    return (short * i + shift + 1).cast("int"), (short + F.when(F.lit(i) >= F.lit(tau + 1) - longer, 1).otherwise(0)).cast("int")


def _key(length: Column, i: int, part: Column) -> Column:
    return F.xxhash64(F.lit(i), length, part)


def _index_keys(tau: int) -> Column:
    n = F.col("n")
    out = []
    for i in range(tau + 1):
        start, size = _segment(n, i, tau)
        out.append(_key(n, i, F.substring("line", start, size)))
    return F.array(*out)


def _probe_keys(tau: int, delta: int) -> Column:
    """Keys under which a line shorter by ``delta`` may be found."""
    n = F.col("n") - delta
    out = []
    for i in range(tau + 1):
        start, size = _segment(n, i, tau)
        for off in range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1):
            inside = (start + off >= 1) & (start + off + size - 1 <= F.col("n"))
            out.append(F.when(inside, _key(n, i, F.substring("line", start + off, size))))
    return F.array(*out)


def _letters(line: Column) -> Column:
    """Counts of eight letters, seven bits each."""
    out = F.lit(0).cast("long")
    for k, letter in enumerate(LETTERS):
        count = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        out = out + F.shiftleft(count.bitwiseAND(F.lit(127)).cast("long"), 7 * k)
    return out


def _letter_gap(a: Column, b: Column) -> Column:
    gap = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        d = F.abs(F.shiftright(a, 7 * k).bitwiseAND(F.lit(127)) - F.shiftright(b, 7 * k).bitwiseAND(F.lit(127)))
        gap = gap + F.least(d, F.lit(128) - d)
    return gap


def shared_segments(short: Column, long: Column, tau: int) -> Column:
    """Whether all but tau of the fine segments of the shorter line stand in the longer one, shifted by tau at most; true for lines too short to split so."""
    n = F.length(short)
    size = F.floor(n / FINE).cast("int")

    def lost(state, i):
        # the first segments have n // FINE letters, the last takes the rest
        start, length = i * size + 1, F.when(i == FINE - 1, n - size * (FINE - 1)).otherwise(size)
        low = F.greatest(start - tau, F.lit(1))
        there = F.contains(long.substr(low, start + tau + length - low), short.substr(start, length))
        return F.when(state > tau, state).when(there, state).otherwise(state + 1)

    return F.when(n < FINE, True).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(FINE - 1)), F.lit(0), lost) <= tau)


def within_edits(a: Column, b: Column, tau: int) -> Column:
    """Whether two strings are within ``tau`` edits: bit-parallel over a diagonal band of 2 tau + 1 cells.

    Bit k of a word is the cell of the pattern's place j - tau + k in column j; ``p`` and
    ``m`` mark where going down the column adds or takes one. The score follows the lower
    edge of the band to the pattern's end, then the last row.
    """
    width = 2 * tau + 1
    ones = F.lit((1 << width) - 1).cast("long")
    top = F.lit(1 << (width - 1)).cast("long")

    def score_of(z):
        pattern, text = z["p"], z["t"]
        rows, cols = F.size(pattern), F.size(text)

        def column(state, j):
            # j from 0; letters of the pattern in the band of this column
            letter = F.get(text, j)
            x = F.lit(0).cast("long")
            for k in range(width):
                x = x + F.when(F.get(pattern, j - tau + k) == letter, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
            p, m = state["p"], state["m"]
            d0 = ((x.bitwiseAND(p) + p).bitwiseXOR(p)).bitwiseOR(x).bitwiseOR(m).bitwiseAND(ones)
            return F.struct(p.alias("p"), m.alias("m"), state["s"].alias("s"), d0.alias("d0"))

        def advance(c, j):
            p, m, score, d0 = c["p"], c["m"], c["s"], c["d0"]
            hp = m.bitwiseOR(ones - d0.bitwiseOR(p).bitwiseAND(ones))
            hn = d0.bitwiseAND(p)
            down = F.when(d0.bitwiseAND(top) == 0, 1).otherwise(0)
            # below the pattern's end the score follows the last row: bit rows - 1 - (j - tau)
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(rows - 1 - j + tau, F.lit(0)))
            along = F.when(hp.bitwiseAND(bit) != 0, 1).when(hn.bitwiseAND(bit) != 0, -1).otherwise(0)
            s = score + F.when(j < rows - tau, down).otherwise(along)
            half = F.shiftright(d0, 1)
            p2 = hn.bitwiseOR(ones - half.bitwiseOR(hp).bitwiseAND(ones)).bitwiseAND(ones)
            return F.struct(p2.alias("p"), half.bitwiseAND(hp).bitwiseAND(ones).alias("m"), s.cast("int").alias("s"))

        def step(state, j):
            # a score beyond 3 tau cannot come back to tau: diagonals never fall, and the last row has 2 tau columns left
            bound = F.transform(F.array(column(state, j)), lambda c: advance(c, j))
            return F.when(state["s"] > 3 * tau, state).otherwise(F.element_at(bound, 1))

        begin = F.struct(
            F.lit(((1 << (tau + 1)) - 1) << (width - tau - 1)).cast("long").alias("p"), F.lit(0).cast("long").alias("m"), F.lit(tau).alias("s")
        )
        return F.aggregate(F.sequence(F.lit(0), cols - 1), begin, step, lambda s: s["s"])

    # the letters are bound to a lambda's variable, so they are split once for a pair and not once for a column
    letters = F.array(F.struct(F.split(a, "").alias("p"), F.split(b, "").alias("t")))
    rows, cols = F.length(a), F.length(b)
    near = F.when((rows <= tau) | (cols == 0), F.levenshtein(a, b) <= tau).otherwise(F.element_at(F.transform(letters, score_of), 1) <= tau)
    return F.when(F.abs(rows - cols) > tau, False).otherwise(near)


def _of_ids(lines: DataFrame, ids: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``(id, line)`` of the distinct lines with these ids."""
    named = lines.select(F.xxhash64("line").alias("id"), "line")
    if ids.count() * 8 <= broadcast_bytes:
        return materialise(named.join(F.broadcast(ids), "id", "left_semi").distinct(), "texts")
    # lines are folded before they are dealt by id, so a line of very many documents is no hot key
    return materialise(named.distinct().join(ids, "id", "left_semi"), "texts")


def near_lines(lines: DataFrame, tau: int, least: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Pairs ``(x, y)`` of hashes of lines within tau edits; ``lines`` has ``line``."""
    base = lines.select("line").distinct().withColumn("n", F.length("line")).where(F.col("n") >= max(least, tau + 1))
    probed = F.concat(*(_probe_keys(tau, d) for d in range(tau + 1)))
    # keys are made once from the texts; who meets is found on numbers only
    known = materialise(base.select(F.xxhash64("line").alias("id"), _index_keys(tau).alias("held"), probed.alias("probed")), "keys")
    index = known.select(F.explode("held").alias("key"), F.col("id").alias("x"))
    probes = known.select(F.explode("probed").alias("key"), F.col("id").alias("y")).where("key is not null")
    probing = materialise(probes.join(index, (probes.key == index.key) & (F.col("x") != F.col("y")), "left_semi").distinct(), "probing")
    probed_keys = materialise(probing.select("key").distinct(), "met")
    held = materialise(index.join(probed_keys, "key", "left_semi"), "held")
    ids = materialise(held.select(F.col("x").alias("id")).union(probing.select("y")).distinct(), "asked")
    texts = _of_ids(lines, ids, broadcast_bytes)
    side = lambda c: texts.select(F.col("id").alias(c), F.col("line").alias(f"{c}l"), _letters(F.col("line")).alias(f"{c}n"))
    alike = (F.col("x") != F.col("y")) & (_letter_gap(F.col("xn"), F.col("yn")) <= 2 * tau) & shared_segments(F.col("xl"), F.col("yl"), tau)
    met = held.join(side("x"), "x").join(probing.join(side("y"), "y"), "key").where(alike)
    pairs = materialise(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    both = pairs.join(side("x").drop("xn"), "x").join(side("y").drop("yn"), "y")
    close = materialise(both.where(within_edits(F.col("xl"), F.col("yl"), tau)).select("x", "y"), "close")
    release(known, probing, probed_keys, held, ids, texts, pairs)
    return close


def _classes(docs: DataFrame, tau: int, least: int) -> tuple[DataFrame, DataFrame]:
    """All lines by name, and ``(doc_id, key, pos, first)`` of the lines of classes of more than one."""
    lines = lines_of(docs)
    named = materialise(lines.select("row", "doc_id", "key", "pos", *_name(F.col("line"))), "lines")
    close = near_lines(lines, tau, least)
    component = connected_components(close, "x", "y").select(F.col("node").alias("a"), "component")
    folded = named.groupBy("a", "b").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "key", "pos")).alias("p")).join(component, "a", "left")
    alone = F.col("component").isNull()
    firsts = materialise(
        folded.where(~alone | (F.col("c") > 1)).select(
            "a", "b", "c", "p", F.coalesce("component", "a").alias("class"), F.when(alone, F.col("b")).otherwise(0).alias("rest")
        ),
        "classes",
    )
    first = firsts.groupBy("class", "rest").agg(F.min("p").alias("first"))
    known = materialise(firsts.join(first, ["class", "rest"]).select("a", "b", "c", "first"), "firsts")
    # a name of more than a thousandth of all lines is one of a thousand at most; those are broadcast, so none of them is a hot key
    hot = F.col("c") * 1000 > named.count()
    places = named.select("doc_id", "key", "pos", "a", "b")
    of_hot = places.join(F.broadcast(known.where(hot).drop("c")), ["a", "b"])
    return named, of_hot.union(places.join(known.where(~hot).drop("c"), ["a", "b"])).select("doc_id", "key", "pos", "first")


def line_classes(docs: DataFrame, tau: int = 2, least: int = 16) -> DataFrame:
    """``(doc_id, key, pos, first)`` of every line whose class has more than one: its place, and that of its class's first line."""
    return _classes(docs, tau, least)[1]


def removed_lines(docs: DataFrame, tau: int = 2, least: int = 16) -> DataFrame:
    """``(doc_id, key, n_lines, removed)``: per document with a line, the places of the lines to take out, in order."""
    named, classed = _classes(docs, tau, least)
    counts = named.groupBy("row", "doc_id", "key").agg(F.count("*").alias("n_lines")).groupBy("doc_id", "key").agg(F.max("n_lines").alias("n_lines"))
    gone = classed.where(F.col("first") != F.struct("doc_id", "key", "pos")).groupBy("key", "doc_id").agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    same = (F.col("n.key") == F.col("g.key")) & F.col("n.doc_id").eqNullSafe(F.col("g.doc_id"))
    return counts.alias("n").join(gone.alias("g"), same, "left").select(
        "n.doc_id", "n.key", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed")
    )


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without its repeated lines; documents of which no line with a word is left go, unless they had none."""
    gone = removed_lines(docs, **options).where("size(removed) > 0").select(
        F.col("key").alias("__key"), F.col("removed").alias("__removed"), (F.size("removed") == F.col("n_lines")).alias("__all")
    )
    joined = docs.withColumn("__key", document_key()).join(gone, "__key", "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    # the lines are bound to a lambda's variable, so a text is split once and not once for a line
    places = lambda z: F.array_except(F.sequence(F.lit(0), F.size(z) - 1), F.col("__removed"))
    kept = F.element_at(F.transform(F.array(lines), lambda z: F.array_join(F.transform(places(z), lambda i: F.get(z, i)), "\n")), 1)
    text = F.when(F.col("__removed").isNull(), F.col("text").cast("string")).otherwise(kept)
    out = joined.where(~F.coalesce("__all", F.lit(False))).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(f"`{c}`" for c in docs.columns))
