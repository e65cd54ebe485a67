"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

The lattice of a text has a node at every byte and an edge for every piece that fits,
plus edges of byte pieces for characters that are no piece of their own. Forward
filtering sums the weights of all ways to each node; backward sampling then draws a
segmentation from its end, with probability in proportion to the product of its pieces'
weights. A draw is a hash of the row's key, the place and the step, so a row gets the
same pieces on every run, in any batch.

A piece weighs (its rank in the vocabulary + 1) ** -theta, the usual law of word counts,
as the vocabulary gives ranks and no counts. Nothing is trained.

No piece holds a blank behind another character, and some bytes occur in no longer piece
at all; the lattice falls apart there into units of about a word. Equal units of a batch
are filtered once, and all of a batch's draws are made together in numpy.

Decoding joins the pieces' bytes and takes the leading blank off: it gives back every
text, byte by byte (U+2581 in a text is an ordinary character here, and runs of white
space are kept). A null text has null pieces, an empty one none. Repeated rows get equal
pieces if their keys are equal; a null key counts as 0. Very long units cost time in
proportion to their length. The vocabulary is read on the driver from the given path and
sent to the tasks; it is of fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.llm.words import U, blocks, buffers, give_back, mix, mix_int, span_hashes

BLANK = "▁"
_built: dict[bytes, Lattice] = {}


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes (blank for U+2581) by id; ``None`` for control pieces. ``byte_ids[b]`` is the piece of byte b."""

    pieces: tuple[bytes | None, ...]
    byte_ids: tuple[int, ...]

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids = [], [-1] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                byte_ids[b] = i
                pieces.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                pieces.append(None)
            else:
                pieces.append(sp.id_to_piece(i).replace(BLANK, " ").encode())
        if -1 in byte_ids:
            raise ValueError(f"{path} has no byte pieces, so not every text can be encoded")
        if any(p and b" " in p.lstrip(b" ") for p in pieces):
            raise ValueError(f"{path} has pieces with a blank inside")
        return Vocabulary(tuple(pieces), tuple(byte_ids))


def _drawn(sums: np.ndarray, a: np.ndarray, b: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The last place e in [a, b) with sums[e] <= target; stretches are short."""
    e = a.copy()
    on = np.arange(len(e))
    while len(on):
        on = on[e[on] + 1 < b[on]]
        on = on[sums[e[on] + 1] <= target[on]]
        e[on] += 1
    return e


class Lattice:
    """Search tables of a vocabulary, built once in a worker."""

    def __init__(self, vocabulary: Vocabulary, theta: float):
        self.pieces, self.byte_ids = vocabulary.pieces, np.array(vocabulary.byte_ids)
        n = len(self.pieces)
        self.weight = -theta * np.log(np.arange(n) + 2.0)
        bytes_only = set(vocabulary.byte_ids)
        nodes: list[dict[int, int]] = [{}]
        ends = [-1]
        joined = np.zeros(256, dtype=bool)
        for i, p in enumerate(self.pieces):
            if p is None or i in bytes_only:
                continue
            at = 0
            for b in p:
                if b not in nodes[at]:
                    nodes[at][b] = len(nodes)
                    nodes.append({})
                    ends.append(-1)
                at = nodes[at][b]
            ends[at] = i
            if len(p) > 1:
                joined[list(p)] = True
        # rows for nodes that go on and columns for bytes in use only; row and column 0 lead nowhere
        inner = [at for at, kids in enumerate(nodes) if kids]
        self.row = np.zeros(len(nodes), dtype=np.int32)
        self.row[inner] = np.arange(1, len(inner) + 1)
        used = sorted({b for at in inner for b in nodes[at]})
        self.column = np.zeros(256, dtype=np.int32)
        self.column[used] = np.arange(1, len(used) + 1)
        self.step = np.zeros((len(inner) + 1, len(used) + 1), dtype=np.int32)
        for at in inner:
            for b, k in nodes[at].items():
                self.step[self.row[at], self.column[b]] = k
        del nodes
        give_back()
        self.ends = np.array(ends, dtype=np.int32)
        self.alone = ~joined
        self.alone[32] = False
        self.flat = np.frombuffer(b"".join(p or b"" for p in self.pieces), dtype=np.uint8)
        self.length = np.array([len(p or b"") for p in self.pieces], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.length)[:-1]))

    def units(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where units begin: at a row, at the first blank of a run, and around bytes that join no other."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        blank, alone = data == 32, self.alone[data]
        cut[:-1] = blank | alone
        cut[1:-1] &= ~(blank[1:] & blank[:-1])
        cut[1:] |= alone
        cut[at] = True
        cut[len(data)] = False
        return np.flatnonzero(cut)

    def filtered(self, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Forward filtering of units laid in order of falling size.

        Nodes are numbered by place in the unit, then by unit. Gives the number of the
        first node at each place, and per node the incoming edges: where they begin in
        the list, running sums of their chances, piece and origin.
        """
        longest = int(size[0])
        alive = np.searchsorted(-size, -np.arange(longest + 1), side="right")  # units with a node at a place
        base = np.concatenate(([0], np.cumsum(alive)))
        base = base.astype(np.int32)
        unit = np.repeat(np.arange(len(start), dtype=np.int32), size)
        rel = np.arange(len(unit), dtype=np.int32) - np.repeat((np.cumsum(size) - size).astype(np.int32), size)
        body = data[start[unit] + rel]
        left = size.astype(np.int32)[unit] - rel
        lead = (body & 0xC0) != 0x80
        width = np.select([body < 0x80, body < 0xE0, body < 0xF0], [1, 2, 3], 4)
        known = np.zeros(len(body), dtype=bool)
        froms, tos, ids = [], [], []
        where, state, k = np.flatnonzero(lead), np.zeros(int(lead.sum()), dtype=np.int32), 0
        while len(where):
            state = self.step[self.row[state], self.column[body[where + k]]]
            ok = state > 0
            where, state = where[ok], state[ok]
            k += 1
            piece = self.ends[state]
            hit = piece >= 0
            p = where[hit]
            known[p[width[p] == k]] = True
            froms.append(base[rel[p]] + unit[p])
            tos.append(base[rel[p] + k] + unit[p])
            ids.append(piece[hit])
            ok = left[where] > k
            where, state = where[ok], state[ok]
        heads = np.flatnonzero(lead)
        spelt = np.repeat(~known[heads], np.diff(np.append(heads, len(body))))
        p = np.flatnonzero(spelt)
        froms.append(base[rel[p]] + unit[p])
        tos.append(base[rel[p] + 1] + unit[p])
        ids.append(self.byte_ids[body[p]].astype(np.int32))
        origin, to, piece = np.concatenate(froms), np.concatenate(tos), np.concatenate(ids)
        order = np.argsort(to, kind="stable")
        origin, to, piece = origin[order], to[order], piece[order]
        first = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=base[-1])))).astype(np.int32)
        del froms, tos, ids, order
        log = np.full(base[-1], -np.inf)
        log[: base[1]] = 0
        chance = np.empty(len(to))
        weight = self.weight[piece]
        for r in range(1, longest + 1):
            a, b = first[base[r]], first[base[r + 1]]
            if a == b:
                continue
            way = log[origin[a:b]] + weight[a:b]
            node, heads = np.unique(to[a:b], return_index=True)
            top = np.maximum.reduceat(way, heads)
            counts = np.diff(np.append(heads, b - a))
            top = np.where(np.isfinite(top), top, 0.0)
            part = np.exp(way - np.repeat(top, counts))
            total = np.add.reduceat(part, heads)
            with np.errstate(divide="ignore", invalid="ignore"):
                log[node] = top + np.log(total)
                chance[a:b] = np.where(np.repeat(total, counts) > 0, part / np.repeat(total, counts), 0.0)
        sums = np.concatenate(([0.0], np.cumsum(chance)))
        return base, first, sums, piece, origin

    def encode(self, data: np.ndarray, at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all rows (each text with a blank before it), and how many each row has."""
        n_rows = len(at) - 1
        if not len(data):
            return np.zeros(0, dtype=np.int32), np.zeros(n_rows, dtype=np.int64)
        start = self.units(data, at)
        end = np.append(start[1:], len(data))
        row = np.searchsorted(at, start, side="right") - 1
        place = np.arange(len(start)) - np.searchsorted(row, np.arange(n_rows))[row]
        _, sample, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        size = (end - start)[sample]
        order = np.argsort(-size, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        base, first, sums, piece, origin = self.filtered(data, start[sample][order], size[order])
        which = rank[which]
        node = base[size[order][which]] + which
        with np.errstate(over="ignore"):
            draw = mix(keys[row] + mix(place.astype(U) + U(1)))
            live, steps = np.arange(len(start)), []
            n_pieces = np.zeros(len(start), dtype=np.int64)
            k = 0
            while len(live):
                at_node = node[live]
                u = (mix(draw[live] + U(k + 1) * U(0x9E3779B97F4A7C15)) >> U(11)).astype(np.float64) / (1 << 53)
                a, b = first[at_node], first[at_node + 1]
                lo, hi = sums[a], sums[b]
                e = _drawn(sums, a, b, lo + u * (hi - lo))
                steps.append((live, piece[e]))
                n_pieces[live] += 1
                node[live] = origin[e]
                live = live[origin[e] >= base[1]]
                k += 1
        last = np.cumsum(n_pieces) - 1
        out = np.empty(int(n_pieces.sum()), dtype=np.int32)
        for k, (live, ids) in enumerate(steps):
            out[last[live] - k] = ids
        return out, np.bincount(row, weights=n_pieces, minlength=n_rows).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and their lengths, the blank before each text still there."""
        size = self.length[ids]
        skip = np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)
        data = self.flat[skip + np.arange(len(skip))]
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        return data, np.diff(ends)


def _lattice(vocabulary: Vocabulary, theta: float) -> Lattice:
    key = (theta, hash(vocabulary.pieces))
    if key not in _built:
        _built.clear()
        _built[key] = Lattice(vocabulary, theta)
    return _built[key]


def _blank_before(column: pa.Array) -> pa.Array:
    text = column.cast(pa.large_string())
    return pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), text, pa.scalar("", pa.large_string())))


def encode(docs: DataFrame, path: str, theta: float = 1.0, seed: int = 0, key: str = "doc_id", text: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` with ``out`` (array of piece ids) and ``<out>_lossless``, whether decoding gave the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    ok = f"{out}_lossless"
    frame = docs.withColumn(text, F.col(text).cast("string"))
    kept = [f for f in frame.schema.fields if f.name not in (out, ok)]
    frame = frame.select(*(f"`{f.name}`" for f in kept), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("__key"))

    def run(batches):
        lattice = _lattice(shared.value, theta)
        for batch in batches:
            for part in blocks(batch, text):
                column = part.column(text)
                data, at = buffers(_blank_before(column))
                with np.errstate(over="ignore"):
                    keys = mix(mix(part.column("__key").to_numpy(zero_copy_only=False).view(U)) + U(mix_int(seed + 1)))
                ids, counts = lattice.encode(data, at, keys)
                back, sizes = lattice.decode(ids, counts)
                same = np.ones(part.num_rows, dtype=bool)
                if not (np.array_equal(sizes, np.diff(at)) and np.array_equal(back, data)):
                    own = np.concatenate(([0], np.cumsum(sizes)))
                    same = np.array([np.array_equal(back[own[i] : own[i + 1]], data[at[i] : at[i + 1]]) for i in range(part.num_rows)], dtype=bool)
                null = np.asarray(column.is_null())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids), mask=pa.array(null))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), lists, pa.array(same, mask=null)], names=[*(f.name for f in kept), out, ok]
                )

    from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

    schema = StructType([*kept, StructField(out, ArrayType(IntegerType())), StructField(ok, BooleanType())])
    return frame.mapInArrow(run, schema)


def decode(rows: DataFrame, path: str, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their pieces; null pieces give null."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    kept = [f for f in rows.schema.fields if f.name != out]

    def run(batches):
        lattice = _lattice(shared.value, 1.0)
        for batch in batches:
            column = batch.column(pieces)
            null = np.asarray(column.is_null())
            counts = np.where(null, 0, np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float))).astype(np.int64)
            data, sizes = lattice.decode(np.asarray(column.flatten()).astype(np.int64), counts)
            ends = np.cumsum(sizes)
            texts = [None if n else data[e - s + 1 : e].tobytes().decode() for n, e, s in zip(null.tolist(), ends.tolist(), sizes.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=[*(f.name for f in kept), out])

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, StructType([*kept, StructField(out, StringType())]))
