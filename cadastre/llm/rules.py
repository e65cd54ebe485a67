"""Quality rules as a short-circuit cascade.

Every text is measured in full (words, symbols, repeated lines and windows); texts that
fail the base limits are out. The rest pass a cascade of rules. On a sample of at most
``SAMPLE`` texts (in expectation, chosen by a hash of the id; the bound is documented
because an order of rules needs no more) each rule's cost and rejections are measured,
and the rules run in the order of rejections per second: a rule sees only the texts that
all rules before it passed. The order never changes a verdict, as a text is kept only
when every rule passes it; timings therefore leave reruns equal.

Null and empty texts have no words and fail the base. Repeated rows are judged each; a
null id is kept as it is. Extra columns are not read. Work per text is linear, but for
sorting its lines and windows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastre.llm.words import U, Words, blocks, n_grams, span_hashes

SAMPLE = 2000
WINDOW = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[97:123] = _SMALL[128:] = True


class Texts:
    """A column of texts with what the rules measure.

    What is returned of every row (word_chars, symbols, lines) is measured once and read by the rules; what only
    rules need (words without a kind of byte) is of chosen rows only.
    """

    def __init__(self, column: pa.Array):
        self.words = Words(column)
        self.n_words = self.words.count.astype(np.int64)

    def _spans(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the words of the rows, and which row of ``rows`` each is of."""
        count = self.n_words[rows]
        owner = np.repeat(np.arange(len(rows)), count)
        begin = np.repeat(self.words.first[:-1][rows] - np.concatenate(([0], np.cumsum(count)[:-1])) if len(rows) else np.zeros(0, dtype=np.int64), count)
        return np.arange(len(owner)) + begin, owner

    @cached_property
    def symbols(self) -> np.ndarray:
        """Symbols in each whole text."""
        at, data = self.words.at, self.words.data
        return np.array([int(np.count_nonzero(_SYMBOL[data[at[r] : at[r + 1]]])) for r in range(self.words.n_rows)], dtype=np.int64)

    def words_without(self, kind: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Words of each row that hold no byte of a kind."""
        index, owner = self._spans(rows)
        data = self.words.data
        out = np.zeros(len(rows), dtype=np.int64)
        if len(index):
            lo, hi = self.words.start[index[0]], self.words.end[index[-1]]
            sums = np.concatenate(([0], np.cumsum(kind[data[lo:hi]], dtype=np.int64)))
            none = sums[self.words.end[index] - lo] == sums[self.words.start[index] - lo]
            out += np.bincount(owner[none], minlength=len(rows))
        return out

    @cached_property
    def word_chars(self) -> np.ndarray:
        """Code points in the words of every row."""
        w = self.words
        if not len(w.start):
            return np.zeros(w.n_rows, dtype=np.int64)
        sums = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80, dtype=np.int64)))
        each = np.concatenate(([0], np.cumsum(sums[w.end] - sums[w.start])))
        return each[w.first[1:]] - each[w.first[:-1]]

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Per row its lines with a word, and those equal to an earlier one."""
        w = self.words
        if not len(w.data):
            return np.zeros(w.n_rows, dtype=np.int64), np.zeros(w.n_rows, dtype=np.int64)
        breaks = np.flatnonzero(w.data == 10)
        filled = np.diff(w.at) > 0
        start = np.sort(np.concatenate((w.at[:-1][filled], breaks + 1)))
        # a text that ends in a break has an empty last line, which holds no word
        start = np.unique(start[start < len(w.data)])
        end = np.append(start[1:], len(w.data))
        end = end - ((w.data[end - 1] == 10) & (end > start))
        worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end = start[worded], end[worded]
        row = np.searchsorted(w.at, start, side="right") - 1
        h = span_hashes(w.data, start, end)
        order = np.lexsort((h, row))
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        return np.bincount(row, minlength=w.n_rows), np.bincount(row[order][same], minlength=w.n_rows)

    def repeat_words(self, size: int = WINDOW) -> np.ndarray:
        """Words of every row inside windows that occur twice or more in it, the first included."""
        w = self.words
        grams = n_grams(w.hashes(), size)
        out = np.zeros(w.n_rows, dtype=np.int64)
        for r in np.flatnonzero(w.count > size).tolist():
            g = grams[w.first[r] : w.first[r] + w.count[r] - size + 1]
            order = np.argsort(g, kind="stable")
            s = g[order]
            same = s[1:] == s[:-1]
            if same.any():
                hit = np.zeros(len(g), dtype=bool)
                hit[order[1:][same]] = True
                hit[order[:-1][same]] = True
                edge = np.zeros(w.count[r] + 1, dtype=np.int64)
                at = np.flatnonzero(hit)
                edge[at] += 1
                edge[at + size] -= 1
                out[r] = int((np.cumsum(edge) > 0).sum())
        return out


@dataclass(frozen=True)
class Rule:
    """A named limit; ``fails(texts, rows)`` is true where a row breaks it."""

    name: str
    fails: Callable[[Texts, np.ndarray], np.ndarray]


def _lines_repeat(texts: Texts, rows: np.ndarray) -> np.ndarray:
    n, again = texts.lines
    return 100 * again[rows] > 50 * n[rows]


RULES = (
    Rule("symbols", lambda t, rows: 100 * t.symbols[rows] > 25 * t.n_words[rows]),
    Rule("letters", lambda t, rows: 100 * t.words_without(_LETTER, rows) > 35 * t.n_words[rows]),
    Rule("shouting", lambda t, rows: 100 * t.words_without(_SMALL, rows) > 50 * t.n_words[rows]),
    Rule("lines", _lines_repeat),
    Rule("word_length", lambda t, rows: (t.word_chars[rows] < 2 * t.n_words[rows]) | (t.word_chars[rows] > 15 * t.n_words[rows])),
)


def _share(docs: DataFrame, sample: int):
    total = docs.count()
    part = int(min(1.0, sample / total) * (1 << 30)) if total else 0
    return F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(part)


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> list[tuple[str, float, int]]:
    """``(rule, seconds, rejections)`` on the sample, best rejections per second first."""

    def measure(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                texts = Texts(part.column("text"))
                rows = np.flatnonzero(texts.n_words > 0)
                # measured for every text anyway, so no cost of a rule
                _ = texts.symbols, texts.word_chars, texts.lines
                times, hits = [], []
                for rule in rules:
                    begun = time.perf_counter()
                    hits.append(int(rule.fails(texts, rows).sum()))
                    times.append(time.perf_counter() - begun)
                yield pa.RecordBatch.from_pydict({"rule": [r.name for r in rules], "seconds": times, "rejected": hits})

    found = (
        docs.where(_share(docs, sample)).select(F.col("text").cast("string").alias("text"))
        .mapInArrow(measure, "rule string, seconds double, rejected long")
        .groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("rejected").alias("rejected"))
    )
    seen = {r.rule: (r.seconds, r.rejected) for r in found.collect()}  # one row a rule
    known = [(r.name, *seen.get(r.name, (0.0, 0))) for r in rules]
    return sorted(known, key=lambda x: (-x[2] / max(x[1], 1e-9), x[1]))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """Per row: doc_id, the measures, base_failed and kept.

    Which rule a text fails first hangs on the order, so it is not told; ``failures`` names all of them.
    """
    by_name = {r.name: r for r in rules}
    ordered = [by_name[name] for name, _, _ in order_rules(docs, rules, sample)]

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                t = Texts(part.column("text"))
                n, repeat = t.n_words, t.repeat_words()
                every = np.arange(part.num_rows)
                base = (n < 20) | (100 * repeat > 30 * n)
                alive = every[~base]
                for rule in ordered:
                    if not len(alive):
                        break
                    alive = alive[~rule.fails(t, alive)]
                kept = np.zeros(part.num_rows, dtype=bool)
                kept[alive] = True
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(n), pa.array(t.word_chars), pa.array(t.symbols),
                        pa.array(t.lines[1].astype(np.int64)), pa.array(repeat), pa.array(base), pa.array(kept),
                    ],
                    names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
                )

    schema = (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean"
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def failures(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row that a rule rejects: doc_id and the names of all rules it fails, in the order of ``rules``; for reports."""

    def run(batches):
        for batch in batches:
            for part in blocks(batch, "text"):
                t = Texts(part.column("text"))
                every = np.flatnonzero(t.n_words > 0)
                hits = np.array([r.fails(t, every) for r in rules]).T if len(rules) else np.zeros((len(every), 0), dtype=bool)
                some = hits.any(axis=1)
                names = [[r.name for r, bad in zip(rules, row) if bad] for row in hits[some].tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(every[some])), pa.array(names, pa.list_(pa.string()))], names=["doc_id", "failed"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, failed array<string>")
