"""Words, hashes and n-grams of whole Arrow columns of text, in numpy.

A batch of texts is one byte buffer; words, their hashes and n-grams are found for
all of it at once, so a task spends no interpreter step on a word. A word is
``[^\\x20\\x09-\\x0D]+``, which can be told from the bytes of UTF-8 alone.

A hash is a polynomial over the bytes (mod 2**64) with a mixing step behind it. It
depends on the word only, never on the batch.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(CHUNK + 1, base, dtype=U)
                steps[0] = 1
                _tables[name] = np.cumprod(steps, dtype=U)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all of it (one to one)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(30))
        x = x * U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U(27))
        x = x * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def mix_int(x: int) -> int:
    """``mix`` of one Python integer."""
    return int(mix(np.array([x & (2**64 - 1)], dtype=U))[0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the place where each row begins; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    at = np.frombuffer(offs, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, column: str, size: int = 1 << 20):
    """The batch cut into slices whose texts hold about ``size`` bytes; one text is never cut."""
    _, at = buffers(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its tasks, and what it keeps is missing to the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # a C library without it


def tidy(run):
    """A task over Arrow batches that gives back its memory at the end."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


class Words:
    """Words of a column: ``start`` and ``end`` in ``data``, and ``row`` they belong to."""

    def __init__(self, column: pa.Array):
        self.data, self.at = buffers(column)
        self.n_rows = len(self.at) - 1
        n = len(self.data)
        if n == 0:
            self.start = self.end = np.zeros(0, dtype=np.int64)
        else:
            inside = ~_SPACE[self.data]
            first = np.zeros(n + 1, dtype=bool)
            first[self.at] = True
            begins = inside.copy()
            begins[1:] &= ~inside[:-1] | first[1:n]
            ends = inside
            ends[:-1] &= ~inside[1:] | first[1:n]
            self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.at)
        self.count = np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.count)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return span_hashes(_LOWER[self.data] if lower else self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span; spans are in order and do not overlap."""
    up, down = _powers()
    out = np.zeros(len(start), dtype=U)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            if end[i] - start[i] > CHUNK:
                out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
                i += 1
                continue
            j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, side="right")))
            lo = start[i]
            part = data[lo : end[j - 1]]
            sums = np.zeros(len(part) + 1, dtype=U)
            np.cumsum((part.astype(U) + U(1)) * up[: len(part)], out=sums[1:])
            s, e = start[i:j] - lo, end[i:j] - lo
            out[i:j] = (sums[e] - sums[s]) * down[s]
            i = j
        return mix(out)


def n_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places are missing."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U)
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            out = out * U(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
    return mix(out)


def shingle_sets(words: Words, n: int, lower: bool = True) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its n-word shingles.

    A row of fewer words has one shingle, of all its words; without words, none.
    """
    h = words.hashes(lower)
    grams = n_grams(h, n)
    out = []
    for first, count in zip(words.first[:-1].tolist(), words.count.tolist()):
        if count >= n:
            s = np.sort(grams[first : first + count - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif count:
            out.append(mix(n_grams(h[first : first + count], count) + U(count)))
        else:
            out.append(np.zeros(0, dtype=U))
    return out
