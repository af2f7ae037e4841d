"""Whole Arrow batches of texts as byte arrays: words, hashes and windows without per-row Python.

A word is a maximal run of characters outside U+0020 and U+0009..U+000D.  These are ASCII, so words
are found on the UTF-8 bytes.  Hashes are 64-bit; equal hashes are taken as equal words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
CHUNK = 2_000_000

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that begin a character (all but UTF-8 continuation bytes).
LEAD = (np.arange(256) & 0xC0) != 0x80
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        if n > 8 * CHUNK:  # not kept, so that one long text does not hold the memory
            return _power(BASE, n), _power(INVERSE, n)
        _POWERS["up"], _POWERS["down"] = _power(BASE, n), _power(INVERSE, n)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _power(base: np.uint64, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, out=steps)


class Hasher:
    """Hashes of any byte ranges of one buffer, from prefix sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[data] * up[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * BASE)


class Words(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def find_words(data: np.ndarray, bounds: np.ndarray) -> Words:
    """Words of the texts ``data[bounds[i]:bounds[i + 1]]``."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return Words(empty, empty, empty)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    space = SPACE[data]
    start = ~space
    start[1:] &= space[:-1] | first[1:-1]
    end = ~space
    end[:-1] &= space[1:] | first[1:-1]
    start = np.flatnonzero(start)
    return Words(np.searchsorted(bounds, start, side="right") - 1, start, np.flatnonzero(end) + 1)


def windows(keys: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all n-word windows inside one text, and their hashes."""
    if len(keys) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(doc[: len(doc) - n + 1] == doc[n - 1:])
    total = np.zeros(len(keys) - n + 1, np.uint64)
    for j in range(n):
        total = total * BASE + keys[j: len(keys) - n + 1 + j]
    return at, mix(total[at])


def per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of per-byte values over each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes of a text column and its bounds; null is an empty text."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if batch.num_rows == 0:
        return
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, batch.num_rows)
        yield batch.slice(lo, hi - lo), data[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo]
        lo = hi


def over_texts(df: DataFrame, work, schema: str, column: str = "text", limit: int = CHUNK) -> DataFrame:
    """``work(rows, data, bounds)`` over every chunk of texts; it returns a dict of Arrow-ready columns."""

    def run(batches):
        for batch in batches:
            for rows, data, bounds in text_chunks(batch, column, limit):
                yield pa.RecordBatch.from_pydict(work(rows, data, bounds))

    return df.mapInArrow(run, schema)


def hashed_sample(df: DataFrame, rows: int, *columns: str) -> DataFrame:
    """At most so many rows, the first by the hash of their columns; all of them if there are no more.

    Rows beyond a hash that about half as many again lie below are dropped first, so no task hands on a full sample of its own.
    """
    total, place = df.count(), F.xxhash64(F.lit(3), *columns)
    if total > 2 * rows:
        df = df.filter(place <= F.lit(int(2 ** 64 * 1.5 * rows / total) - 2 ** 63))
    return df.orderBy(place, *columns).limit(rows)


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of the table has it (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
