"""Hilbert curves in any small number of dimensions, as a table of steps made from the curve's rule.

A curve is walked from the coarsest bit to the finest.  At each level the point's bits name a cell;
the orientation reached so far (``state``) says which place that cell has on the curve and how the curve is
turned inside it.  ``steps`` lists both for every state and cell, so that an index costs one lookup a level.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempaudit.llm.textops import unused


def _gray(w: int) -> int:
    return w ^ (w >> 1)


def _turn(x: int, by: int, n: int) -> int:
    """Bits of x rotated to the left, in a word of n bits."""
    by %= n
    return ((x << by) | (x >> (n - by))) & ((1 << n) - 1)


@lru_cache
def steps(dims: int) -> tuple[int, ...]:
    """For state * 2**dims + cell: place + 2**dims * next state; state 0 is the start.

    A state is the corner at which the curve enters a cube and the axis along which it leaves it.  Places
    are numbered along the reflected Gray code that runs from that corner along that axis.
    """
    size = 1 << dims
    place = {_gray(w): w for w in range(size)}
    out = []
    for corner in range(size):
        for axis in range(dims):
            for cell in range(size):
                w = place[_turn(cell ^ corner, -(axis + 1), dims)]
                enter = _gray(2 * ((w - 1) // 2)) if w else 0
                odd = w if w % 2 else max(w - 1, 0)  # the axis is told by the trailing ones of this number
                along = ((odd + 1) & -(odd + 1)).bit_length() - 1 if w else 0
                corner_in = corner ^ _turn(enter, axis + 1, dims)
                out.append(w + size * (corner_in * dims + (axis + along + 1) % dims))
    return tuple(out)


def indexes(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the curve of the rows of ``points``, whose coordinates lie in [0, 2**bits)."""
    rows, dims = points.shape
    table, size = np.array(steps(dims), np.int64), 1 << dims
    place, state = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    for level in range(bits - 1, -1, -1):
        cell = ((points.astype(np.int64) >> level & 1) << np.arange(dims)).sum(1)
        step = table[state * size + cell]
        place, state = place * size + step % size, step // size
    return place


def with_index(df: DataFrame, coordinates: list[Column], bits: int, name: str) -> DataFrame:
    """The same as a column of built-in expressions; ``coordinates`` are integers in [0, 2**bits)."""
    dims = len(coordinates)
    size, table = 1 << dims, F.array(*[F.lit(x) for x in steps(dims)])
    names = [unused(df, f"_x{i}") for i in range(dims)]
    step, state = unused(df, "_step"), unused(df, "_state")
    df = df.withColumns(dict(zip(names, coordinates))).withColumns({name: F.lit(0).cast("long"), state: F.lit(0)})
    for level in range(bits - 1, -1, -1):
        cell = sum((F.shiftright(c, level).bitwiseAND(1) * (1 << i) for i, c in enumerate(map(F.col, names))), F.lit(0))
        df = df.withColumn(step, F.get(table, F.col(state) * size + cell))
        df = df.withColumns({name: F.col(name) * size + F.pmod(step, F.lit(size)), state: F.floor(F.col(step) / size).cast("int")})
    return df.drop(*names, step, state)
