"""Codes of the integer points on a sphere: a vector goes to the point of Z^d with squared norm r2 in its direction.

The nearest point has the vector's signs and the vector's order of magnitudes, so it is found among the sorted points (atoms:
ways to write r2 as a sum of d squares), by the largest inner product with the sorted magnitudes. A code counts the points
of the atoms before (the largest coordinate first), then the arrangement's place among the atom's distinct ones in order of
their coordinates, then the signs of the coordinates that are not 0, the first one highest (1: negative). Codes fill
[0, number of points) without gaps and can be taken back.

Vectors are cut into pieces of d coordinates that are coded by themselves; all rows of an Arrow batch at once. Ties go to the
first atom, equal magnitudes to the lower coordinate; a piece of zeros has the code of the first atom in that order; null
vectors are left out.
"""

from __future__ import annotations

from functools import lru_cache
from math import factorial, isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@lru_cache(None)
def atoms(d: int, r2: int) -> np.ndarray:
    """All descending lists of d numbers whose squares sum to r2, in descending order."""

    def lists(n: int, rest: int, most: int):
        if n == 0:
            if rest == 0:
                yield ()
            return
        for x in range(min(most, isqrt(rest)), -1, -1):
            if x * x * n < rest:
                return
            for tail in lists(n - 1, rest - x * x, x):
                yield (x, *tail)

    return np.array(list(lists(d, r2, isqrt(r2))), np.int64).reshape(-1, d)


def arrangements(counts) -> int:
    return factorial(sum(counts)) // prod(factorial(c) for c in counts)


@lru_cache(None)
def offsets(d: int, r2: int) -> np.ndarray:
    """The first code of each atom, and the number of all points."""
    sizes = [arrangements(np.unique(a, return_counts=True)[1].tolist()) << int((a > 0).sum()) for a in atoms(d, r2)]
    if sum(sizes) >= 1 << 63:
        raise ValueError("codes of this sphere pass 63 bits")
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def nearest_points(x: np.ndarray, r2: int) -> np.ndarray:
    """The point of the sphere nearest to each row's direction."""
    size = np.abs(x)
    by = np.argsort(-size, axis=1, kind="stable")
    which = (np.take_along_axis(size, by, 1) @ atoms(x.shape[1], r2).T).argmax(1)
    out = np.empty(x.shape, np.int64)
    np.put_along_axis(out, by, atoms(x.shape[1], r2)[which], 1)
    return np.where(np.signbit(x) & (x != 0), -out, out)


def encode(points: np.ndarray, r2: int) -> np.ndarray:
    """The code of each point."""
    n, d = points.shape
    size = np.abs(points)
    known = atoms(d, r2)
    index = {tuple(a): k for k, a in enumerate(known.tolist())}
    which = np.array([index[tuple(a)] for a in (-np.sort(-size, axis=1)).tolist()], np.int64)
    signs, ranks = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for j in range(d):
        signs = np.where(size[:, j] > 0, 2 * signs + (points[:, j] < 0), signs)
    values = np.unique(known)
    left = np.stack([(size == v).sum(1) for v in values], axis=1)
    total = np.array([arrangements(c) for c in left.tolist()], np.int64)  # of the coordinates that are left
    for j in range(d):
        rest = d - j
        for k, v in enumerate(values):
            ways = total * left[:, k] // rest  # arrangements that begin with v
            here = size[:, j] == v
            ranks += np.where(v < size[:, j], ways, 0)
            total_here = np.where(here, ways, 0) if k == 0 else np.where(here, ways, total_here)
        total = total_here
        left = left - (size[:, j : j + 1] == values[None])
    return offsets(d, r2)[which] + (ranks << (size > 0).sum(1)) + signs


def decode(codes: np.ndarray, d: int, r2: int) -> np.ndarray:
    """The point of each code."""
    first, known = offsets(d, r2), atoms(d, r2)
    which = np.searchsorted(first, codes, "right") - 1
    own = known[which]
    many = (own > 0).sum(1)
    rest = codes - first[which]
    signs, ranks = rest & ((1 << many) - 1), rest >> many
    values = np.unique(known)
    left = np.stack([(own == v).sum(1) for v in values], axis=1)
    total = np.array([arrangements(c) for c in left.tolist()], np.int64)
    size = np.zeros((len(codes), d), np.int64)
    for j in range(d):
        chosen = np.zeros(len(codes), bool)
        now = total.copy()
        for k, v in enumerate(values):
            ways = total * left[:, k] // (d - j)
            take = ~chosen & (ranks < ways)
            size[take, j], now[take] = v, ways[take]
            chosen |= take
            ranks = np.where(chosen, ranks, ranks - ways)
        total = now
        left = left - (size[:, j : j + 1] == values[None])
    out = size.copy()
    for j in range(d - 1, -1, -1):
        out[:, j] = np.where((size[:, j] > 0) & (signs & 1 == 1), -size[:, j], size[:, j])
        signs = np.where(size[:, j] > 0, signs >> 1, signs)
    return out


def code_pieces(base: DataFrame, d: int = 4, r2: int = 10) -> DataFrame:
    """(id, piece, code, point) for each piece of d coordinates; the last may be shorter and is filled with zeros. The point is
    what the code gives back."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            x = np.pad(x, ((0, 0), (0, -x.shape[1] % d)))
            pieces = x.shape[1] // d
            codes = encode(nearest_points(x.reshape(-1, d), r2), r2)
            ids = np.repeat(batch.column(0).to_numpy(), pieces)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(pieces), batch.num_rows)), pa.array(codes), pa.array(list(decode(codes, d, r2)), pa.list_(pa.int64()))], ["id", "piece", "code", "point"])

    return base.where("v IS NOT NULL").select("id", "v").mapInArrow(run, "id long, piece long, code long, point array<long>")
