"""Rounding as Spark's round does it (half up, on the shortest decimal text of a double), without a decimal for each value."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scaled values up to this bound are off by 2 ** -21 at most, so that TIE tells the ones that may be half-way.
BOUND, TIE = 2.0**32, 1e-5


def rounded(column: Column | str, digits: int) -> Column:
    """round(column, digits), bit by bit: only values near half-way or beyond the bound take the way of decimals."""
    x = F.col(column) if isinstance(column, str) else column
    y = x * F.lit(10.0**digits)
    plain = (F.abs(y) < BOUND) & (F.abs(y - F.rint(y)) < 0.5 - TIE)
    return F.when(plain, F.rint(y) / F.lit(10.0**digits) + F.lit(0.0)).otherwise(F.round(x, digits))


def rounded_block(x: np.ndarray, digits: int) -> np.ndarray:
    """The same for numpy blocks."""
    y = x * 10.0**digits
    whole = np.rint(y)
    out = whole / 10.0**digits + 0.0
    hard = np.flatnonzero(~((np.abs(y) < BOUND) & (np.abs(y - whole) < 0.5 - TIE)).ravel() & np.isfinite(x).ravel())
    if len(hard):
        step = Decimal(1).scaleb(-digits)
        wide = Decimal(2) ** 52
        given, flat = x.ravel(), out.ravel()
        for n in hard:
            d = Decimal(repr(float(given[n])))
            flat[n] = float(given[n]) if abs(d) >= wide else float(d.quantize(step, ROUND_HALF_UP)) + 0.0
        out = flat.reshape(x.shape)
    return np.where(np.isfinite(x), out, x)


def rounded_near(x: np.ndarray, off: float | np.ndarray, digits: int, exact: Callable) -> np.ndarray:
    """`rounded_block` of a matrix that is known to within `off`; `exact` gives the values at places (rows, columns), for those
    that are near half-way or beyond the bound."""
    with np.errstate(over="ignore", invalid="ignore"):
        y = x * 10.0**digits
        whole = np.rint(y)
        sure = np.abs(y) < BOUND
        y -= whole
        sure &= np.abs(y, out=y) < 0.5 - TIE - off * 10.0**digits
        whole /= 10.0**digits
        whole += 0.0
    at = np.nonzero(~sure)
    if len(at[0]):
        whole[at] = rounded_block(exact(*at), digits)
    return whole
