"""Distances between two array columns, as Spark columns.

Each measure is a sum over coordinates, accumulated in double from left to right, and a formula over such sums. Terms are
written once, in SQL with x and y for the coordinates, so that any engine's plan can be checked against them.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: name -> (coordinate terms by letter, formula over the letters). Smaller is nearer but for SIMILARITIES.
MEASURES: dict[str, tuple[dict[str, str], str]] = {
    "l2_sq": ({"s": "(x - y) * (x - y)"}, "s"),
    "l2": ({"s": "(x - y) * (x - y)"}, "sqrt(s)"),
    "inner_product": ({"s": "x * y"}, "s"),
    "neg_dot": ({"s": "x * y"}, "0.0D - s"),
    "ip_distance": ({"s": "x * y"}, "1 - s"),
    "abs_dot": ({"s": "x * y"}, "0.0D - abs(s)"),
    "cosine": ({"s": "x * y", "p": "x * x", "r": "y * y"}, "CASE WHEN p = 0 OR r = 0 THEN 1.0D ELSE 1 - s / (sqrt(p) * sqrt(r)) END"),
    "angular": ({"s": "x * y", "p": "x * x", "r": "y * y"}, "CASE WHEN p = 0 OR r = 0 THEN sqrt(2.0D) ELSE sqrt(greatest(0.0D, 2 - 2 * (s / (sqrt(p) * sqrt(r))))) END"),
    "limited_inner_product": ({"s": "x * y", "p": "x * x", "r": "y * y"}, "CASE WHEN p * greatest(p, r) = 0 THEN 0.0D ELSE -s / sqrt(p * greatest(p, r)) END"),
    "l1": ({"s": "abs(x - y)"}, "s"),
    "lp3": ({"s": "abs(x - y) * abs(x - y) * abs(x - y)"}, "s"),
    "lp_half": ({"s": "sqrt(abs(x - y))"}, "s * s"),
    "canberra": ({"s": "CASE WHEN x = 0 AND y = 0 THEN 0.0D ELSE abs(x - y) / (abs(x) + abs(y)) END"}, "s"),
    "bray_curtis": ({"s": "abs(x - y)", "p": "abs(x + y)"}, "CASE WHEN p = 0 THEN 0.0D ELSE s / p END"),
    "jensen_shannon": ({"s": "CASE WHEN x > 0 THEN x * ln(2 * x / (x + y)) ELSE 0.0D END + CASE WHEN y > 0 THEN y * ln(2 * y / (x + y)) ELSE 0.0D END"}, "0.5D * s"),
    "neg_l2_sq": ({"s": "(x - y) * (x - y)"}, "0.0D - s"),
    "nonzero_intersect": ({"s": "CASE WHEN x <> 0 AND y <> 0 THEN 1.0D ELSE 0.0D END"}, "0.0D - s"),
    "hamming": ({"s": "CASE WHEN x <> y THEN 1.0D ELSE 0.0D END"}, "s"),
    "jaccard": ({"s": "CASE WHEN x <> 0 AND y <> 0 THEN 1.0D ELSE 0.0D END", "p": "CASE WHEN x <> 0 OR y <> 0 THEN 1.0D ELSE 0.0D END"}, "CASE WHEN p = 0 THEN 0.0D ELSE 1 - s / p END"),
    "weighted_jaccard": ({"s": "least(x, y)", "p": "greatest(x, y)"}, "CASE WHEN p = 0 THEN 0.0D ELSE 1 - s / p END"),
}
SIMILARITIES = {"inner_product"}


def register(name: str, terms: dict[str, str], formula: str, similarity: bool = False, block: tuple[dict[str, Callable], Callable] | None = None) -> None:
    """Adds a measure under a name: sums of coordinate terms in x and y, by letter, and a formula over the letters. `block`
    says the same with numpy functions; without it pairs take the column path."""
    if MEASURES.get(name, (terms, formula)) != (terms, formula):
        raise ValueError(f"the measure {name!r} is known already")
    MEASURES[name] = (terms, formula)
    if block:
        BLOCKS[name] = block
    if similarity:
        SIMILARITIES.add(name)


def coordinate_sum(term: str, a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> CAST({term} AS DOUBLE)), 0D, (acc, z) -> acc + z)"


def measure_sql(name: str, a: str = "q", b: str = "v") -> str:
    """The measure as Spark SQL over two array columns."""
    if name == "linf":
        return f"array_max(zip_with({a}, {b}, (x, y) -> abs(x - y)))"
    if name not in MEASURES:
        raise ValueError(f"unknown distance {name!r}; known: {', '.join(sorted([*MEASURES, 'linf']))}")
    terms, formula = MEASURES[name]
    return spell_out(formula, {letter: coordinate_sum(term, a, b) for letter, term in terms.items()})


def spell_out(formula: str, values: dict[str, str]) -> str:
    """The formula with its letters replaced, all at once."""
    return re.sub(rf"(?<![A-Za-z_.])([{''.join(values)}])(?![A-Za-z_(])", lambda m: f"({values[m[1]]})", formula)


def distance(name: str, a: str = "q", b: str = "v") -> Column:
    return F.expr(measure_sql(name, a, b))


def lp(p: float, root: bool = False, a: str = "q", b: str = "v") -> Column:
    """Sum of |x - y|**p, with its root on request."""
    s = F.expr(coordinate_sum(f"power(abs(x - y), {float(p)}D)", a, b))
    return F.pow(s, F.lit(1.0 / p)) if root else s


def bit_hamming(a: str = "q", b: str = "v") -> Column:
    """Differing bits of arrays of 64-bit words."""
    return F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (acc, z) -> acc + z)")


def is_similarity(name: str) -> bool:
    return name in SIMILARITIES


def _share(s, p, one_less: bool = True):
    ratio = s / np.where(p == 0, 1.0, p)
    return np.where(p == 0, 0.0, 1 - ratio if one_less else ratio)


def _cosine(s, p, r):
    """Cosine similarity, and where it is not defined."""
    return s / np.where((p == 0) | (r == 0), 1.0, np.sqrt(p) * np.sqrt(r)), (p == 0) | (r == 0)


def _limited(s, p, r):
    scale = p * np.maximum(p, r)
    return np.where(scale == 0, 0.0, -s / np.sqrt(np.where(scale == 0, 1.0, scale)))


def _weighed_log(x):
    return x * np.log(np.maximum(x, np.finfo(np.float64).tiny))


def _divergence(x, y):
    """x ln(2x / (x + y)) + y ln(2y / (x + y)), with one logarithm for each pair."""
    t = x + y
    t *= np.log(np.maximum(t, np.finfo(np.float64).tiny))
    t -= _weighed_log(x) + np.log(2.0) * x
    return np.subtract(_weighed_log(y) + np.log(2.0) * y, t, out=t)


def _apart(x, y):
    d = x - y
    return np.abs(d, out=d)


def _together(x, y):
    d = x + y
    return np.abs(d, out=d)


def _cube(x, y):
    d = _apart(x, y)
    return np.multiply(d * d, d, out=d)


def _squared(x, y):
    d = x - y
    return np.multiply(d, d, out=d)


def fourth_power(x, y):
    d = x - y
    z = d * d
    z *= d
    return np.multiply(z, d, out=z)


def _nonzero(x, y, paired: bool):
    """Coordinates that are not zero in both, and in either: whole numbers, so matrix products give them exactly."""
    x, y = (x != 0).astype(np.float64), (y != 0).astype(np.float64)
    both = (x * y).sum(1) if paired else x @ y.T
    p, r = x.sum(1), y.sum(1)
    return both, (p if paired else p[:, None]) + r - both


_PRODUCTS: dict[str, Callable] = {"s": lambda x, y: x * y, "p": lambda x, y: x * x, "r": lambda x, y: y * y}
#: The measures with numpy functions for the coordinate terms and the formula: the same operations in the same order, or one
#: function for the sums of whole blocks where these are exact in any order.
BLOCKS: dict[str, tuple[dict[str, Callable] | Callable, Callable]] = {
    "l2_sq": ({"s": _squared}, lambda s: s),
    "l2": ({"s": _squared}, lambda s: np.sqrt(s)),
    "inner_product": ({"s": _PRODUCTS["s"]}, lambda s: s),
    "neg_dot": ({"s": _PRODUCTS["s"]}, lambda s: 0.0 - s),
    "ip_distance": ({"s": _PRODUCTS["s"]}, lambda s: 1 - s),
    "abs_dot": ({"s": _PRODUCTS["s"]}, lambda s: 0.0 - np.abs(s)),
    "cosine": (_PRODUCTS, lambda s, p, r: np.where(_cosine(s, p, r)[1], 1.0, 1 - _cosine(s, p, r)[0])),
    "angular": (_PRODUCTS, lambda s, p, r: np.where(_cosine(s, p, r)[1], np.sqrt(2.0), np.sqrt(np.maximum(0.0, 2 - 2 * _cosine(s, p, r)[0])))),
    "limited_inner_product": (_PRODUCTS, _limited),
    "l1": ({"s": _apart}, lambda s: s),
    "lp3": ({"s": _cube}, lambda s: s),
    "lp_half": ({"s": lambda x, y: np.sqrt(np.abs(x - y))}, lambda s: s * s),
    "canberra": ({"s": lambda x, y: np.where((x == 0) & (y == 0), 0.0, np.abs(x - y) / np.where((x == 0) & (y == 0), 1.0, np.abs(x) + np.abs(y)))}, lambda s: s),
    "bray_curtis": ({"s": _apart, "p": _together}, lambda s, p: _share(s, p, False)),
    "jensen_shannon": ({"s": _divergence}, lambda s: 0.5 * s),
    "neg_l2_sq": ({"s": _squared}, lambda s: 0.0 - s),
    "nonzero_intersect": (_nonzero, lambda s, p: 0.0 - s),
    "hamming": ({"s": lambda x, y: (x != y).astype(np.float64)}, lambda s: s),
    "jaccard": (_nonzero, _share),
    "weighted_jaccard": ({"s": np.minimum, "p": np.maximum}, _share),
    "linf": ({}, lambda: None),
}
#: Measures whose terms need coordinates that are not negative, as blocks.
NOT_NEGATIVE = {"jensen_shannon"}
#: Fewer pairs than this are summed in one step.
FEW = 512
#: Measures that a matrix product gives.
PRODUCTS = {"l2", "l2_sq", "neg_l2_sq", "cosine", "angular", "limited_inner_product", "inner_product", "neg_dot", "ip_distance", "abs_dot"}


def exact_block(block: tuple[dict[str, Callable] | Callable, Callable], q: np.ndarray, v: np.ndarray, paired: bool = False) -> np.ndarray:
    """The measure of each row of q with each of v (or row by row), for a value of BLOCKS: sums from left to right in
    double, as `distance` takes them, so both give the same doubles."""
    terms, formula = block
    if callable(terms):
        return formula(*terms(q, v, paired))
    if paired and terms and len(q) < FEW:
        return formula(**{letter: np.add.accumulate(term(q, v), axis=1)[:, -1] + 0.0 for letter, term in terms.items()}) + 0.0
    xs, ys = np.ascontiguousarray(q.T), np.ascontiguousarray(v.T)
    xs = xs if paired else xs[:, :, None]
    if not terms:  # the largest difference
        out = np.abs(xs[0] - ys[0])
        apart = np.empty_like(out)
        for x, y in zip(xs[1:], ys[1:]):
            np.abs(np.subtract(x, y, out=apart), out=apart)
            np.maximum(out, apart, out=out)
        return out
    sums: dict = dict.fromkeys(terms, 0.0)
    for x, y in zip(xs, ys):
        for letter, term in terms.items():
            z = term(x, y)
            sums[letter] = np.add(sums[letter], z, out=sums[letter]) if isinstance(sums[letter], np.ndarray) else 0.0 + z
    return formula(**sums) + np.zeros((len(q),) if paired else (len(q), len(v)))


def _least(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Sums of the smaller coordinates of each row of q with each of v."""
    sums, z = np.zeros((len(q), len(v))), np.empty((len(q), len(v)))
    for x, y in zip(np.ascontiguousarray(q.T)[:, :, None], np.ascontiguousarray(v.T)):
        sums += np.minimum(x, y, out=z)
    return sums


def near_block(name: str, q: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, float | np.ndarray] | None:
    """The measure of each row of q with each of v by a matrix product or sums of minima, and how far that may be from
    `exact_block` (not finite: any distance), apart from some last places of the formula's own operations; None where there is no such way."""
    slip, tiny = 8 * (q.shape[1] + 4) * np.finfo(np.float64).eps, 1e-300
    with np.errstate(all="ignore"):
        if name in ("l1", "bray_curtis"):
            own, other = q.sum(1)[:, None], v.sum(1)
            most = slip * (np.abs(q).sum(1).max() + np.abs(v).sum(1).max()) + tiny
            s = own + other - 2 * _least(q, v)
            if name == "l1":
                return s, most
            p = own - other - 2 * _least(q, -v)
            s /= p
            return s, np.where(p > 4 * most, 2 * most * (1 + np.abs(s)) / p, np.inf)
        if name not in PRODUCTS:
            return None
        own, other = (q * q).sum(1), (v * v).sum(1)
        s = q @ v.T
        if name in ("l2", "l2_sq", "neg_l2_sq"):
            s *= -2.0
            s += own[:, None]
            s += other
            most = slip * (own.max() + other.max()) + tiny
            if name == "l2":
                np.sqrt(np.maximum(s, 0.0, out=s), out=s)
                return s, most / s
            return (s if name == "l2_sq" else 0.0 - s), most
        if name in ("cosine", "angular", "limited_inner_product"):
            sizes = np.concatenate([own, other])
            if not ((sizes == 0) | ((sizes > 1e-140) & (sizes < 1e140))).all():
                return None
            s = BLOCKS[name][1](s, own[:, None], other)
            return s, slip + 1e-20 if name != "angular" else 2 * (slip + 1e-20) / s
        return BLOCKS[name][1](s), slip * np.sqrt(own.max()) * np.sqrt(other.max()) + tiny


#: Distances on blocks of numpy rows, for the Arrow path: (queries, rows) -> matrix, smaller is nearer.
def block_distance(name: str) -> Callable | None:
    def norms(m):
        n = np.sqrt((m * m).sum(axis=1))
        return np.where(n == 0, 1, n)

    table = {
        "l2_sq": lambda q, v: (q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * (q @ v.T),
        "l2": lambda q, v: (q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * (q @ v.T),
        "inner_product": lambda q, v: -(q @ v.T),
        "neg_dot": lambda q, v: -(q @ v.T),
        "ip_distance": lambda q, v: -(q @ v.T),
        "cosine": lambda q, v: -((q / norms(q)[:, None]) @ (v / norms(v)[:, None]).T),
        "angular": lambda q, v: -((q / norms(q)[:, None]) @ (v / norms(v)[:, None]).T),
        "l1": lambda q, v: np.stack([np.abs(v - x).sum(1) for x in q]),
        "linf": lambda q, v: np.stack([np.abs(v - x).max(1) for x in q]),
    }
    return table.get(name)
