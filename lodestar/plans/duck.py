"""DuckDB texts of the measures, for the oracle queries."""

from __future__ import annotations

import re

from lodestar.functions.distances import MEASURES, spell_out


def plain(sql: str) -> str:
    return re.sub(r"(?<![A-Za-z_])(\d+(?:\.\d+)?(?:e[-+]?\d+)?)D\b", r"\1::DOUBLE", sql)


def total(term: str, a: str, b: str, var: str = "p") -> str:
    t = re.sub(r"\bx\b", f"{var}[1]", re.sub(r"\by\b", f"{var}[2]", term))
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda {var}: CAST({plain(t)} AS DOUBLE)))"


def measure(name: str, a: str = "q", b: str = "v", var: str = "p") -> str:
    if name == "linf":
        return f"list_max(list_transform(list_zip({a}, {b}), lambda {var}: abs({var}[1] - {var}[2])))"
    terms, formula = MEASURES[name]
    return plain(spell_out(formula, {letter: total(term, a, b, var) for letter, term in terms.items()}))


def matrix(m) -> str:
    return "[" + ", ".join(matrix(x) if hasattr(x, "__len__") else f"{float(x)!r}::DOUBLE" for x in m) + "]"


BASE = "b AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), q AS (SELECT id AS qid, v AS q FROM b WHERE id % 100 = 0)"


def pairs(name: str = "l2", base: str = "b", where: str = "TRUE") -> str:
    return f"SELECT qid, id, {measure(name)} AS dist, label FROM q, {base} WHERE {where}"


def knn(name: str = "l2", k: int = 10, base: str = "b", where: str = "TRUE", desc: bool = False) -> str:
    return f"SELECT qid, rank, id, dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist {'DESC' if desc else ''}, id) AS rank FROM ({pairs(name, base, where)})) WHERE rank <= {k}"
