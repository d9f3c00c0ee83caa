"""Additive codes: a vector is the sum of one entry of each of several books of whole vectors.

Books begin as residual ones (k-means of what the books before leave) and are then fitted together by local search: codes by
iterated conditional modes, each position in turn set to its best entry given all others, from codes of which some positions
were drawn anew (kept only where the error falls); books by least squares for the codes, with noise that cools down. Residual
coding keeps the best `beam` partial codes in place of one.

Distances need the norm of what a code stands for: stored in full (`float`), in 8 or 4 bits between the least and the largest
norm (`int8`, `int4`), or not at all (`none`: it is computed from the books' products). Models are trained on a bounded
sample; every row is coded, by matrix products on Arrow batches. Null vectors are left out; an empty table has no codes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.operators import search as S
from lodestar.operators.indexes import lloyd
from lodestar.operators.search import top_k

NORMS = {"float": 0, "int8": 8, "int4": 4, "none": 0}
BLOCK, BEAM = 2048, 8


def residual_books(x: np.ndarray, books: int, size: int, steps: int = 10) -> np.ndarray:
    """(books, size, d) by k-means of the residuals, book by book."""
    rest, out = x.copy(), []
    for _ in range(books):
        c = lloyd(rest, min(size, len(rest)), steps)
        c = np.concatenate([c, np.zeros((size - len(c), x.shape[1]))])
        rest = rest - c[((c * c).sum(1)[None] - 2 * rest @ c.T).argmin(1)]
        out.append(c)
    return np.stack(out)


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(b[codes[:, j]] for j, b in enumerate(books))


def errors(x: np.ndarray, codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    gap = x - decoded(codes, books)
    return np.einsum("nd,nd->n", gap, gap)


def beam_codes(x: np.ndarray, books: np.ndarray, beam: int = 1) -> np.ndarray:
    """Residual codes; of each row the `beam` partial codes with the least error go on. A beam of one is greedy."""
    n, size = len(x), books.shape[1]
    codes, rest = np.zeros((n, 1, 0), np.int64), x[:, None, :]
    for c in books:
        width = codes.shape[1]
        cost = np.einsum("nbd,nbd->nb", rest, rest)[:, :, None] + (c * c).sum(1)[None, None] - 2 * rest @ c.T
        flat = cost.reshape(n, width * size)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        from_, entry = best // size, best % size
        codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], 1), entry[:, :, None]], 2)
        rest = np.take_along_axis(rest, from_[:, :, None], 1) - c[entry]
    return codes[:, 0]


def products(books: np.ndarray) -> np.ndarray:
    """Inner products of all entries of all books: (books, books, size, size)."""
    return np.einsum("asd,btd->abst", books, books)


def conditional_modes(x: np.ndarray, codes: np.ndarray, books: np.ndarray, cross: np.ndarray, rounds: int) -> np.ndarray:
    """Each position in turn takes its best entry, given all other positions; `rounds` times over."""
    codes, m = codes.copy(), len(books)
    unary = [np.diagonal(cross[j, j])[None] - 2 * x @ books[j].T for j in range(m)]
    for _ in range(rounds):
        for j in range(m):
            cost = unary[j].copy()
            for i in range(m):
                if i != j:
                    cost += 2 * cross[i, j][codes[:, i]]
            codes[:, j] = cost.argmin(1)
    return codes


def local_search(x: np.ndarray, codes: np.ndarray, books: np.ndarray, rng: np.random.Generator, tries: int = 8, redrawn: int = 2, rounds: int = 3) -> np.ndarray:
    """Codes by local search from perturbed codes; a row keeps a new code only if its error falls."""
    cross = products(books)
    best = conditional_modes(x, codes, books, cross, rounds)
    least = errors(x, best, books)
    for _ in range(tries):
        moved = best.copy()
        for _ in range(redrawn):
            moved[np.arange(len(x)), rng.integers(0, len(books), len(x))] = rng.integers(0, books.shape[1], len(x))
        moved = conditional_modes(x, moved, books, cross, rounds)
        now = errors(x, moved, books)
        best = np.where((now < least)[:, None], moved, best)
        least = np.minimum(now, least)
    return best


def fitted_books(x: np.ndarray, codes: np.ndarray, books: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Books of least squared error for the codes, pulled towards the books before: entries of few rows move little."""
    n, (m, size, d) = len(x), books.shape
    ones = np.zeros((n, m * size))
    ones[np.arange(n)[:, None], codes + np.arange(m)[None] * size] = 1
    return np.linalg.solve(ones.T @ ones + pull * np.eye(m * size), ones.T @ x + pull * books.reshape(m * size, d)).reshape(books.shape)


def local_search_books(x: np.ndarray, books: int, size: int, rounds: int = 10, tries: int = 4, seed: int = 3) -> np.ndarray:
    """Books fitted together: codes, books, codes, ... with noise on the vectors that falls to none in the last round. The
    books that are kept are those whose codes, found anew as `encode` finds them, have the least error."""
    rng, c = np.random.default_rng(seed), residual_books(x, books, size)
    codes, spread = beam_codes(x, c, BEAM), x.std(0)
    best, least = c, errors(x, codes, c).mean()
    for r in range(rounds):
        heat = (1 - (r + 1) / rounds) ** 0.5
        noisy = x + rng.standard_normal(x.shape) * spread * heat * 0.1
        c = fitted_books(noisy, codes, c)
        codes = local_search(x, beam_codes(x, c, BEAM), c, rng, tries)
        now = errors(x, codes, c).mean()
        if now < least:
            best, least = c, now
    return best


# -- tables of codes


def norm_range(x: np.ndarray, books: np.ndarray) -> tuple[float, float]:
    """Least and largest squared norm of what a sample's codes stand for."""
    y = decoded(beam_codes(x, books), books) if len(x) else np.zeros((1, 1))
    norms = np.einsum("nd,nd->n", y, y)
    return float(norms.min()), float(norms.max())


def encode(base: DataFrame, books: np.ndarray, how: str = "local", beam: int = BEAM, seed: int = 3) -> DataFrame:
    """(id, code, norm, error) of every row, with the squared norm and error of what its code stands for; how: `greedy`, `beam` or `local`. A row's code depends on the row alone but for the draws
    of local search, which follow from the place in its batch."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                codes = beam_codes(x, books, beam if how != "greedy" else 1)
                if how == "local":
                    codes = local_search(x, codes, books, np.random.default_rng(seed))
                y = decoded(codes, books)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bytes(c) for c in codes.astype(np.uint8)], pa.binary()), pa.array(np.einsum("nd,nd->n", y, y)), pa.array(errors(x, codes, books))], ["id", "code", "norm", "error"])

    return base.where("v IS NOT NULL").select("id", "v").mapInArrow(run, "id long, code binary, norm double, error double")


def stored_norm(norm: np.ndarray, bits: int, low: float, high: float) -> np.ndarray:
    """Norms as they come back from so many bits between two bounds."""
    steps = (1 << bits) - 1
    scale = (high - low) / steps or 1.0
    return low + np.clip(np.round((norm - low) / scale), 0, steps) * scale


def search(codes: DataFrame, queries: DataFrame, books: np.ndarray, k: int, norms: str = "float", bounds: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """The k nearest codes of each query by tables of inner products and norms; each task keeps its k first of each query. Up
    to QUERY_BLOCK queries are shipped to every task; more are dealt out in blocks that meet chunks of codes."""
    if norms not in NORMS:
        raise ValueError(f"norms are kept as {', '.join(NORMS)}")
    m, cross = len(books), products(books) if norms == "none" else None
    names, kinds = ["qid", "id", "dist"], "qid long, id long, dist double"

    def nearest(ids: np.ndarray, q: np.ndarray, batches) -> list:
        tables, own = np.einsum("nd,msd->mns", q, books), np.einsum("nd,nd->n", q, q)
        best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                code = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(-1, m)
                norm = part.column(2).to_numpy()
                if NORMS[norms]:
                    norm = stored_norm(norm, NORMS[norms], *bounds)
                elif cross is not None:
                    norm = sum(cross[i, j][code[:, i], code[:, j]] for i in range(m) for j in range(m))
                d = own[:, None] + norm[None] - 2 * sum(tables[j][:, code[:, j]] for j in range(m))
                d = np.concatenate([best_d, d], 1)
                i = np.concatenate([best_i, np.broadcast_to(part.column(0).to_numpy(), (len(ids), part.num_rows))], 1)
                first = np.lexsort((i, d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(d, first, 1), np.take_along_axis(i, first, 1)
        row, at = np.nonzero(np.isfinite(best_d))
        return [pa.array(ids[row]), pa.array(best_i[row, at]), pa.array(best_d[row, at])]

    codes = codes.select("id", "code", "norm")
    known = queries.select("qid", "q").limit(S.QUERY_BLOCK + 1).collect()
    if len(known) <= S.QUERY_BLOCK:
        ids, q = np.array([r.qid for r in known], np.int64), np.array([r.q for r in known], np.float64).reshape(len(known), -1 if known else 0)

        def run(batches):
            if len(ids):
                yield pa.RecordBatch.from_arrays(nearest(ids, q, batches), names)

        return top_k(codes.mapInArrow(run, kinds), k)
    rows, asked = S.dealt(codes, queries.select("qid", "q"))

    def meet(_, own: pa.Table, asking: pa.Table) -> pa.Table:
        if not own.num_rows or not asking.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        q = asking.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(asking.num_rows, -1)
        return pa.table(nearest(asking.column("qid").to_numpy(), q, own.select(["id", "code", "norm"]).to_batches()), names)

    return top_k(rows.groupBy("_chunk", "_block").cogroup(asked.groupBy("_chunk", "_block")).applyInArrow(meet, kinds), k)
