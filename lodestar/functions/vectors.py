"""Vector-valued column functions: norms, maps, chunks, binary codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def norm(v: str = "v") -> Column:
    return F.expr(f"sqrt(aggregate({v}, 0D, (a, x) -> a + x * x))")


def normalize(v: str = "v") -> Column:
    """Unit length; a zero vector stays."""
    return F.expr(f"transform(array(sqrt(aggregate({v}, 0D, (a, x) -> a + x * x))), n -> transform({v}, x -> CASE WHEN n = 0 THEN x ELSE x / n END))[0]")


def truncate(r: int, v: str = "v") -> Column:
    return F.slice(v, 1, r)


def pad(to_multiple: int, v: str = "v") -> Column:
    return F.expr(f"concat({v}, array_repeat(0D, CAST(pmod(-size({v}), {to_multiple}) AS INT)))")


def chunks(n: int, v: str = "v") -> Column:
    """n equal pieces; the length must be a multiple of n."""
    return F.expr(f"transform(sequence(0, {n - 1}), m -> slice({v}, m * CAST(size({v}) / {n} AS INT) + 1, CAST(size({v}) / {n} AS INT)))")


def sign_bits(v: str = "v") -> Column:
    """1 where a coordinate is not negative."""
    return F.expr(f"transform({v}, x -> CASE WHEN x >= 0 THEN 1 ELSE 0 END)")


def pack_bits(bits: str) -> Column:
    """A word of up to 63 bits, the first one lowest."""
    return F.expr(f"aggregate(transform({bits}, (x, i) -> shiftleft(CAST(x AS BIGINT), i)), CAST(0 AS BIGINT), (a, x) -> a | x)")


def linear(matrix, v: str = "v", bias=None) -> Column:
    """matrix @ v (+ bias) with the matrix as a literal: for small, fixed maps."""
    rows = "array(" + ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in row) + ")" for row in matrix) + ")"
    dot = f"transform({rows}, r -> aggregate(zip_with(r, {v}, (x, y) -> x * y), 0D, (a, z) -> a + z))"
    return F.expr(dot if bias is None else f"zip_with({dot}, array({', '.join(f'{float(x)!r}D' for x in bias)}), (x, y) -> x + y)")


def column_means(df: DataFrame, v: str = "v") -> DataFrame:
    """(pos, mean) of each coordinate: partial aggregates over exploded coordinates."""
    return df.select(F.posexplode(v).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def matrix_stats(df: DataFrame, v: str = "v") -> DataFrame:
    """Counts, extremes and moments of each coordinate."""
    x = F.col("x")
    return df.select(F.posexplode(v).alias("pos", "x")).groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.isnan("x").cast("int")).cast("long").alias("n_nan"),
        F.sum((F.abs(x) == float("inf")).cast("int")).cast("long").alias("n_inf"),
        F.sum((x == 0).cast("int")).cast("long").alias("n_zero"),
        F.min("x").alias("least"),
        F.max("x").alias("most"),
        F.round(F.avg("x"), 6).alias("mean"),
        F.round(F.stddev_pop("x"), 6).alias("deviation"),
    )
