"""Index descriptions as text, and indexes built from them.

    "Flat"  "IVF16,Flat"  "PQ8x4"  "IVF16,SQ8"  "LSH64"  "Forest8"  "PCA32,IVF16,PQ8x4,RFlat"  "L2norm,Flat"

Stages are separated by commas: transforms (PCAd, Truncd, L2norm, Padd), a coarse part (IVFn), a code (Flat, PQmxb, SQb,
LSHn, Forestt) and RFlat for exact re-ranking of k times `k_factor` candidates.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import vectors as V
from lodestar.functions.distances import distance
from lodestar.operators import indexes as X
from lodestar.operators import search as S


@dataclass(frozen=True)
class Spec:
    transforms: tuple[tuple[str, int], ...] = ()
    lists: int = 0
    code: str = "Flat"
    sizes: tuple[int, ...] = ()
    refine: bool = False


def parse(text: str) -> Spec:
    transforms, lists, code, sizes, refine = [], 0, None, (), False
    for part in (x.strip() for x in text.split(",")):
        if m := re.fullmatch(r"(PCA|Trunc|Pad)(\d+)", part):
            transforms.append((m[1], int(m[2])))
        elif part == "L2norm":
            transforms.append((part, 0))
        elif m := re.fullmatch(r"IVF(\d+)", part):
            lists = int(m[1])
        elif part == "Flat":
            code = part
        elif m := re.fullmatch(r"PQ(\d+)(?:x(\d+))?", part):
            code, sizes = "PQ", (int(m[1]), int(m[2] or 8))
        elif m := re.fullmatch(r"(SQ|LSH|Forest)(\d+)", part):
            code, sizes = m[1], (int(m[2]),)
        elif part == "RFlat":
            refine = True
        else:
            raise ValueError(f"unknown part {part!r} in index description {text!r}")
    if code is None:
        raise ValueError(f"index description {text!r} has no code such as Flat, PQ8 or SQ8")
    return Spec(tuple(transforms), lists, code, sizes, refine)


@dataclass
class Index:
    """train on a bounded sample, add tables, search; the tables stay DataFrames."""

    spec: Spec
    model: dict = field(default_factory=dict)
    table: DataFrame | None = None
    raw: DataFrame | None = None

    def _apply(self, df: DataFrame, vec: str) -> DataFrame:
        for k, (name, n) in enumerate(self.spec.transforms):
            if name == "L2norm":
                df = df.withColumn(vec, V.normalize(vec))
            elif name == "Trunc":
                df = df.withColumn(vec, V.truncate(n, vec))
            elif name == "Pad":
                df = df.withColumn(vec, V.pad(n, vec))
            else:
                mean, axes = self.model[f"pca{k}"]
                df = df.withColumn(vec, V.linear(axes.T, vec, -(mean @ axes)))
        return df

    def train(self, base: DataFrame, rows: int = 4096, seed: int = 7) -> Index:
        for k, (name, n) in enumerate(self.spec.transforms):
            if name == "PCA":
                done = Index(Spec(self.spec.transforms[:k]), self.model)
                x = X.training_rows(done._apply(base, "v"), rows)
                values, axes = np.linalg.eigh(np.cov((x - x.mean(0)).T))
                self.model[f"pca{k}"] = (x.mean(0), axes[:, np.argsort(-values)[:n]])
        x = X.training_rows(self._apply(base, "v"), rows)
        if self.spec.lists:
            self.model["centroids"] = X.lloyd(x, min(self.spec.lists, len(x)))
        if self.spec.code == "PQ":
            m, bits = self.spec.sizes
            self.model["books"] = X.codebook(x, m, min(1 << bits, len(x)))
        elif self.spec.code == "SQ":
            self.model["bounds"] = (x.min(0), x.max(0))
        elif self.spec.code == "LSH":
            self.model["planes"] = X.hyperplanes(self.spec.sizes[0], x.shape[1], seed)
        elif self.spec.code == "Forest":
            self.model["trees"] = X.forest(x, self.spec.sizes[0], 32, seed)
        return self

    def add(self, base: DataFrame) -> Index:
        df = self._apply(base.select("id", "v"), "v")
        if self.spec.lists:
            df = X.assign(df, self.model["centroids"]).drop("list_dist")
        if self.spec.code == "PQ":
            df = X.pq_encode(df, self.model["books"])
        elif self.spec.code == "SQ":
            df = X.scalar_quantize(df, *self.model["bounds"], self.spec.sizes[0])
        elif self.spec.code == "LSH":
            df = X.sign_codes(df, self.model["planes"])
        self.table = df if self.table is None else self.table.unionByName(df)
        self.raw = base.select("id", "v") if self.raw is None else self.raw.unionByName(base.select("id", "v"))
        return self

    def search(self, queries: DataFrame, k: int, nprobe: int = 4, k_factor: int = 4) -> DataFrame:
        q, n = self._apply(queries, "q"), k * k_factor if self.spec.refine else k
        if self.spec.code == "Forest":
            out = X.forest_search(self.table, q, self.model["trees"], n)
        elif self.spec.code == "Flat" and not self.spec.lists:
            out = S.knn(self.table, q, n)
        else:
            if self.spec.code == "PQ":
                q, dist = X.pq_tables(q, self.model["books"]), X.adc()
            elif self.spec.code == "SQ":
                dist = distance("l2", "q", "_v")
            elif self.spec.code == "LSH":
                q, dist = X.sign_codes(q, self.model["planes"], "q", "qbits"), F.expr(X.coordinate_sum("CASE WHEN x <> y THEN 1 ELSE 0 END", "qbits", "bits"))
            else:
                dist = distance("l2")
            if self.spec.lists:
                pairs = self.table.join(F.broadcast(X.assign(q, self.model["centroids"], nprobe, "q").drop("list_dist")), "list_no")
            else:
                pairs = self.table.join(F.broadcast(q))
            if self.spec.code == "SQ":
                pairs = pairs.withColumn("_v", X.scalar_decode(*self.model["bounds"], self.spec.sizes[0]))
            out = S.top_k(pairs.select("qid", "id", dist.alias("dist")), n)
        return S.refine(out, self.raw, queries, k) if self.spec.refine else out

    def remove(self, ids: DataFrame) -> Index:
        from lodestar.streaming.maintenance import remove

        self.table, self.raw = remove(self.table, ids), remove(self.raw, ids)
        return self

    def save(self, path: str) -> None:
        """Tables as Parquet (by list where there are lists), the description and model beside them as one row."""
        import pickle

        writer = self.table.write.mode("overwrite")
        (writer.partitionBy("list_no") if self.spec.lists else writer).parquet(f"{path}/table")
        self.raw.write.mode("overwrite").parquet(f"{path}/raw")
        spark = self.table.sparkSession
        spark.createDataFrame([(bytearray(pickle.dumps((self.spec, self.model))),)], "model binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load(spark, path: str) -> Index:
    """An index that this library saved; do not load files of others, models are pickled."""
    import pickle

    spec, model = pickle.loads(bytes(spark.read.parquet(f"{path}/model").first().model))
    return Index(spec, model, spark.read.parquet(f"{path}/table"), spark.read.parquet(f"{path}/raw"))


def build(text: str, base: DataFrame, **how) -> Index:
    return Index(parse(text)).train(base, **how).add(base)


def param_grid(**values) -> list[dict]:
    """All settings of a grid, in order."""
    return [dict(zip(values, x)) for x in itertools.product(*values.values())]


def autopilot(n: int, dimension: int) -> str:
    """A description by size: exact for small tables, then lists of about the square root, then codes with re-ranking."""
    if n < 20_000:
        return "Flat"
    lists = 1 << max(4, int(np.log2(n) / 2))
    return f"IVF{lists},Flat" if n < 1_000_000 else f"IVF{lists},PQ{max(1, dimension // 4)}x4,RFlat"
