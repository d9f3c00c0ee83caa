"""Merging candidate lists of several indexes, and re-ranking.

A list is (qid, rank, id[, dist]) with ranks from 1. Lists are tagged by the index they come from; ties end at the id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.search import refine


def tagged(*lists: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.select("qid", F.col("rank").cast("long"), "id", (F.col("dist") if "dist" in x.columns else F.lit(None).cast("double")).alias("dist"), F.lit(k).alias("source")) for k, x in enumerate(lists)])


def votes(*lists: DataFrame) -> DataFrame:
    """One row for each qid and id: lists that hold it, its best rank, the sum of its ranks, its least distance."""
    return tagged(*lists).groupBy("qid", "id").agg(F.countDistinct("source").alias("votes"), F.min("rank").alias("best"), F.sum("rank").alias("ranks"), F.min("dist").alias("dist"))


def pair_union(*lists: DataFrame) -> DataFrame:
    return tagged(*lists).select("qid", "id").distinct()


def pair_rerank(base: DataFrame, queries: DataFrame, k: int, *lists: DataFrame, measure: str = "l2") -> DataFrame:
    """Union, exact distances, the k best."""
    return refine(pair_union(*lists), base, queries, k, measure)


def _first(voted: DataFrame, k: int, *order: Column) -> DataFrame:
    ranked = voted.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order, F.col("id"))).cast("long"))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "id")


def pair_vote(k: int, *lists: DataFrame) -> DataFrame:
    """What all lists hold first, then by votes, then by best rank."""
    everywhere = (F.col("votes") == len(lists)).cast("int")
    return _first(votes(*lists), k, everywhere.desc(), F.col("votes").desc(), F.col("best"))


def pair_ranksum(k: int, *lists: DataFrame) -> DataFrame:
    """What all lists hold first, then by the sum of ranks over the lists that hold it."""
    everywhere = (F.col("votes") == len(lists)).cast("int")
    return _first(votes(*lists), k, everywhere.desc(), F.col("ranks"))


def pair_common_then_dist(k: int, *lists: DataFrame) -> DataFrame:
    """What all lists hold first, then by the lists' own distances."""
    everywhere = (F.col("votes") == len(lists)).cast("int")
    return _first(votes(*lists), k, everywhere.desc(), F.col("dist"))


def shard_merge(k: int, *shards: tuple[DataFrame, int]) -> DataFrame:
    """Global top k of results of shards whose ids start at an offset."""
    moved = reduce(DataFrame.unionByName, [x.select("qid", (F.col("id") + offset).alias("id"), "dist") for x, offset in shards])
    ranked = moved.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("dist", "id")).cast("long"))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def map_ids(result: DataFrame, mapping: DataFrame) -> DataFrame:
    """Internal ids replaced by external ones; mapping: id, external."""
    return result.join(mapping, "id").drop("id").withColumnRenamed("external", "id")
