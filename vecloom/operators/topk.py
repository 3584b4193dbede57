"""The best rows of each query: top k, merging of partial lists, rank lists.

``row_number() <= k`` over a query's rows is planned with a group limit before the shuffle, so a task sends at most k rows of a query on, however
many it holds. Equal scores go by the smaller id. Null scores and ids don't count; k < 1 gives nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: metrics of which larger scores are better
LARGER = {"ip", "cosine"}


def larger(metric: str) -> bool:
    return metric in LARGER


def top_k(df: DataFrame, k: int | str, metric: str = "ip", by: list[str] | str = "qid", id: str = "id", score: str = "score") -> DataFrame:
    """The k best rows of every query with ``rank`` from 1; k is a number or the name of a column."""
    by = [by] if isinstance(by, str) else by
    key = F.col(score).desc() if larger(metric) else F.col(score).asc()
    rows = df.filter(F.col(score).isNotNull() & F.col(id).isNotNull()).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(key, F.col(id).asc())))
    return rows.filter(F.col("rank") <= (F.lit(k) if isinstance(k, int) else F.col(k)))


def best_of_id(df: DataFrame, metric: str = "ip", by: list[str] | str = "qid", id: str = "id", score: str = "score") -> DataFrame:
    """One row for every id of a query, with its best score; aggregated before the shuffle."""
    by = [by] if isinstance(by, str) else by
    return df.filter(F.col(id) >= 0).groupBy(*by, id).agg((F.max if larger(metric) else F.min)(score).alias(score))


def merge(parts: list[DataFrame], k: int, metric: str = "ip") -> DataFrame:
    """The k best of partial lists ``qid, id, score`` of several shards or tables; an id counts once, padding (id below 0) not at all."""
    union = parts[0].select("qid", "id", "score")
    for p in parts[1:]:
        union = union.unionByName(p.select("qid", "id", "score"))
    return top_k(best_of_id(union, metric), k, metric)


def rank_lists(df: DataFrame, by: str = "qid", id: str = "id", rank: str = "rank") -> DataFrame:
    """One row a query: its ids in the order of their ranks. Lists are as long as k, so no list outgrows a task."""
    return df.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct(rank, id))), lambda s: s[id]).alias("ids"))


def intersection(a: DataFrame, b: DataFrame, by: str = "qid", id: str = "id") -> DataFrame:
    """How many ids two lists of every query have in common: ``qid, common``, 0 included for queries of ``a``."""
    shared = a.select(by, id).distinct().join(b.select(by, id).distinct(), [by, id], "left_semi").groupBy(by).agg(F.count("*").alias("common"))
    return a.select(by).distinct().join(shared, by, "left").select(by, F.coalesce("common", F.lit(0)).alias("common"))


def recall(found: DataFrame, truth: DataFrame, by: str = "qid", id: str = "id") -> DataFrame:
    """One row: ``queries, hits, wanted, recall`` of found lists against true ones."""
    hits = truth.select(by, id).distinct().join(found.select(by, id).distinct().withColumn("hit", F.lit(1)), [by, id], "left")
    out = hits.agg(F.count_distinct(by).alias("queries"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"), F.count("*").alias("wanted"))
    return out.withColumn("recall", F.when(F.col("wanted") > 0, F.col("hits") / F.col("wanted")))
