"""Queries of problem 7: notebooks put together into contexts of a fixed number of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .packing import CONTEXT, LINEAR, QUADRATIC, contexts


def p7_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notebook with its context; of one larger than a context, every part."""
    return contexts(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p7_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: how many contexts there are and the ``least`` number that could hold the tokens, the share of room filled, and the mean and greatest cost of a context."""
    t = F.col("tokens").cast("double")
    each = p7_contexts(spark, sf_dir).groupBy("context_id").agg(F.sum("tokens").alias("tokens"), F.sum(LINEAR * t + QUADRATIC * t * t).alias("cost"))
    out = each.agg(F.count("*").alias("contexts"), F.ceil(F.sum("tokens") / CONTEXT).alias("least"), (F.sum("tokens") / (F.count("*") * CONTEXT)).alias("fill"), F.avg("cost").alias("mean_cost"), F.max("cost").alias("top_cost"))
    return out.select("contexts", "least", F.round("fill", 6).alias("fill"), F.round("mean_cost", 3).alias("mean_cost"), F.round("top_cost", 3).alias("top_cost"))


QUERIES = {"p7_contexts": p7_contexts, "p7_balance": p7_balance}
