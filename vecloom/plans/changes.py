"""Queries on the change feed of table manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import by_arrival, current_state
from ..runtime import table


BATCHES = 3


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as it arrives, in batches that overlap in what they change; late and repeated changes are in all of them."""
    feed = table(spark, sf_dir, "manifest_change")
    return current_state(feed, batches=by_arrival(feed, "received_at", BATCHES))


def p6_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_state(table(spark, sf_dir, "manifest_change"))


def p6_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables per store and level at the end."""
    return p6_found(spark, sf_dir).groupBy("store_id", "level_no").agg(F.count("*").alias("tables"))


QUERIES = {"p6_found": p6_found, "p6_at_once": p6_at_once, "p6_by_level": p6_by_level}

_STATE = """
WITH c AS (
  SELECT DISTINCT store_id, epoch, set_no, pos_no, id, COALESCE(op, 0) AS op, COALESCE(level_no, 0) AS level_no
  FROM manifest_change WHERE store_id IS NOT NULL AND id IS NOT NULL AND epoch IS NOT NULL AND set_no IS NOT NULL AND pos_no IS NOT NULL),
l AS (SELECT c.* FROM c JOIN (SELECT store_id, MAX(epoch) AS epoch FROM c GROUP BY store_id) e USING (store_id, epoch)),
n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY set_no, pos_no) AS ord FROM l),
g AS (SELECT *, COALESCE(MAX(CASE WHEN op = 1 THEN ord END) OVER (PARTITION BY store_id, id), 0) AS gone FROM n),
m AS (SELECT *, MIN(CASE WHEN op = 0 AND ord > gone THEN ord END) OVER (PARTITION BY store_id, id) AS made FROM g),
s AS (SELECT store_id, id, ARG_MAX(level_no, ord) AS level_no FROM m WHERE made IS NOT NULL AND (ord = made OR (op = 2 AND ord > made)) GROUP BY store_id, id)
"""

ORACLES = {
    "p6_found": _STATE + "SELECT store_id, id, level_no FROM s",
    "p6_at_once": _STATE + "SELECT store_id, id, level_no FROM s",
    "p6_by_level": _STATE + "SELECT store_id, level_no, COUNT(*) AS tables FROM s GROUP BY store_id, level_no",
}
