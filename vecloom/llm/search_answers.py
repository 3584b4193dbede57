"""Queries of problem 1: the best answers to every logged query over all workers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .topn import top_n


def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that count: ``request_id, qno, vec_id, score, k, up``. A request logged several times is one request."""
    asked = (
        table(spark, sf_dir, "search_request").select("request_id", F.col("k").alias("want"), (F.coalesce("metric_type", F.lit(0)) != 0).alias("up")).filter("request_id is not null")
        .groupBy("request_id").agg(F.max("want").alias("want"), F.max("up").alias("up"))
    )
    given = (
        table(spark, sf_dir, "search_response").select("request_id", "status", "n", "k", "scores", "ids")
        .filter("status and n > 0 and k > 0 and size(ids) = n * k and size(scores) = n * k")
        .join(asked, "request_id").filter("want > 0")
    )
    items = given.select("request_id", "k", "want", "up", F.posexplode(F.arrays_zip(F.col("ids").alias("id"), F.col("scores").alias("score"))).alias("pos", "item"))
    s = F.col("item.score")
    return items.filter((F.col("item.id") >= 0) & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))).select(
        "request_id", F.expr("cast(pos div k as int)").alias("qno"), F.col("item.id").alias("vec_id"), s.alias("score"), F.col("want").alias("k"), "up")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_n(answered(spark, sf_dir), ["request_id", "qno"], "score", "vec_id", "k", F.col("up")).select("request_id", "qno", "vec_id")


def p1_events_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three events of the highest value of each type and user."""
    return top_n(table(spark, sf_dir, "events"), ["event_type", "user_id"], "value", "event_id", 3)


QUERIES = {"p1_found": p1_found, "p1_events_top3": p1_events_top3}

ORACLES = {
    "p1_found": """
WITH r AS (SELECT request_id, MAX(k) AS want, MAX(COALESCE(metric_type, 0)) AS metric_type FROM search_request WHERE request_id IS NOT NULL GROUP BY request_id),
a AS (SELECT s.request_id, s.k, r.want, r.metric_type, UNNEST(s.ids) AS vec_id, UNNEST(s.scores) AS score, UNNEST(RANGE(LEN(s.ids))) AS pos
  FROM search_response s JOIN r USING (request_id) WHERE status AND s.n > 0 AND s.k > 0 AND LEN(s.ids) = s.n * s.k AND LEN(s.scores) = s.n * s.k AND r.want > 0),
v AS (SELECT request_id, CAST(pos // k AS INTEGER) AS qno, vec_id, want, MIN(CASE WHEN metric_type = 0 THEN score ELSE -score END) AS key
  FROM a WHERE vec_id >= 0 AND score IS NOT NULL AND ISFINITE(score) GROUP BY ALL)
SELECT request_id, qno, vec_id FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY request_id, qno ORDER BY key, vec_id) <= want""",
    "p1_events_top3": """
SELECT event_type, user_id, event_id, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE value IS NOT NULL AND NOT ISNAN(value) AND event_id IS NOT NULL)
WHERE rank <= 3""",
}
