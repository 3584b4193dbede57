"""Queries of problem 5: the most similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import cut, table
from .additive import build_index, search
from .clusters import LATEST
from .vectors import latest_vectors


def logged_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of all well-formed requests: ``qid, sub, grp, q, k, metric``."""
    info = table(spark, sf_dir, "collection_info").select(F.col("collection_name").alias("grp"), F.col("d").alias("dim")).dropDuplicates(["grp"])
    asked = table(spark, sf_dir, "search_request").select("request_id", F.col("collection_name").alias("grp"), "n", "d", "k", "metric_type", "vecs").filter("request_id is not null and k > 0").dropDuplicates(["request_id"])
    good = asked.join(info, "grp").filter("d = dim and n > 0 and size(vecs) = n * d").filter(~F.exists("vecs", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return good.select(F.col("request_id").alias("qid"), "grp", "k", F.coalesce("metric_type", F.lit(0)).alias("metric"), "d", "vecs", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("sub")).select(
        "qid", F.col("sub").cast("bigint").alias("sub"), "grp", F.slice("vecs", F.col("sub") * F.col("d") + 1, F.col("d")).alias("q"), "k", "metric")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = cut(build_index(latest_vectors(spark, sf_dir)))
    return search(index, logged_queries(spark, sf_dir)).select(F.col("qid").alias("request_id"), F.col("sub").cast("int").alias("qno"), F.col("id").alias("vec_id"))


def p5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten other vectors of highest cosine for every stored vector whose id is divisible by 20."""
    vectors = cut(latest_vectors(spark, sf_dir))
    # one more is asked for, as the vector itself is mostly among them
    asked = vectors.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.lit(0).cast("bigint").alias("sub"), "grp", F.col("vec").alias("q"), F.lit(11).alias("k"), F.lit(2).alias("metric"))
    found = search(cut(build_index(vectors)), asked)
    own = F.max(F.when(F.col("id") == F.col("qid"), F.col("rank"))).over(Window.partitionBy("qid"))
    others = found.withColumn("own", own).filter("id != qid").withColumn("rank", F.col("rank") - F.when(F.col("rank") > F.col("own"), 1).otherwise(0)).filter("rank <= 10")
    return others.select(F.col("qid").alias("vec_id"), F.col("id").alias("neighbour_id"), "rank")


QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours}

ORACLES = {
    "p5_found": LATEST
    + """,
g AS (SELECT DISTINCT request_id, collection_name, n, r.d, k, COALESCE(metric_type, 0) AS metric, vecs FROM search_request r JOIN i USING (collection_name)
  WHERE request_id IS NOT NULL AND k > 0 AND r.d = dim AND n > 0 AND LEN(vecs) = n * r.d AND LEN([x FOR x IN vecs IF x IS NULL OR NOT ISFINITE(x)]) = 0),
q AS (SELECT request_id, collection_name, k, metric, p AS qno, CAST(vecs[p * d + 1 : (p + 1) * d] AS DOUBLE[]) AS q FROM (SELECT *, UNNEST(RANGE(n)) AS p FROM g)),
s AS (SELECT request_id, qno, k, id, CASE metric WHEN 0 THEN LIST_DISTANCE(q, v) WHEN 1 THEN -LIST_INNER_PRODUCT(q, v) WHEN 2 THEN CASE WHEN LEN([x FOR x IN q IF x <> 0]) = 0 THEN 0 ELSE -LIST_COSINE_SIMILARITY(q, v) END END AS key
  FROM q JOIN l USING (collection_name) WHERE metric IN (0, 1, 2))
SELECT request_id, CAST(qno AS INTEGER) AS qno, id AS vec_id FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY request_id, qno ORDER BY key, id) <= k""",
    "p5_neighbours": LATEST
    + """
SELECT vec_id, neighbour_id, CAST(rank AS INTEGER) AS rank FROM (SELECT a.id AS vec_id, b.id AS neighbour_id, ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY ROUND(LIST_COSINE_SIMILARITY(a.v, b.v), 12) DESC, b.id) AS rank
  FROM l a JOIN l b ON a.collection_name = b.collection_name AND a.id <> b.id WHERE a.id % 20 = 0) WHERE rank <= 10""",
}
