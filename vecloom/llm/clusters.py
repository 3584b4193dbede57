"""Queries of problem 2: groups of alike vectors inside their collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .peaks import density_peaks
from .vectors import latest_vectors

TYPICAL = 5


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_peaks(latest_vectors(spark, sf_dir)).filter("size > 1").select("cluster_id", F.col("id").alias("vec_id"))


def p2_typical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a group of two or more: its collection, peak, size and the most typical members, best first."""
    order = F.struct((-F.round("total", 9)).alias("t"), "id")
    groups = density_peaks(latest_vectors(spark, sf_dir)).filter("size > 1").groupBy("cluster_id", F.col("grp").alias("collection_name"), "peak", "size")
    return groups.agg(F.slice(F.sort_array(F.collect_list(order)), 1, TYPICAL).alias("m")).select("cluster_id", "collection_name", "peak", "size", F.col("m.id").alias("typical"))


QUERIES = {"p2_found": p2_found, "p2_typical": p2_typical}

#: the usable latest vectors, as ``l``
LATEST = """
WITH i AS (SELECT collection_name, MAX(d) AS dim FROM collection_info GROUP BY ALL),
f AS (SELECT collection_name, sent_at, a.d, vecs, ids, UNNEST(RANGE(LEN(ids))) AS p FROM add_request a JOIN i USING (collection_name) WHERE a.d = dim AND n > 0 AND LEN(ids) = n AND LEN(vecs) = n * a.d),
o AS (SELECT collection_name, sent_at, ids[p + 1] AS id, CAST(vecs[p * d + 1 : (p + 1) * d] AS DOUBLE[]) AS v FROM f),
u AS (SELECT * FROM o WHERE id IS NOT NULL AND LEN([x FOR x IN v IF x IS NULL OR NOT ISFINITE(x)]) = 0 AND LEN([x FOR x IN v IF x <> 0]) > 0),
l AS (SELECT * FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY id ORDER BY sent_at DESC NULLS LAST, collection_name DESC, v DESC) = 1)"""

ORACLES = {
    "p2_found": LATEST + """,
p AS (SELECT a.id AS a, b.id AS b FROM l a JOIN l b ON a.collection_name = b.collection_name WHERE LIST_COSINE_SIMILARITY(a.v, b.v) >= 0.7 OR a.id = b.id)
SELECT MIN(b) AS cluster_id, a AS vec_id FROM p GROUP BY a HAVING COUNT(*) > 1""",
}
