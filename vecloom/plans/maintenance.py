"""Maintenance of collections: additions, deletions, updates, merges, subsets, parameter swaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantize as z
from ..operators import ivf, maintenance, selectors
from ..operators.training import recentred
from ..runtime import cut, table
from .common import PARTS, Registry, books, books_column, centroids, params, sql, vectors
from .index import also

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


def _coded(v: DataFrame) -> DataFrame:
    """``list_no, id, code``: what an insertion stores on the filter side."""
    return ivf.assign(v, centroids(v)).join(v.select("id", z.pq_encode("vec", books_column(books(v)), PARTS).alias("code")), "id")


@query(sql("e c l w b k", "SELECT list_no, id, code, CAST(id % 3 AS INTEGER) AS shard FROM l JOIN k USING (id)"))
def add_with_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additions on both sides: list and codes everywhere, the vector on its owner."""
    return _coded(vectors(spark, sf_dir)).select("list_no", "id", "code", selectors.shard_of(3).alias("shard"))


@query(sql("e c l w b k", "SELECT list_no, id, code FROM l JOIN k USING (id)"))
def add_base_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter side only, through the blocks that are stored and back."""
    v = vectors(spark, sf_dir)
    p = params(v, "l2", "pq")
    return ivf.entries(cut(ivf.build(v, cut(centroids(v)), p)), p).select("list_no", "id", "code")


@query(sql("e", "SELECT id, v AS vec, CAST(id % 3 AS INTEGER) AS shard FROM e"))
def add_refine_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", "vec", selectors.shard_of(3).alias("shard"))


@query("SELECT o_custkey AS id, ARG_MAX(o_totalprice, (o_orderdate, o_orderkey)) AS price FROM orders GROUP BY o_custkey")
def flat_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated additions under one id: the newest holds; ids that were never added have no row."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", "o_orderdate", F.col("o_totalprice").alias("price"))
    newest = maintenance.latest(o.select("id", F.struct("o_orderdate", "o_orderkey", "price").alias("x"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("seq")))
    return newest.select("id", F.col("x.price").alias("price"))


_GONE = "g AS (SELECT id FROM e WHERE id % 7 = 0)"


@query(also("e", _GONE, "SELECT id, v AS vec FROM e WHERE id NOT IN (SELECT id FROM g) OR id % 14 = 0"))
def delete_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh id is deleted, every fourteenth added again later: the newest of both holds."""
    v = vectors(spark, sf_dir).select("id", "vec")
    added = v.withColumn("seq", F.lit(1)).unionByName(v.filter("id % 14 = 0").withColumn("seq", F.lit(3)))
    return maintenance.alive(added, v.filter("id % 7 = 0").select("id", F.lit(2).alias("seq"))).select("id", "vec")


@query(sql("e", "SELECT id, v AS vec FROM e WHERE id % 7 <> 0"))
def delete_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", "vec")
    return maintenance.removed(v, v.filter("id % 7 = 0"))


@query(sql("e", "SELECT id, v AS vec FROM e WHERE NOT (id >= 100 AND id < 300)"))
def remove_physical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.removed(vectors(spark, sf_dir).select("id", "vec"), selectors.id_range(100, 300))


@query(also("e c", "u AS (SELECT id, CASE WHEN id % 5 = 0 THEN [-x FOR x IN v] ELSE v END AS v FROM e)", "SELECT id, ARG_MIN(list_no, (POW(LIST_DISTANCE(v, c), 2), list_no)) AS list_no, ROUND(ANY_VALUE(v[1]), 6) AS first FROM u, c GROUP BY id"))
def update_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth vector is negated in place and assigned anew."""
    v = vectors(spark, sf_dir)
    new = maintenance.upsert(v.select("id", "vec"), v.filter("id % 5 = 0").select("id", F.transform("vec", lambda x: -x).alias("vec")))
    return ivf.assign(new, centroids(v)).join(new, "id").select("id", "list_no", F.round(F.col("vec")[0], 6).alias("first"))


@query("SELECT c_custkey AS key, CASE WHEN n > 0 THEN 'seen' ELSE c_mktsegment END AS value FROM (SELECT c_custkey, c_mktsegment, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS n FROM customer)")
def add_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a finished order replace their stored row."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    done = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key")).distinct()
    changes = done.join(stored.select("key"), "key", "left_semi").withColumn("value", F.lit("seen"))
    return maintenance.upsert(stored, changes, "key")


@query(sql("e", "SELECT id, v AS vec FROM e UNION ALL SELECT id + 100000, v FROM e WHERE label < 3"))
def merge_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    size = {"d": 64, "metric": "l2", "nlist": 10, "code_size": 32}
    maintenance.check_compatible(size, dict(size))
    return maintenance.merged(v.select("id", "vec"), v.filter("label < 3").select("id", "vec"), 100_000)


@query(sql("e", "SELECT CASE WHEN id % 2 = 0 THEN id + 1 ELSE id - 1 END AS id, v AS vec FROM e"))
def permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring ids change places."""
    v = vectors(spark, sf_dir).select("id", "vec")
    return maintenance.permuted(v, v.select("id", F.when(F.col("id") % 2 == 0, F.col("id") + 1).otherwise(F.col("id") - 1).alias("new")))


@query(sql("e", "SELECT id, v AS vec FROM e WHERE FALSE"))
def reset_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.reset(vectors(spark, sf_dir).select("id", "vec"))


_ORDERED = "o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY list_no ORDER BY id) - 1 AS no, COUNT(*) OVER (PARTITION BY list_no) AS n, ROW_NUMBER() OVER (ORDER BY list_no, id) - 1 AS place FROM l)"
_SUBSETS = {
    "subset_id_range": ("id_range", 100, 300, "id >= 100 AND id < 300"),
    "subset_mod": ("id_mod", 3, 1, "id % 3 = 1"),
    "subset_list_range": ("list_range", 2, 5, "list_no >= 2 AND list_no < 5"),
    "subset_elements": ("elements", 120, 260, "place >= 120 AND place < 260"),
    "subset_list_fraction": ("list_fraction", 3, 1, "no >= n // 3 AND no < n * 2 // 3"),
}


def _subset(how: str, a: int, b: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        return selectors.subset(ivf.assign(v, centroids(v)), how, a, b).select("list_no", "id")

    return run


for _name, (_how, _a, _b, _where) in _SUBSETS.items():
    query(also("e c l", _ORDERED, f"SELECT list_no, id FROM o WHERE {_where}"), _name)(_subset(_how, _a, _b))


@query(sql("e w b k ke", "SELECT id, FLATTEN(LIST([ROUND(x, 6) FOR x IN s] ORDER BY ke.m)) AS x FROM ke JOIN b ON ke.m = b.m AND ke.code = b.code WHERE id >= 100 AND id < 300 GROUP BY id"))
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a range of ids from their codes in the stored blocks."""
    v = vectors(spark, sf_dir)
    p = params(v, "l2", "pq")
    return ivf.entries(ivf.build(v, centroids(v), p), p).filter(selectors.id_range(100, 300)).select("id", F.transform("vec", lambda x: F.round(x, 6)).alias("x"))


@query(also("e c", "x AS (SELECT 'insert' AS role, list_no, c FROM c UNION ALL SELECT 'query', list_no, [-y FOR y IN c] FROM c)", "SELECT role, 'centroids' AS name, list_no AS no, [ROUND(y, 6) FOR y IN c] AS value FROM x"))
def install_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New centroids for queries; those of insertions stay."""
    c = cut(centroids(vectors(spark, sf_dir))).select(F.lit("centroids").alias("name"), F.col("list_no").alias("no"), F.col("c").alias("value"))
    both = c.withColumn("role", F.lit("insert")).unionByName(c.withColumn("role", F.lit("query")))
    new = c.withColumn("value", F.transform("value", lambda y: -y))
    out = maintenance.installed(both.select("role", "name", "no", "value"), new)
    return out.select("role", "name", "no", F.transform("value", lambda y: F.round(y, 6)).alias("value"))


@query(
    also(
        "e c l",
        "n AS (SELECT list_no, LIST(m ORDER BY j) AS m FROM (SELECT list_no, j, AVG(x) AS m FROM (SELECT list_no, UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS j FROM e JOIN l USING (id)) GROUP BY ALL) GROUP BY list_no), u AS (SELECT list_no, COALESCE(m, c) AS c FROM c LEFT JOIN n USING (list_no))",
        "SELECT list_no, [ROUND(x / SQRT(LIST_INNER_PRODUCT(c, c)), 6) FOR x IN c] AS c FROM u",
    )
)
def recenter_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    c = cut(centroids(v))
    return recentred(v.select("id", "vec"), ivf.assign(v, c), c, "ip").select("list_no", F.transform("c", lambda x: F.round(x, 6) + F.lit(0.0)).alias("c"))
