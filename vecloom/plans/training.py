"""Training: means, k-means, quantisers, rotations, fine-tuning. Iterative results have no SQL; each is tested against its own invariants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exact, statistics, training
from ..runtime import table
from .common import D, Registry, asked, centroids, sql, vectors
from .index import also

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(sql("e", "SELECT list_no, CAST(n AS BIGINT) AS n, LIST(ROUND(m, 6) ORDER BY j) AS mean FROM (SELECT label AS list_no, j, COUNT(*) AS n, SUM((1 + id % 3) * x) / SUM(1 + id % 3) AS m FROM (SELECT id, label, UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS j FROM e) GROUP BY ALL) GROUP BY ALL"))
def centroid_mean_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted means of the vectors of each label."""
    v = vectors(spark, sf_dir).withColumn("w", 1 + F.col("id") % 3)
    out = statistics.means(v, "label", "vec", "w")
    return out.select(F.col("label").cast("int").alias("list_no"), "n", F.transform("mean", lambda x: F.round(x, 6) + F.lit(0.0)).alias("mean"))


@query(also("e c l", "n AS (SELECT list_no, j, AVG(x) AS m, COUNT(*) AS n FROM (SELECT list_no, UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS j FROM e JOIN l USING (id)) GROUP BY ALL)", "SELECT list_no, CAST(ANY_VALUE(n) AS BIGINT) AS n, LIST(ROUND(m, 6) ORDER BY j) AS mean FROM n GROUP BY list_no"))
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of Lloyd's algorithm from the means of the labels."""
    v = vectors(spark, sf_dir)
    start = {r["list_no"]: r["c"] for r in centroids(v).collect()}  # one row a label
    labels = sorted(start)
    n, sums, _ = training.step(v, np.array([start[x] for x in labels]))
    rows = [(x, int(c), [round(float(y), 6) + 0.0 for y in s / c]) for x, c, s in zip(labels, n, sums) if c]
    return spark.createDataFrame(rows, "list_no int, n bigint, mean array<double>")


@query(sql("e c", "SELECT ROUND(SUM(g), 6) AS objective FROM (SELECT id, MIN(POW(LIST_DISTANCE(v, c), 2)) AS g FROM e, c GROUP BY id)"))
def kmeans_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    found = exact.knn(v, centroids(v), 1, "l2", "id", "vec", "list_no", "c")
    return found.agg(F.round(F.sum("score"), 6).alias("objective"))


@query(sql("e", "SELECT CAST(j AS INTEGER) AS j, ROUND(MIN(x), 6) AS low, ROUND(MAX(x), 6) AS high, ROUND(MAX(x) - MIN(x), 6) AS span FROM (SELECT UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS j FROM e) GROUP BY j"))
def dimension_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.per_dimension(vectors(spark, sf_dir), "vec")
    return out.select("j", *[F.round(c, 6).alias(c) for c in ("low", "high", "span")])


@query()
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten centroids, the better of two starts, and the objective before each round (which never rises)."""
    c, costs = training.kmeans(vectors(spark, sf_dir), 10, 8, redo=2)
    return spark.createDataFrame([(i, [float(x) for x in row], [float(x) for x in costs]) for i, row in enumerate(c)], "list_no int, c array<double>, objectives array<double>")


@query()
def kmeans_spherical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit centroids, the first two of them frozen, trained on at most 20 vectors for each."""
    v = vectors(spark, sf_dir)
    c, _ = training.kmeans(v, 10, 5, spherical=True, frozen=training.sample(v, 2, 99), per_centroid=20)
    return training.vectors_frame(spark, c)


@query()
def kmeans_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five groups of customers' balances (rounded to hundreds)."""
    c, cost = training.kmeans_line(table(spark, sf_dir, "customer").select(F.round(F.col("c_acctbal") / 100).alias("x")), "x", 5)
    return spark.createDataFrame([(i, float(x), float(cost)) for i, x in enumerate(c)], "no int, centre double, objective double")


@query()
def pq_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codebooks of 32 sub-spaces: ``m, code, c``."""
    b = training.train_pq(training.sample(vectors(spark, sf_dir)), 32)
    return spark.createDataFrame([(m, k, [float(x) for x in b[m, k]]) for m in range(b.shape[0]) for k in range(b.shape[1])], "m int, code int, c array<double>")


@query()
def opq_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rotation to 32 dimensions (rows are orthonormal) and the error of the codes of the rotated sample."""
    x = training.sample(vectors(spark, sf_dir))
    a, b = training.train_opq(x, 32, 16, rounds=5)
    _, y = training.pq_round_trip(x @ a.T, b)
    error = float((((x @ a.T) - y) ** 2).sum(axis=1).mean())
    return spark.createDataFrame([(i, [float(v) for v in row], error) for i, row in enumerate(a)], "j int, row array<double>, error double")


@query()
def index_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All first parameters of an index: ``name, no, value``."""
    p = training.train_index(vectors(spark, sf_dir), 32, 10, rounds=5)
    rows = [("a", i, [float(x) for x in r]) for i, r in enumerate(p["a"])] + [("centroids", i, [float(x) for x in r]) for i, r in enumerate(p["centroids"])]
    rows += [("books", m, [float(x) for x in b.ravel()]) for m, b in enumerate(p["books"])] + [("b", 0, [float(x) for x in p["b"]])]
    return spark.createDataFrame(rows, "name string, no int, value array<double>")


@query()
def finetune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of each epoch of fine-tuning from an untuned index on queries and their exact neighbours."""
    v = vectors(spark, sf_dir)
    x = training.sample(v)
    a, b = np.eye(D)[:32], np.zeros(32)
    near = exact.knn(asked(v), v, 20, "ip").join(v.select("id", "vec"), "id").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "vec"))).getField("vec").alias("pos"))
    *_, losses = training.finetune(near.join(asked(v), "qid"), a, b, training.train_pq(x @ a.T, 16), epochs=4, rate=1e-2)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(losses)], "epoch int, loss double")
