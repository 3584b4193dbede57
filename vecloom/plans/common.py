"""Registration of queries, and the inputs and SQL parts several of them share.

Query sets are the stored vectors whose id is divisible by 20, each against all vectors. Centroids are the means of the vectors of each label (all of
them); codebooks hold the parts of the 16 vectors of the smallest ids as codewords. Both engines can build these parameters, so
every step of a search can be compared; trained ones are used by the queries of ``plans.training``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import literal
from ..operators.ivf import Params
from ..operators.statistics import means
from ..runtime import table

D, PARTS, CODES, K = 64, 32, 16, 10


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def register(f):
            key = name or f.__name__
            self.queries[key] = f
            if sql is not None:
                self.oracles[key] = sql
            return f

        return register


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("int").alias("label"))


def asked(v: DataFrame) -> DataFrame:
    return v.filter("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("q"))


def centroids(v: DataFrame) -> DataFrame:
    return means(v, "label", "vec").select(F.col("label").cast("int").alias("list_no"), F.col("mean").alias("c"))


def books(v: DataFrame) -> np.ndarray:
    rows = v.select("id", "vec").orderBy("id").limit(CODES).collect()
    x = np.array([r["vec"] for r in rows], float)
    return np.ascontiguousarray(x.reshape(len(x), PARTS, -1).transpose(1, 0, 2))


def books_column(b: np.ndarray):
    """The codebook as a literal; 2^bits times d numbers."""
    return literal(b.tolist(), "array<array<array<double>>>")


def params(v: DataFrame, metric: str, kind: str = "flat", by_residual: bool = False) -> Params:
    return Params(metric, D, kind, books(v) if kind == "pq" else None, by_residual=by_residual)


#: named parts of SQL; each may use those before it
PART = {
    "e": "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, CAST(label AS INTEGER) AS label FROM embeddings)",
    "a": "a AS (SELECT id AS qid, v AS q FROM e WHERE id % 20 = 0)",
    "c": "c AS (SELECT label AS list_no, LIST(m ORDER BY j) AS c FROM (SELECT label, j, AVG(x) AS m FROM (SELECT label, UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS j FROM e) GROUP BY ALL) GROUP BY label)",
    "w": f"w AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY id) - 1 AS INTEGER) AS code, v FROM (SELECT id, v FROM e ORDER BY id LIMIT {CODES}))",
    "b": f"b AS (SELECT CAST(m AS INTEGER) AS m, code, v[m * {D // PARTS} + 1 : (m + 1) * {D // PARTS}] AS s FROM w, RANGE({PARTS}) t(m))",
    # nearest list of every vector
    "l": "l AS (SELECT id, ARG_MIN(list_no, (POW(LIST_DISTANCE(v, c), 2), list_no)) AS list_no FROM e, c GROUP BY id)",
    "li": "li AS (SELECT id, ARG_MIN(list_no, (-LIST_INNER_PRODUCT(v, c), list_no)) AS list_no FROM e, c GROUP BY id)",
    # codes of every vector
    "k": f"k AS (SELECT id, LIST(code ORDER BY m) AS code FROM (SELECT id, m, ARG_MIN(code, (ROUND(POW(LIST_DISTANCE(v[m * {D // PARTS} + 1 : (m + 1) * {D // PARTS}], s), 2), 14), code)) AS code FROM e, b GROUP BY id, m) GROUP BY id)",
    # score table of every query
    "ti": f"ti AS (SELECT qid, m, code, LIST_INNER_PRODUCT(q[m * {D // PARTS} + 1 : (m + 1) * {D // PARTS}], s) AS x FROM a, b)",
    "tl": f"tl AS (SELECT qid, m, code, POW(LIST_DISTANCE(q[m * {D // PARTS} + 1 : (m + 1) * {D // PARTS}], s), 2) AS x FROM a, b)",
    "ke": "ke AS (SELECT id, UNNEST(code) AS code, UNNEST(RANGE(LEN(code))) AS m FROM k)",
}


def sql(parts: str, select: str) -> str:
    return "WITH " + ",\n".join(PART[p] for p in parts.split()) + "\n" + select


def ranked(score: str, source: str, order: str = "DESC", k: int = K, digits: int = 6) -> str:
    """``qid, id, score, rank`` of the k best rows of each query of a source with a, e joined."""
    return (
        f"SELECT qid, id, ROUND(score, {digits}) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND(score, 12) {order}, id) AS rank "
        f"FROM (SELECT qid, id, {score} AS score FROM {source})) WHERE rank <= {k}"
    )


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select("qid", "id", F.round("score", digits).alias("score"), *([F.col("rank").cast("int").alias("rank")] if "rank" in df.columns else []))
