"""Queries of problem 3: abstracts that occur again with small edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from .neardup import NearDuplicates


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NearDuplicates(table(spark, sf_dir, "pubmedqa"), "id", "text", words=3, similarity=0.7).id_pairs()


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per abstract with its class of equal word runs and the number of similar classes, at five words and 0.8."""
    return NearDuplicates(table(spark, sf_dir, "pubmedqa"), "id", "text").links()


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes}

_SETS = """
WITH t AS (SELECT id, MAX(text) AS text FROM pubmedqa WHERE id IS NOT NULL GROUP BY id),
w AS (SELECT id, REGEXP_EXTRACT_ALL(LOWER(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
g AS (SELECT DISTINCT id, ARRAY_TO_STRING(LIST_SLICE(w, i, i + {n} - 1), ' ') AS g FROM (SELECT id, w, UNNEST(RANGE(1, LEN(w) - {n} + 2)) AS i FROM w)),
s AS (SELECT id, COUNT(*) AS n FROM g GROUP BY id),
p AS (SELECT a.id AS id_a, b.id AS id_b, COUNT(*) AS x FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
r AS (SELECT id_a, id_b FROM p JOIN s a ON a.id = id_a JOIN s b ON b.id = id_b WHERE x >= {j} * (a.n + b.n - x))
"""

ORACLES = {
    "p3_found": _SETS.format(n=3, j=0.7) + "SELECT id_a, id_b FROM r",
    "p3_classes": _SETS.format(n=5, j=0.8).rstrip()
    + """,
c AS (SELECT id, MIN(id) OVER (PARTITION BY s) AS rep, COUNT(*) OVER (PARTITION BY s) AS copies FROM (SELECT id, LIST(g ORDER BY g) AS s FROM g GROUP BY id)),
e AS (SELECT a.rep AS rep FROM r JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b WHERE a.rep = a.id AND b.rep = b.id
  UNION ALL SELECT b.rep FROM r JOIN c a ON a.id = id_a JOIN c b ON b.id = id_b WHERE a.rep = a.id AND b.rep = b.id)
SELECT id, rep, copies, (SELECT COUNT(*) FROM e WHERE e.rep = c.rep) AS links FROM c""",
}
