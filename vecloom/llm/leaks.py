"""Queries of problem 8: held-out passages in notebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import bounded, table
from .contamination import leaks


def p8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every notebook and item with a common run of twelve words (24 characters), or with half of the passage in shorter tiles, as where its parts were
    reordered; ``whole`` marks a coverage of half the passage or more."""
    found = leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_item"), "item_id", "passage", "lang")
    return found.withColumn("whole", F.col("coverage") >= 0.5)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those with such a run; the items' languages decide what a run is."""
    items = table(spark, sf_dir, "eval_item").select("item_id", F.when(F.col("lang") == "zh", 24).otherwise(12).alias("least"))
    return p8_tiles(spark, sf_dir).join(bounded(items, 100_000), "item_id").filter(F.col("longest") >= F.col("least")).select("doc_id", "item_id")


QUERIES = {"p8_found": p8_found, "p8_tiles": p8_tiles}

_PLAIN = "REGEXP_EXTRACT_ALL(LOWER(STRIP_ACCENTS(REGEXP_REPLACE({}, '</?[A-Za-z][^<>]*>|<!--.*?-->', '', 'gs'))), '[\\p{{L}}\\p{{N}}]+')"

ORACLES = {
    "p8_found": f"""
WITH d AS (SELECT doc_id, {_PLAIN.format("text")} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, lang, {_PLAIN.format("passage")} AS w FROM eval_item WHERE passage IS NOT NULL),
pw AS (SELECT DISTINCT item_id, ARRAY_TO_STRING(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, UNNEST(RANGE(1, LEN(w) - 10)) AS k FROM i WHERE lang IS DISTINCT FROM 'zh')),
dw AS (SELECT DISTINCT doc_id, ARRAY_TO_STRING(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 10)) AS k FROM d)),
pc AS (SELECT DISTINCT item_id, SUBSTR(c, k, 24) AS g FROM (SELECT item_id, c, UNNEST(RANGE(1, LENGTH(c) - 22)) AS k FROM (SELECT item_id, ARRAY_TO_STRING(w, '') AS c FROM i WHERE lang = 'zh'))),
dc AS (SELECT DISTINCT doc_id, SUBSTR(c, k, 24) AS g FROM (SELECT doc_id, c, UNNEST(RANGE(1, LENGTH(c) - 22)) AS k FROM (SELECT doc_id, ARRAY_TO_STRING(w, '') AS c FROM d)) WHERE REGEXP_MATCHES(SUBSTR(c, k, 1), '[\\x{{3400}}-\\x{{9fff}}]'))
SELECT DISTINCT doc_id, item_id FROM pw JOIN dw USING (g) UNION SELECT doc_id, item_id FROM pc JOIN dc USING (g)""",
}
