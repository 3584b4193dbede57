"""Queries of problem 4: texts cut to what an embedding model accepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import bounded, table
from .splitting import pieces
from .tokens import tokenizer

ABSTRACT_MODEL = "med-abstract"
TOKENS, OVERLAP = 256, 32


def _name(c: str):
    return F.lower(F.trim(F.col(c)))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of both tables with the limits of their models."""
    models = table(spark, sf_dir, "embed_model").groupBy(_name("model_name_").alias("model")).agg(F.max("max_chars").alias("most"), F.max("overlap_chars").alias("overlap")).filter("model is not null")
    sent = table(spark, sf_dir, "embed_worker_request").select(F.lit("embed_worker_request").alias("src"), F.col("request_id").alias("id"), F.col("data_").alias("text"), _name("model_name_").alias("model"))
    read = table(spark, sf_dir, "pubmedqa").select(F.lit("pubmedqa").alias("src"), "id", "text", F.lit(ABSTRACT_MODEL).alias("model"))
    return sent.union(read).join(bounded(models, 10_000), "model", "left")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of both tables: ``src_table, item_id, piece_no, begin_char, end_char, cut, piece``."""
    return pieces(_items(spark, sf_dir), "src", "id", "text", "most", "overlap").withColumnsRenamed({"src": "src_table", "id": "item_id"})


def p4_token_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts in pieces of at most TOKENS tokens of a public tokenizer, OVERLAP of them common to neighbours."""
    rows = _items(spark, sf_dir).withColumn("most", F.lit(TOKENS)).withColumn("overlap", F.lit(OVERLAP))
    return pieces(rows, "src", "id", "text", "most", "overlap", tokenizer(spark)).withColumnsRenamed({"src": "src_table", "id": "item_id"})


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of more than one piece, which are those over their limit."""
    return p4_pieces(spark, sf_dir).filter("piece_no = 1").select("src_table", "item_id")


QUERIES = {"p4_found": p4_found, "p4_pieces": p4_pieces, "p4_token_pieces": p4_token_pieces}

ORACLES = {
    "p4_found": """
WITH m AS (SELECT LOWER(TRIM(model_name_)) AS model, MAX(max_chars) AS most FROM embed_model GROUP BY ALL)
SELECT DISTINCT 'embed_worker_request' AS src_table, request_id AS item_id FROM embed_worker_request JOIN m ON LOWER(TRIM(model_name_)) = model WHERE most > 0 AND LENGTH(data_) > most
UNION ALL SELECT DISTINCT 'pubmedqa', id FROM pubmedqa JOIN m ON model = 'med-abstract' WHERE most > 0 AND LENGTH(text) > most""",
}
