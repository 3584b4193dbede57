"""Exact searches: metrics, selectors, tombstones, shards, ranges, given candidates, recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exact, selectors, topk
from ..runtime import table
from .common import K, Registry, asked, ranked, shown, sql, vectors

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles

SCORES = {
    "ip": ("LIST_INNER_PRODUCT(q, v)", "DESC"),
    "cosine": ("LIST_COSINE_SIMILARITY(q, v)", "DESC"),
    "l2": ("POW(LIST_DISTANCE(q, v), 2)", "ASC"),
    "l1": ("LIST_SUM([ABS(q[i] - v[i]) FOR i IN RANGE(1, LEN(q) + 1)])", "ASC"),
    "linf": ("LIST_MAX([ABS(q[i] - v[i]) FOR i IN RANGE(1, LEN(q) + 1)])", "ASC"),
}


def _topk(metric: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        return shown(exact.knn(asked(v), v, K, metric))

    return run


for _metric, (_score, _order) in SCORES.items():
    query(sql("e a", ranked(_score, "a, e", _order)), f"exact_topk_{_metric}")(_topk(_metric))


@query(sql("e a", ranked("LIST_INNER_PRODUCT(q, v)", "a, e", k=100)))
def exact_topk_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger k, and both sides in blocks that meet in a grid, as where neither can be broadcast."""
    v = vectors(spark, sf_dir)
    return shown(exact.knn(asked(v), v, 100, "ip", sent=0))


def _selected(where: str, predicate):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        return shown(exact.knn(asked(v), predicate(v), K, "ip"))

    return sql("e a", ranked("LIST_INNER_PRODUCT(q, v)", f"a, e WHERE {where}")), run


_SELECTORS = {
    "knn_selector_range": ("id >= 100 AND id < 300", lambda v: v.filter(selectors.id_range(100, 300))),
    "knn_selector_list": ("id IN (3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377)", lambda v: v.filter(selectors.id_list([3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377]))),
    "knn_selector_batch": ("id % 3 = 0", lambda v: selectors.of_table(v, v.filter("id % 3 = 0"))),
    "knn_selector_not": ("NOT (id >= 100 AND id < 300)", lambda v: v.filter(selectors.neither(selectors.id_range(100, 300)))),
    "knn_selector_and": ("id >= 100 AND id % 2 = 0", lambda v: v.filter(selectors.both(selectors.id_range(100), F.col("id") % 2 == 0))),
    "knn_selector_or": ("id < 100 OR id % 7 = 0", lambda v: v.filter(selectors.either(selectors.id_range(None, 100), F.col("id") % 7 == 0))),
    "knn_selector_xor": ("(id >= 100 AND id < 300) <> (id % 3 = 0)", lambda v: v.filter(selectors.one_of(selectors.id_range(100, 300), F.col("id") % 3 == 0))),
    "knn_selector_bitmap": (
        "(id < 8) OR (id >= 8 AND id < 12) OR (id >= 24 AND id < 32 AND id % 2 = 1) OR (id >= 32 AND id < 40 AND id % 2 = 0)",
        lambda v: v.filter(selectors.bitmap(F.unhex(F.lit("FF0F00AA55")))),
    ),
    "knn_tombstone": ("id % 7 <> 0", lambda v: selectors.not_of_table(v, v.filter("id % 7 = 0"))),
}
for _name, (_where, _predicate) in _SELECTORS.items():
    _sql, _run = _selected(_where, _predicate)
    query(_sql, _name)(_run)


@query(sql("e", "SELECT id, CAST(id % 3 AS INTEGER) AS shard, id % 3 = 1 AS owned FROM e"))
def shard_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", selectors.shard_of(3).alias("shard"), selectors.owned(3, 1).alias("owned"))


@query(sql("e a", ranked("LIST_INNER_PRODUCT(q, v)", "a, e")))
def shard_merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three workers each search what they own; their answers are merged. Any number of shards gives the same result."""
    v = vectors(spark, sf_dir)
    parts = [exact.knn(asked(v), v.filter(selectors.owned(3, s)), K, "ip") for s in range(3)]
    return shown(topk.merge(parts, K, "ip"))


@query(
    """
WITH i AS (SELECT request_id, worker_id, UNNEST(ids) AS id, UNNEST(scores) AS score FROM search_response WHERE status AND LEN(ids) = LEN(scores))
SELECT request_id, id, ROUND(MAX(CAST(score AS DOUBLE)), 6) AS score, COUNT(*) AS times FROM i WHERE id >= 0 AND ISFINITE(score) GROUP BY request_id, id"""
)
def valid_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without padding, each id of a request once with its greatest score."""
    given = table(spark, sf_dir, "search_response").filter("status and size(ids) = size(scores)").select("request_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    items = given.select("request_id", F.col("x.ids").alias("id"), F.col("x.scores").cast("double").alias("score"))
    ok = items.filter(selectors.valid("id") & F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    return ok.groupBy("request_id", "id").agg(F.round(F.max("score"), 6).alias("score"), F.count("*").alias("times"))


@query("SELECT request_id, worker_id, received_at, k, ids[1:5] AS first_ids, scores[1:5] AS first_scores FROM search_response WHERE LEN(ids) > 0 AND LEN(scores) = LEN(ids) AND LEN([s FOR s IN scores IF s IS NULL OR NOT ISFINITE(s)]) = 0")
def slice_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "search_response").filter("size(ids) > 0 and size(scores) = size(ids)")
    fine = rows.filter(F.forall("scores", lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))))
    return fine.select("request_id", "worker_id", "received_at", "k", F.slice("ids", 1, 5).alias("first_ids"), F.slice("scores", 1, 5).alias("first_scores"))


def _range(metric: str, bound: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        return shown(exact.range_search(asked(v), v, bound, metric))

    return run


query(sql("e a", "SELECT qid, id, ROUND(LIST_INNER_PRODUCT(q, v), 6) AS score FROM a, e WHERE LIST_INNER_PRODUCT(q, v) > 0.3"), "range_ip")(_range("ip", 0.3))
query(sql("e a", "SELECT qid, id, ROUND(POW(LIST_DISTANCE(q, v), 2), 6) AS score FROM a, e WHERE POW(LIST_DISTANCE(q, v), 2) < 1.4"), "range_l2")(_range("l2", 1.4))

_LISTS = "x AS (SELECT qid, e.id FROM a, e WHERE (qid + e.id) % 9 = 0)"


def _candidates(v: DataFrame) -> DataFrame:
    """A ninth of the ids for each query, each joined by the remainder that belongs to it."""
    left = asked(v).select("qid", F.pmod(-F.col("qid"), F.lit(9)).alias("r"))
    return left.join(v.select("id", F.pmod("id", F.lit(9)).alias("r")), "r").select("qid", "id")


def _with(part: str, select: str) -> str:
    return sql("e a", select).replace("\nSELECT", ",\n" + part + "\nSELECT", 1)


@query(_with(_LISTS, ranked("LIST_INNER_PRODUCT(q, v)", "x JOIN a USING (qid) JOIN e USING (id)")))
def knn_by_idlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return shown(exact.rerank(_candidates(v), asked(v), v, K, "ip"))


@query(_with(_LISTS, "SELECT qid, id, ROUND(LIST_INNER_PRODUCT(q, v), 6) AS ip, ROUND(POW(LIST_DISTANCE(q, v), 2), 6) AS l2 FROM x JOIN a USING (qid) JOIN e USING (id)"))
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both metrics of given pairs of ids."""
    v = vectors(spark, sf_dir)
    ip, l2 = (exact.scored(_candidates(v), asked(v), v, m).select("qid", "id", F.round("score", 6).alias(m)) for m in ("ip", "l2"))
    return ip.join(l2, ["qid", "id"])


@query(sql("e a", f"SELECT qid, LIST(id ORDER BY rank) AS ids FROM ({ranked('POW(LIST_DISTANCE(q, v), 2)', 'a, e', 'ASC', 20)}) GROUP BY qid"))
def nn_train_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with their exact neighbours, as training takes them."""
    v = vectors(spark, sf_dir)
    return topk.rank_lists(exact.knn(asked(v), v, 20, "l2"))


@query("SELECT c_custkey AS qid, id, ROUND(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT c_custkey, s_suppkey AS id, ABS(c_acctbal - s_acctbal) AS score, ROW_NUMBER() OVER (PARTITION BY c_custkey ORDER BY ABS(c_acctbal - s_acctbal), s_suppkey) AS rank FROM customer, supplier WHERE c_custkey % 20 = 0) WHERE rank <= 5")
def sorted_1d_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest numbers to numbers: suppliers by the balance of customers."""
    c = table(spark, sf_dir, "customer").filter("c_custkey % 20 = 0").select(F.col("c_custkey").alias("qid"), F.array("c_acctbal").alias("q"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array("s_acctbal").alias("vec"))
    return shown(exact.knn(c, s, 5, "l1"))


_BOTH = f"t AS ({ranked('LIST_INNER_PRODUCT(q, v)', 'a, e')}), f AS ({ranked('LIST_INNER_PRODUCT(q, v)', 'a, e WHERE id % 3 <> 0')})"


@query(_with(_BOTH, "SELECT CAST(COUNT(DISTINCT qid) AS BIGINT) AS queries, CAST(COUNT(f.id) AS BIGINT) AS hits, COUNT(*) AS wanted, ROUND(COUNT(f.id) / COUNT(*), 9) AS recall FROM t LEFT JOIN f USING (qid, id)"))
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of a search that sees two thirds of the vectors."""
    v = vectors(spark, sf_dir)
    truth, found = exact.knn(asked(v), v, K, "ip"), exact.knn(asked(v), v.filter("id % 3 != 0"), K, "ip")
    return topk.recall(found, truth).select("queries", "hits", "wanted", F.round("recall", 9).alias("recall"))


@query(_with(_BOTH, "SELECT qid, CAST(COUNT(f.id) AS BIGINT) AS common FROM t LEFT JOIN f USING (qid, id) GROUP BY qid"))
def rank_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return topk.intersection(exact.knn(asked(v), v, K, "ip"), exact.knn(asked(v), v.filter("id % 3 != 0"), K, "ip"))


@query(_with(f"t AS ({ranked('LIST_INNER_PRODUCT(q, v)', 'a, e WHERE id < 250')}), f AS ({ranked('LIST_INNER_PRODUCT(q, v)', 'a, e WHERE id >= 100')}), u AS (SELECT qid, id, MAX(score) AS score FROM (SELECT * FROM t UNION ALL SELECT * FROM f) GROUP BY ALL)", "SELECT qid, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM u) WHERE rank <= 10"))
def result_table_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping result tables as one, an id once with its better score."""
    v = vectors(spark, sf_dir)
    t, f = (shown(exact.knn(asked(v), p, K, "ip")) for p in (v.filter("id < 250"), v.filter("id >= 100")))
    return shown(topk.merge([t, f], K, "ip"))


@query("SELECT user_id, event_id, value, CAST(rank AS INTEGER) AS rank FROM (SELECT user_id, event_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events WHERE value IS NOT NULL AND event_id IS NOT NULL) WHERE rank <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return topk.top_k(rows, 5, "ip", "user_id", "event_id", "value").withColumn("rank", F.col("rank").cast("int"))


@query("SELECT o_custkey AS qid, LIST(o_orderkey ORDER BY rank) AS ids FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY YEAR(o_orderdate), o_orderkey) AS rank FROM orders) WHERE rank <= 20 GROUP BY o_custkey")
def rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with many equal scores (years): ties in the order of ids."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("id"), F.year("o_orderdate").cast("double").alias("score"))
    return topk.rank_lists(topk.top_k(rows, 20, "l2"))
