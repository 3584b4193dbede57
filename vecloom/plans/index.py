"""Inverted lists: assignment, probing, scans of full and quantised vectors, two-phase search, statistics of lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quantize as z
from ..functions import vectors as m
from ..operators import documents, exact, ivf, maintenance, statistics, topk, training
from ..operators.ivf import Params
from ..runtime import cut, table
from .common import D, K, PART, PARTS, Registry, asked, books, books_column, centroids, params, ranked, shown, sql, vectors

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
NPROBE, FACTOR = 4, 10


def also(parts: str, more: str, select: str) -> str:
    return "WITH " + ",\n".join([*(PART[p] for p in parts.split()), more]) + "\n" + select


def _probes(n: int = NPROBE, by: str = "-LIST_INNER_PRODUCT(q, c)") -> str:
    return f'p AS (SELECT qid, q, list_no, c, "order" FROM (SELECT qid, q, list_no, c, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY {by}, list_no) AS "order" FROM a, c) WHERE "order" <= {n})'


@query(sql("e c l", "SELECT id, list_no FROM l"))
def coarse_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return ivf.assign(v, centroids(v), "l2")


@query(sql("e c li", "SELECT id, list_no FROM li"))
def coarse_assign_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return ivf.assign(v, centroids(v), "ip")


@query(
    also(
        "e c",
        """n AS (SELECT label AS list_no, COUNT(*) AS n FROM e GROUP BY label),
o AS (SELECT id, list_no, ROW_NUMBER() OVER (PARTITION BY id ORDER BY POW(LIST_DISTANCE(v, c), 2), list_no) AS r FROM e, c)""",
        "SELECT id, ARG_MIN(list_no, (n, r)) AS list_no FROM o JOIN n USING (list_no) WHERE r <= 3 GROUP BY id",
    )
)
def coarse_assign_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the three nearest lists the shortest, sizes being those of the labels."""
    v = vectors(spark, sf_dir)
    return ivf.balanced(v, centroids(v), statistics.list_sizes(v.select(F.col("label").alias("list_no"))), 3)


@query(also("e a c", _probes(), 'SELECT qid, list_no, CAST("order" AS INTEGER) AS "order" FROM p'))
def coarse_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return ivf.probe(asked(v), centroids(v), NPROBE, "ip").withColumn("order", F.col("order").cast("int"))


_SQ8 = "LIST_SUM([POW(GREATEST(LEAST(FLOOR(q[i] * 127 + 128), 255), 0) - GREATEST(LEAST(FLOOR(c[i] * 127 + 128), 255), 0), 2) FOR i IN RANGE(1, 65)])"


@query(also("e a c", _probes(NPROBE, _SQ8), 'SELECT qid, list_no, CAST("order" AS INTEGER) AS "order" FROM p'))
def coarse_probe_sq8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return ivf.probe(asked(v), centroids(v), NPROBE, "ip", sq8=True).withColumn("order", F.col("order").cast("int"))


def _index(v: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    c = cut(centroids(v))
    return cut(ivf.build(v, c, p)), c


def _scanned(kind: str, metric: str, k: int, nprobe: int, by_residual: bool = False):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        v = vectors(spark, sf_dir)
        p = params(v, metric, kind, by_residual)
        index, c = _index(v, p)
        return shown(ivf.search(index, asked(v), c, p, k, nprobe))

    return run


_IP, _L2 = "LIST_INNER_PRODUCT(q, v)", "POW(LIST_DISTANCE(q, v), 2)"
_BY_L2 = "POW(LIST_DISTANCE(q, c), 2)"
query(also("e a c li", _probes(), ranked(_IP, "p JOIN li USING (list_no) JOIN e USING (id)")), "ivf_flat_topk")(_scanned("flat", "ip", K, NPROBE))
query(also("e a c l", _probes(NPROBE, _BY_L2), ranked(_L2, "p JOIN l USING (list_no) JOIN e USING (id)", "ASC")), "ivf_flat_topk_l2")(_scanned("flat", "l2", K, NPROBE))

# score of the codes of an entry by the table of a query
_ADC = "LIST_SUM([t.entries[i][code[i] + 1] FOR i IN RANGE(1, LEN(code) + 1)])"
_TABLES = "t AS (SELECT qid, LIST(row ORDER BY m) AS entries FROM (SELECT qid, m, LIST(x ORDER BY code) AS row FROM {} GROUP BY qid, m) GROUP BY qid)"
query(also("e a c li w b k ti", _TABLES.format("ti") + ", " + _probes(), ranked(_ADC, "p JOIN li USING (list_no) JOIN k USING (id) JOIN t USING (qid)")), "ivf_pq_topk")(_scanned("pq", "ip", K, NPROBE))
query(also("e a c l w b k tl", _TABLES.format("tl") + ", " + _probes(NPROBE, _BY_L2), ranked(_ADC, "p JOIN l USING (list_no) JOIN k USING (id) JOIN t USING (qid)", "ASC", 50)), "ivf_pq_topk50_l2")(_scanned("pq", "l2", 50, NPROBE))


@query(also("e a w b k ti", _TABLES.format("ti"), ranked(_ADC, "k, t")))
def pq_flat_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All codes, without lists: one list that all queries probe."""
    v = vectors(spark, sf_dir)
    p = params(v, "ip", "pq")
    one = v.select("id", F.lit(0).alias("list_no"))
    index = ivf.build(v, centroids(v), p, one)
    found = ivf.scan(index, asked(v), asked(v).select("qid", F.lit(0).alias("list_no")), p, K)
    return shown(topk.top_k(found, K, "ip"))


@query(also("e a w b k ti", _TABLES.format("ti"), ranked(_ADC, "k, t")))
def adc_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by column expressions: query tables broadcast behind a check, codes scored where they are."""
    from ..runtime import bounded

    v = vectors(spark, sf_dir)
    book = books_column(books(v))
    k = v.select("id", z.pq_encode("vec", book, PARTS).alias("code"))
    t = asked(v).select("qid", z.adc_table("q", book, PARTS, "ip").alias("t")).withColumn("one", F.lit(1))
    pairs = k.withColumn("one", F.lit(1)).join(bounded(t, 4096), "one")
    return shown(topk.top_k(pairs.select("qid", "id", F.round(z.adc_score(F.col("t"), F.col("code")), 12).alias("score")), K, "ip"))


_RES = f"""kr AS (SELECT id, list_no, LIST(code ORDER BY m) AS code FROM (SELECT id, list_no, m, ARG_MIN(code, (ROUND(POW(LIST_DISTANCE(r[m * {D // PARTS} + 1 : (m + 1) * {D // PARTS}], s), 2), 14), code)) AS code
FROM (SELECT id, list_no, [v[i] - c[i] FOR i IN RANGE(1, {D + 1})] AS r FROM e JOIN l USING (id) JOIN c USING (list_no)), b GROUP BY id, list_no, m) GROUP BY id, list_no),
xr AS (SELECT id, list_no, FLATTEN(LIST(s ORDER BY x.m)) AS x FROM (SELECT id, list_no, UNNEST(code) AS code, UNNEST(RANGE(LEN(code))) AS m FROM kr) x JOIN b ON b.m = x.m AND b.code = x.code GROUP BY id, list_no)"""
_GAP = "POW(LIST_DISTANCE([q[i] - c[i] FOR i IN RANGE(1, 65)], x), 2)"
query(also("e a c l w b", _RES + ", " + _probes(NPROBE, _BY_L2), ranked(_GAP, "p JOIN xr USING (list_no)", "ASC")), "ivf_pq_residual_topk")(_scanned("pq", "l2", K, NPROBE, True))


@query(
    also(
        "e a c l",
        """j AS (SELECT j, MIN(x) AS low, MAX(x) - MIN(x) AS span FROM (SELECT UNNEST(v) AS x, UNNEST(RANGE(LEN(v))) AS j FROM e) GROUP BY j), r AS (SELECT LIST(low ORDER BY j) AS low, LIST(span ORDER BY j) AS span FROM j),
y AS (SELECT id, [low[i] + (FLOOR(GREATEST(LEAST((v[i] - low[i]) / span[i], 1.0), 0.0) * 255) + 0.5) / 255 * span[i] FOR i IN RANGE(1, 65)] AS y FROM e, r)""",
        ranked("POW(LIST_DISTANCE(q, y), 2)", "a, y", "ASC"),
    )
)
def sq8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists, entries in eight bits for each dimension."""
    v = vectors(spark, sf_dir)
    r = {x["j"]: (x["low"], x["span"]) for x in statistics.per_dimension(v, "vec").collect()}  # one row a dimension
    low, span = (np.array([r[j][i] for j in range(D)]) for i in (0, 1))
    p = Params("l2", D, "sq8", low=low, span=span)
    index, c = _index(v, p)
    return shown(ivf.search(index, asked(v), c, p, K, 1 << 20))


_SIZES = "n AS (SELECT list_no, COUNT(*) AS n FROM l GROUP BY list_no)"


@query(also("e a c l", _SIZES + ", " + _probes(1 << 20, _BY_L2), "SELECT qid, list_no FROM (SELECT qid, list_no, COALESCE(SUM(n) OVER (PARTITION BY qid ORDER BY \"order\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN n USING (list_no)) WHERE before < 150"))
def ivf_max_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists a query visits until it has seen 150 entries."""
    v = vectors(spark, sf_dir)
    c = centroids(v)
    sizes = statistics.list_sizes(ivf.assign(v, c))
    return ivf.capped(ivf.probe(asked(v), c, 1 << 20, "l2"), sizes, 150).select("qid", "list_no")


@query()
def ivf_early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing ends after two lists in a row that bring fewer than two of the ten best."""
    v = vectors(spark, sf_dir)
    p = params(v, "ip")
    index, c = _index(v, p)
    probes = ivf.probe(asked(v), c, 1 << 20, "ip")
    found = ivf.scan(index, asked(v), probes, p, K, per_list=True)
    return shown(ivf.early_stop(found, probes, K, 2, 2, "ip"))


@query(also("e a c li", _probes(), f"SELECT qid, id, ROUND({_IP}, 6) AS score FROM p JOIN li USING (list_no) JOIN e USING (id) WHERE {_IP} > 0.25"))
def ivf_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    p = params(v, "ip")
    index, c = _index(v, p)
    return shown(ivf.range_scan(index, asked(v), c, p, 0.25, NPROBE))


_CANDIDATES = f"""f AS (SELECT qid, id FROM (SELECT qid, id, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND({_ADC}, 12) DESC, id) AS r FROM p JOIN li USING (list_no) JOIN k USING (id) JOIN t USING (qid) WHERE {{}}) WHERE r <= {K * FACTOR})"""
_T = _TABLES.format("ti") + ", " + _probes() + ", "


def _two_phase(v: DataFrame, deleted: DataFrame | None = None, nprobe: int = NPROBE, factor: float = FACTOR) -> DataFrame:
    p = params(v, "ip", "pq")
    index, c = _index(v, p)
    return ivf.two_phase(index, v, asked(v), c, p, K, nprobe, factor, deleted)


@query(also("e a c li w b k ti", _T + _CANDIDATES.format("TRUE"), ranked(_IP, "f JOIN a USING (qid) JOIN e USING (id)")))
def ivf_pq_refine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two-phase query: probe, scan of codes for ten times k candidates, exact ranking."""
    return shown(_two_phase(vectors(spark, sf_dir)))


@query(also("e a c li w b k ti", _T + _CANDIDATES.format("id % 7 <> 0"), ranked(_IP, "f JOIN a USING (qid) JOIN e USING (id)")))
def ivf_pq_refine_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted ids take no place among the candidates and are in no answer."""
    v = vectors(spark, sf_dir)
    return shown(_two_phase(v, v.filter("id % 7 = 0").select("id")))


@query(sql("e a", ranked(_IP, "a, e")))
def ivf_all_lists_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists and enough candidates: the exact answer."""
    return shown(_two_phase(vectors(spark, sf_dir), None, 1 << 20, 1_000))


@query(also("e a c li w b k ti ke", _T + f"s AS ({ranked(_ADC, 'p JOIN li USING (list_no) JOIN k USING (id) JOIN t USING (qid)')}), y AS (SELECT id, FLATTEN(LIST([ROUND(x, 6) FOR x IN s] ORDER BY ke.m)) AS y FROM ke JOIN b ON ke.m = b.m AND ke.code = b.code GROUP BY id)", "SELECT qid, id, rank, code, y FROM s JOIN k USING (id) JOIN y USING (id)"))
def search_and_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results with their codes and reconstructed vectors."""
    v = vectors(spark, sf_dir)
    p = params(v, "ip", "pq")
    index, c = _index(v, p)
    found = shown(ivf.search(index, asked(v), c, p, K, NPROBE)).drop("score")
    return found.join(ivf.entries(index, p), "id").select("qid", "id", "rank", "code", F.transform("vec", lambda x: F.round(x, 6)).alias("y"))


@query(also("e a c li w b k ti", _T + _CANDIDATES.format("TRUE") + f", s AS ({ranked(_IP, 'f JOIN a USING (qid) JOIN e USING (id)')})", "SELECT qid, id, rank, COALESCE(SHA256(text), '') AS value FROM s LEFT JOIN documents ON doc_id = id"))
def client_query_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search and fetch: the (digests of the) documents of the ids found, empty where there is none."""
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("value"))
    return documents.fetch(shown(_two_phase(vectors(spark, sf_dir))).drop("score"), store, "id").select("qid", "id", "rank", "value")


@query(
    also(
        "e a c l w b k ke",
        f"y AS (SELECT id, FLATTEN(LIST(s ORDER BY ke.m)) AS y FROM ke JOIN b ON ke.m = b.m AND ke.code = b.code GROUP BY id), g AS ({ranked(_IP, 'a, e')})",
        "SELECT qid, id, ROUND(LIST_INNER_PRODUCT(q, v), 6) AS raw, ROUND(LIST_INNER_PRODUCT(q[1:32], v[1:32]), 6) AS reduced, ROUND(LIST_INNER_PRODUCT(q, c), 6) AS list, ROUND(LIST_INNER_PRODUCT(q, y), 6) AS quantised, a.label = e.label AS same FROM g JOIN (SELECT id AS qid, v AS q, label FROM e) a USING (qid) JOIN e USING (id) JOIN l USING (id) JOIN c USING (list_no) JOIN y USING (id)",
    )
)
def distance_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of queries and their neighbours by the vectors, their first half, the list's centroid and the reconstruction, and whether labels agree."""
    v = vectors(spark, sf_dir)
    book = books_column(books(v))
    c = centroids(v)
    g = exact.knn(asked(v), v, K, "ip").select("qid", "id")
    near = v.join(ivf.assign(v, c), "id").join(F.broadcast(c), "list_no").withColumn("y", z.pq_decode(z.pq_encode("vec", book, PARTS), book))
    q = v.select(F.col("id").alias("qid"), F.col("vec").alias("q"), F.col("label").alias("ql"))
    r = lambda x: F.round(x, 6)
    return g.join(near, "id").join(q, "qid").select("qid", "id", r(m.dot("q", "vec")).alias("raw"), r(m.dot(m.truncated("q", 32), m.truncated("vec", 32))).alias("reduced"), r(m.dot("q", "c")).alias("list"), r(m.dot("q", "y")).alias("quantised"), (F.col("label") == F.col("ql")).alias("same"))


@query(
    f"""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), a AS (SELECT id AS qid, v AS q FROM e WHERE id % 20 = 0),
w AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY id) - 1 AS BIGINT) AS code, v FROM (SELECT id, v FROM e ORDER BY id LIMIT 16)),
g AS (SELECT qid, x.code + 16 * y.code AS id, POW(LIST_DISTANCE(q[1:32], x.v[1:32]), 2) + POW(LIST_DISTANCE(q[33:64], y.v[33:64]), 2) AS score FROM a, w x, w y)
SELECT qid, id, ROUND(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND(score, 12), id) AS rank FROM g) WHERE rank <= {K}"""
)
def multi_index_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a product of two sets of centroids, one for each half of the dimensions."""
    v = vectors(spark, sf_dir)
    x = np.array([r["vec"] for r in v.select("id", "vec").orderBy("id").limit(16).collect()], float)
    return shown(ivf.product_probe(asked(v), np.ascontiguousarray(x.reshape(len(x), 2, 32).transpose(1, 0, 2)), K))


@query(also("e c l", "n AS (SELECT list_no, COUNT(*) AS n FROM l GROUP BY list_no)", "SELECT list_no, n FROM n"))
def list_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coarse_assign(spark, sf_dir).transform(statistics.list_sizes)


@query(also("e c l", _SIZES, "SELECT ROUND((SELECT COUNT(*) FROM c) * SUM(n * n) / POW(SUM(n), 2), 9) AS imbalance FROM n"))
def imbalance_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    c = centroids(v)
    return statistics.imbalance(statistics.list_sizes(ivf.assign(v, c)), c.count()).select(F.round("imbalance", 9).alias("imbalance"))


@query("SELECT CAST(FLOOR(LOG2(n)) AS INTEGER) AS bits, COUNT(*) AS lists FROM (SELECT user_id, COUNT(*) AS n FROM events GROUP BY user_id) GROUP BY bits")
def list_size_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.size_classes(statistics.list_sizes(table(spark, sf_dir, "events"), "user_id"))


@query(also("e c l", _SIZES, f"SELECT CAST(SUM(n) AS BIGINT) AS ntotal, COUNT(*) AS lists, CAST(SUM(n) AS BIGINT) * {PARTS + 8} AS bytes FROM n"))
def collection_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, lists and bytes of an index of codes."""
    v = vectors(spark, sf_dir)
    index, _ = _index(v, params(v, "l2", "pq"))
    size = F.sum(F.length("ids") + F.length("data")).cast("bigint")
    return index.agg(F.sum("n").cast("bigint").alias("ntotal"), F.count_distinct("list_no").alias("lists"), size.alias("bytes"))


@query(also("e c", "h AS (SELECT id, label AS list_no, [CAST(FLOOR(x * 2) AS INTEGER) FOR x IN v[1:4]] AS code FROM e), g AS (SELECT list_no, code, MIN(id) AS first FROM h GROUP BY ALL HAVING COUNT(*) > 1)", "SELECT list_no, first, id FROM h JOIN g USING (list_no, code)"))
def find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a list with equal (here very coarse) codes."""
    v = vectors(spark, sf_dir)
    return statistics.equal_codes(v.select("id", F.col("label").alias("list_no"), F.transform(F.slice("vec", 1, 4), lambda x: F.floor(x * 2).cast("int")).alias("code")))


@query(also("e a c l", _SIZES + ", " + _probes(NPROBE, _BY_L2), "SELECT CAST(COUNT(DISTINCT qid) AS BIGINT) AS nq, COUNT(*) AS nlist, CAST(SUM(n) AS BIGINT) AS ndis FROM p JOIN n USING (list_no)"))
def search_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries, lists probed and entries compared."""
    v = vectors(spark, sf_dir)
    c = centroids(v)
    p = ivf.probe(asked(v), c, NPROBE, "l2").join(F.broadcast(statistics.list_sizes(ivf.assign(v, c))), "list_no")
    return p.agg(F.count_distinct("qid").alias("nq"), F.count("*").alias("nlist"), F.sum("n").cast("bigint").alias("ndis"))


@query()
def ivf_recall_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at ten of the two-phase search with trained parameters, for several nprobe and k_factor."""
    v = vectors(spark, sf_dir)
    x = training.sample(v)
    p = Params("ip", D, "pq", training.train_pq(x, PARTS))
    c = cut(training.vectors_frame(spark, training.kmeans(v, 16, 8, spherical=True)[0]))
    index = cut(ivf.build(v, c, p))
    truth = cut(exact.knn(asked(v), v, K, "ip"))
    out = None
    for nprobe in (1, 4, 16):
        for factor in (1, 10):
            found = ivf.two_phase(index, v, asked(v), c, p, K, nprobe, factor)
            row = topk.recall(found, truth).select(F.lit(nprobe).alias("nprobe"), F.lit(factor).alias("k_factor"), F.round("recall", 6).alias("recall"))
            out = row if out is None else out.union(row)
    return out


@query(also("e a c li", f"s AS ({ranked(_IP, 'a, e')})", "SELECT qid, id, CAST(list_no AS INTEGER) AS list_no FROM s JOIN li USING (id)"))
def reconstruct_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists in which the answers of an exact search lie."""
    v = vectors(spark, sf_dir)
    return exact.knn(asked(v), v, K, "ip").select("qid", "id").join(ivf.assign(v, centroids(v), "ip"), "id").select("qid", "id", "list_no")


@query(also("e c l", "o AS (SELECT list_no, id, v, ROW_NUMBER() OVER (PARTITION BY list_no ORDER BY id) - 1 AS o FROM l JOIN e USING (id))", "SELECT list_no, o AS \"offset\", id, v AS vec FROM o WHERE o IN (0, 3)"))
def reconstruct_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by their places inside lists."""
    v = vectors(spark, sf_dir)
    entries = v.select("id", "vec").join(ivf.assign(v, centroids(v)), "id")
    wanted = centroids(v).select("list_no", F.explode(F.array(F.lit(0), F.lit(3))).alias("offset"))
    return maintenance.at_offset(entries, wanted).select("list_no", "offset", "id", "vec")
