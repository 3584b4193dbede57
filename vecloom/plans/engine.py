"""The library as a whole: sources, checkpoints, collections, embedding, prompts, streams of insertions, statistics of calls."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..operators import exact, ivf
from ..runtime import cut, hadoop_path, scratch, table
from ..sources import checkpoints, matrices
from ..streaming import inserts
from .common import D, K, Registry, asked, centroids, params, ranked, shown, sql, vectors
from .index import also

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles


@query(sql("e", "SELECT CAST(ROW_NUMBER() OVER (ORDER BY id) - 1 AS BIGINT) AS id, [CAST(x AS FLOAT) FOR x IN v] AS vec FROM e"))
def raw_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors as one raw file of floats, read back as splittable records."""
    path = f"{scratch(spark, 'raw')}/x.bin"
    matrices.write_floats(vectors(spark, sf_dir), path)
    return matrices.read_floats(spark, path, D)


@query(sql("e", "SELECT CAST((id) // 2 AS BIGINT) AS qid, CAST(id AS BIGINT) AS id, CAST(id % 2 + 1 AS INTEGER) AS rank FROM e"))
def raw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw file of ground-truth ids (here of ids in order, two to a query)."""
    path = f"{scratch(spark, 'raw')}/gt.bin"
    ids = np.array(sorted(r["id"] for r in vectors(spark, sf_dir).select("id").collect()), "<i4")
    fs, p = hadoop_path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(ids.tobytes()))
    out.close()
    return matrices.read_neighbours(spark, path, 2)


def _tables(v: DataFrame) -> dict[str, DataFrame]:
    """All that an index consists of."""
    p = params(v, "ip", "pq")
    c = centroids(v)
    spark = v.sparkSession
    rows = [("books", m, [float(x) for x in b.ravel()]) for m, b in enumerate(p.books)] + [("a", i, [float(x) for x in r]) for i, r in enumerate(np.eye(D))]
    named = c.select(F.lit("centroids").alias("name"), F.col("list_no").alias("no"), F.col("c").alias("value"))
    return {"params": spark.createDataFrame(rows, "name string, no int, value array<double>").unionByName(named), "postings": ivf.build(v, cut(c), p), "vectors": v.select("id", "vec"), "deleted": v.filter("id % 7 = 0").select("id")}


@query(sql("e c li w b k", "SELECT list_no, id, code FROM li JOIN k USING (id)"))
def checkpoint_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint written and its filter side loaded: the entries of the lists."""
    v = vectors(spark, sf_dir)
    path = scratch(spark, "collection")
    checkpoints.write(spark, path, _tables(v), {"postings": "list_no"})
    held = checkpoints.read(spark, path, 1)
    assert "vectors" not in held
    return ivf.entries(held["postings"], params(v, "ip", "pq")).select(F.col("list_no").cast("int").alias("list_no"), "id", "code")


@query(sql("e", "SELECT id, v AS vec FROM e"))
def checkpoint_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The refine side of a checkpoint."""
    path = scratch(spark, "collection")
    checkpoints.write(spark, path, _tables(vectors(spark, sf_dir)))
    held = checkpoints.read(spark, path, 2)
    assert "postings" not in held
    return held["vectors"]


@query(also("e c w b", "x AS (SELECT 'centroids' AS name, list_no AS no, c AS value FROM c UNION ALL SELECT 'books', m, FLATTEN(LIST(s ORDER BY code)) FROM b GROUP BY m)", "SELECT name, CAST(no AS INTEGER) AS no, [ROUND(y, 6) FOR y IN value] AS value FROM x"))
def checkpoint_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters only, from the newest of two checkpoints."""
    path = scratch(spark, "collection")
    p = _tables(vectors(spark, sf_dir))["params"]
    checkpoints.write(spark, path, {"params": p.filter("name = 'a'")})
    checkpoints.write(spark, path, {"params": p.filter("name != 'a'")})
    return checkpoints.read(spark, path, 1)["params"].select("name", "no", F.transform("value", lambda y: F.round(y, 6) + F.lit(0.0)).alias("value"))


@query("SELECT collection_name, CAST(CASE WHEN metric_type = 1 THEN 1 ELSE 0 END AS INTEGER) AS version FROM collection_info")
def list_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint for each known collection, two for those of inner products."""
    root = scratch(spark, "root")
    for r in table(spark, sf_dir, "collection_info").select("collection_name", "metric_type").collect():
        for _ in range(2 if r["metric_type"] == 1 else 1):
            checkpoints.write(spark, f"{root}/{r['collection_name']}", {"deleted": spark.createDataFrame([], "id bigint")})
    return checkpoints.collections(spark, root)


@query(sql("e a", ranked("LIST_INNER_PRODUCT(q, v)", "a, e WHERE id % 7 <> 0 OR id % 14 = 0")))
def engine_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, add, delete, add again, checkpoint, load anew, search."""
    v = vectors(spark, sf_dir).select("id", "vec")
    root = scratch(spark, "root")
    first = api.Engine(spark, root)
    first.load("c")
    first.add("c", v)
    first.delete("c", v.filter("id % 7 = 0"))
    first.add("c", v.filter("id % 14 = 0"))
    first.checkpoint("c")
    again = api.Engine(spark, root)
    again.load("c")
    return shown(again.search("c", asked(v), api.SearchParams(K)))


@query(sql("e a", ranked("LIST_INNER_PRODUCT(q, v)", "a, e")))
def engine_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-phase collection with all lists probed and enough candidates gives the exact answer."""
    v = vectors(spark, sf_dir)
    made = api.Engine(spark, scratch(spark, "root")).load("c", make=api.IvfCollection, params=params(v, "ip", "pq"), centroids=cut(centroids(v)))
    made.add(v)
    return shown(made.search(asked(v), api.SearchParams(K, 1 << 20, 1_000)))


@query("SELECT id, text FROM (SELECT id, text, ROW_NUMBER() OVER (PARTITION BY id ORDER BY loaded_at DESC, text DESC) AS r FROM (SELECT id, loaded_at, CONCAT_WS(CHR(10), final_decision, text) AS text FROM pubmedqa WHERE id IS NOT NULL)) WHERE r = 1")
def ingest_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records mapped to ``id, text``: label and text joined by line ends, the delivery loaded last."""
    rows = table(spark, sf_dir, "pubmedqa").filter("id is not null").select("id", "loaded_at", F.concat_ws("\n", "final_decision", "text").alias("text"))
    return rows.groupBy("id").agg(F.max(F.struct("loaded_at", "text")).alias("m")).select("id", "m.text")


@query()
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evaluation passages as vectors of a deterministic embedder."""
    out = api.embedded(table(spark, sf_dir, "eval_item").select("item_id", "passage"), api.HashingEmbedder(D), "passage")
    return out.select("item_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query()
def client_query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages as queries against the passages in a collection: each finds itself first."""
    items = table(spark, sf_dir, "eval_item").filter("passage is not null").select(F.col("item_id").alias("qid"), F.col("passage").alias("text"))
    embedder = api.HashingEmbedder(D)
    c = api.FlatCollection(spark, scratch(spark, "c"))
    c.add(cut(api.embedded(items, embedder).select(F.col("qid").alias("id"), "vec")))
    store = items.select(F.col("qid").alias("xid"), F.col("text").alias("value"))
    found = api.client_query(items, embedder, c, store, api.SearchParams(3))
    return found.select("qid", "id", "rank", F.sha2("value", 256).alias("digest"))


@query()
def coordinator_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages embedded, stored and added in one call: ids, keys and whether each has its vector."""
    batch = table(spark, sf_dir, "eval_item").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("key"), F.col("passage").alias("value"), F.lit(1).alias("seq"))
    store, c = api.TableStore(spark), api.FlatCollection(spark, scratch(spark, "c"))
    api.coordinator_add(batch, api.HashingEmbedder(D), c, store)
    return store.table.join(c.vectors().select(F.col("id").alias("xid"), F.size("vec").alias("d")), "xid").select("xid", "key", "d")


@query("SELECT item_id, [COALESCE(w[i], '[PAD]') FOR i IN RANGE(1, 17)] AS tokens, [CASE WHEN i <= LEN(w) THEN 1 ELSE 0 END FOR i IN RANGE(1, 17)] AS mask FROM (SELECT item_id, REGEXP_EXTRACT_ALL(LOWER(COALESCE(passage, '')), '[\\p{L}\\p{N}]+') AS w FROM eval_item)")
def padded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs of fixed length for a text model."""
    t = api.padded_tokens(F.col("passage"), 16)
    return table(spark, sf_dir, "eval_item").select("item_id", t.alias("t")).select("item_id", "t.tokens", "t.mask")


_PROMPT = f"""s AS (SELECT qid, id, ROW_NUMBER() OVER (PARTITION BY qid ORDER BY ROUND(LIST_INNER_PRODUCT(q, v), 12) DESC, id) AS rank FROM a, e),
f AS (SELECT qid, STRING_AGG(SHA256(COALESCE(text, '')), CHR(10) ORDER BY rank) AS v FROM s LEFT JOIN documents ON doc_id = id WHERE rank <= {K} GROUP BY qid)"""


@query(also("e a", _PROMPT, "SELECT qid, 'Answer by the context.' || CHR(10) || v || CHR(10) || 'Which label has ' || qid || '?' AS prompt FROM f"))
def rag_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of a question and the (digests of the) documents found for it."""
    v = vectors(spark, sf_dir)
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("value"))
    found = exact.knn(asked(v), v, K, "ip").join(store, "id", "left").withColumn("value", F.sha2(F.coalesce("value", F.lit("")), 256))
    questions = asked(v).select("qid", F.concat(F.lit("Which label has "), F.col("qid").cast("string"), F.lit("?")).alias("question"))
    return api.prompts(questions, found, most=K)


@query(sql("e c l w b k", "SELECT list_no, id, code FROM l JOIN k USING (id)"))
def stream_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors arrive as a stream; each micro-batch is assigned, encoded and appended."""
    v = vectors(spark, sf_dir)
    arriving, path = scratch(spark, "arriving"), scratch(spark, "postings")
    v.select("id", "vec").repartition(3, "id").write.parquet(arriving)
    p, c = params(v, "l2", "pq"), cut(centroids(v))
    stream = spark.readStream.schema("id bigint, vec array<double>").option("maxFilesPerTrigger", 1).parquet(arriving)
    inserts.into_folder(stream, path, scratch(spark, "state"), lambda batch: ivf.build(batch, c, p)).awaitTermination()
    return ivf.entries(spark.read.schema(ivf.BLOCKS).parquet(f"{path}/batch=*"), p).select("list_no", "id", "code")


@query(
    """SELECT event_type AS model, COUNT(*) AS calls, MAX(ts) AS last_call, ROUND(AVG(CASE WHEN gap IS NOT NULL THEN gap END), 3) AS interarrival, ROUND(AVG(value), 6) AS exec_time FROM
(SELECT *, EPOCH_US(ts) - EPOCH_US(LAG(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)) AS gap FROM events WHERE event_type IS NOT NULL) GROUP BY event_type"""
)
def model_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each model, the last of them, the mean time between calls (microseconds) and of a call. The mean gap of a series is its whole length over the number of
    gaps, so no model's calls have to be brought into order."""
    e = table(spark, sf_dir, "events").filter("event_type is not null")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    out = e.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.max("ts").alias("last_call"), F.min(t).alias("a"), F.max(t).alias("b"), F.round(F.avg("value"), 6).alias("exec_time"))
    gap = F.when(F.col("calls") > 1, F.round((F.col("b") - F.col("a")) / (F.col("calls") - 1), 3))
    return out.select("model", "calls", "last_call", gap.alias("interarrival"), "exec_time")
