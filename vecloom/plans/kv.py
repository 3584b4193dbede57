"""Key-value queries on the log of events: a key for each user, the event's number as version, errors as deletions, some entries with an expiry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, kv
from ..runtime import cut, scratch, table
from ..streaming import versions as streamed
from .common import Registry

query = Registry()
QUERIES, ORACLES = query.queries, query.oracles
NOW = 1_700_005_000  # some of the expiries lie before it
BASE = 1_700_000_000


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return as_log(e)


def as_log(e: DataFrame) -> DataFrame:
    return e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_id").alias("version"), F.col("props").alias("value"),
        (F.when(F.col("event_type") == "error", kv.DELETED).otherwise(0) + F.when(F.col("event_type") == "signup", kv.DISCARD_EARLIER).otherwise(0)).alias("meta"),
        F.lit(0).alias("user_meta"), F.when(F.col("event_id") % 11 == 0, F.lit(BASE) + F.col("event_id")).otherwise(0).cast("bigint").alias("expires_at"),
    )


_LOG = f"""WITH g AS (SELECT 'u' || user_id AS key, event_id AS version, props AS value, CASE event_type WHEN 'error' THEN 1 WHEN 'signup' THEN 4 ELSE 0 END AS meta, 0 AS user_meta,
CASE WHEN event_id % 11 = 0 THEN {BASE} + event_id ELSE 0 END AS expires_at, event_type = 'error' OR (event_id % 11 = 0 AND {BASE} + event_id <= {NOW}) AS dead FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL)"""


def _state(where: str = "TRUE") -> str:
    return _LOG + f", s AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM g WHERE {where}) WHERE r = 1 AND NOT dead)\n"


_COLS = "key, version, value, meta, user_meta, expires_at"


@query(_state() + f"SELECT {_COLS} FROM s")
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.visible(event_log(spark, sf_dir), NOW)


@query(_state("version <= 4000") + f"SELECT {_COLS} FROM s")
def kv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state as of a version."""
    return kv.visible(event_log(spark, sf_dir), NOW, read_ts=4000)


@query(_state() + f"SELECT {_COLS} FROM s WHERE key = 'u17'")
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get(event_log(spark, sf_dir), "u17", NOW)


@query(_state() + "SELECT k.key AS key, s.key IS NOT NULL AS found, COALESCE(s.value, '') AS value FROM (SELECT 'u' || c_custkey AS key FROM customer) k LEFT JOIN s ON s.key = k.key")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all customers; unknown, deleted and expired ones have an empty value."""
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("key"))
    return kv.multi_get(event_log(spark, sf_dir), keys, NOW)


@query(_state() + f"SELECT {_COLS} FROM s WHERE key >= 'u3' ORDER BY key LIMIT 25")
def kv_scan_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(event_log(spark, sf_dir), NOW, count=25, start="u3")


@query(_state() + f"SELECT {_COLS} FROM s WHERE key >= 'u3' AND key <= 'u59'")
def kv_scan_endkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end key is included."""
    return kv.scan(event_log(spark, sf_dir), NOW, start="u3", end="u59")


@query(_state() + f"SELECT {_COLS} FROM s WHERE key >= 'u7'")
def kv_scan_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(event_log(spark, sf_dir), NOW, start="u7")


@query(_state() + f"SELECT {_COLS} FROM s WHERE STARTS_WITH(key, 'u1')")
def kv_scan_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(event_log(spark, sf_dir), NOW, prefix="u1")


@query(_state() + f"SELECT {_COLS} FROM s ORDER BY key DESC LIMIT 40")
def kv_scan_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(event_log(spark, sf_dir), NOW, count=40, reverse=True)


@query(_LOG + f" SELECT {_COLS} FROM g")
def kv_all_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions and expired entries too."""
    return kv.versions(event_log(spark, sf_dir))


@query(_LOG + f" SELECT {_COLS} FROM g WHERE version > 900 AND version <= 4000 AND STARTS_WITH(key, 'u1')")
def kv_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.versions(event_log(spark, sf_dir), read_ts=4000, since=900, prefix="u1")


@query(_LOG + f", i AS (SELECT CASE WHEN version % 10 = 0 THEN '!store!' || key ELSE key END AS key, * EXCLUDE (key) FROM g), s AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM i) WHERE r = 1 AND NOT dead) SELECT {_COLS} FROM s WHERE NOT STARTS_WITH(key, '!store!')")
def kv_internal_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the store itself aren't seen."""
    g = event_log(spark, sf_dir)
    return kv.visible(g.withColumn("key", F.when(F.col("version") % 10 == 0, F.concat(F.lit(kv.INTERNAL), "key")).otherwise(F.col("key"))), NOW)


@query(f"SELECT 'o' || o_orderkey AS key, o_orderkey AS version, o_orderstatus AS value, 0 AS meta, 0 AS user_meta, {BASE} + 60 * (o_orderkey % 100) AS expires_at FROM orders WHERE {BASE} + 60 * (o_orderkey % 100) > {NOW}")
def kv_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders put with a time to live, read later."""
    o = table(spark, sf_dir, "orders")
    put = kv.put(o, F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.col("o_orderkey"), F.col("o_orderstatus"), 60 * (F.col("o_orderkey") % 100), BASE)
    return kv.visible(put, NOW)


@query(_LOG + ", d AS (SELECT 'u' || c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING') " + f"SELECT {_COLS} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM g) WHERE r = 1 AND NOT dead AND key NOT IN (SELECT key FROM d)")
def kv_put_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with newer tombstones for the customers of one segment."""
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    tombs = kv.delete(gone, F.concat(F.lit("u"), F.col("c_custkey").cast("string")), F.lit(1 << 40))
    return kv.visible(event_log(spark, sf_dir).unionByName(tombs), NOW)


def _compact(keep: int, discard: int | None, overlap: bool) -> str:
    old = "TRUE" if discard is None else f"version <= {discard}"
    return (
        _LOG + f""", o AS (SELECT * FROM g WHERE {old} AND NOT STARTS_WITH(key, 'u9')), f AS (SELECT * FROM g WHERE NOT ({old}) AND NOT STARTS_WITH(key, 'u9')),
x AS (SELECT *, MAX(CASE WHEN dead OR meta = 4 THEN version END) OVER (PARTITION BY key) AS stop, ROW_NUMBER() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM o)
SELECT {_COLS} FROM x WHERE r <= {keep} AND (stop IS NULL OR version >= stop) AND ({'TRUE' if overlap else 'NOT dead'}) UNION ALL SELECT {_COLS} FROM f"""
    )


@query(_compact(1, None, False))
def kv_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.compacted(event_log(spark, sf_dir), NOW, drop_prefixes=["u9"])


@query(_compact(3, 6000, True))
def kv_compact_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of a key are kept, those newer than the read watermark anyway, and tombstones, as deeper levels may hold the key."""
    return kv.compacted(event_log(spark, sf_dir), NOW, 3, 6000, ["u9"], overlap=True)


@query(_LOG + f" SELECT key, version, CASE WHEN version % 3 = 0 THEN 'new' ELSE value END AS value, meta, user_meta, expires_at FROM g")
def kv_merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with common versions: the newer run wins."""
    g = event_log(spark, sf_dir)
    return kv.merge_runs([g.filter("version % 3 = 0").withColumn("value", F.lit("new")), g])


@query(_state() + f"SELECT {_COLS} FROM s WHERE key >= 'u2' AND key <= 'u4'")
def kv_sorted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written as files of key ranges and read back by range."""
    path = scratch(spark, "log")
    kv.write_sorted(event_log(spark, sf_dir), path)
    return kv.visible(kv.read_sorted(spark, path), NOW, start="u2", end="u4")


@query("SELECT MAX(event_id) AS max_version FROM events WHERE user_id IS NOT NULL")
def kv_max_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.max_version(event_log(spark, sf_dir))


@query(_LOG + " SELECT key, version, value, meta <> 1 AS present FROM g WHERE version > 900")
def kv_change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed.feed(event_log(spark, sf_dir), 900)


@query(_LOG + " SELECT key, version, CASE WHEN NOT dead THEN value END AS value, NOT dead AS present FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY key ORDER BY version DESC) AS r FROM g) WHERE r = 1")
def kv_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream, in batches: the last row written for each key is its state."""
    shuffled = scratch(spark, "arriving")
    event_log(spark, sf_dir).repartition(3, F.xxhash64("version")).write.parquet(shuffled)  # three files in no order of versions
    stream = spark.readStream.schema(kv.LOG).option("maxFilesPerTrigger", 1).parquet(shuffled)
    path = scratch(spark, "changes")
    streamed.to_table(streamed.latest(stream, NOW), path, scratch(spark, "state")).awaitTermination()
    out = spark.read.schema(streamed.CHANGES).parquet(f"{path}/batch=*")
    return out.groupBy("key").agg(F.max(F.struct("version", "value", "present")).alias("m")).select("key", "m.version", "m.value", "m.present")


@query(_state() + f"SELECT {_COLS} FROM s")
def kv_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State from log files written in several appends, some of them twice."""
    path = scratch(spark, "wal")
    g = cut(event_log(spark, sf_dir))
    for part in (1, 0, 1):
        g.filter(F.col("version") % 2 == part).write.mode("append").parquet(path)
    return kv.visible(spark.read.schema(kv.LOG).parquet(path), NOW)


@query("SELECT c_name AS key, CAST(ROW_NUMBER() OVER (ORDER BY c_name) + 99 AS BIGINT) AS xid FROM customer")
def xid_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous ids in the order of keys, without one task that sees all rows."""
    return documents.numbered(table(spark, sf_dir, "customer").select(F.col("c_name").alias("key")), "key", first=100)


@query("SELECT 'p' || o_custkey AS key, CAST(DENSE_RANK() OVER (ORDER BY 'p' || o_custkey) - 1 AS BIGINT) AS xid, value FROM (SELECT o_custkey, ARG_MAX(o_orderpriority, o_orderkey) AS value FROM orders GROUP BY o_custkey)")
def document_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches into a store of documents: ids are given once, the last value holds."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    empty = spark.createDataFrame([], "key string, xid bigint, value string")
    first = cut(documents.put(empty, o))
    return documents.put(first, o.withColumn("seq", F.col("seq") + 1))


@query("WITH s AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 <> 0) SELECT p.doc_id AS qid, i AS xid, SHA256(COALESCE(s.text, '')) AS digest, CAST(i - p.doc_id AS INTEGER) AS pos FROM documents p, UNNEST(RANGE(p.doc_id, p.doc_id + 3)) t(i) LEFT JOIN s ON s.doc_id = i")
def fetch_documents_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ids for each row, some unknown, in the order asked."""
    d = table(spark, sf_dir, "documents")
    asked = d.select(F.col("doc_id").alias("qid"), F.sequence(F.col("doc_id"), F.col("doc_id") + 2).alias("ids"))
    store = d.filter("doc_id % 3 != 0").select(F.col("doc_id").alias("xid"), F.col("text").alias("value"))
    single = asked.select("qid", F.posexplode("ids").alias("pos", "xid"))
    return documents.fetch(single, store).select("qid", "xid", F.sha2("value", 256).alias("digest"), "pos")
