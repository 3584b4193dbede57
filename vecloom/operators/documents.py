"""A store of documents ``key, xid, value``: ids given out in contiguous ranges, last write wins, fetching in the order asked.

Defined results: null keys and ids are fetched as empty values and never stored; a key written twice in one batch keeps its last row by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut
from .maintenance import latest, upsert


def numbered(df: DataFrame, *order: str, first: int = 0, name: str = "xid") -> DataFrame:
    """Rows numbered without gaps in the order given. Ranges of rows are sorted apart; only their sizes are added up, so no task sees all rows."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("_no", place).join(F.broadcast(sizes), "_part").withColumn(name, (F.col("_before") + F.col("_no") - 1 + first).cast("bigint")).drop("_part", "_no", "_before")


def put(store: DataFrame, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """The store with a batch ``key, value, seq``: known keys keep their id and take the new value, new ones get the ids after the greatest."""
    last = latest(batch.select("key", "value", seq), "key", seq).select("key", "value")
    known = last.join(store.select("key", "xid"), "key")
    top = store.agg(F.max("xid").alias("m")).first()["m"]
    new = numbered(last.join(store.select("key"), "key", "left_anti"), "key", first=0 if top is None else top + 1)
    return upsert(store.select("key", "xid", "value"), known.select("key", "xid", "value").unionByName(new.select("key", "xid", "value")), "key")


def fetch(asked: DataFrame, store: DataFrame, on: str = "xid") -> DataFrame:
    """``asked`` (with ``pos`` and the key or id) with ``value``, empty where there is none."""
    have = store.filter(F.col(on).isNotNull()).select(on, "value")
    return asked.join(have, on, "left").withColumn("value", F.coalesce("value", F.lit("")))


def fetched_lists(asked: DataFrame, store: DataFrame, by: str = "qid", on: str = "xid", ids: str = "ids") -> DataFrame:
    """For rows with an array of ids the array of values in the same order."""
    single = asked.select(by, F.posexplode_outer(ids).alias("pos", on))
    lists = fetch(single, store, on).groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("values"))
    return asked.select(by, ids).join(lists, by)


def deleted(store: DataFrame, ids: DataFrame, on: str = "xid") -> DataFrame:
    return store.join(ids.select(on).distinct(), on, "left_anti")
