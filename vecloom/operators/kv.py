"""Ordered, versioned key-value data: an append-only log ``key, version, value, meta, user_meta, expires_at`` and queries on it.

Versions decide, not the order of arrival, so late and repeated entries change nothing but what they should. Time is an argument (``now``, in seconds),
never the clock. Keys compare by their bytes.

Defined results: rows with a null key or version take no part; null meta and expires_at stand for 0; of several entries of one key and version the greatest
(by meta, expiry, value) counts; an empty log has nothing; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELETED, POINTER, DISCARD_EARLIER = 1, 2, 4
INTERNAL = "!store!"  # prefix of the store's own keys
LOG = "key string, version bigint, value string, meta int, user_meta int, expires_at bigint"
COLUMNS = ["key", "version", "value", "meta", "user_meta", "expires_at"]


def log(df: DataFrame) -> DataFrame:
    """The columns of the log with defaults applied."""
    has = set(df.columns)
    col = lambda c, t, d=None: (F.coalesce(F.col(c).cast(t), F.lit(d)) if d is not None else F.col(c).cast(t)).alias(c) if c in has else F.lit(d).cast(t).alias(c)
    rows = df.select(F.col("key"), F.col("version").cast("bigint").alias("version"), F.col("value"), col("meta", "int", 0), col("user_meta", "int", 0), col("expires_at", "bigint", 0))
    return rows.filter("key is not null and version is not null")


def put(df: DataFrame, key: Column, version: Column, value: Column, ttl: Column | None = None, now: int | None = None, discard_earlier: bool = False) -> DataFrame:
    """Entries to append; with ``ttl`` (seconds) they expire at ``now + ttl``."""
    if ttl is not None and now is None:
        raise ValueError("a time to live needs the time from which it counts")
    expires = F.lit(0) if ttl is None else F.lit(now) + ttl
    return df.select(
        key.alias("key"), version.cast("bigint").alias("version"), value.alias("value"), F.lit(DISCARD_EARLIER if discard_earlier else 0).alias("meta"),
        F.lit(0).alias("user_meta"), F.coalesce(expires.cast("bigint"), F.lit(0)).alias("expires_at"),
    )


def delete(df: DataFrame, key: Column, version: Column) -> DataFrame:
    """Tombstones to append."""
    return df.select(key.alias("key"), version.cast("bigint").alias("version"), F.lit(None).cast("string").alias("value"), F.lit(DELETED).alias("meta"), F.lit(0).alias("user_meta"), F.lit(0).cast("bigint").alias("expires_at"))


def dead(now: int) -> Column:
    """Deleted, or expired at ``now``."""
    expired = (F.col("expires_at") > 0) & (F.col("expires_at") <= now)
    return (F.col("meta").bitwiseAND(DELETED) != 0) | expired


def has_prefix(prefixes: str | list[str]) -> Column:
    out = F.lit(False)
    for p in [prefixes] if isinstance(prefixes, str) else prefixes:
        out = out | F.col("key").startswith(p)
    return out


def newest(rows: DataFrame) -> DataFrame:
    """The newest entry of every key. One aggregation, partial before the shuffle, so a key with most entries costs a task one row."""
    order = F.struct("version", "meta", "expires_at", "value", "user_meta")
    return rows.groupBy("key").agg(F.max(order).alias("m")).select("key", "m.version", "m.value", "m.meta", "m.user_meta", "m.expires_at")


def versions(df: DataFrame, read_ts: int | None = None, since: int | None = None, prefix: str | None = None, internal: bool = False) -> DataFrame:
    """All entries, tombstones and expired ones too, with ``since < version <= read_ts``; repeated entries once."""
    rows = log(df)
    if read_ts is not None:
        rows = rows.filter(F.col("version") <= read_ts)
    if since is not None:
        rows = rows.filter(F.col("version") > since)
    if prefix is not None:
        rows = rows.filter(F.col("key").startswith(prefix))
    if not internal:
        rows = rows.filter(~F.col("key").startswith(INTERNAL))
    order = F.struct("meta", "expires_at", "value", "user_meta")
    return rows.groupBy("key", "version").agg(F.max(order).alias("m")).select("key", "version", "m.value", "m.meta", "m.user_meta", "m.expires_at")


def visible(df: DataFrame, now: int, read_ts: int | None = None, since: int | None = None, start: str | None = None, end: str | None = None, prefix: str | None = None, internal: bool = False) -> DataFrame:
    """The state as of a version: for every key its newest entry up to ``read_ts``, unless that is dead at ``now`` (or not newer than ``since``).
    Keys from ``start`` to ``end``, both included."""
    rows = log(df)
    if read_ts is not None:
        rows = rows.filter(F.col("version") <= read_ts)
    if since is not None:
        rows = rows.filter(F.col("version") > since)
    if start is not None:
        rows = rows.filter(F.col("key") >= start)
    if end is not None:
        rows = rows.filter(F.col("key") <= end)
    if prefix is not None:
        rows = rows.filter(F.col("key").startswith(prefix))
    if not internal:
        rows = rows.filter(~F.col("key").startswith(INTERNAL))
    return newest(rows).filter(~dead(now))


def scan(df: DataFrame, now: int, count: int | None = None, reverse: bool = False, **where) -> DataFrame:
    """``visible`` in the order of keys, the first ``count`` if given."""
    rows = visible(df, now, **where).orderBy(F.col("key").desc() if reverse else F.col("key").asc())
    return rows if count is None else rows.limit(count)


def get(df: DataFrame, key: str, now: int, read_ts: int | None = None) -> DataFrame:
    """The entry of one key, or no row. The filter on the key reaches the scan."""
    return visible(df.filter(F.col("key") == key), now, read_ts)


def multi_get(df: DataFrame, keys: DataFrame, now: int, read_ts: int | None = None) -> DataFrame:
    """``key, found, value`` for every given key, repeated ones too; missing ones have an empty value."""
    from ..runtime import bounded

    wanted = keys.select("key")
    some = df.join(bounded(wanted.distinct(), 1_000_000), "key", "left_semi")
    state = visible(some, now, read_ts).select("key", "value", F.lit(True).alias("found"))
    return wanted.join(state, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), F.when(F.col("found"), F.col("value")).otherwise(F.lit("")).alias("value"))


def merge_runs(runs: list[DataFrame]) -> DataFrame:
    """Entries of sorted runs, newest run first: of equal keys and versions that of the newest run counts."""
    all_ = None
    for age, r in enumerate(runs):
        one = log(r).withColumn("age", F.lit(-age))
        all_ = one if all_ is None else all_.unionByName(one)
    order = F.struct("age", "meta", "expires_at", "value", "user_meta")
    return all_.groupBy("key", "version").agg(F.max(order).alias("m")).select("key", "version", "m.value", "m.meta", "m.user_meta", "m.expires_at")


def compacted(df: DataFrame, now: int, keep: int = 1, discard_ts: int | None = None, drop_prefixes: list[str] | None = None, overlap: bool = False) -> DataFrame:
    """What a compaction leaves: entries newer than ``discard_ts`` (the oldest version that is still read) all stay; of the others of a key, newest
    first, those up to the ``keep``-th, or up to the first that is dead or says that earlier ones are void. A dead entry itself goes, unless deeper
    levels may hold its key (``overlap``). Keys of ``drop_prefixes`` go.

    The cut of a key is aggregated first and the count of versions uses a group limit, so of a key with a third of all entries each task keeps few."""
    rows = versions(df, internal=True)
    if drop_prefixes:
        rows = rows.filter(~has_prefix(drop_prefixes))
    fresh = rows.filter(F.lit(False) if discard_ts is None else F.col("version") > discard_ts)
    old = rows if discard_ts is None else rows.filter(F.col("version") <= discard_ts)
    stops = dead(now) | (F.col("meta").bitwiseAND(DISCARD_EARLIER) != 0)
    cuts = old.filter(stops).groupBy("key").agg(F.max("version").alias("_cut"))
    left = old.join(cuts, "key", "left").filter(F.col("_cut").isNull() | (F.col("version") >= F.col("_cut"))).drop("_cut")
    ranked = left.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(F.col("version").desc()))).filter(F.col("_r") <= keep).drop("_r")
    return fresh.unionByName(ranked if overlap else ranked.filter(~dead(now))).select(*COLUMNS)


def max_version(df: DataFrame) -> DataFrame:
    return log(df).agg(F.max("version").alias("max_version"))


def write_sorted(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """The log as files of ascending key ranges, so range, prefix and point reads skip files by their statistics; with bloom filters on keys."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = log(df).repartitionByRange(n, "key", F.col("version").desc()).sortWithinPartitions("key", F.col("version").desc())
    rows.write.option("parquet.bloom.filter.enabled#key", "true").mode("append").parquet(path)


def read_sorted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).parquet(path)
