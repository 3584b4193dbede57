"""Maintenance of collections: adds, deletes, updates, merges, parameter swaps, as functions from tables to tables.

A collection is a log of additions ``id, vec, seq`` and a log of deletions ``id, seq``; the newest of both decides whether and with which vector an id is
alive, whatever the order in which they arrive. Rows with a null id take no part; a null seq counts as before all others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OLDEST = -(1 << 62)


def latest(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """One row for every key, that of the greatest ``seq``; aggregated before the shuffle. Ties go to the greatest row."""
    rest = [c for c in log.columns if c not in (key, seq)]
    order = F.coalesce(F.col(seq).cast("bigint"), F.lit(OLDEST))
    newest = log.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order.alias("_o"), F.col(seq).alias("_s"), *rest)).alias("_m"))
    return newest.select(key, *[F.col(f"_m.{c}").alias(c) for c in rest], F.col("_m._s").alias(seq))


def alive(added: DataFrame, deleted: DataFrame) -> DataFrame:
    """``id, vec, seq`` of ids whose newest addition is newer than their newest deletion."""
    gone = deleted.filter("id is not null").groupBy("id").agg(F.max(F.coalesce(F.col("seq").cast("bigint"), F.lit(OLDEST))).alias("gone"))
    newest = latest(added.select("id", "vec", "seq"))
    return newest.join(gone, "id", "left").filter(F.col("gone").isNull() | (F.coalesce("seq", F.lit(OLDEST)) > F.col("gone"))).drop("gone")


def upsert(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """The table with the rows of ``changes`` in place of those of equal keys. ``changes`` has one row a key (see ``latest``)."""
    return table.join(changes.select(key), key, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def removed(table: DataFrame, ids: DataFrame | Column, key: str = "id") -> DataFrame:
    """Without the ids of a table, or without what a predicate selects."""
    if isinstance(ids, Column):
        return table.filter(~F.coalesce(ids, F.lit(False)))
    return table.join(ids.select(key).distinct(), key, "left_anti")


def check_compatible(a: Mapping, b: Mapping) -> None:
    """Raise unless two indexes have the same dimension, metric, number of lists and code size."""
    for name in ("d", "metric", "nlist", "code_size"):
        if a.get(name) != b.get(name):
            raise ValueError(f"{name} differs: {a.get(name)} and {b.get(name)}")


def merged(a: DataFrame, b: DataFrame, add_id: int = 0, key: str = "id") -> DataFrame:
    """Entries of both, ids of b raised by ``add_id``; columns are matched by name and must be the same."""
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    return a.unionByName(b.withColumn(key, F.col(key) + F.lit(add_id)))


def permuted(table: DataFrame, moves: DataFrame, key: str = "id") -> DataFrame:
    """Rows under new numbers: ``moves`` has the old number in ``key`` and the new one in ``new``; numbers without a move stay."""
    at = table.join(moves.select(F.col(key), F.col("new").alias("_new")), key, "left")
    return at.withColumn(key, F.coalesce("_new", key)).select(*table.columns)


def reset(table: DataFrame) -> DataFrame:
    """No rows, the same columns."""
    return table.sparkSession.createDataFrame([], table.schema)


def at_offset(entries: DataFrame, wanted: DataFrame, lists: str = "list_no", id: str = "id") -> DataFrame:
    """Entries at 0-based places inside their lists (in the order of ids): ``wanted`` has ``list_no, offset``."""
    from pyspark.sql import Window

    asked = wanted.select(lists, "offset").distinct()
    needed = asked.groupBy(lists).agg(F.max("offset").alias("_far"))
    placed = entries.join(F.broadcast(needed) if needed.limit(100_001).count() <= 100_000 else needed, lists)
    numbered = placed.withColumn("offset", (F.row_number().over(Window.partitionBy(lists).orderBy(id)) - 1).cast("bigint")).drop("_far")
    return numbered.join(asked.withColumn("offset", F.col("offset").cast("bigint")), [lists, "offset"])


def installed(params: DataFrame, new: DataFrame, part: str = "name") -> DataFrame:
    """Parameters ``role, name, no, value`` with the query side replaced by ``new`` (``name, no, value``); the side of insertions stays, so stored
    codes keep their meaning. Raises if a part has another shape than the one it replaces."""
    shape = lambda df: {(r[part], r["n"], r["d"]) for r in df.groupBy(part).agg(F.count("*").alias("n"), F.max(F.size("value")).alias("d")).collect()}
    old = params.filter("role = 'query'")
    names = {s[0] for s in shape(new)}
    if {s for s in shape(old) if s[0] in names} != shape(new):
        raise ValueError("the new parameters have another shape")
    kept = params.filter((F.col("role") != "query") | ~F.col(part).isin(list(names)))
    return kept.unionByName(new.withColumn("role", F.lit("query")).select(*params.columns))
