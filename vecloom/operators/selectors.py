"""Which ids take part: predicates on an id column, and semi or anti joins where the ids are a table.

Predicates on literals reach the Parquet scan. A null id is a member of nothing, also not of a negation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded

BROADCAST_ROWS = 1_000_000


def id_range(low: int | None = None, high: int | None = None, id: str = "id") -> Column:
    """``low <= id < high``; a bound left out doesn't limit."""
    c = F.col(id).isNotNull()
    if low is not None:
        c = c & (F.col(id) >= low)
    return c if high is None else c & (F.col(id) < high)


def id_list(ids: list[int], id: str = "id") -> Column:
    """For short lists that are part of the query; long ones belong into a table (``of_table``)."""
    return F.coalesce(F.col(id).isin(ids), F.lit(False)) if ids else F.lit(False)


def bitmap(bits: Column, id: str = "id") -> Column:
    """Bit ``id mod 8`` of byte ``id / 8`` of a binary column; ids beyond it aren't members."""
    place = F.shiftright(F.col(id), 3)
    inside = (F.col(id) >= 0) & (place < F.length(bits))
    byte = F.conv(F.hex(F.substring(bits, (place + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.when(inside, byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col(id) % 8).cast("int"))) != 0).otherwise(F.lit(False))


def both(a: Column, b: Column) -> Column:
    return a & b


def either(a: Column, b: Column) -> Column:
    return a | b


def one_of(a: Column, b: Column) -> Column:
    """Members of exactly one."""
    return a != b


def neither(a: Column, id: str = "id") -> Column:
    return ~a & F.col(id).isNotNull()


def of_table(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose id is in a table of ids; broadcast up to BROADCAST_ROWS ids, else a shuffled semi join."""
    return df.join(bounded(ids.select(id).distinct(), BROADCAST_ROWS), id, "left_semi")


def not_of_table(df: DataFrame, ids: DataFrame, id: str = "id") -> DataFrame:
    """Rows whose id is not in a table of ids (tombstones)."""
    return df.join(bounded(ids.select(id).distinct(), BROADCAST_ROWS), id, "left_anti")


def shard_of(shards: int, id: str = "id") -> Column:
    """The worker that owns an id; also for negative ids a number from 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    return F.pmod(F.col(id), F.lit(shards)).cast("int")


def owned(shards: int, shard: int, id: str = "id") -> Column:
    return shard_of(shards, id) == shard


def valid(id: str = "id") -> Column:
    """Ids of results: no padding."""
    return F.col(id) >= 0


def check_search(k: int, nprobe: int = 1, k_factor: float = 1, n: int = 1) -> None:
    """Raise unless all are positive."""
    for name, v in {"k": k, "nprobe": nprobe, "k_factor": k_factor, "n": n}.items():
        if v is None or v <= 0:
            raise ValueError(f"{name} must be positive, not {v}")


def subset(postings: DataFrame, how: str, a: int, b: int, lists: str = "list_no", id: str = "id") -> DataFrame:
    """Part of the entries of an index: ``id_range`` (a <= id < b), ``id_mod`` (id mod a = b), ``list_range`` (a <= list < b), ``elements`` (entries
    a to b of all, in the order of list and id) or ``list_fraction`` (part b of a equal parts of every list, in the order of ids)."""
    from pyspark.sql import Window

    if how == "id_range":
        return postings.filter(id_range(a, b, id))
    if how == "id_mod":
        return postings.filter(F.pmod(F.col(id), F.lit(a)) == b)
    if how == "list_range":
        return postings.filter((F.col(lists) >= a) & (F.col(lists) < b))
    sizes = postings.groupBy(lists).agg(F.count("*").alias("_size"))
    ordered = postings.withColumn("_no", F.row_number().over(Window.partitionBy(lists).orderBy(id)) - 1)
    if how == "list_fraction":
        n = F.col("_size")
        part = (F.floor(n * b / a) <= F.col("_no")) & (F.col("_no") < F.floor(n * (b + 1) / a))
        return ordered.join(sizes, lists).filter(part).drop("_no", "_size")
    if how == "elements":
        # one row a list, so the running sum over lists is small
        before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy(lists).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        at = F.col("_before") + F.col("_no")
        return ordered.join(before.select(lists, "_before"), lists).filter((at >= a) & (at < b)).drop("_no", "_before")
    raise ValueError(f"unknown subset {how}")
