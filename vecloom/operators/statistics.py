"""Statistics of vectors and inverted lists. Sums over vectors are added up inside each task first, so one row a task and key is shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .exact import matrices


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict = {}
    for b in batches:
        keys, weights = b.column("key").to_numpy(), b.column("weight").to_numpy()
        at = {}
        for row, x in matrices(b):  # "id" is the position of the row here
            at[x.shape[1]] = (row, x)
        base = int(b.column("id")[0].as_py()) if b.num_rows else 0
        for d, (row, x) in at.items():
            pos = row - base
            for key in np.unique(keys[pos]):
                w = weights[pos][keys[pos] == key]
                part = held.setdefault((int(key), d), [0, 0.0, np.zeros(d)])
                part[0] += len(w)
                part[1] += float(w.sum())
                part[2] += (x[keys[pos] == key] * w[:, None]).sum(axis=0)
    rows = [(k, d, n, w, s.tolist()) for (k, d), (n, w, s) in held.items()]
    cols = list(zip(*rows)) if rows else [[]] * 5
    types = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["key", "d", "n", "weight", "sums"])


def means(df: DataFrame, key: str, vec: str, weight: str | None = None) -> DataFrame:
    """``key, n, mean``: the (weighted) mean vector of every key. Weights default to 1; a key of total weight 0 has no mean."""
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))
    rows = df.select(F.col(key).cast("bigint").alias("key"), w.alias("weight"), F.col(vec).alias("vec"), F.monotonically_increasing_id().alias("id")).filter("key is not null")
    usable = rows.withColumn("vec", F.col("vec").cast("array<double>")).filter(F.size("vec") > 0).filter(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    parts = usable.mapInArrow(_by_position, "key bigint, d int, n bigint, weight double, sums array<double>")
    cells = parts.select("key", "n", "weight", F.posexplode("sums").alias("j", "s")).groupBy("key", "j").agg(F.sum("n").alias("n"), F.sum("weight").alias("w"), F.sum("s").alias("s"))
    whole = cells.filter("w != 0").groupBy("key").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("j", (F.col("s") / F.col("w")).alias("x")))), lambda c: c["x"]).alias("mean"))
    return whole.withColumnRenamed("key", key)


def _by_position(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def numbered() -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(b.schema.get_field_index("id"), "id", pa.array(np.arange(b.num_rows, dtype=np.int64)))

    return _sums(numbered())


def per_dimension(df: DataFrame, vec: str) -> DataFrame:
    """``j, low, high, span, mean, sd`` of every dimension (sd of the whole population)."""
    cells = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("j", "x")).filter("x is not null and not isnan(x)")
    out = cells.groupBy("j").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    return out.withColumn("span", F.col("high") - F.col("low")).select("j", "low", "high", "span", "mean", "sd")


def quantile_ranges(df: DataFrame, vec: str, share: float) -> DataFrame:
    """``j, low, span`` of every dimension without the least and greatest ``share`` of its values (interpolated percentiles)."""
    cells = df.select(F.posexplode(F.col(vec).cast("array<double>")).alias("j", "x")).filter("x is not null and not isnan(x)")
    out = cells.groupBy("j").agg(F.percentile("x", F.lit(share)).alias("low"), F.percentile("x", F.lit(1 - share)).alias("high"))
    return out.select("j", "low", (F.col("high") - F.col("low")).alias("span"))


def list_sizes(df: DataFrame, key: str = "list_no") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"))


def imbalance(sizes: DataFrame, lists: int | Column) -> DataFrame:
    """One row: ``lists * sum(n^2) / (sum n)^2``, 1 for equal sizes; ``lists`` counts the empty ones too."""
    k = F.lit(lists) if isinstance(lists, int) else lists
    total = F.sum("n").cast("double")
    return sizes.agg((k * F.sum((F.col("n") * F.col("n")).cast("double")) / (total * total)).alias("imbalance"))


def size_classes(sizes: DataFrame) -> DataFrame:
    """How many lists hold up to each power of two: ``bits, lists`` (sizes below 2^(bits + 1))."""
    return sizes.filter("n > 0").groupBy(F.floor(F.log2("n")).cast("int").alias("bits")).agg(F.count("*").alias("lists"))


def equal_codes(entries: DataFrame) -> DataFrame:
    """Entries of a list with equal codes: ``list_no, first, id``, a row for every member of a group of two or more, ``first`` its smallest id. The groups
    are aggregated before they are joined back, so one of any size is no task's burden."""
    groups = entries.groupBy("list_no", "code").agg(F.count("*").alias("c"), F.min("id").alias("first")).filter("c > 1").drop("c")
    return entries.select("list_no", "code", "id").join(groups, ["list_no", "code"]).select("list_no", "first", "id")
