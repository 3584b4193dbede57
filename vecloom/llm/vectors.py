"""The usable latest vectors of logged additions, and packing of vectors into blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import flat, table, whole_groups

PACKED = "grp string, block int, blocks int, n int, d int, ids binary, vecs binary"


def usable(vec) -> F.Column:
    """Finite numbers, not all zero."""
    return ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)


def latest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``grp`` (collection), ``id, vec``: of each id the usable vector sent last."""
    info = table(spark, sf_dir, "collection_info").select(F.col("collection_name").alias("grp"), F.col("d").alias("dim")).dropDuplicates(["grp"])
    added = table(spark, sf_dir, "add_request").select(F.col("collection_name").alias("grp"), "sent_at", "n", "d", "vecs", "ids")
    fit = added.join(info, "grp").filter("d = dim and n > 0 and size(ids) = n and size(vecs) = n * d")
    one = fit.select("grp", "sent_at", "d", "vecs", F.posexplode("ids").alias("pos", "id")).select("grp", "sent_at", "id", F.slice("vecs", F.col("pos") * F.col("d") + 1, F.col("d")).alias("vec"))
    # aggregated before the shuffle: of an id a task sends on one vector; nulls of sent_at are less than all times
    newest = one.filter(F.col("id").isNotNull() & usable(F.col("vec"))).groupBy("id").agg(F.max(F.struct("sent_at", "grp", "vec")).alias("m"))
    return newest.select("m.grp", "id", "m.vec")


def matrix(t: pa.Table, s: int, e: int, name: str = "vec") -> np.ndarray:
    """Rows s..e of a list column of equal lengths as a float32 matrix."""
    _, values = flat(t.column(name).slice(s, e - s))
    return np.ascontiguousarray(values, np.float32).reshape(e - s, -1)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, at in whole_groups(batches, ["grp", "block"]):
        for s, e in zip(at[:-1], at[1:]):
            s, e = int(s), int(e)
            order = np.argsort(t.column("id")[s:e].to_numpy(), kind="stable")
            x = matrix(t, s, e)[order]
            ids = t.column("id")[s:e].to_numpy()[order]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip((t.column("grp")[s].as_py(), t.column("block")[s].as_py(), t.column("blocks")[s].as_py(), e - s, x.shape[1], ids.astype("<i8").tobytes(), x.tobytes()), (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                ["grp", "block", "blocks", "n", "d", "ids", "vecs"],
            )


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of about ``rows`` vectors, each a random part of its group (by a hash of the id), so a group with most rows is as many
    blocks and block 0 is a uniform sample of bounded size."""
    sizes = vectors.groupBy("grp").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    placed = vectors.join(sizes, "grp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    return placed.repartition("grp", "block").sortWithinPartitions("grp", "block").mapInArrow(_pack, PACKED)
