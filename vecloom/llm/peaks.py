"""Groups of alike vectors by density peaks.

1. Neighbour join. Vectors are packed into blocks of unit vectors; every block of a group (collection) meets every other and itself in a cell
   of a grid, so all pairs are looked at, none is sampled or capped. The density of a vector is the number of its neighbours, those of a cosine of at
   least ``least``. A cell gives one row a vector, not one a pair, so a dense group costs no more shuffle than a thin one.
2. Pointers. In a second pass over the same cells each vector points to its most similar neighbour that is denser (of equal density: of
   smaller id). A vector without one is a peak.
3. Pointers are followed by doubling until all lead to peaks; the vectors of one peak are a cluster, named by its smallest id.

Where being alike is transitive, as the 0.6 to 0.7 gap of the stored collections makes it, clusters are exactly the groups of alike vectors; elsewhere a
chain is divided between its peaks. The most typical members of a cluster are those of the greatest sum of cosines with their neighbours.

Cosines are in double precision. Defined results: null and unusable vectors and null ids take no part (see ``latest_vectors``); ids are unique over
all groups; a vector without neighbours is a cluster of one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .vectors import packed

BLOCK, ROWS = 4096, 512
ALIKE = 0.7


def _unit(row: dict) -> np.ndarray:
    x = np.frombuffer(row["vecs"], np.float32).reshape(row["n"], row["d"]).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, dict, np.ndarray]]:
    """The two blocks of each cell with their unit vectors, from rows sorted by cell and side; the same block twice on the diagonal."""
    held = None
    for b in batches:
        for row in b.to_pylist():
            row["ids"] = np.frombuffer(row["ids"], np.int64)
            x = _unit(row)
            if row["i"] == row["j"]:
                yield row, x, row, x
            elif held and all(held[0][k] == row[k] for k in ("grp", "i", "j")):
                yield *held, row, x
                held = None
            else:  # alone if hashing left no row for the other block
                held = row, x


def _density(least: float):
    def density(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, x, b, y in cells(batches):
            same = a["i"] == a["j"]
            na, sa, nb, sb = np.zeros(len(x), np.int64), np.zeros(len(x)), np.zeros(len(y), np.int64), np.zeros(len(y))
            for s in range(0, len(x), ROWS):
                cos = x[s : s + ROWS] @ y.T
                near = cos >= least
                if same:
                    near[np.arange(len(near)), np.arange(s, s + len(near))] = False
                cos[~near] = 0
                na[s : s + ROWS], sa[s : s + ROWS] = near.sum(axis=1), cos.sum(axis=1)
                nb += near.sum(axis=0)
                sb += cos.sum(axis=0)
            for row, n, total in [(a, na, sa)] + ([] if same else [(b, nb, sb)]):
                yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * len(n), pa.string()), pa.array([row["block"]] * len(n), pa.int32()), pa.array(row["ids"]), pa.array(n), pa.array(total)], ["grp", "block", "id", "density", "total"])

    return density


def _denser(least: float):
    def denser(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, x, b, y in cells(batches):
            for one, p, two, q in [(a, x, b, y)] + ([] if a["i"] == a["j"] else [(b, y, a, x)]):
                d, e, ids, others = np.array(one["density"]), np.array(two["density"]), one["ids"], two["ids"]
                for s in range(0, len(p), ROWS):
                    cos = p[s : s + ROWS] @ q.T
                    dd, ii = d[s : s + ROWS, None], ids[s : s + ROWS, None]
                    cos[~((cos >= least) & ((e > dd) | (e == dd) & (others < ii)))] = -2
                    # ids ascend in a block, so of copies the first, of the smallest id, is taken
                    cos = np.round(cos, 12)
                    at = cos.argmax(axis=1)
                    top = cos[np.arange(len(cos)), at]
                    has = np.flatnonzero(top > -2)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s + has]), pa.array(top[has]), pa.array(others[at[has]])], ["id", "cos", "other"])

    return denser


def _grid(blocks: DataFrame) -> DataFrame:
    """Every pair of blocks of a group as one cell; a block is the only row of its own cell."""
    other = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = other.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    return placed.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "block")


def follow(pointers: DataFrame) -> DataFrame:
    """``id, peak`` of ``id, parent`` (a peak is its own parent): pointers are doubled until none moves."""
    now = cut(pointers.select("id", F.col("parent").alias("peak")))
    while True:
        step = now.select(F.col("id").alias("peak"), F.col("peak").alias("next"))
        moved = cut(now.join(step, "peak").select("id", F.col("next").alias("peak"), (F.col("next") != F.col("peak")).alias("moved")))
        now = moved.select("id", "peak")
        if not moved.filter("moved").limit(1).count():
            return now


def density_peaks(vectors: DataFrame, least: float = ALIKE, block: int = BLOCK) -> DataFrame:
    """``cluster_id, id, grp, density, total, parent, peak, size`` of rows ``grp string, id bigint, vec array<float>``; total is the sum of cosines
    with the neighbours, a peak its own parent."""
    blocks = cut(packed(vectors, block))
    parts = _grid(blocks).mapInArrow(_density(least), "grp string, block int, id bigint, density bigint, total double")
    dense = cut(parts.groupBy("grp", "block", "id").agg(F.sum("density").alias("density"), F.sum("total").alias("total")))
    lists = dense.groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct("id", "density"))).alias("l")).select("grp", "block", F.col("l.density").alias("density"))
    found = _grid(blocks.join(lists, ["grp", "block"])).mapInArrow(_denser(least), "id bigint, cos double, other bigint")
    best = found.groupBy("id").agg(F.max(F.struct("cos", (-F.col("other")).alias("o"))).alias("m")).select("id", (-F.col("m.o")).alias("parent"))
    linked = cut(dense.join(best, "id", "left").select("grp", "id", "density", "total", F.coalesce("parent", "id").alias("parent")))
    all_ = linked.join(follow(linked), "id")
    named = all_.groupBy("peak").agg(F.min("id").alias("cluster_id"), F.count("*").alias("size"))
    return all_.join(named, "peak").select("cluster_id", "id", "grp", "density", "total", "parent", "peak", "size")
