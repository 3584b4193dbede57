"""Exact nearest neighbours and range search: a query set against all vectors, in blocks.

Whichever side is small is sent to every task, behind a check of its bytes, and the other is read once without a shuffle. Where both are large, both are
packed into blocks which meet in a grid of cells; a cell holds a bounded number of blocks of each side, whatever their ids and values are, and sends on
at most k rows of a query.

Defined results: null ids and vectors, and vectors with null, NaN or infinite elements take no part; only vectors of a query's dimension are
compared with it; equal scores go by the smaller id; fewer than k vectors give as many rows; ``k < 1`` gives none; range bounds are exclusive;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, flat
from .kernels import Flat, best, first_k
from .topk import top_k

SENT = 64 << 20  # bytes of a side that may be broadcast
BLOCK = 2 << 20  # bytes of a block
ACROSS = 8  # blocks of a side in a cell
RESULT = "qid bigint, id bigint, score double"
PACKED = "d int, ids binary, vecs binary"


def clean(df: DataFrame, id: str, vec: str) -> DataFrame:
    """``id, vec`` of rows that take part."""
    ok = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id).cast("bigint").alias("id"), F.col(vec).cast("array<double>").alias("vec")).filter(F.col("id").isNotNull() & (F.size("vec") > 0)).filter(ok)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of a batch ``id, vec``, one for each dimension in it."""
    offsets, values = flat(batch.column("vec"))
    sizes, ids = np.diff(offsets), batch.column("id").to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield ids[at], values[(offsets[at][:, None] + np.arange(d))]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def out(d: int) -> pa.RecordBatch:
        parts = held.pop(d)
        ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids.astype("<i8").tobytes()]), pa.array([x.astype("<f8").tobytes()])], ["d", "ids", "vecs"])

    for b in batches:
        for ids, x in matrices(b):
            d = x.shape[1]
            step = max(1, BLOCK // (8 * d))
            for s in range(0, len(x), step):
                held.setdefault(d, []).append((ids[s : s + step], x[s : s + step]))
                if sum(len(p[0]) for p in held[d]) >= step:
                    yield out(d)
    for d in list(held):
        yield out(d)


def packed(df: DataFrame, id: str, vec: str) -> DataFrame:
    """Blocks of at most twice BLOCK bytes, made where the rows are."""
    return clean(df, id, vec).mapInArrow(_pack, PACKED)


def _read(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vecs"], "<f8").reshape(-1, row["d"])


def small(df: DataFrame, vec: str, most: int = SENT) -> bool:
    """Whether the vectors of a table have at most ``most`` bytes. Reads the sizes of arrays only."""
    n = df.agg(F.sum(F.greatest(F.size(vec), F.lit(0)) + 1).alias("n")).first()["n"] or 0
    return 8 * n <= most


def _batch(qid, id, score, sign) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(id, pa.int64()), pa.array(score * sign)], ["qid", "id", "score"])


class _Kept:
    """Best rows so far, pruned now and then."""

    def __init__(self, k: int):
        self.k, self.parts, self.n, self.limit = k, [], 0, 200_000

    def add(self, *cols: np.ndarray) -> None:
        self.parts.append(cols)
        self.n += len(cols[0])
        if self.n > self.limit:
            self.prune()
            self.limit = max(200_000, 2 * self.n)

    def prune(self) -> tuple[np.ndarray, ...]:
        q, i, s = (np.concatenate([p[c] for p in self.parts]) if self.parts else np.empty(0, t) for c, t in enumerate((np.int64, np.int64, float)))
        at = first_k(q, i, s, self.k)
        self.parts = [(q[at], i[at], s[at])]
        self.n = len(at)
        return self.parts[0]


def _search(queries: DataFrame, base: DataFrame, metric: str, k: int | None, bound: float | None, sent: int) -> DataFrame:
    """``queries`` and ``base`` as ``id, vec``."""
    spark = base.sparkSession
    kernel = Flat(metric)
    sign = kernel.sign()
    least = None if bound is None else bound * sign

    if small(queries, "vec", sent):
        held = spark.sparkContext.broadcast([_read(r.asDict()) for r in packed(queries, "id", "vec").collect()])

        def over_base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = _Kept(k or 0)
            for b in batches:
                for ids, x in matrices(b):
                    for qids, q in held.value:
                        if q.shape[1] == x.shape[1]:
                            i, j, s = best(kernel, q, x, ids, k, least)
                            if k is None:
                                yield _batch(qids[i], j, s, sign)
                            else:
                                kept.add(qids[i], j, s)
            if k is not None:
                yield _batch(*kept.prune(), sign)

        return clean(base, "id", "vec").mapInArrow(over_base, RESULT)

    if small(base, "vec", sent):
        held = spark.sparkContext.broadcast([_read(r.asDict()) for r in packed(base, "id", "vec").collect()])

        def over_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for qids, q in matrices(b):
                    kept = _Kept(k or 0)
                    for ids, x in held.value:
                        if q.shape[1] == x.shape[1]:
                            i, j, s = best(kernel, q, x, ids, k, least)
                            if k is None:
                                yield _batch(qids[i], j, s, sign)
                            else:
                                kept.add(qids[i], j, s)
                    if k is not None:
                        yield _batch(*kept.prune(), sign)

        return clean(queries, "id", "vec").mapInArrow(over_queries, RESULT)

    asked, stored = cut(packed(queries, "id", "vec")), cut(packed(base, "id", "vec"))
    rows, across = (max(1, -(-t.count() // ACROSS)) for t in (asked, stored))
    spread = lambda t, n: F.pmod(F.xxhash64("ids"), F.lit(n)).cast("int")
    left = asked.withColumn("i", spread(asked, rows)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("kind", F.lit(0))
    right = stored.withColumn("j", spread(stored, across)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("kind", F.lit(1))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, kept = None, [], _Kept(k or 0)
        for b in batches:
            for row in b.to_pylist():
                if (row["i"], row["j"]) != at:
                    if k is not None and kept.n:
                        yield _batch(*kept.prune(), sign)
                    at, asked, kept = (row["i"], row["j"]), [], _Kept(k or 0)
                if row["kind"] == 0:
                    asked.append(_read(row))
                    continue
                ids, x = _read(row)
                for qids, q in asked:
                    if q.shape[1] == x.shape[1]:
                        i, j, s = best(kernel, q, x, ids, k, least)
                        if k is None:
                            yield _batch(qids[i], j, s, sign)
                        else:
                            kept.add(qids[i], j, s)
        if k is not None and kept.n:
            yield _batch(*kept.prune(), sign)

    met = left.unionByName(right).repartition("i", "j").sortWithinPartitions("i", "j", "kind")
    return met.mapInArrow(cell, RESULT)


def knn(queries: DataFrame, base: DataFrame, k: int, metric: str = "ip", qid: str = "qid", q: str = "q", id: str = "id", vec: str = "vec", sent: int = SENT) -> DataFrame:
    """``qid, id, score, rank``: the k best vectors of each query. Distances are positive, squared for ``l2``."""
    asked, stored = queries.select(F.col(qid).alias("id"), F.col(q).alias("vec")), base.select(F.col(id).alias("id"), F.col(vec).alias("vec"))
    if k < 1:
        return base.sparkSession.createDataFrame([], RESULT + ", rank int")
    return top_k(_search(asked, stored, metric, k, None, sent), k, metric)


def range_search(queries: DataFrame, base: DataFrame, bound: float, metric: str = "ip", qid: str = "qid", q: str = "q", id: str = "id", vec: str = "vec", sent: int = SENT) -> DataFrame:
    """``qid, id, score`` of all vectors of a score above (for distances below) the bound."""
    asked, stored = queries.select(F.col(qid).alias("id"), F.col(q).alias("vec")), base.select(F.col(id).alias("id"), F.col(vec).alias("vec"))
    return _search(asked, stored, metric, None, bound, sent)


def scored(pairs: DataFrame, queries: DataFrame, base: DataFrame, metric: str = "ip") -> DataFrame:
    """``qid, id, score`` of given pairs ``qid, id``, by two joins on keys. Repeated pairs count once; pairs without both vectors give nothing."""
    kernel = Flat(metric)
    sign = kernel.sign()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            qo, qv = flat(b.column("q"))
            xo, xv = flat(b.column("vec"))
            nq, nx = np.diff(qo), np.diff(xo)
            qid, id = b.column("qid").to_numpy(), b.column("id").to_numpy()
            for d in np.unique(nq):
                at = np.flatnonzero((nq == d) & (nx == d))
                if len(at):
                    s = kernel.exact(qv[qo[at][:, None] + np.arange(d)], xv[xo[at][:, None] + np.arange(d)])
                    yield _batch(qid[at], id[at], s, sign)

    asked = clean(queries, "qid", "q").select(F.col("id").alias("qid"), F.col("vec").alias("q"))
    both = pairs.select("qid", "id").distinct().join(clean(base, "id", "vec"), "id").join(asked, "qid")
    return both.select("qid", "id", "q", "vec").mapInArrow(score, RESULT)


def rerank(candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """The k best of each query's candidates by exact scores."""
    return top_k(scored(candidates, queries, base, metric), k, metric)
