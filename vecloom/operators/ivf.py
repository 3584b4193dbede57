"""Two-phase search: inverted lists of full, scalar- or product-quantised vectors, then exact scores of the best candidates.

Build. Each vector goes to its nearest centroid's list; a list is stored as blocks of at most about ``ROWS`` entries (a hash of the id parts a large list), so
a list with a third of all vectors is many blocks. Search. Queries take the ``nprobe`` nearest lists; rows of queries meet the blocks of their lists in
one shuffle on (list, block, part of the queries), so neither a hot list nor a list that all queries probe lands in one task; per task at most k
entries of a query go on.

Centroids and codebooks are parameters: of bounded number (``nlist``, 2^bits), independent of the number of vectors. They are sent to tasks behind the
size check of ``exact.knn`` or, for codebooks, as a numpy array of 2^bits times d numbers.

Defined results: as in ``exact``; ``nprobe`` above the number of lists means all; empty lists give nothing; an entry added twice under one id
counts once, with its best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantize import direct8
from ..runtime import bounded, flat, whole_groups
from .exact import RESULT, SENT, clean, knn
from .kernels import Codes, Flat, best
from .topk import best_of_id, top_k

ROWS, ASKED = 4096, 2048
BLOCKS = "list_no int, block int, n int, ids binary, data binary"


@dataclass(frozen=True)
class Params:
    """What search and build share. ``kind``: ``flat``, ``pq`` or ``sq8``; ``books`` is (sub-spaces, codes, dimensions); ``low`` and ``span`` the ranges of
    ``sq8``; ``by_residual`` encodes what the centroid leaves over."""

    metric: str
    d: int
    kind: str = "flat"
    books: np.ndarray | None = None
    low: np.ndarray | None = None
    span: np.ndarray | None = None
    by_residual: bool = False

    def encode(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "flat":
            return x.astype("<f8")
        if self.kind == "sq8":
            with np.errstate(invalid="ignore", divide="ignore"):
                at = np.where(self.span == 0, 0.0, (x - self.low) / self.span)
            return np.floor(np.clip(at, 0, 1) * 255).astype(np.uint8)
        m, _, d = self.books.shape
        parts = x.reshape(len(x), m, d)
        out = np.zeros((len(x), m), np.uint8)
        for s in range(0, len(x), 1024):
            gaps = ((parts[s : s + 1024, :, None, :] - self.books[None]) ** 2).sum(axis=3)
            out[s : s + 1024] = gaps.argmin(axis=2)
        return out

    def decode(self, data: bytes, n: int) -> np.ndarray:
        if self.kind == "flat":
            return np.frombuffer(data, "<f8").reshape(n, -1)
        codes = np.frombuffer(data, np.uint8).reshape(n, -1)
        if self.kind == "sq8":
            return self.low + (codes + 0.5) / 255 * self.span
        return codes

    def vectors(self, data: bytes, n: int) -> np.ndarray:
        """Reconstructed vectors (of residuals, what was left over)."""
        x = self.decode(data, n)
        return np.concatenate([self.books[m][x[:, m]] for m in range(x.shape[1])], axis=1) if self.kind == "pq" else x

    def kernel(self, centre: np.ndarray | None):
        if self.kind == "pq":
            return Codes(self.metric, self.books, centre if self.by_residual else None)
        return Flat(self.metric)


def assign(vectors: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """``id, list_no``: the nearest centroid of every vector, the smaller number on ties. Vectors that take no part have no list."""
    found = knn(vectors, centroids, 1, metric, qid="id", q="vec", id="list_no", vec="c")
    return found.select(F.col("qid").alias("id"), F.col("id").cast("int").alias("list_no"))


def probe(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "l2", sq8: bool = False) -> DataFrame:
    """``qid, list_no, order``: the nearest lists of every query; with ``sq8`` by squared distance between eight-bit codes of both sides."""
    if sq8:
        queries = queries.select("qid", direct8("q").alias("q"))
        centroids = centroids.select("list_no", direct8("c").alias("c"))
        metric = "l2"
    found = knn(queries, centroids, nprobe, metric, id="list_no", vec="c")
    return found.select("qid", F.col("id").cast("int").alias("list_no"), F.col("rank").alias("order"))


def balanced(vectors: DataFrame, centroids: DataFrame, sizes: DataFrame, among: int, metric: str = "l2") -> DataFrame:
    """``id, list_no``: of a batch's ``among`` nearest lists the shortest by the sizes before the batch (``list_no, n``), the nearer on ties."""
    near = knn(vectors, centroids, among, metric, qid="id", q="vec", id="list_no", vec="c").select(F.col("qid").alias("id"), F.col("id").cast("int").alias("list_no"), "rank")
    sized = near.join(bounded(sizes.select("list_no", "n"), 1_000_000), "list_no", "left")
    return sized.groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "rank", "list_no")).alias("m")).select("id", "m.list_no")


def _centres(centroids: DataFrame) -> dict[int, np.ndarray]:
    from .exact import small

    if not small(centroids, "c"):
        raise ValueError(f"centroids of more than {SENT} bytes can't be used for residuals; train fewer lists")
    return {r["list_no"]: np.array(r["c"], float) for r in centroids.select("list_no", F.col("c").cast("array<double>").alias("c")).collect()}


def build(vectors: DataFrame, centroids: DataFrame, params: Params, assigned: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """The blocks of an index over ``id, vec``: ``list_no, block, n, ids, data``; write it partitioned by ``list_no`` to keep it."""
    placed = (assign(vectors, centroids, params.metric) if assigned is None else assigned).join(clean(vectors, "id", "vec").filter(F.size("vec") == params.d), "id")
    sizes = placed.groupBy("list_no").agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    parted = placed.join(bounded(sizes, 1_000_000), "list_no").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    centres = vectors.sparkSession.sparkContext.broadcast(_centres(centroids)) if params.by_residual else None

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["list_no", "block"]):
            for s, e in zip(at[:-1], at[1:]):
                part = t.slice(int(s), int(e - s)).sort_by("id")
                no = part.column("list_no")[0].as_py()
                x = flat(part.column("vec"))[1].reshape(part.num_rows, -1)
                data = params.encode(x - centres.value[no] if centres else x)
                cols = (no, part.column("block")[0].as_py(), part.num_rows, part.column("id").to_numpy().astype("<i8").tobytes(), data.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["list_no", "block", "n", "ids", "data"])

    return parted.repartition("list_no", "block").sortWithinPartitions("list_no", "block").mapInArrow(pack, BLOCKS)


def entries(index: DataFrame, params: Params, centroids: DataFrame | None = None) -> DataFrame:
    """The single entries of an index: ``list_no, id, vec`` with reconstructed vectors (codes for ``pq`` in ``code``)."""
    centres = index.sparkSession.sparkContext.broadcast(_centres(centroids)) if params.by_residual else None

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                n = row["n"]
                x = params.vectors(row["data"], n)
                if centres:
                    x = x + centres.value[row["list_no"]]
                code = np.frombuffer(row["data"], np.uint8).reshape(n, -1).astype(np.int32) if params.kind != "flat" else np.zeros((n, 0), np.int32)
                lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([row["list_no"]] * n, pa.int32()), pa.array(np.frombuffer(row["ids"], "<i8")), lists(code), lists(x.astype(float))], ["list_no", "id", "code", "vec"])

    return index.mapInArrow(unpack, "list_no int, id bigint, code array<int>, vec array<double>")


def scan(index: DataFrame, queries: DataFrame, probes: DataFrame, params: Params, k: int | None, bound: float | None = None, centroids: DataFrame | None = None, deleted: DataFrame | None = None, per_list: bool = False, asked: int = ASKED) -> DataFrame:
    """``qid, id, score`` (with ``per_list`` also ``list_no``): the k best entries of each query in each block of its lists, or all above (for
    distances below) ``bound``. Ids of ``deleted`` are passed over before anything is ranked."""
    sign = Flat("cosine").sign() if params.metric in ("ip", "cosine") else -1
    least = None if bound is None else bound * sign
    centres = index.sparkSession.sparkContext.broadcast(_centres(centroids)) if params.by_residual else None
    wanted = probes.select("qid", "list_no").join(clean(queries, "qid", "q").select(F.col("id").alias("qid"), F.col("vec").alias("q")).filter(F.size("q") == params.d), "qid")
    crowds = wanted.groupBy("list_no").agg(F.ceil(F.count("*") / asked).cast("int").alias("parts"))
    blocks = index.groupBy("list_no").agg((F.max("block") + 1).alias("blocks"))
    crowd = bounded(crowds, 1_000_000)
    stored = index.join(crowd, "list_no").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").withColumn("kind", F.lit(0))
    sent = (
        wanted.join(crowd, "list_no").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).drop("parts")
        .join(bounded(blocks, 1_000_000), "list_no").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumn("kind", F.lit(1))
    )
    rows = stored.unionByName(sent, allowMissingColumns=True)
    if deleted is not None:
        # the tombstones of a block travel to it as one sorted list
        where = entries_ids(index).join(deleted.select("id").distinct(), "id", "left_semi").groupBy("list_no", "block").agg(F.sort_array(F.collect_list("id")).alias("dead"))
        rows = stored.join(where, ["list_no", "block"], "left").unionByName(sent, allowMissingColumns=True)
    else:
        rows = rows.withColumn("dead", F.lit(None).cast("array<bigint>"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at, qids, qs = None, None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if not qs:
                return
            no, ids, x, kernel = block
            q, names = np.stack(qs), np.array(qids, np.int64)
            qs.clear()
            qids.clear()
            i, j, s = best(kernel, q, x, ids, k, least)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), no, np.int32)), pa.array(names[i]), pa.array(j), pa.array(s * sign)], ["list_no", "qid", "id", "score"])

        for b in batches:
            for row in b.to_pylist():
                here = row["list_no"], row["block"], row["part"]
                if row["kind"] == 0:
                    yield from flush()
                    ids, x = np.frombuffer(row["ids"], "<i8"), params.decode(row["data"], row["n"])
                    if row["dead"]:
                        alive = ~np.isin(ids, row["dead"])
                        ids, x = ids[alive], x[alive]
                    block, at = (row["list_no"], ids, x, params.kernel(centres.value[row["list_no"]] if centres else None)), here
                elif here == at:
                    qids.append(row["qid"])
                    qs.append(np.array(row["q"]))
                    if len(qs) >= 512:
                        yield from flush()
        yield from flush()

    met = rows.select("list_no", "block", "part", "kind", "n", "ids", "data", "dead", "qid", "q").repartition("list_no", "block", "part").sortWithinPartitions("list_no", "block", "part", "kind")
    found = met.mapInArrow(meet, "list_no int, " + RESULT)
    return found if per_list else found.drop("list_no")


def entries_ids(index: DataFrame) -> DataFrame:
    """``list_no, block, id`` of an index."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.select(["list_no", "block", "ids"]).to_pylist():
                x = np.frombuffer(row["ids"], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), row["list_no"], np.int32)), pa.array(np.full(len(x), row["block"], np.int32)), pa.array(x)], ["list_no", "block", "id"])

    return index.select("list_no", "block", "ids").mapInArrow(ids, "list_no int, block int, id bigint")


def search(index: DataFrame, queries: DataFrame, centroids: DataFrame, params: Params, k: int, nprobe: int, deleted: DataFrame | None = None, sq8: bool = False, probe_metric: str | None = None) -> DataFrame:
    """The filter phase: ``qid, id, score, rank`` of the k best entries of the probed lists."""
    probes = probe(queries, centroids, nprobe, probe_metric or params.metric, sq8)
    return top_k(best_of_id(scan(index, queries, probes, params, k, None, centroids, deleted), params.metric), k, params.metric)


def range_scan(index: DataFrame, queries: DataFrame, centroids: DataFrame, params: Params, bound: float, nprobe: int, deleted: DataFrame | None = None) -> DataFrame:
    """All entries of the probed lists within a bound."""
    return best_of_id(scan(index, queries, probe(queries, centroids, nprobe, params.metric), params, None, bound, centroids, deleted), params.metric)


def two_phase(index: DataFrame, vectors: DataFrame, queries: DataFrame, centroids: DataFrame, params: Params, k: int, nprobe: int, k_factor: float, deleted: DataFrame | None = None, exact_queries: DataFrame | None = None, sq8: bool = False) -> DataFrame:
    """Filter for ``k * k_factor`` candidates, then rank them by exact scores over ``vectors`` (``id, vec``); ``exact_queries`` are the queries before a
    transform, where the index holds transformed vectors."""
    from .exact import rerank
    from .selectors import check_search, not_of_table

    check_search(k, nprobe, k_factor)
    candidates = search(index, queries, centroids, params, int(k * k_factor), nprobe, deleted, sq8)
    alive = candidates if deleted is None else not_of_table(candidates, deleted)
    return rerank(alive, exact_queries or queries, vectors, k, params.metric)


def capped(probes: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Probes up to the list with which a query has seen ``most`` entries (that list included)."""
    seen = F.sum("n").over(Window.partitionBy("qid").orderBy("order").rowsBetween(Window.unboundedPreceding, -1))
    sized = probes.join(bounded(sizes, 1_000_000), "list_no", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return sized.withColumn("before", F.coalesce(seen, F.lit(0))).filter(F.col("before") < most).drop("n", "before")


def early_stop(found: DataFrame, probes: DataFrame, k: int, least: int, patience: int, metric: str) -> DataFrame:
    """Of per-list results (``scan(per_list=True)``) what a search gives that goes through the lists in order and stops after ``patience`` lists in a row
    each of which brought fewer than ``least`` entries into the k best so far: ``qid, id, score, rank``."""
    sign = 1 if metric in ("ip", "cosine") else -1
    rows = probes.select("qid", "list_no", "order").join(top_k(found, k, metric, by=["qid", "list_no"]).drop("rank"), ["qid", "list_no"], "left").select("qid", "order", "id", "score")

    def stop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["qid"]):
            for s, e in zip(at[:-1], at[1:]):
                order = t.column("order")[int(s) : int(e)].to_numpy()
                ids, score = (t.column(c)[int(s) : int(e)].to_numpy(zero_copy_only=False) for c in ("id", "score"))
                held: list[tuple[float, int]] = []
                dull = 0
                for o in np.unique(order):
                    new = {(-sign * float(x), int(i)) for x, i in zip(score[order == o], ids[order == o]) if not np.isnan(i)}
                    held = sorted({*held, *new})[:k]
                    dull = dull + 1 if sum(h in new for h in held) < least else 0
                    if dull >= patience:
                        break
                yield pa.RecordBatch.from_arrays([pa.array([t.column("qid")[int(s)].as_py()] * len(held), pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array([-sign * h[0] for h in held], pa.float64()), pa.array(range(1, len(held) + 1), pa.int32())], ["qid", "id", "score", "rank"])

    return rows.repartition("qid").sortWithinPartitions("qid", "order").mapInArrow(stop, RESULT + ", rank int")


def product_probe(queries: DataFrame, books: np.ndarray, k: int) -> DataFrame:
    """The k least sums of squared distances over all combinations of one sub-centroid from each sub-space, as ``qid, id, score, rank``; the id of a
    combination has the first sub-space's code in its lowest place. Only the k best of a sub-space can be part of the k best combinations."""
    m, codes, d = books.shape

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, values = flat(b.column("vec"))
            q = values.reshape(len(offsets) - 1, m, d) if len(offsets) > 1 else np.zeros((0, m, d))
            out: list[list] = [[], [], [], []]
            for row, qid in zip(q, b.column("id").to_pylist()):
                ids, total = np.zeros(1, np.int64), np.zeros(1)
                for i in range(m):
                    gaps = ((books[i] - row[i]) ** 2).sum(axis=1)
                    near = np.lexsort((np.arange(codes), gaps))[:k]
                    ids, total = (ids[:, None] + near * codes**i).ravel(), (total[:, None] + gaps[near]).ravel()
                    keep = np.lexsort((ids, total))[:k]
                    ids, total = ids[keep], total[keep]
                for col, v in zip(out, ([qid] * len(ids), ids.tolist(), total.tolist(), range(1, len(ids) + 1))):
                    col.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.int32()))], ["qid", "id", "score", "rank"])

    return clean(queries, "qid", "q").filter(F.size("vec") == m * d).mapInArrow(combine, RESULT + ", rank int")
