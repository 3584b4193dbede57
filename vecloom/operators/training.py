"""Training of the parameters of an index: k-means, inverted lists, product quantisers, rotations, fine-tuning.

A pass over the data assigns vectors and adds up sums inside tasks; only centroids, codebooks and gradients, whose size doesn't depend on the number of
vectors, come to the driver. Steps that need many passes over few vectors (product quantiser, rotation) take a sample of at most ``SAMPLE`` vectors,
those of the least hashes of their ids; every vector is then encoded with the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, flat
from .exact import clean, matrices
from .statistics import means

SAMPLE = 65_536
SPLIT = 1 / 1024  # by which the halves of a split cluster are moved apart
LISTS = 1 << 22  # of one-dimensional k-means: distinct values the exact method takes


def sample(df: DataFrame, n: int = SAMPLE, seed: int = 0, id: str = "id", vec: str = "vec") -> np.ndarray:
    """At most n usable vectors, the same on every run."""
    rows = clean(df, id, vec).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(n).select("vec").collect()
    return np.array([r["vec"] for r in rows], float)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest row of c for each row of x, the first on ties, and the squared distance."""
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)
    at = d.argmin(axis=1)
    return at, ((x - c[at]) ** 2).sum(axis=1)


def split_empty(c: np.ndarray, n: np.ndarray, seed: int = 0) -> np.ndarray:
    """Centroids without members take over half of the largest cluster: both halves are the centroid moved by SPLIT up and down in turn."""
    c, n = c.copy(), n.astype(float).copy()
    up = np.where(np.arange(c.shape[1]) % 2 == 0, 1 + SPLIT, 1 - SPLIT)
    for i in np.flatnonzero(n == 0):
        j = int(n.argmax())
        if n[j] < 2:
            break
        c[i], c[j] = c[j] * up, c[j] * (2 - up)
        n[i] = n[j] / 2
        n[j] -= n[i]
    return c


def step(df: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One pass of Lloyd's algorithm over ``id, vec``: member counts, sums of members, and the sum of squared distances."""
    held = df.sparkSession.sparkContext.broadcast(c)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, d = held.value.shape
        n, sums, cost = np.zeros(k, np.int64), np.zeros((k, d)), 0.0
        for b in batches:
            for _, x in matrices(b):
                if x.shape[1] != d:
                    continue
                at, gaps = nearest(x, held.value)
                cost += float(gaps.sum())
                n += np.bincount(at, minlength=k)
                order = np.argsort(at, kind="stable")
                used = np.flatnonzero(np.bincount(at, minlength=k))
                sums[used] += np.add.reduceat(x[order], np.searchsorted(at[order], used), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n), pa.array([cost] + [0.0] * (k - 1)), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["c", "n", "cost", "sums"])

    parts = clean(df, "id", "vec").mapInArrow(add, "c int, n bigint, cost double, sums array<double>")
    cells = parts.select("c", "n", "cost", F.posexplode("sums").alias("j", "s")).groupBy("c", "j").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("s").alias("s")).collect()
    n, sums, cost = np.zeros(len(c), np.int64), np.zeros(c.shape), 0.0
    for r in cells:  # k times d rows
        n[r["c"]], sums[r["c"], r["j"]] = r["n"], r["s"]
        cost += r["cost"] if r["j"] == 0 else 0.0
    return n, sums, cost


def kmeans(df: DataFrame, k: int, rounds: int = 10, redo: int = 1, spherical: bool = False, whole_numbers: bool = False, frozen: np.ndarray | None = None, per_centroid: int | None = None, seed: int = 0) -> tuple[np.ndarray, list[float]]:
    """Centroids (k, d) and the objective before every round of the best of ``redo`` starts. ``frozen`` centroids come first and stay; ``per_centroid``
    trains on that many vectors for each centroid only (by hash). Fewer vectors than k give as many centroids."""
    rows = df.select("id", "vec")
    if per_centroid is not None:
        rows = clean(rows, "id", "vec").orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(per_centroid * k)
    rows = cut(rows)
    best: tuple[np.ndarray, list[float]] | None = None
    for start in range(redo):
        c = sample(rows, k, seed + start)
        kept = 0
        if frozen is not None:
            kept = len(frozen)
            c = np.concatenate([frozen, c[: k - kept]])
        costs = []
        for _ in range(rounds):
            if not len(c):
                break
            n, sums, cost = step(rows, c)
            costs.append(cost)
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
            new = split_empty(new, n, seed)
            if spherical:
                new = unit(new)
            if whole_numbers:
                new = np.round(new)
            new[:kept] = c[:kept]
            c = new
        if best is None or costs and costs[-1] < best[1][-1]:
            best = (c, costs)
    return best


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1))[:, None]
    return np.divide(x, size, out=x.copy(), where=size > 0)


def kmeans_local(x: np.ndarray, k: int, rounds: int = 25, start: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm on a sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]].copy() if start is None else start.copy()
    for _ in range(rounds):
        at, _ = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = split_empty(np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c), n)
    return c


def kmeans_line(df: DataFrame, value: str, k: int) -> tuple[list[float], float]:
    """Exact k-means of numbers: the centroids in ascending order and the least possible objective, by dynamic programming over the sorted distinct
    values (the best last cut of a prefix moves to the right with the prefix, so each row is filled by dividing and conquering)."""
    table = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").alias("n"))
    if table.limit(LISTS + 1).count() > LISTS:
        raise ValueError(f"more than {LISTS} distinct values; use kmeans")
    rows = sorted((r["x"], r["n"]) for r in table.collect())
    if not rows:
        return [], 0.0
    x, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    shift = float((x * w).sum() / w.sum())
    y = x - shift
    sw, sx, sq = (np.append(0, np.cumsum(v)) for v in (w, w * y, w * y * y))
    m, k = len(x), min(k, len(x))

    def cost(i: np.ndarray, j: int) -> np.ndarray:
        """Of values i..j-1 as one cluster."""
        return np.maximum(sq[j] - sq[i] - (sx[j] - sx[i]) ** 2 / (sw[j] - sw[i]), 0)

    best = np.array([0.0, *(cost(np.array([0]), j)[0] for j in range(1, m + 1))])
    cuts = [np.zeros(m + 1, np.int64)]
    for c in range(2, k + 1):
        new, at = np.full(m + 1, np.inf), np.zeros(m + 1, np.int64)
        todo = [(c, m, c - 1, m - 1)]
        while todo:
            lo, hi, left, right = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            total = best[i] + cost(i, j)
            p = int(total.argmin())
            new[j], at[j] = total[p], i[p]
            todo += [(lo, j - 1, left, int(i[p])), (j + 1, hi, int(i[p]), right)]
        best = new
        cuts.append(at)
    centres, j = [], m
    for at in reversed(cuts):
        i = int(at[j])
        centres.append(shift + (sx[j] - sx[i]) / (sw[j] - sw[i]))
        j = i
    return centres[::-1], float(best[m])


def train_pq(x: np.ndarray, parts: int, bits: int = 4, rounds: int = 25, start: np.ndarray | None = None, shared: bool = False, seed: int = 0) -> np.ndarray:
    """Codebooks (parts, 2^bits, d / parts) from sample rows; ``start`` continues from given ones, ``shared`` trains one for all sub-spaces."""
    n, d = x.shape
    if d % parts:
        raise ValueError("the dimension must be a multiple of the number of parts")
    sub = x.reshape(n, parts, d // parts)
    k = min(1 << bits, n)
    if shared:
        one = kmeans_local(sub.reshape(-1, d // parts), k, rounds, None if start is None else start[0], seed)
        return np.repeat(one[None], parts, axis=0)
    return np.stack([kmeans_local(sub[:, m], k, rounds, None if start is None else start[m], seed + m) for m in range(parts)])


def pq_round_trip(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and reconstruction."""
    parts, _, d = books.shape
    codes = np.stack([nearest(x.reshape(len(x), parts, d)[:, m], books[m])[0] for m in range(parts)], axis=1)
    return codes, np.concatenate([books[m][codes[:, m]] for m in range(parts)], axis=1)


def train_opq(x: np.ndarray, d_out: int, parts: int, bits: int = 4, rounds: int = 20, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A transform (d_out, d) with orthonormal rows and codebooks of the transformed vectors: by turns the codebooks are fitted to the
    rotated sample and the rotation to their reconstruction (orthogonal Procrustes). It starts from the principal directions."""
    _, _, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=True)
    a = v[:d_out]
    books = train_pq(x @ a.T, parts, bits, 5, seed=seed)
    for _ in range(rounds):
        _, y = pq_round_trip(x @ a.T, books)
        u, _, w = np.linalg.svd(y.T @ x, full_matrices=False)
        a = u @ w
        books = train_pq(x @ a.T, parts, bits, 2, start=books, seed=seed)
    return a, books


def train_index(df: DataFrame, d_out: int, lists: int, metric: str = "ip", bits: int = 4, rounds: int = 10, seed: int = 0) -> dict:
    """First parameters of an index over ``id, vec``: ``a`` (rotation), ``b``, ``centroids`` of the transformed vectors and ``books`` of d_out / 2 parts."""
    x = sample(df, SAMPLE, seed)
    a, books = train_opq(x, d_out, d_out // 2, bits, seed=seed)
    centroids, _ = kmeans(transformed(df, a, np.zeros(d_out)), lists, rounds, spherical=metric == "ip", seed=seed)
    return {"a": a, "b": np.zeros(d_out), "centroids": centroids, "books": books}


def transformed(df: DataFrame, a: np.ndarray, b: np.ndarray, id: str = "id", vec: str = "vec") -> DataFrame:
    """``id, vec`` with ``A x + b`` by matrix multiplication."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in matrices(batch):
                if x.shape[1] == a.shape[1]:
                    y = x @ a.T + b
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * len(a)), pa.array(y.ravel()))], ["id", "vec"])

    return clean(df, id, vec).mapInArrow(move, "id bigint, vec array<double>")


def recentred(vectors: DataFrame, assigned: DataFrame, old: DataFrame, metric: str = "l2") -> DataFrame:
    """``list_no, c``: the mean of each list's (transformed) members, of unit length for ``ip``; a list without members keeps its centroid."""
    from ..functions.vectors import renormalised

    new = means(vectors.join(assigned, "id"), "list_no", "vec").select("list_no", F.col("mean").alias("m"))
    moved = old.join(new, "list_no", "left").select("list_no", F.coalesce("m", F.col("c").cast("array<double>")).alias("c"))
    return moved.withColumn("c", renormalised("c")) if metric == "ip" else moved


def finetune(pairs: DataFrame, a: np.ndarray, b: np.ndarray, books: np.ndarray, epochs: int = 3, rate: float = 1e-3, decay: float = 1e-2, warm: int = 2, temperature: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """Transform and codebooks moved so that quantised scores rank each query's neighbours as exact ones do: ``(a, b, books, losses)``.

    ``pairs`` has ``q array<double>, pos array<array<double>>``. The loss of a query is the divergence of the softmax of its quantised inner products from that
    of the exact ones. The choice of codes passes gradients through unchanged. Each epoch is one pass in which tasks add up gradients; AdamW steps, with
    a linear warm-up and decay, are taken on the driver."""
    spark = pairs.sparkSession
    rows = cut(pairs.select(F.col("q").cast("array<double>").alias("q"), F.col("pos").cast("array<array<double>>").alias("pos")).filter("size(q) > 0 and size(pos) > 0"))
    shapes = [a.shape, b.shape, books.shape]
    theta = np.concatenate([x.ravel() for x in (a, b, books)])
    m1, m2, losses = np.zeros_like(theta), np.zeros_like(theta), []
    unpack = lambda t: [p.reshape(s) for p, s in zip(np.split(t, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes)]
    for epoch in range(epochs):
        held = spark.sparkContext.broadcast(theta)

        def gradient(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            a, b, books = unpack(held.value)
            ga, gb, gc, loss, n = np.zeros_like(a), np.zeros_like(b), np.zeros_like(books), 0.0, 0
            for batch in batches:
                qo, qv = flat(batch.column("q"))
                for i, pos in enumerate(batch.column("pos").to_pylist()):
                    q, p = qv[qo[i] : qo[i + 1]], np.array(pos)
                    y, z = a @ q + b, p @ a.T + b
                    codes, d = pq_round_trip(z, books)
                    exact, given = (p @ q) / temperature, (d @ y) / temperature
                    t, s = np.exp(exact - exact.max()), np.exp(given - given.max())
                    t, s = t / t.sum(), s / s.sum()
                    loss += float((t * (np.log(np.maximum(t, 1e-300)) - np.log(np.maximum(s, 1e-300)))).sum())
                    n += 1
                    g = (s - t) / temperature
                    dy, dz = g @ d, g[:, None] * y
                    ga += np.outer(dy, q) + dz.T @ p
                    gb += dy + dz.sum(axis=0)
                    for k in range(books.shape[0]):
                        np.add.at(gc[k], codes[:, k], dz.reshape(len(p), *books.shape[::2])[:, k])
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([np.concatenate([x.ravel() for x in (ga, gb, gc)]).tolist()], pa.list_(pa.float64()))], ["n", "loss", "g"])

        parts = rows.mapInArrow(gradient, "n bigint, loss double, g array<double>")
        total = parts.select("n", "loss", F.posexplode("g").alias("j", "g")).groupBy("j").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), F.sum("g").alias("g")).collect()
        n = max(1, total[0]["n"]) if total else 1
        g = np.zeros_like(theta)
        for r in total:
            g[r["j"]] = r["g"] / n
        losses.append(total[0]["loss"] / n if total else 0.0)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        pace = rate * min(1.0, (epoch + 1) / max(1, warm)) * (1 - max(0, epoch - warm) / max(1, epochs))
        theta = theta * (1 - pace * decay) - pace * (m1 / (1 - 0.9 ** (epoch + 1))) / (np.sqrt(m2 / (1 - 0.999 ** (epoch + 1))) + 1e-8)
    return *unpack(theta), losses


def vectors_frame(spark, c: np.ndarray, id: str = "list_no", vec: str = "c") -> DataFrame:
    """Rows of a matrix as a small table, numbered from 0."""
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(c)], f"{id} int, {vec} array<double>")
