"""Nearest vectors by additive quantisation.

Index. Vectors are packed into blocks. For each group (collection) ``BOOKS`` codebooks of ``WORDS`` full-dimensional codewords are trained on the residuals
of a sample of at most ``SAMPLE`` vectors (block 0, a random part of the group); every vector is then encoded as a sum of one codeword of each
book by beam search. A block keeps the codes, the vectors' norms, the length of what the code leaves over, and the vectors.

Search. Query blocks of a group are divided into crowds of about ``ACROSS``, and every crowd meets every block of the group in a task of its own. Lookup tables hold the inner products of a query with all codewords; the estimate of a
vector is the sum of ``BOOKS`` table entries, with the stored norms for the other metrics. The best ``2 k + 16`` by estimate are scored exactly. Left over
is a vector only if its estimate, raised by the most that its own quantisation error can add (the length of what its code leaves over times that of the
query) and by the rounding of single precision, is below the k-th of those scores. So the answer is exact whatever the codebooks and the
queries are; those only decide how many vectors are scored. The lists of the blocks are merged by the loser tree of ``topn``.

Metrics: 0 squared L2 (smaller is better), 1 inner product, 2 cosine. Exact scores are in double precision; equal scores go by the
smaller id.

Defined results: null, empty, non-finite or (as stored vectors) all-zero vectors and null ids take no part; a query of another dimension than its group's,
with k null or < 1, or of an unknown group gets no rows; a zero query has cosine 0 with everything; groups smaller than k give all
their vectors; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded, cut, whole_groups
from .topn import top_n
from .vectors import matrix, packed

BLOCK, QUERIES, SAMPLE = 8192, 256, 4096
ACROSS = 16  # blocks of queries in a crowd
GROUPS = 100_000  # groups whose sizes may be broadcast
BOOKS, WORDS, BEAM, ROUNDS = 16, 64, 3, 5
ROUNDING = 2.0**-23  # of a step in single precision, doubled
L2, INNER, COSINE = 0, 1, 2


def train(x: np.ndarray, seed: int = 7) -> np.ndarray:
    """Codebooks (BOOKS, words, d) for the rows of x: k-means on what the books before leave over."""
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))[:SAMPLE]].astype(np.float32)
    k = max(1, min(WORDS, len(x)))
    books = np.zeros((BOOKS, k, x.shape[1]), np.float32)
    for m in range(BOOKS):
        c = x[rng.permutation(len(x))[:k]].copy()
        for _ in range(ROUNDS):
            near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
            n = np.bincount(near, minlength=k)
            order = np.argsort(near, kind="stable")
            filled = np.flatnonzero(n)
            c[filled] = np.add.reduceat(x[order], np.append(0, np.cumsum(n))[filled], axis=0) / n[filled, None]
        books[m] = c
        x -= c[(x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)]
    return books


def encode(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, BOOKS) by beam search, and the length of what they leave over."""
    count, k, d = books.shape
    out, left = np.zeros((len(x), count), np.uint8), np.zeros(len(x), np.float32)
    norms = (books * books).sum(axis=2)
    for s in range(0, len(x), 1024):
        part = x[s : s + 1024].astype(np.float32)
        n = len(part)
        rest, codes = part[:, None, :], np.zeros((n, 1, 0), np.uint8)
        error = (part * part).sum(axis=1)[:, None]
        for m in range(count):
            width = rest.shape[1]
            cost = (error[:, :, None] - 2 * (rest.reshape(n * width, d) @ books[m].T).reshape(n, width, k) + norms[m]).reshape(n, width * k)
            keep = min(BEAM, width * k)
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < width * k else np.tile(np.arange(keep), (n, 1))
            beam, word = best // k, best % k
            error = np.take_along_axis(cost, best, axis=1)
            rest = np.take_along_axis(rest, beam[:, :, None], axis=1) - books[m][word]
            codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        top = error.argmin(axis=1)
        out[s : s + n] = codes[np.arange(n), top]
        r = rest[np.arange(n), top]
        left[s : s + n] = np.sqrt((r * r).sum(axis=1))
    return out, left


class Block:
    """Decoded block of an index."""

    def __init__(self, ids: bytes, vecs: bytes, codes: bytes, left: bytes, books: bytes, n: int, d: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(vecs, np.float32).reshape(n, d)
        self.codes = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(n, BOOKS).T).astype(np.intp)
        self.left = np.frombuffer(left, np.float32)
        self.books = np.frombuffer(books, np.float32).reshape(-1, d)
        x = self.x.astype(np.float64)
        self.square = (x * x).sum(axis=1)
        self.length = np.sqrt(self.square)

    def exact(self, rows: np.ndarray, q: np.ndarray, metric: int) -> np.ndarray:
        """Scores of rows, larger being better; each row is summed alike, so copies score the same."""
        x = self.x[rows].astype(np.float64)
        if metric == L2:
            x -= q
            return -(x * x).sum(axis=1)
        dot = (x * q).sum(axis=1)
        if metric == INNER:
            return dot
        size = np.sqrt((q * q).sum())
        return dot / (size * self.length[rows]) if size else np.zeros(len(rows))

    def search(self, q: np.ndarray, ks: np.ndarray, metrics: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, ids, scores) of the best k of the block, best first."""
        n, d = self.x.shape
        words = len(self.books) // BOOKS
        tables = q.astype(np.float32) @ self.books.T
        # the sum of the longest words bounds every partial sum of an estimate
        longest = np.sqrt((self.books.astype(np.float64).reshape(BOOKS, words, d) ** 2).sum(axis=2)).max(axis=1).sum()
        step = (d + 2 * BOOKS) * ROUNDING
        spread = self.left * (1 + step) + step * (longest + self.length)
        for s in range(0, len(q), 32):
            lut = tables[s : s + 32]
            dots = np.zeros((len(lut), n), np.float32)
            for m in range(BOOKS):
                dots += np.take(lut[:, m * words : (m + 1) * words], self.codes[m], axis=1)
            for i in range(len(lut)):
                k, metric, one = int(ks[s + i]), int(metrics[s + i]), q[s + i].astype(np.float64)
                first = min(n, 2 * k + 16)
                size = np.sqrt((one * one).sum())
                scale = 2 if metric == L2 else 1 / self.length if metric == COSINE else 1
                about, more = dots[i] * scale - (self.square if metric == L2 else 0), size * spread * scale
                if first < n:
                    rows = np.argpartition(about, n - first)[n - first :]
                    score = self.exact(rows, one, metric)
                    limit = np.partition(score, first - k)[first - k]
                    if metric == L2:
                        limit += size * size
                    elif metric == COSINE:
                        limit *= size
                    near = ~(about + more < limit)  # also where numbers too large for single precision leave no estimate
                    near[rows] = True
                    rows = np.flatnonzero(near)
                    if len(rows) > 4 * k:  # once more by the vectors themselves in single precision
                        scale = scale[rows] if metric == COSINE else scale
                        about = (self.x[rows] @ q[s + i].astype(np.float32)) * scale - (self.square[rows] if metric == L2 else 0)
                        rows = rows[~(about + step * size * self.length[rows] * scale < limit)]
                else:
                    rows = np.arange(n)
                score = self.exact(rows, one, metric)
                if len(rows) > 4 * k:
                    near = np.flatnonzero(score >= np.partition(score, len(rows) - k)[len(rows) - k])
                    rows, score = rows[near], score[near]
                best = np.lexsort((self.ids[rows], -score))[:k]
                yield s + i, self.ids[rows[best]], score[best]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            x = np.frombuffer(b.column("vecs")[i].as_py(), np.float32).reshape(-1, b.column("d")[i].as_py())
            yield pa.RecordBatch.from_arrays([b.column("grp").slice(i, 1), b.column("blocks").slice(i, 1), pa.array([train(x).tobytes()])], ["grp", "blocks", "books"])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    books = None
    for b in batches:
        for i in range(b.num_rows):
            if b.column("kind")[i].as_py() == 0:
                books = b.column("books")[i].as_py()
                continue
            d = b.column("d")[i].as_py()
            x = np.frombuffer(b.column("vecs")[i].as_py(), np.float32).reshape(-1, d)
            codes, left = encode(x, np.frombuffer(books, np.float32).reshape(BOOKS, -1, d))
            row = b.slice(i, 1)
            yield pa.RecordBatch.from_arrays([*[row.column(c) for c in ("grp", "block", "blocks", "n", "d", "ids", "vecs")], pa.array([codes.tobytes()]), pa.array([left.tobytes()]), pa.array([books])], ["grp", "block", "blocks", "n", "d", "ids", "vecs", "codes", "left", "books"])


def build_index(vectors: DataFrame) -> DataFrame:
    """The encoded blocks of ``grp string, id bigint, vec array<float>``; write it as Parquet to keep it."""
    blocks = cut(packed(vectors, BLOCK))
    books = blocks.filter("block = 0").mapInArrow(_train, "grp string, blocks int, books binary")
    sent = books.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "books")
    rows = sent.unionByName(blocks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "kind").mapInArrow(
        _encode, "grp string, block int, blocks int, n int, d int, ids binary, vecs binary, codes binary, left binary, books binary")


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, at in whole_groups(batches, ["grp", "part", "d"]):
        for s, e in zip(at[:-1], at[1:]):
            s, e = int(s), int(e)
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in ((t.column("grp")[s].as_py(), pa.string()), (t.column("d")[s].as_py(), pa.int32()), (t.column("qid")[s:e].to_numpy().astype("<i8").tobytes(), pa.binary()), (t.column("sub")[s:e].to_numpy().astype("<i8").tobytes(), pa.binary()), (t.column("k")[s:e].to_numpy().astype("<i8").tobytes(), pa.binary()), (t.column("metric")[s:e].to_numpy().astype("<i8").tobytes(), pa.binary()), (matrix(t, s, e, "q").tobytes(), pa.binary()), (t.column("crowd")[s].as_py(), pa.int32()))],
                ["grp", "d", "qids", "subs", "ks", "metrics", "qs", "crowd"],
            )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = at = None
    for b in batches:
        for i in range(b.num_rows):
            get = lambda c: b.column(c)[i].as_py()  # noqa: B023, E731
            here = get("grp"), get("block"), get("crowd")
            if get("kind") == 0:
                block, at = Block(*(get(c) for c in ("ids", "vecs", "codes", "left", "books", "n", "d"))), here
                continue
            if here != at or get("d") != block.x.shape[1]:
                continue
            qids, subs, ks, metrics = (np.frombuffer(get(c), np.int64) for c in ("qids", "subs", "ks", "metrics"))
            found = list(block.search(np.frombuffer(get("qs"), np.float32).reshape(len(qids), -1), ks, metrics))
            lens = [len(x[1]) for x in found]
            which = np.repeat([x[0] for x in found], lens)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (qids[which], subs[which], ks[which], np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found]))], ["qid", "sub", "k", "id", "score"])


def search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """``qid, sub, id, score, rank`` for queries ``qid bigint, sub bigint, grp string, q array<float>, k, metric`` ((qid, sub) unique). Scores are
    such that larger is better (squared distances are negated)."""
    asked = queries.filter("k > 0 and size(q) > 0 and qid is not null and metric in (0, 1, 2)").withColumn("d", F.size("q"))
    # of each group: blocks of its queries, and the crowds these are divided into, so a cell of one index block and one crowd has bounded work and bytes
    parts = F.ceil(F.count("*") / QUERIES).cast("int")
    counts = bounded(cut(asked.groupBy("grp").agg(parts.alias("parts"), F.ceil(parts / ACROSS).cast("int").alias("crowds"))), GROUPS)
    placed = asked.join(counts, "grp").withColumn("part", F.pmod(F.xxhash64("qid", "sub"), F.col("parts")).cast("int")).withColumn("crowd", F.col("part") % F.col("crowds"))
    blocks = placed.repartition("grp", "part").sortWithinPartitions("grp", "part", "d").mapInArrow(_pack_queries, "grp string, d int, qids binary, subs binary, ks binary, metrics binary, qs binary, crowd int")
    sizes = bounded(index.select("grp", "blocks").filter("block = 0"), GROUPS)
    sent = blocks.join(sizes, "grp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").withColumn("kind", F.lit(1))
    stored = index.drop("blocks").join(counts.select("grp", "crowds"), "grp").withColumn("crowd", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1))).drop("crowds").withColumn("kind", F.lit(0))
    rows = stored.unionByName(sent, allowMissingColumns=True)
    found = rows.repartition("grp", "block", "crowd").sortWithinPartitions("grp", "block", "crowd", "kind").mapInArrow(_search, "qid bigint, sub bigint, k bigint, id bigint, score double")
    return top_n(found, ["qid", "sub"], "score", "id", "k")
