"""Near-duplicate texts with SetSketch registers.

Each text is the set of its runs of ``words`` consecutive words. Register i of a set is ``floor(1 - log_b(h_i))`` limited to 0..q+1, with h_i
the least of one exponential value per element: exponentially spaced, truncated minima. Registers of a union are the maxima of the
registers, and two registers agree with a probability close to the similarity of the sets.

1. Rows are sketched where they are; from here on only sketches are shuffled. Texts with the same set form a class; only its representative (smallest id) goes on to
   be compared; ``id_pairs`` gives the pairs of all members.
2. Registers are banded; representatives that agree in all registers of a band are compared. The bands are laid out so that a pair at the
   threshold is missed with a probability of at most ``MISS``. Bands carry ids only. Buckets are counted first (one row a task for a hot one); those of more than ``HOT`` members
   are divided by further bands over the registers in another order, ``DEPTH`` times; what is still as large then (texts alike in very many bands) is compared in full as
   a grid of blocks spread over tasks. No bucket is cut short.
3. Similarity is estimated jointly from the numbers of greater, equal and smaller registers by maximum likelihood; pairs well under the threshold end here.
4. The rest are verified on their texts' sets, so no pair below the threshold comes out.

Defined results: null or empty texts and texts of fewer words than a run have an empty set and are similar to nothing; rows with a null id
are left out; of several rows of one id one counts, that with the most distinct runs (then the greatest digest); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded, cut, flat, whole_groups

REGISTERS, BASE, RATE, TOP = 240, 1.001, 20.0, (1 << 16) - 2
MISS = 2e-4
SLACK = 0.15  # about five standard errors of the estimate
BLOCK, HOT, DEPTH = 256, 256, 2
WORD = re.compile(r"[^\W_]+")
_known: dict[str, int] = {}


@lru_cache
def _mixers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)


@lru_cache
def _order(level: int) -> np.ndarray:
    """The order in which registers are banded at a level of division."""
    return np.arange(REGISTERS) if level == 0 else np.random.default_rng(level).permutation(REGISTERS)


def band_rows(similarity: float) -> int:
    """The most registers in a band with which a pair at the threshold is still missed with a probability of at most MISS."""
    fits = [r for r in range(1, 17) if (1 - similarity**r) ** (REGISTERS // r) <= MISS]
    return max(fits, default=1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit values of the runs of ``words`` words (runs of letters or digits, in lower case)."""
    found = WORD.findall(text.lower()) if text else []
    if len(found) < words:
        return np.empty(0, np.uint64)
    if len(_known) > 2_000_000:
        _known.clear()
    codes = np.empty(len(found), np.uint64)
    for i, w in enumerate(found):
        c = _known.get(w)
        if c is None:
            c = _known[w] = xxhash.xxh64_intdigest(w)
        codes[i] = c
    n = len(codes) - words + 1
    value = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            value = (value ^ (value >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + n]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(32)
    return np.unique(value)


def registers(values: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit values. Hashing is in 32 bits, which processors do eight at a time."""
    a, b = _mixers()
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    x = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    for i in range(0, len(x), 1024):  # bounds the memory for very long texts
        h = x[i : i + 1024, None] * a
        h += b
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        least = np.minimum(least, h.min(axis=0))
    u = (least.astype(np.float64) + 1) / 2.0**32
    h = -np.log1p(-np.minimum(u, 1 - 1e-12)) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of sets from their registers (rows of a and b) and sizes."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, 101)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    floor = 1e-9
    fit = more * np.log(np.maximum(up, floor)) + less * np.log(np.maximum(down, floor)) + same * np.log(np.maximum(1 - up - down, floor))
    return np.take_along_axis(j, fit.argmax(axis=1)[:, None], axis=1)[:, 0]


def _regs(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _sketch(words: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                s = shingles(text, words)
                if len(s):
                    rows.append((id, len(s), xxhash.xxh3_128_digest(s.tobytes()), registers(s).tobytes()))
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary())], ["id", "n", "set_key", "regs"])

    return sketch


def _bands(rows: int, level: int):
    """``key, id``, one row for each band; below level 0 the key of the bucket that is divided is part of the new keys."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            regs, count = _regs(b.column("regs"))[:, _order(level)], REGISTERS // rows
            keys = np.zeros((len(regs), count), np.uint64)
            with np.errstate(over="ignore"):
                keys += np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                if level:
                    keys ^= b.column("key").to_numpy().view(np.uint64)[:, None]
                for j in range(rows):
                    keys = (keys ^ (keys >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9) + regs[:, j : count * rows : rows]
                keys ^= keys >> np.uint64(31)
            ids = np.repeat(b.column("id").to_numpy(), count)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    return bands


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs inside buckets of at most HOT members."""
    for t, at in whole_groups(batches, ["key"]):
        ids, sizes = t.column("id").to_numpy(), np.diff(at)
        left, right = [], []
        for n in np.unique(sizes):
            begin = at[:-1][sizes == n]
            x, y = np.triu_indices(n, 1)
            for s in range(0, len(begin), max(1, (1 << 20) // max(1, len(x)))):
                part = begin[s : s + max(1, (1 << 20) // max(1, len(x)))][:, None]
                left.append(ids[(part + x).ravel()])
                right.append(ids[(part + y).ravel()])
        a, b = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (left, right))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _compare(least: float):
    """Within each cell of a bucket's grid, the pairs whose estimate reaches ``least``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["key", "i", "j"]):
            regs, ids, n = _regs(t.column("regs")), t.column("id").to_numpy(), t.column("n").to_numpy()
            part, ci, cj = (t.column(c).to_numpy() for c in ("part", "i", "j"))
            left, right = [], []
            for s, e in zip(at[:-1], at[1:]):
                if ci[s] == cj[s]:
                    x, y = np.triu_indices(e - s, 1)
                    x, y = x + s, y + s
                else:
                    x, y = (g.ravel() for g in np.meshgrid(s + np.flatnonzero(part[s:e] == ci[s]), s + np.flatnonzero(part[s:e] == cj[s]), indexing="ij"))
                for k in range(0, len(x), 4096):
                    p, q = x[k : k + 4096], y[k : k + 4096]
                    good = estimate(regs[p], regs[q], n[p], n[q]) >= least
                    left.append(ids[p[good]])
                    right.append(ids[q[good]])
            a, b = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return compare


def _likely(least: float):
    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                good = estimate(_regs(b.column("ra")), _regs(b.column("rb")), b.column("na").to_numpy(), b.column("nb").to_numpy()) >= least
                yield b.select(["a", "b"]).filter(pa.array(good))

    return likely


def _sets(words: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingles(t, words) for t in b.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in made]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in made], pa.int64()), pa.array(keys, pa.binary()), pa.array([s.view(np.int64) for s in made], pa.list_(pa.int64()))], ["id", "n", "set_key", "elements"])

    return sets


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of common elements of pairs of sets."""
    for b in batches:
        (ao, av), (bo, bv) = flat(b.column("sa")), flat(b.column("sb"))
        out = np.zeros(b.num_rows)
        for i in range(b.num_rows):
            x, y = av[ao[i] : ao[i + 1]].view(np.uint64), bv[bo[i] : bo[i + 1]].view(np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            out[i] = common / max(1, len(both) - common)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(out)], ["a", "b", "similarity"])


class NearDuplicates:
    """``classes``: id, rep (a row for every text with a set); ``pairs``: a, b, similarity between representatives, a < b."""

    def __init__(self, df: DataFrame, id: str, text: str, words: int = 5, similarity: float = 0.8, hot: int = HOT):
        self.words, self.similarity, self.hot = words, similarity, hot
        texts = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
        each = texts.mapInArrow(_sketch(words), "id bigint, n bigint, set_key binary, regs binary")
        sketched = cut(each.groupBy("id").agg(F.max(F.struct("n", "set_key", "regs")).alias("m")).select("id", "m.n", "m.set_key", "m.regs"))
        firsts = cut(sketched.groupBy("set_key").agg(F.min(F.struct("id", "n", "regs")).alias("m"), F.count("*").alias("copies")).select("set_key", "copies", "m.id", "m.n", "m.regs"))
        # only classes of several members have to be looked up again
        several = firsts.filter("copies > 1").select("set_key", F.col("id").alias("rep"))
        self.classes = sketched.select("id", "set_key").join(bounded(several, 200_000), "set_key", "left").select("id", F.coalesce("rep", "id").alias("rep"))
        self.several = self.classes.join(several.select("rep"), "rep", "left_semi").select("id", "rep")
        self.reps = firsts.select("id", "n", "regs")
        near = cut(self._candidates(self.reps, 0).distinct())
        ra, rb = (self.reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}")) for x in "ab")
        likely = cut(near.join(ra, "a").join(rb, "b").mapInArrow(_likely(similarity - SLACK), "a bigint, b bigint"))
        ids = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = texts.join(bounded(ids, 200_000), "id", "left_semi").mapInArrow(_sets(words), "id bigint, n bigint, set_key binary, elements array<bigint>")
        sets = cut(wanted.groupBy("id").agg(F.max(F.struct("n", "set_key", "elements")).alias("m")).select("id", "m.elements"))
        sa, sb = (sets.select(F.col("id").alias(x), F.col("elements").alias(f"s{x}")) for x in "ab")
        both = likely.join(sa, "a").join(sb, "b").mapInArrow(_verify, "a bigint, b bigint, similarity double")
        self.pairs = cut(both.filter(F.col("similarity") >= similarity))

    def _candidates(self, rows: DataFrame, level: int) -> DataFrame:
        """Pairs ``a, b`` (with repeats) of ``id, n, regs`` (below level 0 also ``key``) that share a band."""
        bands = rows.mapInArrow(_bands(band_rows(self.similarity), level), "key bigint, id bigint")
        buckets = cut(bands.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("a"), F.max("id").alias("b")).filter("c > 1 and a != b"))
        two = buckets.filter("c = 2").select("a", "b")
        some = bands.join(bounded(buckets.filter(F.col("c").between(3, self.hot)).select("key"), 200_000), "key", "left_semi")
        few = some.repartition("key").sortWithinPartitions("key").mapInArrow(_members, "a bigint, b bigint")
        out = two.union(few)
        crowds = buckets.filter(F.col("c") > self.hot).select("key", "c")
        if not crowds.limit(1).count():
            return out
        inside = bands.join(crowds, "key").join(self.reps, "id")
        if level < DEPTH:
            return out.union(self._candidates(cut(inside.select("id", "n", "regs", "key")), level + 1))
        # each row meets the others of its bucket in a grid of blocks, so the rows of a hot bucket are spread over tasks
        parts = F.ceil(F.col("c") / BLOCK).cast("int")
        placed = inside.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
        cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1))).select(
            "key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "n", "regs")
        return out.union(cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compare(self.similarity - SLACK), "a bigint, b bigint"))

    def id_pairs(self) -> DataFrame:
        """All pairs of ids, ``id_a < id_b``: the members of a class with each other, and with the members of similar classes."""
        a, b = (self.several.select(F.col("rep").alias(x), F.col("id").alias(f"i{x}")) for x in "ab")
        across = self.pairs.select("a", "b").join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ia", "a").alias("ia"), F.coalesce("ib", "b").alias("ib"))
        within = a.join(b.withColumnRenamed("b", "a"), "a").filter("ia < ib").select("ia", "ib")
        return across.union(within).select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))

    def links(self) -> DataFrame:
        """One row a text: ``id``, its class ``rep``, the number of ``copies`` and of similar other classes (``links``)."""
        ends = self.pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
        sizes = self.classes.groupBy("rep").agg(F.count("*").alias("copies"))
        return self.classes.join(sizes, "rep").join(ends, "rep", "left").select("id", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"))
