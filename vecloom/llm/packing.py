"""Putting texts together into contexts of a fixed number of tokens, balanced by cost.

The cost of a text of t tokens in a context is ``LINEAR * t + QUADRATIC * t * t``: what is done for every token, and what every token does with the
others of its text. Texts go in descending order, each to the cheapest context that has room for it; a context is opened when none has. As
many contexts as the tokens fill are open from the start, so small texts come last and level out what the large ones left. Only a text
larger than a context is divided: into full contexts, and a rest that is packed like a text.

Where the texts are they are counted, and divided if need be; only sizes and ranges are shuffled. Packing goes by shards of about ``SHARD`` texts by a
hash of the id, each on one task with bounded memory, so room is left over shard by shard.

Tokens are those of a public tokenizer over the whole text (``tokens``). A text larger than a context is cut where the prefix sums of its tokens say, at the last character
at which a part still fits.

Defined results: null and empty texts have no tokens and are in no context; rows with a null id are left out; of several
rows of one id one counts, that with the most tokens; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, whole_groups
from .tokens import VOCABULARY, Tokenizer, tokenizer

CONTEXT, SHARD = 8192, 16384
LINEAR, QUADRATIC = 1.0, 1 / 1024
PARTS = "id bigint, part_no int, begin_char int, end_char int, tokens int"


def parts(text: str | None, size: int, tokens: Tokenizer) -> list[tuple[int, int, int]]:
    """(begin, end, tokens) of a text's parts: one, or full contexts and a rest if it is larger than a context. They cover the text."""
    if not text:
        return []
    count = tokens.count(text)
    if count <= size:
        return [(0, len(text), count)]
    sums, out, begin = tokens.sums(text), [], 0
    while begin < len(text):
        end = max(begin + 1, int(np.searchsorted(sums, sums[begin] + size, "right")) - 1)
        out.append((begin, end, int(sums[end] - sums[begin])))
        begin = end
    return out


def pack(tokens: np.ndarray, size: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """The context number of every text, given in descending order of tokens."""
    room, cost = (np.zeros(len(tokens) + 1) for _ in range(2))
    count = -(-int(tokens.sum()) // size)
    room[:count] = size
    out = np.zeros(len(tokens), np.int64)
    for k, t in enumerate(tokens):
        fits = np.flatnonzero(room[:count] >= t)
        if len(fits):
            at = fits[cost[fits].argmin()]
        else:
            at, count = count, count + 1
            room[at] = size
        out[k] = at
        room[at] -= t
        cost[at] += linear * t + quadratic * t * t
    return out


def _measure(size: int, tokens: Tokenizer):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for id, text in zip(b.column("id").to_pylist(), b.column("text")):
                t = text.as_py()
                if p := parts(t, size, tokens):
                    rows.append((id, sum(x[2] for x in p), xxhash.xxh3_64_intdigest(t) >> 1, [0, *(x[1] for x in p)], [x[2] for x in p]))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["id", "total", "digest", "cuts", "sizes"])

    return measure


def _pack(size: int):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, ["shard"]):
            for s, e in zip(at[:-1], at[1:]):
                part = t.slice(int(s), int(e - s)).sort_by([("tokens", "descending"), ("id", "ascending"), ("part_no", "ascending")])
                where = pack(part.column("tokens").to_numpy(), size) + (part.column("shard")[0].as_py() << 32)
                yield from part.drop_columns("shard").add_column(0, "context_id", pa.array(where)).to_batches()

    return shards


def contexts(df: DataFrame, id: str, text: str, size: int = CONTEXT, shard: int = SHARD, vocabulary: str = VOCABULARY) -> DataFrame:
    """``context_id, id, part_no, begin_char, end_char, tokens``: the context of every text, or of every part of one larger than a context."""
    texts = df.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).filter("id is not null")
    counted = texts.mapInArrow(_measure(size, tokenizer(df.sparkSession, vocabulary)), "id bigint, total bigint, digest bigint, cuts array<int>, sizes array<int>")
    measured = counted.groupBy("id").agg(F.max(F.struct("total", "digest", "cuts", "sizes")).alias("m"))
    each = measured.select("id", "m.cuts", F.posexplode("m.sizes").alias("part_no", "tokens"))
    k = F.col("part_no")
    each = cut(each.select("id", "part_no", F.col("cuts")[k].alias("begin_char"), F.col("cuts")[k + 1].alias("end_char"), "tokens"))
    shards = max(1, -(-each.count() // shard))
    placed = each.withColumn("shard", F.pmod(F.xxhash64("id", "part_no"), F.lit(shards)))
    return placed.repartition("shard").sortWithinPartitions("shard").mapInArrow(_pack(size), "context_id bigint, " + PARTS)
