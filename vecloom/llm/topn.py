"""Top N items within every group, by a loser-tree merge of sorted runs.

1. Runs. Each task sorts its own rows by group, score and id (no shuffle, spills to disk) and cuts every group's run after N
   distinct ids: the rest of a run can't reach the result. A group with a third of all rows thus leaves each task as one run of at most N.
2. Merge. Runs, one row each, are shuffled by group; a loser tree merges a group's runs and, once N ids are out, the merge seeks to the
   next group without looking at what the runs still hold. Never more than ``FAN_IN`` runs of one group are held at a time.

Defined results: rows with a null or NaN score or a null id don't count; a null N means 0; an id counts once a group, with its best score;
equal scores go by the smaller id; null is a group of its own; groups with fewer than N ids give what they have; an empty table gives none.
Infinite scores are ordered like numbers. Columns of the input other than those named are ignored, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import starts

FAN_IN = 64
SPENT = (1,)


def merge_runs(runs: list[tuple[list, list]], n: int) -> tuple[list, list]:
    """First n distinct ids of ascending runs of (keys, ids), by a tree of losers."""
    k = len(runs)
    at = [0] * k
    heads = [(0, keys[0], ids[0]) if keys else SPENT for keys, ids in runs]
    tree = [-1] * k  # tree[0] is the winner, tree[i] the loser of the match at node i
    for r in range(k):
        best, node = r, (r + k) >> 1
        while node:
            if tree[node] < 0:
                tree[node], best = best, -1
                break
            if heads[tree[node]] < heads[best]:
                tree[node], best = best, tree[node]
            node >>= 1
        if best >= 0:
            tree[0] = best
    out_keys, out_ids, seen = [], [], set()
    while len(out_ids) < n:
        w = tree[0]
        head = heads[w]
        if head is SPENT:
            break
        if head[2] not in seen:
            seen.add(head[2])
            out_keys.append(head[1])
            out_ids.append(head[2])
        at[w] += 1
        keys, ids = runs[w]
        heads[w] = (0, keys[at[w]], ids[at[w]]) if at[w] < len(keys) else SPENT
        node = (w + k) >> 1
        while node:
            if heads[tree[node]] < heads[w]:
                tree[node], w = w, tree[node]
            node >>= 1
        tree[0] = w
    return out_keys, out_ids


def _heads(t: pa.Table, groups: list[str]) -> tuple[pa.Table, int]:
    """Of rows sorted by group, key and id, the first n distinct ids of each group; and where the last group begins in the result."""
    at = starts(t, groups)
    sizes = np.diff(np.append(at, t.num_rows))
    group = np.repeat(np.arange(len(at)), sizes)
    ids = t.column("id").combine_chunks()
    ids = pa.concat_arrays(ids.chunks) if isinstance(ids, pa.ChunkedArray) else ids
    codes = ids.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair = group * (codes.max() + 1 if len(codes) else 1) + codes
    first = np.zeros(t.num_rows, dtype=bool)
    first[np.unique(pair, return_index=True)[1]] = True  # the index is that of the first occurrence
    rank = np.cumsum(first) - first
    rank -= rank[at][group]
    keep = first & (rank < t.column("n").to_numpy())
    kept = t.filter(pa.array(keep))
    return kept, int(keep[: at[-1]].sum()) if len(at) else 0


def _pack(t: pa.Table, groups: list[str]) -> pa.RecordBatch:
    """One row a group, its run as two lists."""
    at = starts(t, groups)
    offsets = pa.array(np.append(at, t.num_rows).astype(np.int32))
    first = t.select([*groups, "n"]).take(pa.array(at))
    one = lambda name: pa.concat_arrays(t.column(name).chunks)
    cols = [pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in first.columns]
    cols += [pa.ListArray.from_arrays(offsets, one("key")), pa.ListArray.from_arrays(offsets, one("id"))]
    return pa.RecordBatch.from_arrays(cols, [*groups, "n", "keys", "ids"])


def _runs(groups: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            kept, last = _heads(pa.concat_tables([held, t]) if held is not None else t, groups)
            # the last group may go on in the next batch; at most n of its rows are carried over, and they stay the first of it
            if last:
                yield _pack(kept.slice(0, last), groups)
            held = kept.slice(last)
        if held is not None and held.num_rows:
            yield _pack(held, groups)

    return run


def _merge(groups: list[str], schema: pa.Schema):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(len(groups) + 3)]

        def close(group: tuple, n: int, runs: list) -> None:
            keys, ids = merge_runs(runs, n)
            for col, v in zip(out, group):
                col.extend([v] * len(ids))
            out[-3].extend(ids)
            out[-2].extend(keys)
            out[-1].extend(range(1, len(ids) + 1))

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
            for c in out:
                c.clear()
            return made

        group, n, runs = None, 0, []
        for batch in batches:
            named = list(zip(*[batch.column(g).to_pylist() for g in groups])) if groups else [()] * batch.num_rows
            limits = batch.column("n").to_pylist()
            keys, ids = batch.column("keys").to_pylist(), batch.column("ids").to_pylist()
            for i, g in enumerate(named):
                if g != group:
                    if runs:
                        close(group, n, runs)
                    group, n, runs = g, limits[i], []
                n = max(n, limits[i])
                runs.append((keys[i], ids[i]))
                if len(runs) >= FAN_IN:
                    runs = [merge_runs(runs, n)]
            if len(out[-1]) > 50_000:
                yield full()
        if runs:
            close(group, n, runs)
        if out[-1]:
            yield full()

    return merge


def top_n(df: DataFrame, groups: list[str], score: str, id: str, n: int | str, largest: bool | Column = True) -> DataFrame:
    """The n best ids of each group: ``groups``, the id, the score (as double) and ``rank`` from 1. ``n`` is a number or a column that
    is constant in a group; ``largest`` says whether larger scores are better, also as a column constant in a group."""
    g = [f"g{i}" for i in range(len(groups))]
    value = F.col(score).cast("double")
    up = largest if isinstance(largest, Column) else F.lit(largest)
    limit = F.coalesce((F.lit(n) if isinstance(n, int) else F.col(n)).cast("bigint"), F.lit(0))
    rows = df.select(
        *[F.col(c).alias(a) for c, a in zip(groups, g)], limit.alias("n"), (F.when(up, -value).otherwise(value) + F.lit(0.0)).alias("key"),
        F.col(id).alias("id"), up.alias("up"),
    ).filter("n > 0 and id is not null and key is not null and not isnan(key)")
    # the direction rides along as a group column, being constant in a group
    gu = [*g, "up"]
    field = {f.name: f.dataType for f in rows.schema}
    packed = T.StructType([*[T.StructField(c, field[c]) for c in gu], T.StructField("n", T.LongType()), T.StructField("keys", T.ArrayType(T.DoubleType())), T.StructField("ids", T.ArrayType(field["id"]))])
    runs = rows.sortWithinPartitions(*gu, "key", "id").mapInArrow(_runs(gu), packed)
    result = T.StructType([*[T.StructField(c, field[c]) for c in gu], T.StructField("id", field["id"]), T.StructField("key", T.DoubleType()), T.StructField("rank", T.IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    merged = runs.repartition(*gu).sortWithinPartitions(*gu).mapInArrow(_merge(gu, to_arrow_schema(result)), result)
    return merged.select(*[F.col(a).alias(c) for c, a in zip(groups, g)], F.col("id").alias(id), F.when(F.col("up"), -F.col("key")).otherwise(F.col("key")).alias(score), "rank")
