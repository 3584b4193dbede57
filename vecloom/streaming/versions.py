"""Latest versions of keys over a stream of log entries that come late and out of order."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import kv

CHANGES = "key string, version bigint, value string, present boolean"


def _advance(now: int | None):
    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else (-(1 << 62), 0, 0, None)
        best = tuple(held)
        for part in parts:
            for r in part.itertuples(index=False):
                entry = (int(r.version), int(r.meta), int(r.expires_at), r.value)
                if entry[:3] > best[:3] or entry[:3] == best[:3] and (entry[3] or "") > (best[3] or ""):
                    best = entry
        if best == tuple(held):
            return
        state.update(best)
        version, meta, expires, value = best
        gone = meta & kv.DELETED or 0 < expires <= (now if now is not None else 0)
        yield pd.DataFrame({"key": [key[0]], "version": [version], "value": [None if gone else value], "present": [not gone]})

    return advance


def latest(stream: DataFrame, now: int | None = None) -> DataFrame:
    """A stream of ``key, version, value, present``: one row whenever a key's newest version changes. An entry older than what the key has is
    dropped, however late it comes; the state is one entry a key and is spread over tasks by key."""
    rows = kv.log(stream).select("key", "version", "value", "meta", "expires_at")
    return rows.groupBy("key").applyInPandasWithState(_advance(now), CHANGES, "version bigint, meta int, expires_at bigint, value string", "update", GroupStateTimeout.NoTimeout)


def feed(log: DataFrame, since: int, read_ts: int | None = None) -> DataFrame:
    """The change feed: all entries with ``since < version <= read_ts``, deletions as ``present`` false; on a stream and on a table alike."""
    rows = kv.log(log).filter(F.col("version") > since)
    if read_ts is not None:
        rows = rows.filter(F.col("version") <= read_ts)
    return rows.select("key", "version", "value", (F.col("meta").bitwiseAND(kv.DELETED) == 0).alias("present"))


def to_table(changes: DataFrame, path: str, state: str, **trigger: Any) -> StreamingQuery:
    """Write a stream of changes; the state of a key is the row of its greatest version in it."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True})).start()
