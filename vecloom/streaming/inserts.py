"""Continuous inserts into the tables of a collection while they are searched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from ..runtime import hadoop_path


def into_folder(stream: DataFrame, path: str, state: str, make: Callable[[DataFrame], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Append every micro-batch to ``path`` as its own folder ``batch=<n>``; a batch that is run again after a failure replaces its folder, so
    rows arrive once. ``make`` turns a batch into what is stored (assignment to lists, encoding). Readers see whole batches only: the folder is renamed
    into place."""

    def store(batch: DataFrame, number: int) -> None:
        rows = make(batch) if make else batch
        staged, target = f"{path}/_batch_{number}", f"{path}/batch={number}"
        rows.write.mode("overwrite").parquet(staged)
        fs, source = hadoop_path(batch.sparkSession, staged)
        _, place = hadoop_path(batch.sparkSession, target)
        fs.delete(place, True)
        if not fs.rename(source, place):
            raise RuntimeError(f"{staged} couldn't be renamed")

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(**(trigger or {"availableNow": True})).start()
