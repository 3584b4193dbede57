"""Session helpers shared by all operators: table access, shared storage, lineage cuts, size-checked broadcasts,
and streaming over the groups of a sorted partition."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "vecloom", **conf: str) -> SparkSession:
    """A session with the settings the plans here assume; existing settings of a cluster win."""
    builder = SparkSession.builder.appName(app)
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where it is unset, a local session gets a temporary one;
    on a cluster that would be another disk for each executor, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
        if not path:
            if not local(spark):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            path = tempfile.mkdtemp(prefix="vecloom-")
            spark.sparkContext.setCheckpointDir(path)
            spark.conf.set("spark.vecloom.scratch", path)
    return path


def hadoop_path(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path on it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = hadoop_path(spark, path)
        fs.delete(p, True)
    except Exception:  # the session may be gone; what is left lies in the scratch folder
        pass


_made: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, what: str = "stage") -> str:
    """A new folder name in the shared folder; removed by ``release`` or when the Python driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if what == "code":
        atexit.register(remove, spark, path)
    else:
        if not _made:
            atexit.register(release)
        _made.append((spark, path))
    return path


def release() -> None:
    """Remove all intermediate results made so far. For long sessions: call it when the results of the queries run so far have been written."""
    while _made:
        remove(*_made.pop())


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers: nothing to do in a local session whose PYTHONPATH leads to it, else a zip of it is
    put into the shared folder and added to the session."""
    root = Path(__file__).resolve().parent
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    if local(spark) and str(root.parent) in [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = f"{scratch(spark, 'code')}/{root.name}.zip"
    fs, p = hadoop_path(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(held.getvalue()))
    finally:
        stream.close()
    sc.addPyFile(path)


def cut(df: DataFrame) -> DataFrame:
    """Compute once, write as compressed Parquet to the shared folder, continue from the files. Survives the loss of executors."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if ``df`` has at most ``rows`` rows; otherwise leave the join to the optimizer. The count reads at most
    ``rows`` + 1 rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def columns(batch: pa.RecordBatch | pa.Table, names: list[str]) -> list[list]:
    return [batch.column(n).to_pylist() for n in names]


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins, for rows sorted by ``keys`` (nulls form a group)."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for k in keys:
        col = table.column(k)
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
            if isinstance(col, pa.ChunkedArray):
                col = pa.concat_arrays(col.chunks)
        codes = col.dictionary_encode(null_encoding="encode")
        idx = codes.indices.to_numpy(zero_copy_only=False)
        new[1:] |= idx[1:] != idx[:-1]
    return np.flatnonzero(new)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Regroup a sorted stream so that no group is divided: yields tables with the offsets of their groups (one more than groups)."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        at = starts(t, keys)
        if held and tuple(t.column(k)[0].as_py() for k in keys) != tuple(held[0].column(k)[0].as_py() for k in keys):
            full = pa.concat_tables(held).combine_chunks()
            yield full, np.append(starts(full, keys), full.num_rows)
            held = []
        if len(at) == 1:
            held.append(t)
            continue
        # the last group stays open; all before it, with what was held, is complete
        full = pa.concat_tables([*held, t.slice(0, int(at[-1]))]).combine_chunks()
        held = [t.slice(int(at[-1]))]
        if full.num_rows:
            yield full, np.append(starts(full, keys), full.num_rows)
    if held:
        full = pa.concat_tables(held).combine_chunks()
        yield full, np.append(starts(full, keys), full.num_rows)


def flat(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column (null lists are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    lengths = np.diff(col.offsets.to_numpy())
    if col.null_count:
        lengths = np.where(col.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    return np.append(0, np.cumsum(lengths)), col.flatten().to_numpy(zero_copy_only=False)
