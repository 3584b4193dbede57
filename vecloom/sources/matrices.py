"""Raw row-major matrices of fixed-size records: float32 vectors and int32 neighbour lists.

Files are read as splittable fixed-length records, so one of any size is read by many tasks; a record's number is its place in the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import hadoop_path

FORMAT = "org.apache.spark.input.FixedLengthBinaryInputFormat"


def _records(spark: SparkSession, path: str, size: int) -> DataFrame:
    fs, p = hadoop_path(spark, path)
    length = fs.getFileStatus(p).getLen()
    if length % size:
        raise ValueError(f"{path} has {length} bytes, no multiple of {size}")
    rdd = spark.sparkContext.newAPIHadoopFile(path, FORMAT, "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf={f"{FORMAT}.recordLength": str(size)})
    return spark.createDataFrame(rdd.map(lambda r: (int(r[0]), bytearray(r[1]))), "id bigint, raw binary")


def _numbers(records: DataFrame, dtype: str, sql: str) -> DataFrame:
    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values = np.frombuffer(b"".join(b.column("raw").to_pylist()), dtype)
                d = len(values) // b.num_rows
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * d), pa.array(values.astype(dtype[1:])))], ["id", "vec"])

    return records.mapInArrow(numbers, f"id bigint, vec array<{sql}>")


def read_floats(spark: SparkSession, path: str, d: int, n: int | None = None) -> DataFrame:
    """``id, vec array<float>`` of a matrix of d columns; the first n rows if given."""
    rows = _numbers(_records(spark, path, 4 * d), "<f4", "float")
    return rows if n is None else rows.filter(F.col("id") < n)


def read_neighbours(spark: SparkSession, path: str, width: int, k: int | None = None) -> DataFrame:
    """``qid, id, rank`` of a matrix of neighbour ids, the first k of each query."""
    rows = _numbers(_records(spark, path, 4 * width), "<i4", "int")
    out = rows.select(F.col("id").alias("qid"), F.posexplode("vec").alias("pos", "n")).select("qid", F.col("n").cast("bigint").alias("id"), (F.col("pos") + 1).alias("rank"))
    return out if k is None else out.filter(F.col("rank") <= k)


def write_floats(df: DataFrame, path: str, vec: str = "vec", id: str = "id") -> None:
    """One raw file of the vectors in the order of ids. For exchange with single-machine tools: written by the driver, partition by partition."""
    fs, p = hadoop_path(df.sparkSession, path)
    out = fs.create(p, True)
    try:
        for r in df.orderBy(id).select(F.col(vec).cast("array<float>").alias("v")).toLocalIterator():
            out.write(bytearray(np.asarray(r["v"], "<f4").tobytes()))
    finally:
        out.close()
