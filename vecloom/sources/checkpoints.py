"""Checkpoints of collections: ``<root>/<collection>/checkpoint_<n>/<table>``, the largest complete n being the current one.

A checkpoint is written under another name and renamed when it is complete, so readers never see half of one. Tables are Parquet; readers name the ones
they need, which is all there is to loading only the filter or the refine side.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..runtime import hadoop_path

PREFIX = "checkpoint_"
#: which tables belong to a side, for the load modes full (0), filter only (1), refine only (2)
FILTER, REFINE = ("params", "postings", "deleted"), ("vectors", "deleted")
MODES = {0: (*FILTER, "vectors"), 1: FILTER, 2: REFINE}


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = hadoop_path(spark, path)
    return [x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()] if fs.exists(p) else []


def versions(spark: SparkSession, collection: str) -> list[int]:
    """Numbers of complete checkpoints, ascending."""
    tails = [n[len(PREFIX) :] for n in _names(spark, collection) if n.startswith(PREFIX)]
    return sorted(int(t) for t in tails if t.isdigit())


def latest(spark: SparkSession, collection: str) -> str | None:
    """The path of the newest checkpoint."""
    found = versions(spark, collection)
    return f"{collection}/{PREFIX}{found[-1]}" if found else None


def collections(spark: SparkSession, root: str) -> DataFrame:
    """``collection_name, version`` of all collections under a root with at least one checkpoint."""
    rows = [(n, v[-1]) for n in _names(spark, root) if (v := versions(spark, f"{root}/{n}"))]
    return spark.createDataFrame(rows, "collection_name string, version int")


def write(spark: SparkSession, collection: str, tables: dict[str, DataFrame], partition: dict[str, str] | None = None) -> int:
    """Write all tables as the next checkpoint; returns its number. Raises if another writer took it."""
    number = (versions(spark, collection) or [-1])[-1] + 1
    staged = f"{collection}/_writing_{uuid.uuid4().hex}"
    for name, df in tables.items():
        out = df.write
        if partition and name in partition:
            out = out.partitionBy(partition[name])
        out.parquet(f"{staged}/{name}")
    fs, source = hadoop_path(spark, staged)
    _, target = hadoop_path(spark, f"{collection}/{PREFIX}{number}")
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)
        raise RuntimeError(f"checkpoint {number} was written by another writer")
    return number


def read(spark: SparkSession, collection: str, mode: int = 0, version: int | None = None) -> dict[str, DataFrame]:
    """Tables of a checkpoint by load mode; those it doesn't have are left out."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    path = latest(spark, collection) if version is None else f"{collection}/{PREFIX}{version}"
    if path is None:
        raise FileNotFoundError(f"{collection} has no checkpoint")
    have = set(_names(spark, path))
    return {t: spark.read.parquet(f"{path}/{t}") for t in MODES[mode] if t in have}
