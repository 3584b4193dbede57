"""The engine as a library: collections with the verbs initialise, list, load, add, search, rerank, delete, checkpoint; plug-ins for embedding and
storing; assembly of prompts.

A collection keeps its tables in a folder of checkpoints (``sources.checkpoints``). Between checkpoints, additions and deletions are logs in memory of the plan,
not of the driver: they are DataFrames that are appended by union.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import documents, exact, ivf, maintenance
from .operators.selectors import check_search
from .operators.topk import top_k
from .runtime import cut
from .sources import checkpoints

VECTORS = "id bigint, vec array<double>, seq bigint"
DELETED = "id bigint, seq bigint"


@dataclass(frozen=True)
class SearchParams:
    k: int
    nprobe: int = 1
    k_factor: float = 1.0
    metric: str = "ip"

    def __post_init__(self):
        check_search(self.k, self.nprobe, self.k_factor)


class Collection(Protocol):
    """What an index type has to offer to be used by ``Engine``."""

    metric: str

    def add(self, vectors: DataFrame) -> None: ...
    def delete(self, ids: DataFrame) -> None: ...
    def search(self, queries: DataFrame, params: SearchParams) -> DataFrame: ...
    def rerank(self, candidates: DataFrame, queries: DataFrame, params: SearchParams) -> DataFrame: ...
    def checkpoint(self) -> int: ...


class FlatCollection:
    """Exact search over the vectors alive."""

    def __init__(self, spark: SparkSession, path: str, metric: str = "ip", mode: int = 0):
        self.spark, self.path, self.metric = spark, path, metric
        tables = checkpoints.read(spark, path, mode) if checkpoints.latest(spark, path) else {}
        self.added = tables.get("vectors", spark.createDataFrame([], VECTORS))
        self.gone = tables.get("deleted", spark.createDataFrame([], DELETED))
        tops = [t.agg(F.max("seq").alias("m")).first()["m"] for t in (self.added, self.gone)]
        self.seq = max([t for t in tops if t is not None], default=0)

    def add(self, vectors: DataFrame) -> None:
        """``id, vec``; a vector added again replaces the one before."""
        self.seq += 1
        self.added = self.added.unionByName(exact.clean(vectors, "id", "vec").withColumn("seq", F.lit(self.seq).cast("bigint")))

    def delete(self, ids: DataFrame) -> None:
        self.seq += 1
        self.gone = self.gone.unionByName(ids.select(F.col("id").cast("bigint"), F.lit(self.seq).cast("bigint").alias("seq")))

    def vectors(self) -> DataFrame:
        return maintenance.alive(self.added, self.gone).select("id", "vec")

    def _same_metric(self, params: SearchParams) -> None:
        if params.metric != self.metric:
            raise ValueError(f"the collection is for {self.metric}, not {params.metric}")

    def search(self, queries: DataFrame, params: SearchParams) -> DataFrame:
        self._same_metric(params)
        return exact.knn(queries, self.vectors(), params.k, self.metric)

    def rerank(self, candidates: DataFrame, queries: DataFrame, params: SearchParams) -> DataFrame:
        self._same_metric(params)
        return exact.rerank(candidates, queries, self.vectors(), params.k, self.metric)

    def checkpoint(self) -> int:
        """Writes the vectors alive and continues from the files, so the logs don't grow without end. Deletions are kept: a later copy of an old
        addition must not bring an id back."""
        number = checkpoints.write(self.spark, self.path, {"vectors": maintenance.alive(self.added, self.gone), "deleted": maintenance.latest(self.gone)})
        tables = checkpoints.read(self.spark, self.path, 0, number)
        self.added, self.gone = tables["vectors"], tables["deleted"]
        return number


class IvfCollection(FlatCollection):
    """Two-phase search. Parameters come in two roles: those of the insert side made the stored codes, those of the query side transform and probe;
    ``install`` replaces the latter without touching what is stored."""

    def __init__(self, spark: SparkSession, path: str, params: ivf.Params, centroids: DataFrame, metric: str = "ip", mode: int = 0):
        super().__init__(spark, path, metric, mode)
        self.params, self.centroids, self.query_centroids = params, centroids, centroids
        self.index = ivf.build(self.vectors(), centroids, params)

    def _rebuild(self) -> None:
        self.index = ivf.build(self.vectors(), self.centroids, self.params)

    def add(self, vectors: DataFrame) -> None:
        super().add(vectors)
        self._rebuild()

    def delete(self, ids: DataFrame) -> None:
        super().delete(ids)
        self._rebuild()

    def install(self, centroids: DataFrame) -> None:
        n, d = ((c.count(), c.agg(F.max(F.size("c"))).first()[0]) for c in (self.centroids, centroids))
        if n != d:
            raise ValueError("the new centroids have another shape")
        self.query_centroids = centroids

    def search(self, queries: DataFrame, params: SearchParams) -> DataFrame:
        self._same_metric(params)
        return ivf.two_phase(self.index, self.vectors(), queries, self.query_centroids, self.params, params.k, params.nprobe, params.k_factor)


class Engine:
    """Collections under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.loaded: dict[str, Collection] = {}

    def list(self) -> DataFrame:
        return checkpoints.collections(self.spark, self.root)

    def has_loaded(self, name: str) -> bool:
        return name in self.loaded

    def load(self, name: str, metric: str = "ip", mode: int = 0, make=FlatCollection, **options) -> Collection:
        """Loading again changes nothing."""
        if name not in self.loaded:
            self.loaded[name] = make(self.spark, f"{self.root}/{name}", metric=metric, mode=mode, **options)
        return self.loaded[name]

    def _of(self, name: str) -> Collection:
        if name not in self.loaded:
            raise KeyError(f"{name} isn't loaded")
        return self.loaded[name]

    def add(self, name: str, vectors: DataFrame) -> None:
        self._of(name).add(vectors)

    def delete(self, name: str, ids: DataFrame) -> None:
        self._of(name).delete(ids)

    def search(self, name: str, queries: DataFrame, params: SearchParams) -> DataFrame:
        return self._of(name).search(queries, params)

    def rerank(self, name: str, candidates: DataFrame, queries: DataFrame, params: SearchParams) -> DataFrame:
        return self._of(name).rerank(candidates, queries, params)

    def checkpoint(self, name: str) -> int:
        return self._of(name).checkpoint()


class Embedder(Protocol):
    """Text or bytes to vectors; called with Arrow batches in the tasks."""

    d: int

    def embed_text(self, texts: list[str | None]) -> np.ndarray: ...
    def embed_binary(self, data: list[bytes | None]) -> np.ndarray: ...


class HashingEmbedder:
    """Counts of hashed words, of long ones (and so of scripts without spaces) also of all runs of three characters, with random signs and of unit
    length: deterministic and without a model. Empty and null texts give zeros."""

    def __init__(self, d: int = 64):
        self.d = d

    def embed_text(self, texts: list[str | None]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.d))
        for row, t in zip(out, texts):
            words = (t or "").lower().split()
            for w in [*words, *(w[i : i + 3] for w in words if len(w) > 12 for i in range(len(w) - 2))]:
                h = zlib.crc32(w.encode())
                row[h % self.d] += 1 if h >> 31 else -1
        size = np.sqrt((out * out).sum(axis=1))[:, None]
        return np.divide(out, size, out=out, where=size > 0)

    def embed_binary(self, data: list[bytes | None]) -> np.ndarray:
        return self.embed_text([None if b is None else b.decode("utf-8", "replace") for b in data])


def embedded(df: DataFrame, embedder: Embedder, source: str = "text", name: str = "vec") -> DataFrame:
    """The table with a column of vectors."""
    binary = dict(df.dtypes)[source] == "binary"

    @F.pandas_udf("array<double>")
    def run(c: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in c:
            x = embedder.embed_binary(s.tolist()) if binary else embedder.embed_text(s.tolist())
            yield pd.Series(list(x))

    return df.withColumn(name, run(source))


def padded_tokens(text, length: int):
    """``struct(tokens, mask)``: lower-case words cut or filled up to a fixed length, and 1 for each that is a word."""
    words = F.slice(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), 1, length)
    fill = F.array_repeat(F.lit("[PAD]"), F.lit(length) - F.size(words))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(words)), F.array_repeat(F.lit(0), F.lit(length) - F.size(words)))
    return F.struct(F.concat(words, fill).alias("tokens"), mask.alias("mask"))


class Store(Protocol):
    """A place for documents."""

    def put(self, batch: DataFrame) -> None: ...
    def get_by_keys(self, asked: DataFrame) -> DataFrame: ...
    def get_by_ids(self, asked: DataFrame) -> DataFrame: ...
    def delete(self, ids: DataFrame) -> None: ...


class TableStore:
    """Documents in a table."""

    def __init__(self, spark: SparkSession):
        self.table = spark.createDataFrame([], "key string, xid bigint, value string")

    def put(self, batch: DataFrame) -> None:
        """``key, value, seq``; cut so that ids are given out once."""
        self.table = cut(documents.put(self.table, batch))

    def get_by_keys(self, asked: DataFrame) -> DataFrame:
        return documents.fetch(asked, self.table, "key")

    def get_by_ids(self, asked: DataFrame) -> DataFrame:
        return documents.fetch(asked, self.table, "xid")

    def delete(self, ids: DataFrame) -> None:
        self.table = documents.deleted(self.table, ids)


def client_query(texts: DataFrame, embedder: Embedder, collection: Collection, store: DataFrame, params: SearchParams) -> DataFrame:
    """Embed, search and fetch: ``qid, id, score, rank, value`` for ``qid, text``. ``store`` has ``xid, value``."""
    queries = embedded(texts, embedder).select("qid", F.col("vec").alias("q"))
    found = collection.search(queries, params)
    return documents.fetch(found.withColumnRenamed("id", "xid"), store).withColumnRenamed("xid", "id")


def coordinator_add(batch: DataFrame, embedder: Embedder, collection: Collection, store: TableStore) -> None:
    """Put the documents of a batch ``key, value, seq`` and add their vectors under the ids they got."""
    store.put(batch)
    rows = store.table.join(batch.select("key").distinct(), "key", "left_semi")
    collection.add(embedded(rows, embedder, "value").select(F.col("xid").alias("id"), "vec"))


def prompts(questions: DataFrame, found: DataFrame, head: str = "Answer by the context.", most: int = 10) -> DataFrame:
    """``qid, prompt``: a question below the texts found for it, best first. ``questions`` has ``qid, question``; ``found`` has ``qid, rank, value``."""
    best = found.filter(F.col("rank") <= most).groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("v"))
    text = F.concat_ws("\n", F.lit(head), F.coalesce(F.array_join("v", "\n"), F.lit("")), F.col("question"))
    return questions.join(best, "qid", "left").select("qid", text.alias("prompt"))


def merged_shards(parts: list[DataFrame], k: int, metric: str) -> DataFrame:
    """Answers of several workers as one."""
    from .operators.topk import merge

    return merge(parts, k, metric)


__all__ = ["Collection", "Embedder", "Engine", "FlatCollection", "HashingEmbedder", "IvfCollection", "SearchParams", "Store", "TableStore", "client_query", "coordinator_add", "embedded", "merged_shards", "padded_tokens", "prompts", "top_k"]
