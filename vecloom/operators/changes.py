"""Apply change feeds of inserts, updates and deletes to bucketed tables, copy-on-write.

The base is hashed by key into buckets, one or more Parquet files each, sorted by key and place. A batch of changes is stripped of repeats, routed by the same hash and
sorted; only the files of buckets that receive changes are read, merged with them in the order of keys and rewritten to new files; a new manifest that names the
current files of every bucket is then created exclusively, which is the commit. Readers use the newest manifest, so they never see half a batch.

A new epoch empties a store in all its buckets. Each version keeps every store's last epoch in a small table beside the buckets, by which readers pass over what
an epoch made stale; buckets lose such rows when they are next rewritten. So a batch never reads buckets it has no changes for.

What a bucket stores is not the state but the *compacted log*: the changes that can still decide the state when older or newer changes
arrive later. Hence batches may arrive in any order and any number of times and the state comes out the same:

* changes of an epoch before the store's last one are dead;
* of a key's deletes only the last matters, and whatever lies before it is dead;
* of a key's moves only the last matters;
* creates after the last delete are kept, the first of them is the one that takes effect.

The state of a key: absent if nothing was created after the last delete; otherwise the level of the last move after that create, or
the create's own level.

Defined results: null op and level mean 0; rows with a null store, epoch, set or position take no part (they have no place in the order), nor
do rows with an unknown op or a null id; an empty feed commits nothing and an empty table has no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import bounded, cut, hadoop_path, scratch

CREATE, DELETE, MOVE = 0, 1, 2
STORES = 1_000_000
COLUMNS = ["store_id", "id", "op", "epoch", "set_no", "pos_no", "level_no"]
EPOCHS = "store_id bigint, epoch int"
LOG = "store_id bigint, id string, op int, epoch int, set_no bigint, pos_no int, level_no int"


def ordered_changes(changes: DataFrame) -> DataFrame:
    """The columns of the log with defaults applied and rows without a place in the order left out."""
    return (
        changes.select(
            F.col("store_id").cast("bigint"), F.col("id").cast("string"), F.coalesce(F.col("op"), F.lit(CREATE)).cast("int").alias("op"),
            F.col("epoch").cast("int"), F.col("set_no").cast("bigint"), F.col("pos_no").cast("int"),
            F.coalesce(F.col("level_no"), F.lit(0)).cast("int").alias("level_no"),
        )
        .filter("store_id is not null and id is not null and epoch is not null and set_no is not null and pos_no is not null")
        .filter(F.col("op").isin(CREATE, DELETE, MOVE))
    )


AT = "struct(set_no, pos_no)"
KEY = ["store_id", "id"]


def last_epochs(log: DataFrame) -> DataFrame:
    """``store_id, epoch``: one row a store."""
    return log.groupBy("store_id").agg(F.max("epoch").alias("epoch"))


def live(log: DataFrame, epochs: DataFrame) -> DataFrame:
    """Changes of each store's last epoch (or of a later one than is known); broadcast while the stores are few, else a join that can be split."""
    known = bounded(epochs.select(F.col("store_id").alias("s"), F.col("epoch").alias("e")), STORES)
    return log.join(known, F.col("store_id") == F.col("s"), "left").filter(F.col("e").isNull() | (F.col("epoch") >= F.col("e"))).drop("s", "e")


def distinct_changes(log: DataFrame) -> DataFrame:
    """One row per key and place for creates, one per key and epoch for deletes and for moves, the last of them. Aggregated before the shuffle, so a key with a third of
    all rows, and repeated deliveries, cost each task one row."""
    at = F.expr(AT)
    few = log.groupBy(*KEY, "op", "epoch", F.when(F.col("op") == CREATE, at).alias("place")).agg(F.max(F.struct(at.alias("at"), "level_no")).alias("last"))
    return few.select(*KEY, "op", "epoch", "last.at.set_no", "last.at.pos_no", "last.level_no")


def merge(old: DataFrame | None, new: DataFrame, buckets: int) -> DataFrame:
    """The compacted log of two, one partition a bucket, in the order of keys and places. Rows are brought together by the hash that makes the buckets and sorted; the
    windows then run over each key's rows as they come, without another shuffle."""
    rows = new.select(*COLUMNS) if old is None else old.select(*COLUMNS).unionByName(new.select(*COLUMNS))
    place = [F.col(c) for c in ("epoch", "set_no", "pos_no", "op", "level_no")]
    met = rows.repartition(buckets, *KEY).sortWithinPartitions(*KEY, *place)
    key = Window.partitionBy(*KEY)
    at = F.struct("epoch", "set_no", "pos_no")
    of = lambda op: F.max(F.when(F.col("op") == op, at)).over(key)
    seen = met.withColumns({"at": at, "gone": of(DELETE), "moved": of(MOVE), "next": F.lead(F.struct(*place)).over(key.orderBy(*place))})
    # what lies before the last delete is dead, as are moves but the last; a repeat is equal to the row after it
    first = F.col("gone").isNull() | (F.col("at") >= F.col("gone"))
    kept = first & ((F.col("op") != MOVE) | (F.col("at") == F.col("moved"))) & (F.col("next").isNull() | (F.struct(*place) != F.col("next")))
    return seen.filter(kept).select(*COLUMNS)


def state(log: DataFrame) -> DataFrame:
    """The tables present after the last change of each store, of a log of its last epoch only: ``store_id, id, level_no``."""
    at = F.struct("epoch", "set_no", "pos_no")
    made = F.min(F.when(F.col("op") == CREATE, F.struct(at.alias("at"), "level_no")))
    moved = F.max(F.when(F.col("op") == MOVE, F.struct(at.alias("at"), "level_no")))
    return (
        log.groupBy("store_id", "id")
        .agg(made.alias("made"), moved.alias("moved"))
        .filter(F.col("made").isNotNull())
        .select("store_id", "id", F.when(F.col("moved.at") > F.col("made.at"), F.col("moved.level_no")).otherwise(F.col("made.level_no")).alias("level_no"))
    )


class BucketedTable:
    """A copy-on-write table in a folder: ``data/`` holds immutable bucket files, ``manifest/`` one JSON file a version."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """``buckets`` is fixed when the table is created; about one bucket for every 128 MB of expected log is a good choice."""
        self.spark, self.path = spark, path.rstrip("/")
        manifest = self._newest()
        self.buckets = manifest["buckets"] if manifest else buckets

    def _versions(self) -> list[int]:
        fs, folder = hadoop_path(self.spark, f"{self.path}/manifest")
        names = [x.getPath().getName() for x in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _read(self, version: int) -> dict | None:
        """A manifest; None while its writer is still at it."""
        fs, file = hadoop_path(self.spark, f"{self.path}/manifest/{version:012d}.json")
        stream = fs.open(file)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}") else None

    def _newest(self) -> dict | None:
        return next((m for v in reversed(self._versions()) if (m := self._read(v))), None)

    @property
    def version(self) -> int:
        """0 before the first commit."""
        return (self._newest() or {"version": 0})["version"]

    def _commit(self, manifest: dict) -> None:
        """Create the next manifest exclusively: of two writers one gets the file, on object stores too, which have no rename that fails. Its only write is
        small; a manifest that doesn't end yet is not read, and no other is written after it."""
        taken = self._versions()
        text = json.dumps(manifest).encode()
        fs, target = hadoop_path(self.spark, f"{self.path}/manifest/{manifest['version']:012d}.json")
        try:
            if taken and taken[-1] >= manifest["version"]:
                raise FileExistsError
            if fs.getScheme() == "file":  # Hadoop's own exclusive creation isn't atomic here
                place = target.toUri().getPath()
                os.makedirs(os.path.dirname(place), exist_ok=True)
                with open(place, "xb") as f:
                    f.write(text)
            else:
                stream = fs.create(target, False)
                try:
                    stream.write(bytearray(text))
                finally:
                    stream.close()
        except (FileExistsError, Py4JJavaError) as e:
            raise RuntimeError(f"version {manifest['version']} was committed by another writer; apply the batch again") from e

    def _bucket(self):
        """The number of the partition into which ``repartition(buckets, *KEY)`` puts a row."""
        return F.pmod(F.hash(*KEY), F.lit(self.buckets)).cast("int")

    def log(self, buckets: set[int] | None = None) -> DataFrame:
        """The compacted log as of the newest manifest, of all buckets or some."""
        files = (self._newest() or {"files": {}})["files"]
        folders = sorted({f for b, f in files.items() if buckets is None or int(b) in buckets})
        if not folders:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def epochs(self) -> DataFrame:
        """Each store's last epoch."""
        manifest = self._newest()
        return self.spark.read.schema(EPOCHS).parquet(f"{self.path}/data/{manifest['epochs']}") if manifest else self.spark.createDataFrame([], EPOCHS)

    def state(self) -> DataFrame:
        return state(live(self.log(), self.epochs()))

    def apply(self, changes: DataFrame) -> list[int]:
        """Merge one batch and commit it; returns the buckets that were rewritten. Applying a batch again changes nothing."""
        manifest = self._newest() or {"version": 0, "files": {}}
        batch = uuid.uuid4().hex
        routed = cut(distinct_changes(ordered_changes(changes)))
        touched = {r[0] for r in routed.select(self._bucket().alias("b")).distinct().collect()}  # at most `buckets` numbers
        if not touched:
            return []
        # the whole table decides which epoch is a store's last: a late batch may bring only dead changes
        last_epochs(self.epochs().unionByName(routed.select("store_id", "epoch"))).coalesce(1).write.parquet(f"{self.path}/data/{batch}/epochs")
        epochs = self.spark.read.schema(EPOCHS).parquet(f"{self.path}/data/{batch}/epochs")
        some = {b for b in touched if str(b) in manifest["files"]}
        old = live(self.log(some), epochs) if some else None
        merged = merge(old, live(routed, epochs), self.buckets).withColumn("bucket", self._bucket())
        merged.write.partitionBy("bucket").parquet(f"{self.path}/data/{batch}/rows")
        fs, folder = hadoop_path(self.spark, f"{self.path}/data/{batch}/rows")
        written = {int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(folder) if x.isDirectory()}
        files = {b: f for b, f in manifest["files"].items() if int(b) not in touched}
        files |= {str(b): f"{batch}/rows/bucket={b}" for b in written}
        self._commit({"version": manifest["version"] + 1, "buckets": self.buckets, "files": files, "epochs": f"{batch}/epochs"})
        return sorted(touched)

    def vacuum(self) -> None:
        """Delete batches that the newest manifest no longer names; only when no reader uses an older version."""
        newest = self._newest() or {"files": {}, "epochs": ""}
        used = {f.split("/")[0] for f in [*newest["files"].values(), newest["epochs"]]}
        fs, folder = hadoop_path(self.spark, f"{self.path}/data")
        for x in fs.listStatus(folder) if fs.exists(folder) else []:
            if x.getPath().getName() not in used:
                fs.delete(x.getPath(), True)


def current_state(changes: DataFrame, path: str | None = None, buckets: int | None = None, batches: list[DataFrame] | None = None) -> DataFrame:
    """Apply a feed to a new table in ``path`` (a scratch folder if omitted) and return its state: at once, or the ``batches`` it came in, one after the other.
    ``buckets`` follows the number of shuffle partitions if omitted."""
    spark = changes.sparkSession
    buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    built = BucketedTable(spark, path or scratch(spark, "bucketed"), buckets)
    for batch in batches or [changes]:
        built.apply(batch)
    return built.state()


def by_arrival(changes: DataFrame, when: str, batches: int) -> list[DataFrame]:
    """A feed divided into about equal batches by time of arrival; rows without a time come last. The bounds are approximate quantiles, the division is exact."""
    at = F.unix_micros(F.col(when).cast("timestamp")).cast("double")
    bounds = changes.select(at.alias("t")).approxQuantile("t", [k / batches for k in range(1, batches)], 0.01)
    edges = [None, *sorted(set(bounds)), None]
    inside = lambda a, b: (F.lit(True) if a is None else at > a) & (F.lit(True) if b is None else at <= b)
    parts = [changes.filter(F.coalesce(inside(a, b), F.lit(b is None))) for a, b in zip(edges[:-1], edges[1:])]
    return parts
