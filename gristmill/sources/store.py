"""A keyed table in snapshots: an upsert rewrites only the buckets that it touches.

Rows are dealt to a fixed number of buckets by a hash of their key; a bucket is a folder of
Parquet files that never change. A snapshot is a manifest, a small JSON file that names the folder of
each bucket. An upsert writes new folders for the buckets of its keys, from the rows that
they had and the changes, and then makes the next manifest. A manifest's number is given once, so of
two writers that start from the same snapshot one commits; the other merges again, on top of
what the first has committed. Readers see one snapshot or the next, never a part.

    <root>/manifests/00000003.json
    <root>/data/<write>/__bucket=<number>/part-....parquet

Works on any file system that Spark writes to, where a rename does not overwrite (HDFS and local
disks do; object stores need a lock of their own). The driver handles one name for each bucket.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files

BUCKET, NEW = "__bucket", "__new"


class Conflict(Exception):
    """Other writers kept committing first."""


@dataclass(frozen=True)
class Manifest:
    number: int
    key: str
    version: str
    buckets: int
    schema: dict
    folders: dict[str, str]

    def text(self) -> str:
        return json.dumps(asdict(self), indent=1)


class Store:
    """root: a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def create(self, schema: StructType, key: str, version: str, buckets: int = 64) -> Store:
        """An empty table; the row of a key with the greatest version is the one that stays."""
        first = Manifest(0, key, version, buckets, json.loads(schema.json()), {})
        if not files.create_once(self.spark, self._manifest(0), first.text()):
            raise FileExistsError(f"there is a table in {self.root}")
        return self

    def _manifest(self, number: int) -> str:
        return f"{self.root}/manifests/{number:08d}.json"

    def versions(self) -> list[int]:
        """Numbers of the snapshots, the oldest first."""
        fs, folder = files.at(self.spark, f"{self.root}/manifests")
        names = [f.getPath().getName() for f in files.listed(fs, folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit() and n.endswith(".json"))

    def manifest(self, number: int | None = None) -> Manifest:
        """A snapshot, the newest unless told."""
        if number is None:
            found = self.versions()
            if not found:
                raise FileNotFoundError(f"there is no table in {self.root}")
            number = found[-1]
        return Manifest(**json.loads(files.read_text(self.spark, self._manifest(number))))

    def _rows(self, of: Manifest, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(of.schema)
        paths = [f"{self.root}/data/{p}" for b, p in of.folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(self.manifest(number))

    def lookup(self, keys: list, number: int | None = None) -> DataFrame:
        """The rows of a few keys; only their buckets are read."""
        of = self.manifest(number)
        kind = StructType.fromJson(of.schema)[of.key].dataType
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType().add("k", kind)).select(self._bucket(of, F.col("k")).alias("b"))
        return self._rows(of, [str(r.b) for r in asked.distinct().collect()]).where(F.col(of.key).isin(keys))

    @staticmethod
    def _bucket(of: Manifest, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(of.buckets)).cast("int")

    def merge(self, changes: DataFrame, deleted: DataFrame | None = None, retries: int = 5) -> int:
        """Upserts changes (rows of the table), then drops the keys in deleted; returns the number of the new snapshot.

        Of rows of a key with equal versions, a changed one wins over a stored one, and the order of their
        hashes decides between changed ones. Rows without a key are refused.
        """
        of = self.manifest()
        names = StructType.fromJson(of.schema).names
        changes = changes.select(*names)
        if changes.where(F.col(of.key).isNull()).limit(1).count():
            raise ValueError(f"changes without {of.key}")
        for _ in range(retries + 1):
            if (done := self._merged(of, changes, deleted)) is not None:
                return done
            of = self.manifest()
        raise Conflict(f"{retries + 1} times another writer was first")

    def _merged(self, of: Manifest, changes: DataFrame, deleted: DataFrame | None) -> int | None:
        key, bucket = F.col(of.key), self._bucket(of, F.col(of.key))
        keys = changes.select(of.key) if deleted is None else changes.select(of.key).unionByName(deleted.select(of.key))
        touched = [str(r.b) for r in keys.select(bucket.alias("b")).distinct().collect()]
        own = Window.partitionBy(of.key).orderBy(F.col(of.version).desc(), F.col(NEW).desc(), F.xxhash64(*changes.columns))
        both = self._rows(of, touched).withColumn(NEW, F.lit(0)).unionByName(changes.withColumn(NEW, F.lit(1)))
        newest = both.withColumn("__nth", F.row_number().over(own)).where("__nth = 1").drop("__nth", NEW)
        if deleted is not None:
            newest = newest.join(deleted.select(of.key).distinct(), of.key, "left_anti")
        write = str(uuid.uuid4())
        fs, folder = files.at(self.spark, f"{self.root}/data/{write}")
        committed = False
        try:
            # rows go together by bucket; what is too large for a task is split, what is small joined, as the session's advisory size says
            newest.withColumn(BUCKET, self._bucket(of, key)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(folder.toString())
            there = {f.getPath().getName().removeprefix(f"{BUCKET}=") for f in files.listed(fs, folder) if f.isDirectory()}
            folders = {b: p for b, p in of.folders.items() if b not in touched} | {b: f"{write}/{BUCKET}={b}" for b in touched if b in there}
            after = replace(of, number=of.number + 1, folders=folders)
            committed = files.create_once(self.spark, self._manifest(after.number), after.text())
            return after.number if committed else None
        finally:
            if not committed:
                fs.delete(folder, True)

    def retain(self, keep_last: int = 10, grace: float = 86_400.0) -> int:
        """Drops all but the newest snapshots, and the folders that none of those names; returns the number of folders dropped.

        Folders younger than grace seconds stay: they may be those of a writer that has not committed yet.
        """
        if keep_last < 1:
            raise ValueError("at least one snapshot stays")
        numbers = self.versions()
        fs, data = files.at(self.spark, f"{self.root}/data")
        for n in numbers[:-keep_last]:
            fs.delete(files.at(self.spark, self._manifest(n))[1], False)
        named = {p for n in numbers[-keep_last:] for p in self.manifest(n).folders.values()}
        dropped, before = 0, (time.time() - grace) * 1000
        for write in files.listed(fs, data):
            own = [f for f in files.listed(fs, write.getPath()) if f.isDirectory()]
            gone = [f for f in own if f"{write.getPath().getName()}/{f.getPath().getName()}" not in named and f.getModificationTime() <= before]
            for f in gone:
                fs.delete(f.getPath(), True)
            dropped += len(gone)
            if len(gone) == len(own) and write.getModificationTime() <= before:
                fs.delete(write.getPath(), True)
        return dropped
