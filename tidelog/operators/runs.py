"""Sorted runs as Parquet files and the manifest that says which of them count.

A run is written whole under a new name, sorted by key within its files, and then named in a new manifest version; the
manifest is a small Parquet table in a folder of its own, and the highest complete version counts.  Nothing is changed in
place, so readers keep their snapshot, a failed write leaves no trace in the manifest, and replaced runs stay until vacuum.
Versions are resolved by each row's seq, never by the order of files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.errors import StoreError
from tidelog.model import CHANGELOG
from tidelog.operators.resolve import latest

MANIFEST = "version long, path string, min_seq long, max_seq long, min_key binary, max_key binary, key_count long, created_time timestamp"
COLUMNS = "path min_seq max_seq min_key max_key key_count created_time".split()


class RunStore:
    """Runs under one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))

    # --- manifest: one row a run, so it is small beside the data

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifest"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def manifest(self) -> DataFrame:
        v = self.version()
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/{v}")

    def commit(self, rows: list[tuple], expect: int) -> int:
        """Publishes a new version by one rename; fails if another writer was first."""
        new = expect + 1
        trial = f"{self.root}/manifest/_{uuid.uuid4().hex}"
        self.spark.createDataFrame([(new, *r) for r in rows], MANIFEST).coalesce(1).write.parquet(trial)
        to = self._path(f"{self.root}/manifest/{new}")
        if self._fs.exists(to) or not self._fs.rename(self._path(trial), to):
            self._fs.delete(self._path(trial), True)
            raise StoreError("IO_ERROR", f"manifest version {new} was published by another writer")
        return new

    def entries(self) -> list[tuple]:
        return [tuple(r) for r in self.manifest().select(*COLUMNS).collect()]

    # --- runs

    def write(self, rows: DataFrame, files: int | None = None) -> tuple | None:
        """Writes rows with unique keys as one run and gives its manifest entry; None if there are no rows."""
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        ordered = rows.select("seq", "op", "key", "value")
        ordered = ordered.repartitionByRange(files, "key") if files else ordered.repartitionByRange("key")
        ordered.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").option("parquet.page.write-checksum.enabled", "true").parquet(path)
        seen = self.spark.read.schema(CHANGELOG).parquet(path).agg(F.min("seq"), F.max("seq"), F.min("key"), F.max("key"), F.count("*"), F.current_timestamp()).first()
        if not seen[4]:
            self._fs.delete(self._path(path), True)
            return None
        return (path, *seen)

    def publish(self, replaced: list[tuple], made: list[tuple], tries: int = 10) -> int:
        """Publishes a version in which runs made stand for those replaced, on top of what other writers published meanwhile.

        Fails if a replaced run is no longer there, since another merge then holds it already.
        """
        gone = {e[0] for e in replaced}
        for left in reversed(range(tries)):
            at, entries = self.version(), self.entries()
            if not gone <= {e[0] for e in entries}:
                raise StoreError("IO_ERROR", "another writer has replaced the same runs")
            try:
                return self.commit([*(e for e in entries if e[0] not in gone), *made], at)
            except StoreError:
                if not left:
                    raise

    def flush(self, changes: DataFrame) -> bool:
        """The newest versions of a changelog segment become a run, tombstones included."""
        entry = self.write(latest(changes))
        if entry is None:
            return False
        self.publish([], [entry])
        return True

    def rows(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        """All records of the runs whose key range may meet [start, end]; the rest of the pruning is Parquet's."""
        kept = [e for e in self.entries() if (start is None or e[4] >= start) and (end is None or e[3] <= end)]
        if not kept:
            return self.spark.createDataFrame([], CHANGELOG)
        return self.spark.read.schema(CHANGELOG).parquet(*(e[0] for e in kept))

    def compact(self, paths: list[str] | None = None) -> bool:
        """Merges the runs (all, or those named) into one; tombstones go only if no other run remains.

        A run that is flushed meanwhile stays beside the merged one; it is newer than what a dropped tombstone hid.
        """
        entries = self.entries()
        chosen = [e for e in entries if paths is None or e[0] in paths]
        if not chosen:
            return False
        merged = latest(self.spark.read.schema(CHANGELOG).parquet(*(e[0] for e in chosen)))
        if len(chosen) == len(entries):
            merged = merged.filter("op <> 2")
        entry = self.write(merged)
        self.publish(chosen, [entry] if entry else [])
        return True

    def vacuum(self) -> int:
        """Deletes run folders that the newest manifest does not name, and older manifests; gives how many runs went."""
        live = {e[0].rsplit("/", 1)[1] for e in self.entries()}
        folder, gone = self._path(f"{self.root}/runs"), 0
        for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if s.getPath().getName() not in live:
                self._fs.delete(s.getPath(), True)
                gone += 1
        for s in self._fs.listStatus(self._path(f"{self.root}/manifest")):
            if s.getPath().getName() != str(self.version()):
                self._fs.delete(s.getPath(), True)
        return gone
