"""A store over one folder: puts and deletes go to a changelog, runs are made from it, lookups see both."""

from __future__ import annotations

import enum
import threading
import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.config import StoreConfig
from tidelog.errors import StoreError
from tidelog.model import CHANGELOG, DELETE, PUT, normalise
from tidelog.operators import resolve
from tidelog.operators.runs import RunStore
from tidelog.operators.simulate import Backpressure


class State(enum.Enum):
    INITIALIZING, RECOVERING, RUNNING, FAILED, CLOSED = range(5)


class Store:
    """Batches of changes are appended as Parquet; a batch stays in the log until a run that holds it is in the manifest.

    One writer at a time.  Changes of one batch take effect in their given order, later batches after earlier ones.
    """

    def __init__(self, spark: SparkSession, root: str, config: StoreConfig | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or StoreConfig()
        self.state, self.next_seq = State.INITIALIZING, 0
        self.backpressure = Backpressure(self.config.backpressure_lag_ms)
        self.background = False

    def start(self) -> "Store":
        """Reads the manifest and the log; a log that is due for a flush becomes a run before the store runs."""
        self.state = State.RECOVERING
        try:
            self.runs = RunStore(self.spark, self.root)
            tops = [e[2] for e in self.runs.entries()]
            logged = self._log().agg(F.max("seq")).first()[0]
            self.next_seq = 1 + max([*tops, -1 if logged is None else logged])
        except Exception as e:
            self.state = State.FAILED
            if isinstance(e, StoreError) and e.name in ("BUDGET_EXCEEDED", "IO_ERROR"):
                raise
            raise StoreError("RECOVERY_FAILED", str(e)) from e
        self.state = State.RUNNING
        if self.log_bytes() >= self.config.memtable_max:
            self.flush()
        return self

    def close(self) -> None:
        self.state = State.CLOSED

    def __enter__(self) -> "Store":
        return self.start()

    def __exit__(self, *exc) -> None:
        self.close()

    def _ready(self) -> None:
        if self.state is not State.RUNNING:
            raise StoreError("ENGINE_CLOSED", f"the store is {self.state.name}")

    def _batches(self) -> list[str]:
        """Folders of the log's complete batches, named by first seq, bytes and, if given, tag."""
        fs, path = self.runs._fs, self.runs._path(f"{self.root}/log")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n for n in names if fs.exists(self.runs._path(f"{self.root}/log/{n}/_SUCCESS")))

    def log_bytes(self) -> int:
        """Bytes of entries in the log, from the names of its batches."""
        return sum(int(n.split("-")[1]) for n in self._batches())

    def _log(self, batches: list[str] | None = None) -> DataFrame:
        batches = self._batches() if batches is None else batches
        if not batches:
            return self.spark.createDataFrame([], CHANGELOG)
        return self.spark.read.schema(CHANGELOG).parquet(*(f"{self.root}/log/{n}" for n in batches))

    # --- writes

    def append(self, changes: DataFrame, tag: str | None = None) -> None:
        """Appends a changelog (seq, op, key, value); its seqs order the batch, and the store numbers them on from its last.

        A batch with a tag that was appended before changes nothing.  Each batch keeps the size of its entries in its name,
        so that deciding on a flush reads no log; a key that several batches write counts in each.
        """
        self._ready()
        mark = None if tag is None else self.runs._path(f"{self.root}/tags/{tag}")
        if mark is not None and (self.runs._fs.exists(mark) or any(n.endswith(f"-{tag}") for n in self._batches())):
            return
        self.backpressure.wait()
        top = changes.agg(F.max("seq"), F.min("seq"), F.sum(resolve.entry_size())).first()
        if top[0] is not None:
            rows = normalise(changes.select("seq", "op", "key", "value")).withColumn("seq", F.col("seq") - F.lit(top[1]) + F.lit(self.next_seq))
            name = f"{self.next_seq:020d}-{top[2]}" + ("" if tag is None else f"-{tag}")
            rows.select(*(F.col(f.name).cast(f.dataType) for f in CHANGELOG)).write.parquet(f"{self.root}/log/{name}")
            self.next_seq += top[0] - top[1] + 1
        if mark is not None:
            self.runs._fs.mkdirs(mark)
        if self.log_bytes() >= self.config.memtable_max:
            self.flush()

    def write(self, ops: Iterable[tuple[int, bytes, bytes]]) -> None:
        """A small batch of (op, key, value) given on the driver."""
        rows = []
        for i, (op, key, value) in enumerate(ops):
            if key is None or value is None:
                raise StoreError("INVALID_CONFIGURATION", "keys and values are never null")
            rows.append((i, op, bytearray(key), bytearray(value)))
        self.append(self.spark.createDataFrame(rows, CHANGELOG))

    def put(self, key: bytes, value: bytes) -> None:
        self.write([(PUT, key, value)])

    def delete(self, key: bytes) -> None:
        self.write([(DELETE, key, b"")])

    def flush(self) -> bool:
        """Makes a run of the log, then drops the log that it holds.

        Runs compact when there are enough of them, here unless a Compactor does so in the background.
        """
        self._ready()
        batches = self._batches()
        if not batches:
            return False
        self.runs.flush(self._log(batches))
        for n in batches:  # a batch that came meanwhile stays
            self.runs._fs.delete(self.runs._path(f"{self.root}/log/{n}"), True)
        if not self.background and len(self.runs.entries()) >= self.config.compaction_threshold:
            self.compact()
        return True

    def compact(self, since: float | None = None) -> bool:
        """Merges all runs; other threads' writes wait once it is longer than the lag allowed since it began or fell due."""
        self._ready()
        began = time.monotonic() if since is None else since
        done = threading.Event()

        def lag() -> None:
            while not done.wait(1):
                self.backpressure.signal(int(1000 * (time.monotonic() - began)))

        watch = threading.Thread(target=lag, daemon=True)
        watch.start()
        try:
            return self.runs.compact()
        finally:
            done.set()
            watch.join()
            self.backpressure.complete()

    # --- reads

    def changes(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        return self.runs.rows(start, end).unionByName(self._log())

    def get(self, key: bytes) -> bytes | None:
        self._ready()
        row = resolve.get(self.changes(key, key), bytearray(key)).first()
        return bytes(row.value) if row.value is not None else None

    def multi_get(self, probes: DataFrame) -> DataFrame:
        self._ready()
        return resolve.multi_get(self.changes(), probes)

    def scan(self, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
        self._ready()
        as_key = lambda k: None if k is None else bytearray(k)
        return resolve.range_scan(self.changes(start, end), as_key(start), as_key(end)).select("key", "value")
