"""Order-dependent folds: flush boundaries, the block cache, the memory budget, backpressure.

A fold is sequential within its shard, and a shard is bounded (one log file, one cache's request log), so shards run in
parallel and none grows with the data.
"""

from __future__ import annotations

import time
from collections import OrderedDict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.cluster import ship
from tidelog.errors import StoreError
from tidelog.operators.resolve import entry_size


def flush_segments(changes: DataFrame, threshold: int, shard: str = "run_id") -> DataFrame:
    """(shard, flushes, last_flush_seq, residual_bytes): a memtable flushes and starts anew when its entries reach threshold bytes.

    Overwriting a key counts only the difference, if the key was written since the last flush; what a row adds follows from the
    previous row of its key.
    """
    by_key = Window.partitionBy(shard, "key").orderBy("seq")
    sized = changes.withColumn("size", entry_size())
    rows = sized.select(shard, F.struct("seq", "size", F.lag("seq", 1, -1).over(by_key).alias("prev_seq"), F.lag("size", 1, 0).over(by_key).alias("prev_size")).alias("row"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).cast("long").alias("flushed"), F.lit(0).cast("long").alias("flushes"))

    def step(state, row):
        again = row["prev_seq"] > state["flushed"]
        total = state["total"] + row["size"] - F.when(again, row["prev_size"]).otherwise(0)
        full = total >= threshold
        return F.struct(F.when(full, 0).otherwise(total).alias("total"), F.when(full, row["seq"]).otherwise(state["flushed"]).alias("flushed"), (state["flushes"] + full.cast("long")).alias("flushes"))

    folded = rows.groupBy(shard).agg(F.array_sort(F.collect_list("row")).alias("rows")).withColumn("end", F.aggregate("rows", start, step))
    return folded.select(shard, F.col("end.flushes").alias("flushes"), F.col("end.flushed").alias("last_flush_seq"), F.col("end.total").alias("residual_bytes"))


class LruCache:
    """A block cache of max_bytes; a block takes its length and an overhead, and one insert evicts one block at most."""

    OVERHEAD = 128

    def __init__(self, max_bytes: int):
        self.max_bytes, self.blocks, self.size, self.evicted = max_bytes, OrderedDict(), 0, 0

    def put(self, key, length: int) -> None:
        if key in self.blocks:
            return
        self.blocks[key] = length + self.OVERHEAD
        self.size += length + self.OVERHEAD
        if self.size > self.max_bytes:
            _, gone = self.blocks.popitem(last=False)
            self.size -= gone
            self.evicted += 1

    def get(self, key) -> bool:
        if key in self.blocks:
            self.blocks.move_to_end(key)
            return True
        return False

    def evict(self, key) -> None:
        """Drops one block, if it is there."""
        self.size -= self.blocks.pop(key, 0)

    def clear(self) -> None:
        self.blocks.clear()
        self.size = 0


def cache_simulation(requests: DataFrame, max_bytes: int, shard: str = "cache") -> DataFrame:
    """(shard, seq, hit): replays a request log (shard, seq, action, block, length); hit is null for a put."""
    ship(requests.sparkSession)
    kind = requests.schema[shard].dataType.simpleString()

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        lru, hits = LruCache(max_bytes), []
        pdf = pdf.sort_values("seq")
        for action, block, length in zip(pdf.action, pdf.block, pdf.length):
            hits.append(lru.put(block, length) if action == "put" else lru.get(block))
        return pd.DataFrame({shard: pdf[shard], "seq": pdf.seq, "hit": pd.array(hits, "boolean")})

    return requests.groupBy(shard).applyInPandas(replay, f"{shard} {kind}, seq long, hit boolean")


class Budget:
    """A global allowance of bytes that components draw from."""

    def __init__(self, max_bytes: int):
        self.max_bytes, self.used, self.by_component = max_bytes, 0, {}

    def register(self, component: str) -> None:
        self.by_component.setdefault(component, 0)

    def allocate(self, component: str, n: int) -> None:
        if n < 0:
            raise StoreError("INVALID_CONFIGURATION", "a negative allocation")
        if n == 0:
            return
        if component not in self.by_component:
            raise StoreError("INVALID_CONFIGURATION", f"{component} is not registered")
        if self.used + n > self.max_bytes:
            raise StoreError("BUDGET_EXCEEDED", f"{self.used} + {n} > {self.max_bytes}")
        self.used += n
        self.by_component[component] += n

    def release(self, component: str, n: int) -> None:
        self.used -= n
        if component in self.by_component:
            self.by_component[component] -= n


class Tracker:
    """A component's own view of a budget; leaving its scope releases what it holds."""

    def __init__(self, budget: Budget, component: str):
        self.budget, self.component = budget, component
        budget.register(component)

    @property
    def used(self) -> int:
        return self.budget.by_component[self.component]

    def allocate(self, n: int) -> None:
        self.budget.allocate(self.component, n)

    def release(self, n: int) -> None:
        self.budget.release(self.component, n)

    def __enter__(self) -> "Tracker":
        return self

    def __exit__(self, *exc) -> None:
        self.release(self.used)


class Backpressure:
    """Lets writers through while compaction lags by less than a threshold."""

    def __init__(self, threshold_ms: int):
        self.threshold_ms, self.lag_ms = threshold_ms, 0

    def signal(self, lag_ms: int) -> None:
        self.lag_ms = lag_ms

    def complete(self) -> None:
        self.lag_ms = 0

    def can_write(self) -> bool:
        return self.lag_ms < self.threshold_ms

    def wait(self, timeout_s: float | None = None, poll_s: float = 0.01) -> None:
        """Returns as soon as writes may pass; raises WRITE_BACKPRESSURE if they may not within the timeout."""
        end = None if timeout_s is None else time.monotonic() + timeout_s
        while not self.can_write():
            if end is not None and time.monotonic() >= end:
                raise StoreError("WRITE_BACKPRESSURE", f"compaction lags by {self.lag_ms} ms")
            time.sleep(poll_s)


def budget_by_component(allocations: DataFrame) -> DataFrame:
    """(component, bytes_used) of an allocation log (component, delta); component null is the total."""
    return allocations.rollup("component").agg(F.sum("delta").cast("long").alias("bytes_used"))


def backpressure(lags: DataFrame, threshold: int, shard: str = "shard") -> DataFrame:
    """Adds current_lag and can_write to a log (shard, seq, lag_ms); a null lag says that a compaction ended."""
    lag = F.coalesce("lag_ms", F.lit(0)).cast("long")
    return lags.select(shard, "seq", lag.alias("current_lag"), (lag < threshold).alias("can_write"))


def last_lag(lags: DataFrame, threshold: int, shard: str = "shard") -> DataFrame:
    """(shard, current_lag, can_write): the state after the newest event."""
    newest = lags.groupBy(shard).agg(F.max(F.struct("seq", F.coalesce("lag_ms", F.lit(0)).cast("long").alias("lag"))).alias("n"))
    return newest.select(shard, F.col("n.lag").alias("current_lag"), (F.col("n.lag") < threshold).alias("can_write"))
