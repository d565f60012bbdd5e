"""Newest version of each key, and lookups on it.

The newest version is a max of (seq, op, value) per key: Spark combines it on the map side, so one row a key and task is
shuffled, however often a key is overwritten, and a hot key needs no salting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import DELETE, PUT

#: Bytes that an entry takes besides its key and value.
ENTRY_OVERHEAD = 64


def latest(changes: DataFrame, order: str = "seq") -> DataFrame:
    """(key, seq, op, value): the newest version of every key, tombstones included."""
    newest = changes.groupBy("key").agg(F.max(F.struct(F.col(order).alias("seq"), "op", "value")).alias("n"))
    return newest.select("key", "n.seq", "n.op", "n.value")


def live(changes: DataFrame, order: str = "seq") -> DataFrame:
    """The newest version of every key that is not deleted; the filter stays above the aggregate."""
    return latest(changes, order).filter(F.col("op") == PUT)


def tombstones(changes: DataFrame, order: str = "seq") -> DataFrame:
    return latest(changes, order).filter(F.col("op") == DELETE)


def status(op: Column) -> Column:
    return F.when(op.isNull(), "NOT_FOUND").when(op == DELETE, "DELETED").otherwise("FOUND")


def get(changes: DataFrame, key) -> DataFrame:
    """(key, status, value) of one key, one row always; the key is compared below the aggregate and reaches the scan."""
    probe = changes.sparkSession.range(1).select(F.lit(key).alias("key"))
    return multi_get(changes.filter(F.col("key") == F.lit(key)), probe)


def multi_get(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, status, value) for every probed key."""
    found = latest(changes).select("key", "op", F.col("value").alias("held"))
    joined = probes.select("key").join(found, "key", "left")
    return joined.select("key", status(F.col("op")).alias("status"), F.when(F.col("op") == PUT, F.col("held")).alias("value"))


def range_scan(changes: DataFrame, start=None, end=None) -> DataFrame:
    """Live rows with start <= key <= end; either bound may be None.  The range is applied below the aggregate."""
    if start is not None:
        changes = changes.filter(F.col("key") >= F.lit(start))
    if end is not None:
        changes = changes.filter(F.col("key") <= F.lit(end))
    return live(changes)


def entry_size(key: str = "key", value: str = "value") -> Column:
    return (ENTRY_OVERHEAD + F.octet_length(key) + F.octet_length(value)).cast("long")


def state_size(changes: DataFrame) -> DataFrame:
    """(size_bytes): what the newest versions take, tombstones included."""
    return latest(changes).agg(F.coalesce(F.sum(entry_size()), F.lit(0)).alias("size_bytes"))


def snapshot(changes: DataFrame) -> DataFrame:
    """All newest versions in key order; a tombstone has an empty value."""
    return latest(changes).orderBy("key")


def read_amplification(runs: DataFrame) -> DataFrame:
    """(key, runs_holding, runs_probed): a lookup goes from the newest run down and stops at the first that has the key."""
    newest = runs.agg(F.max("run_id")).withColumnRenamed("max(run_id)", "top")
    held = runs.groupBy("key").agg(F.count_distinct("run_id").alias("runs_holding"), F.max("run_id").alias("hit"))
    return held.crossJoin(F.broadcast(newest)).select("key", "runs_holding", (F.col("top") - F.col("hit") + 1).alias("runs_probed"))  # newest is one row
