"""Where records lie in a sorted run file, its sparse index and header, and floor lookups.

A run is a bounded file with unique keys, so its running sums are windows of one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of the file header, of a record and of an index entry besides their key and value, and records per index entry.
HEADER, RECORD_OVERHEAD, INDEX_OVERHEAD, INTERVAL = 41, 13, 12, 128


def record_size() -> Column:
    return (RECORD_OVERHEAD + F.octet_length("key") + F.octet_length("value")).cast("long")


def records(runs: DataFrame) -> DataFrame:
    """Adds size, offset and number of each record, in key order within its run."""
    in_run = Window.partitionBy("run_id").orderBy("key")
    before = in_run.rowsBetween(Window.unboundedPreceding, -1)
    placed = runs.withColumn("size", record_size())
    return placed.withColumn("offset", HEADER + F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("number", F.row_number().over(in_run) - 1)


def sparse_index(runs: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """(run_id, key, offset): every interval-th record."""
    return records(runs).filter(F.col("number") % interval == 0).select("run_id", "key", "offset")


def header(runs: DataFrame, interval: int = INTERVAL) -> DataFrame:
    """(run_id, key_count, data_offset, index_offset, index_entries, file_size)"""
    placed = records(runs)
    indexed = F.col("number") % interval == 0
    sums = placed.groupBy("run_id").agg(
        F.count("*").alias("key_count"),
        (HEADER + F.sum("size")).alias("index_offset"),
        F.count_if(indexed).alias("index_entries"),
        F.sum(F.when(indexed, INDEX_OVERHEAD + F.octet_length("key")).otherwise(0)).cast("long").alias("index_bytes"),
    )
    size = F.col("index_offset") + F.col("index_bytes") + 8 * F.col("index_entries") + 8
    return sums.select("run_id", "key_count", F.lit(HEADER).cast("long").alias("data_offset"), "index_offset", "index_entries", size.alias("file_size"))


def floor_lookup(index: DataFrame, probes: DataFrame) -> DataFrame:
    """(run_id, key, offset): offset of the greatest indexed key <= the probed key in each run, -1 if there is none.

    Index entries and probes are sorted together by key and the last offset carried along, so no pair of both is formed.
    """
    runs = index.select("run_id").distinct()
    asked = probes.select("key").distinct().join(runs).select("run_id", "key", F.lit(None).cast("long").alias("offset"), F.lit(1).alias("asks"))
    both = index.select("run_id", "key", "offset", F.lit(0).alias("asks")).unionByName(asked)
    carried = F.last("offset", ignorenulls=True).over(Window.partitionBy("run_id").orderBy("key", "asks"))
    return both.withColumn("floor", F.coalesce(carried, F.lit(-1))).filter("asks = 1").select("run_id", "key", F.col("floor").alias("offset"))


def byte_window(runs: DataFrame, start: int, limit: int) -> DataFrame:
    """The records that begin in [start, start + limit) of their run."""
    return records(runs).filter((F.col("offset") >= start) & (F.col("offset") < start + limit))
