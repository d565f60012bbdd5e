"""Merging runs: newest version per key; a major compaction also drops tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.model import DELETE
from tidelog.operators.resolve import latest


def merge(runs: DataFrame, order: str = "seq") -> DataFrame:
    """The newest version of every key in the runs, in whichever order and grouping they come."""
    return latest(runs, order)


def compact(runs: DataFrame, major: bool, order: str = "seq") -> DataFrame:
    """Only a compaction of all runs may be major: an older run outside could hold what a tombstone hides."""
    merged = merge(runs, order)
    return merged.filter(F.col("op") != DELETE) if major else merged


def stats(runs: DataFrame) -> DataFrame:
    """(input_rows, output_rows, shadowed_rows, dropped_tombstones) of a major compaction, in one pass."""
    per_key = runs.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("seq", "op")).alias("top"))
    is_delete = F.col("top.op") == DELETE
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.count_if(~is_delete).alias("output_rows"), F.count("*").alias("keys"), F.count_if(is_delete).alias("dropped_tombstones"))
    return total.select("input_rows", "output_rows", (F.col("input_rows") - F.col("keys")).alias("shadowed_rows"), "dropped_tombstones")
