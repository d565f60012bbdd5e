"""The write-ahead log: record offsets, valid prefixes, replay and file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.model import DELETE, PUT
from tidelog.operators.resolve import latest

#: Bytes of a log record besides its key and value, and the most that one record may have.
RECORD_OVERHEAD, RECORD_MAX = 14, 100 << 20


def record_size() -> Column:
    return (RECORD_OVERHEAD + F.octet_length("key") + F.octet_length("value")).cast("long")


def offsets(log: DataFrame, file: str = "file_no") -> DataFrame:
    """Adds the record's size and its offset in its file; files are bounded, and each is one window."""
    before = Window.partitionBy(file).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("size", record_size()).withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))


def valid_prefix(log: DataFrame, file: str = "file_no") -> DataFrame:
    """The records of each file before its first bad one; the first bad seq is an aggregate that joins back, no window."""
    first_bad = log.filter("bad").groupBy(file).agg(F.min("seq").alias("first_bad"))
    return log.join(first_bad, file, "left").filter(F.col("first_bad").isNull() | (F.col("seq") < F.col("first_bad"))).drop("first_bad")


def prefix_report(log: DataFrame, file: str = "file_no") -> DataFrame:
    """(file, records, valid_records, truncated)"""
    first_bad = F.min(F.when(F.col("bad"), F.col("seq")))
    per_file = log.groupBy(file).agg(F.count("*").alias("records"), first_bad.alias("first_bad"))
    kept = valid_prefix(log, file).groupBy(file).agg(F.count("*").alias("valid_records"))
    joined = per_file.join(kept, file, "left")
    return joined.select(file, "records", F.coalesce("valid_records", F.lit(0)).alias("valid_records"), F.col("first_bad").isNotNull().alias("truncated"))


def replay(log: DataFrame, file: str = "file_no") -> DataFrame:
    """Newest versions after replaying the valid prefixes of all files; records of unknown kind are skipped."""
    good = valid_prefix(log, file).filter(F.col("op").isin(PUT, DELETE))
    return latest(good)


def file_number(name: Column) -> Column:
    """The digits of a file name as a number; 0 if there are none or too many."""
    return F.coalesce(F.expr("try_cast(nullif(regexp_replace(name, '[^0-9]+', ''), '') as bigint)") if isinstance(name, str) else F.nullif(F.regexp_replace(name, "[^0-9]+", ""), F.lit("")).try_cast("bigint"), F.lit(0))
