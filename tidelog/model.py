"""The relation everything derives from: a changelog (seq, op, key, value), newest seq last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DELETE = 1, 2

CHANGELOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.IntegerType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), False),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def normalise(changes: DataFrame) -> DataFrame:
    """A put of an empty value is a delete, and a delete has an empty value; both are settled on the way in."""
    deleted = (F.col("op") == DELETE) | F.col("value").isNull() | (F.octet_length("value") == 0)
    empty = F.lit("").cast(changes.schema["value"].dataType)
    return changes.withColumn("op", F.when(deleted, DELETE).otherwise(PUT)).withColumn("value", F.when(deleted, empty).otherwise(F.col("value")))


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a changelog by user: an error deletes, any other event puts its type; 2500 events make a run."""
    is_error = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(is_error, DELETE).otherwise(PUT).alias("op"),
        F.col("user_id").cast("string").alias("key"),
        F.when(is_error, "").otherwise(F.col("event_type")).alias("value"),
        F.expr("event_id div 2500").alias("run_id"),
    )
