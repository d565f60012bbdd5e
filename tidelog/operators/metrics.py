"""Counters, sampled latencies, percentiles, and their text forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.text import format_bytes

# Fixed values of the exposition format: field, help text and kind of each metric, in order.
FIELDS = [
    ("read_throughput_ops_per_sec", "Current read operations per second", "gauge"),
    ("write_throughput_ops_per_sec", "Current write operations per second", "gauge"),
    ("read_latency_p50_ms", "Read latency P50 in milliseconds", "gauge"),
    ("read_latency_p99_ms", "Read latency P99 in milliseconds", "gauge"),
    ("read_latency_p999_ms", "Read latency P99.9 in milliseconds", "gauge"),
    ("write_latency_p50_ms", "Write latency P50 in milliseconds", "gauge"),
    ("write_latency_p99_ms", "Write latency P99 in milliseconds", "gauge"),
    ("write_latency_p999_ms", "Write latency P99.9 in milliseconds", "gauge"),
    ("cache_hit_ratio", "Cache hit ratio (0.0 to 1.0)", "gauge"),
    ("compaction_lag_ms", "Compaction lag in milliseconds", "gauge"),
    ("heap_used_bytes", "Memory used by engine on heap in bytes", "gauge"),
    ("off_heap_used_bytes", "Memory used by engine off-heap in bytes", "gauge"),
    ("total_memory_limit_bytes", "Total configured memory limit for engine in bytes", "gauge"),
    ("checksum_errors_total", "Total number of checksum mismatches detected", "counter"),
    ("budget_exceeded_total", "Total number of memory budget exceeded events", "counter"),
]


def numbered(rows: DataFrame, by: str, order: str, width: int = 100_000) -> DataFrame:
    """Adds number, the 1-based rank of each row within `by`, from counts per range of `order` and a rank in each range.

    No task sorts more than one range of one group.
    """
    ranges = rows.withColumn("range", F.expr(f"{order} div {width}"))
    counts = ranges.groupBy(by, "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(by, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy(by, "range").orderBy(order)
    return ranges.join(first, [by, "range"]).withColumn("number", F.col("first") + F.row_number().over(within)).drop("range", "first")


def sampled(ops: DataFrame, every: int = 100, by: str = "kind") -> DataFrame:
    """Every `every`-th operation of each kind."""
    return numbered(ops, by, "seq").filter(F.col("number") % every == 0)


def last_samples(ops: DataFrame, capacity: int, by: str = "kind") -> DataFrame:
    """The newest `capacity` samples of each kind, as a ring buffer keeps them."""
    newest = Window.partitionBy(by).orderBy(F.desc("seq"))
    return ops.withColumn("age", F.row_number().over(newest)).filter(F.col("age") <= capacity).drop("age")  # a partial limit runs before the shuffle


def nearest_rank(column: str, percent: float) -> Column:
    """Nearest-rank percentile; 0 for no samples."""
    return F.coalesce(F.expr(f"percentile_disc({percent / 100.0}) within group (order by {column})").cast("long"), F.lit(0))


def percentiles(samples: DataFrame, by: str = "kind") -> DataFrame:
    """(by, samples, p50, p90, p99, p100)"""
    return samples.groupBy(by).agg(F.count("*").alias("samples"), *(nearest_rank("latency_ms", p).alias(f"p{p}") for p in (50, 90, 99, 100)))


def hit_ratio(hits: Column, misses: Column) -> Column:
    return F.coalesce(F.try_divide(hits.cast("double"), (hits + misses).cast("double")), F.lit(0.0))


def throughput(ops: Column, elapsed_ms: Column) -> Column:
    """Operations a second; all of them if less than a second went by."""
    return F.when(elapsed_ms < 1000, ops).otherwise(F.floor(ops / (elapsed_ms / 1000.0))).cast("long")


def snapshot(ops: DataFrame, elapsed_ms: int, memory_limit: int, every: int = 100) -> DataFrame:
    """One row with the FIELDS of an operation log (seq, kind, latency_ms, enabled).

    Only enabled operations count.  Latencies are sampled; gauges are the newest value of the kinds lag, heap and off_heap,
    which carry it in latency_ms.
    """
    on = ops.filter("enabled")
    count = lambda kind: F.count_if(F.col("kind") == kind)
    newest = lambda kind: F.coalesce(F.max_by("latency_ms", F.when(F.col("kind") == kind, F.col("seq"))), F.lit(0)).cast("long")
    elapsed = F.lit(elapsed_ms)
    counters = on.agg(
        throughput(count("read"), elapsed).alias("read_throughput_ops_per_sec"),
        throughput(count("write"), elapsed).alias("write_throughput_ops_per_sec"),
        hit_ratio(count("hit"), count("miss")).alias("cache_hit_ratio"),
        newest("lag").alias("compaction_lag_ms"),
        newest("heap").alias("heap_used_bytes"),
        newest("off_heap").alias("off_heap_used_bytes"),
        F.lit(memory_limit).cast("long").alias("total_memory_limit_bytes"),
        count("checksum_error").alias("checksum_errors_total"),
        count("budget_exceeded").alias("budget_exceeded_total"),
    )
    timed = sampled(on.filter(F.col("kind").isin("read", "write")), every)
    part = lambda kind, p: F.coalesce(F.expr(f"percentile_disc({p / 100}) within group (order by latency_ms) filter (where kind = '{kind}')").cast("long"), F.lit(0))
    names = [(kind, p, f"{kind}_latency_p{str(p).replace('.', '')}_ms") for kind in ("read", "write") for p in (50, 99, 99.9)]
    both = counters.crossJoin(F.broadcast(timed.agg(*(part(kind, p).alias(name) for kind, p, name in names))))  # one row each
    return both.select(*(name for name, _, _ in FIELDS))


def format_text(row: DataFrame) -> DataFrame:
    """(text): the snapshot as a readable block."""
    lines = [
        F.lit("Engine Metrics Snapshot:"),
        F.format_string("  Throughput: Read: %d ops/sec, Write: %d ops/sec", "read_throughput_ops_per_sec", "write_throughput_ops_per_sec"),
        F.format_string("  Latency Read: P50: %dms, P99: %dms, P99.9: %dms", *(f"read_latency_{p}_ms" for p in ("p50", "p99", "p999"))),
        F.format_string("  Latency Write: P50: %dms, P99: %dms, P99.9: %dms", *(f"write_latency_{p}_ms" for p in ("p50", "p99", "p999"))),
        F.format_string("  Cache Hit Ratio: %.2f%%", F.col("cache_hit_ratio") * 100),
        F.format_string("  Compaction Lag: %dms", "compaction_lag_ms"),
        F.concat(F.lit("  Memory: Heap: "), format_bytes(F.col("heap_used_bytes")), F.lit(", Off-Heap: "), format_bytes(F.col("off_heap_used_bytes")), F.lit(", Limit: "), format_bytes(F.col("total_memory_limit_bytes"))),
        F.format_string("  Errors: Checksum: %d, Budget Exceeded: %d", "checksum_errors_total", "budget_exceeded_total"),
    ]
    return row.select(F.concat_ws("\n", *lines).alias("text"))


def exposition(row: DataFrame, prefix: str = "kvstore") -> DataFrame:
    """(position, line): HELP, TYPE and value lines of every field of a snapshot."""
    lines = []
    for name, text, kind in FIELDS:
        lines += [F.lit(f"# HELP {prefix}_{name} {text}"), F.lit(f"# TYPE {prefix}_{name} {kind}"), F.concat(F.lit(f"{prefix}_{name} "), F.col(name).cast("string"))]
    return row.select(F.posexplode(F.array(*lines)).alias("position", "line"))
