"""SQL that DuckDB runs on the same tables, one statement a query, written apart from the operators."""

from __future__ import annotations

_CL = """cl AS (SELECT event_id AS seq, CASE WHEN event_type='error' THEN 2 ELSE 1 END AS op, CAST(user_id AS VARCHAR) AS key,
CASE WHEN event_type='error' THEN '' ELSE event_type END AS value, event_id // 2500 AS run_id FROM events)"""
_LATEST = _CL + """, latest AS (SELECT key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM cl) WHERE rn = 1)"""
_RUNS = _CL + """, runs AS (SELECT run_id, key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) rn FROM cl) WHERE rn = 1)"""
_PLACED = _RUNS + """, placed AS (SELECT *, 13 + strlen(key) + strlen(value) AS size, row_number() OVER w - 1 AS number,
41 + coalesce(sum(13 + strlen(key) + strlen(value)) OVER (PARTITION BY run_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset"
FROM runs WINDOW w AS (PARTITION BY run_id ORDER BY key))"""
_WAL = _CL + """, wal AS (SELECT run_id AS file_no, seq, op, key, value, seq % 997 = 996 AS bad FROM cl),
kept AS (SELECT * FROM wal w WHERE seq < coalesce((SELECT min(seq) FROM wal b WHERE b.bad AND b.file_no = w.file_no), 9223372036854775807))"""
_PROBES = """probes AS (SELECT CAST(range AS VARCHAR) AS key FROM range(200))"""
_OPS = """ops AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'signup' THEN 'hit' WHEN 'purchase' THEN 'miss' ELSE 'checksum_error' END AS kind,
CAST(floor(value) AS BIGINT) AS latency_ms, event_id % 10 <> 0 AS enabled FROM events)"""


def _pct(p: float, where: str = "") -> str:
    return f"CAST(coalesce(percentile_disc({p / 100}) WITHIN GROUP (ORDER BY latency_ms){where}, 0) AS BIGINT)"


_PCTS = ", ".join(f"{_pct(p)} AS p{p}" for p in (50, 90, 99, 100))
_SNAPSHOT = f"""{_OPS}, live AS (SELECT * FROM ops WHERE enabled),
timed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq) rn FROM live WHERE kind IN ('read', 'write')) WHERE rn % 10 = 0),
snap AS (SELECT CAST(floor(count(*) FILTER (kind = 'read') / 10.0) AS BIGINT) AS read_throughput_ops_per_sec,
CAST(floor(count(*) FILTER (kind = 'write') / 10.0) AS BIGINT) AS write_throughput_ops_per_sec,
{", ".join(f"(SELECT {_pct(p, f" FILTER (kind = '{k}')")} FROM timed) AS {k}_latency_p{str(p).replace('.', '')}_ms" for k in ("read", "write") for p in (50, 99, 99.9))},
coalesce(count(*) FILTER (kind = 'hit') / nullif(count(*) FILTER (kind IN ('hit', 'miss')), 0), 0.0) AS cache_hit_ratio,
coalesce((SELECT max_by(event_id % 977, event_id) FROM events WHERE event_id % 50 = 7), 0) AS compaction_lag_ms,
coalesce((SELECT max(event_id) FROM events WHERE event_id % 50 = 8), 0) * 12345 AS heap_used_bytes, coalesce((SELECT max(event_id) FROM events WHERE event_id % 50 = 9), 0) * 777 AS off_heap_used_bytes, CAST(1073741824 AS BIGINT) AS total_memory_limit_bytes,
count(*) FILTER (kind = 'checksum_error') AS checksum_errors_total, count(*) FILTER (kind = 'budget_exceeded') AS budget_exceeded_total FROM live)"""
# Fixed values of the exposition format.
_HELP = """read_throughput_ops_per_sec|Current read operations per second|gauge
write_throughput_ops_per_sec|Current write operations per second|gauge
read_latency_p50_ms|Read latency P50 in milliseconds|gauge
read_latency_p99_ms|Read latency P99 in milliseconds|gauge
read_latency_p999_ms|Read latency P99.9 in milliseconds|gauge
write_latency_p50_ms|Write latency P50 in milliseconds|gauge
write_latency_p99_ms|Write latency P99 in milliseconds|gauge
write_latency_p999_ms|Write latency P99.9 in milliseconds|gauge
cache_hit_ratio|Cache hit ratio (0.0 to 1.0)|gauge
compaction_lag_ms|Compaction lag in milliseconds|gauge
heap_used_bytes|Memory used by engine on heap in bytes|gauge
off_heap_used_bytes|Memory used by engine off-heap in bytes|gauge
total_memory_limit_bytes|Total configured memory limit for engine in bytes|gauge
checksum_errors_total|Total number of checksum mismatches detected|counter
budget_exceeded_total|Total number of memory budget exceeded events|counter"""
_SIZE = "CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.2f KB', floor(n / 1024.0 * 100 + 0.5) / 100) WHEN n < 1073741824 THEN printf('%.2f MB', floor(n / 1048576.0 * 100 + 0.5) / 100) ELSE printf('%.2f GB', floor(n / 1073741824.0 * 100 + 0.5) / 100) END"

ORACLES: dict[str, str] = {
    "kv_live_state": f"WITH {_LATEST} SELECT key, value, seq FROM latest WHERE op = 1",
    "kv_tombstones": f"WITH {_LATEST} SELECT key, seq FROM latest WHERE op = 2",
    "kv_multi_get": f"WITH {_LATEST}, {_PROBES} SELECT p.key, CASE WHEN l.op IS NULL THEN 'NOT_FOUND' WHEN l.op = 2 THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN l.op = 1 THEN l.value END AS value FROM probes p LEFT JOIN latest l ON p.key = l.key",
    "kv_point_get": f"WITH {_LATEST}, p AS (SELECT '14' AS key) SELECT p.key, CASE WHEN l.op IS NULL THEN 'NOT_FOUND' WHEN l.op = 2 THEN 'DELETED' ELSE 'FOUND' END AS status, CASE WHEN l.op = 1 THEN l.value END AS value FROM p LEFT JOIN latest l ON p.key = l.key",
    "kv_range_scan": f"WITH {_LATEST} SELECT key, value, seq FROM latest WHERE op = 1 AND key BETWEEN '10' AND '15'",
    "kv_keys_only": f"WITH {_LATEST} SELECT key FROM latest WHERE op = 1",
    "kv_snapshot_orders": "SELECT CAST(o_custkey AS VARCHAR) AS key, o_orderstatus AS value, o_orderkey AS seq FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) rn FROM orders) WHERE rn = 1",
    "memtable_snapshot": f"WITH {_LATEST} SELECT key, CAST(op AS BIGINT) AS op, value FROM latest ORDER BY key",
    "memtable_size": f"WITH {_LATEST} SELECT CAST(coalesce(sum(64 + strlen(key) + strlen(value)), 0) AS BIGINT) AS size_bytes FROM latest",
    "memtable_flush_segments": f"""WITH {_CL}, sized AS (SELECT *, CAST(64 + strlen(key) + strlen(value) AS BIGINT) AS size FROM cl),
rows AS (SELECT run_id, seq, size, coalesce(lag(seq) OVER w, -1) AS prev_seq, coalesce(lag(size) OVER w, 0) AS prev_size FROM sized WINDOW w AS (PARTITION BY run_id, key ORDER BY seq)),
lists AS (SELECT run_id, list({{'seq': seq, 'size': size, 'prev_seq': prev_seq, 'prev_size': prev_size, 'total': CAST(0 AS BIGINT), 'flushed': CAST(-1 AS BIGINT), 'flushes': CAST(0 AS BIGINT)}} ORDER BY seq) AS l FROM rows GROUP BY run_id),
folded AS (SELECT run_id, list_reduce(list_prepend({{'seq': CAST(-1 AS BIGINT), 'size': CAST(0 AS BIGINT), 'prev_seq': CAST(-1 AS BIGINT), 'prev_size': CAST(0 AS BIGINT), 'total': CAST(0 AS BIGINT), 'flushed': CAST(-1 AS BIGINT), 'flushes': CAST(0 AS BIGINT)}}, l),
lambda a, x: {{'seq': x.seq, 'size': x.size, 'prev_seq': x.prev_seq, 'prev_size': x.prev_size,
'total': CASE WHEN a.total + x.size - (CASE WHEN x.prev_seq > a.flushed THEN x.prev_size ELSE 0 END) >= 4096 THEN 0 ELSE a.total + x.size - (CASE WHEN x.prev_seq > a.flushed THEN x.prev_size ELSE 0 END) END,
'flushed': CASE WHEN a.total + x.size - (CASE WHEN x.prev_seq > a.flushed THEN x.prev_size ELSE 0 END) >= 4096 THEN x.seq ELSE a.flushed END,
'flushes': CASE WHEN a.total + x.size - (CASE WHEN x.prev_seq > a.flushed THEN x.prev_size ELSE 0 END) >= 4096 THEN a.flushes + 1 ELSE a.flushes END}}) AS e FROM lists)
SELECT run_id, e.flushes AS flushes, e.flushed AS last_flush_seq, e.total AS residual_bytes FROM folded""",
    "sst_layout": f'WITH {_PLACED} SELECT run_id, key, CAST("offset" AS BIGINT) AS "offset", CAST(size AS BIGINT) AS size FROM placed',
    "sst_header": f"""WITH {_PLACED} SELECT run_id, count(*) AS key_count, CAST(41 AS BIGINT) AS data_offset, CAST(41 + sum(size) AS BIGINT) AS index_offset,
count(*) FILTER (number % 128 = 0) AS index_entries, CAST(41 + sum(size) + sum(CASE WHEN number % 128 = 0 THEN 12 + strlen(key) + 8 ELSE 0 END) + 8 AS BIGINT) AS file_size FROM placed GROUP BY run_id""",
    "sparse_index": f'WITH {_PLACED} SELECT run_id, key, CAST("offset" AS BIGINT) AS "offset" FROM placed WHERE number % 16 = 0',
    "sparse_floor_lookup": f"""WITH {_PLACED}, {_PROBES}, idx AS (SELECT run_id, key, "offset" FROM placed WHERE number % 16 = 0),
asked AS (SELECT r.run_id, p.key FROM (SELECT DISTINCT run_id FROM idx) r, probes p)
SELECT a.run_id, a.key, CAST(coalesce(i."offset", -1) AS BIGINT) AS "offset" FROM asked a ASOF LEFT JOIN idx i ON a.run_id = i.run_id AND a.key >= i.key""",
    "byte_window_list": f'WITH {_PLACED} SELECT run_id, key, CAST("offset" AS BIGINT) AS "offset" FROM placed WHERE "offset" >= 100 AND "offset" < 1100',
    "compact_minor": f"WITH {_RUNS} SELECT key, CAST(op AS BIGINT) AS op, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM runs WHERE run_id IN (1, 2)) WHERE rn = 1",
    "compact_major": f"WITH {_RUNS} SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id DESC) rn FROM runs) WHERE rn = 1 AND op <> 2",
    "compact_stats": f"""WITH {_RUNS}, top AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY run_id DESC) rn FROM runs)
SELECT count(*) AS input_rows, count(*) FILTER (rn = 1 AND op = 1) AS output_rows, count(*) FILTER (rn > 1) AS shadowed_rows, count(*) FILTER (rn = 1 AND op = 2) AS dropped_tombstones FROM top""",
    "read_amplification": f"WITH {_RUNS} SELECT key, count(DISTINCT run_id) AS runs_holding, (SELECT max(run_id) FROM runs) - max(run_id) + 1 AS runs_probed FROM runs GROUP BY key",
    "wal_offsets": f'WITH {_WAL} SELECT file_no, seq, CAST(coalesce(sum(14 + strlen(key) + strlen(value)) OVER (PARTITION BY file_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", CAST(14 + strlen(key) + strlen(value) AS BIGINT) AS size FROM wal',
    "wal_valid_prefix": f"WITH {_WAL} SELECT w.file_no, count(*) AS records, (SELECT count(*) FROM kept k WHERE k.file_no = w.file_no) AS valid_records, bool_or(bad) AS truncated FROM wal w GROUP BY w.file_no",
    "wal_replay_state": f"WITH {_WAL} SELECT key, value, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) rn FROM kept) WHERE rn = 1 AND op = 1",
    "wal_file_order": "SELECT name, coalesce(TRY_CAST(nullif(regexp_replace(name, '[^0-9]+', '', 'g'), '') AS BIGINT), 0) AS file_no FROM (SELECT 'wal-' || n_nationkey || '.log' AS name FROM nation)",
    "backpressure_state": """SELECT shard, current_lag, current_lag < 50 AS can_write FROM (SELECT user_id AS shard, CASE WHEN event_type = 'signup' THEN 0 ELSE CAST(floor(value) AS BIGINT) END AS current_lag,
row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) rn FROM events) WHERE rn = 1""",
    "budget_by_component": "SELECT event_type AS component, CAST(sum(CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END * CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes_used FROM events GROUP BY ROLLUP (event_type)",
    "metrics_percentiles": f"WITH {_OPS} SELECT kind, count(*) AS samples, {_PCTS} FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq) rn FROM ops) WHERE rn % 100 = 0 GROUP BY kind",
    "metrics_ring_buffer": f"WITH {_OPS} SELECT kind, count(*) AS samples, {_PCTS} FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY seq DESC) rn FROM ops) WHERE rn <= 50 GROUP BY kind",
    "metrics_hit_ratio": f"WITH {_OPS} SELECT count(*) FILTER (kind = 'hit') AS hits, count(*) FILTER (kind = 'miss') AS misses, coalesce(count(*) FILTER (kind = 'hit') / nullif(count(*) FILTER (kind IN ('hit', 'miss')), 0), 0.0) AS hit_ratio FROM ops WHERE enabled",
    "metrics_throughput": f"WITH {_OPS} SELECT kind, CAST(floor(count(*) / 2.5) AS BIGINT) AS ops_per_sec, count(*) AS ops_short FROM ops GROUP BY kind",
    "metrics_snapshot": f"WITH {_SNAPSHOT} SELECT * FROM snap",
    "metrics_format": f"""WITH {_SNAPSHOT} SELECT printf('Engine Metrics Snapshot:
  Throughput: Read: %d ops/sec, Write: %d ops/sec
  Latency Read: P50: %dms, P99: %dms, P99.9: %dms
  Latency Write: P50: %dms, P99: %dms, P99.9: %dms
  Cache Hit Ratio: %.2f%%
  Compaction Lag: %dms
  Memory: Heap: %s, Off-Heap: %s, Limit: 1.00 GB
  Errors: Checksum: %d, Budget Exceeded: %d', read_throughput_ops_per_sec, write_throughput_ops_per_sec, read_latency_p50_ms, read_latency_p99_ms, read_latency_p999_ms, write_latency_p50_ms, write_latency_p99_ms, write_latency_p999_ms,
cache_hit_ratio * 100, compaction_lag_ms, (SELECT {_SIZE} FROM (SELECT heap_used_bytes AS n FROM snap)), (SELECT {_SIZE} FROM (SELECT off_heap_used_bytes AS n FROM snap)), checksum_errors_total, budget_exceeded_total) AS text FROM snap""",
    "metrics_prometheus": f"WITH {_SNAPSHOT} "
    + " UNION ALL ".join(
        f"SELECT CAST({3 * i} AS BIGINT) AS position, '# HELP kvstore_{n} {h}' AS line UNION ALL SELECT CAST({3 * i + 1} AS BIGINT), '# TYPE kvstore_{n} {k}' UNION ALL SELECT CAST({3 * i + 2} AS BIGINT), 'kvstore_{n} ' || CAST({n} AS VARCHAR) FROM snap"
        for i, (n, h, k) in enumerate(x.split("|") for x in _HELP.split("\n"))
    ),
    "format_sizes": f"SELECT o_orderkey, {_SIZE} AS shown FROM (SELECT o_orderkey, o_orderkey * o_custkey AS n FROM orders)",
    "key_display": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '0xff' || lower(hex(c_name)) END AS shown FROM customer",
    "bloom_no_false_negative": "SELECT count(DISTINCT user_id) AS keys, CAST(0 AS BIGINT) AS missed FROM events",
    "bloom_sizing": f"WITH {_RUNS}, n AS (SELECT run_id, count(*) AS keys FROM runs GROUP BY run_id), b AS (SELECT *, CAST(floor(-keys * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits FROM n) SELECT run_id, keys, bits, greatest(1, CAST(floor(bits / keys * ln(2) + 0.5) AS BIGINT)) AS hashes FROM b",
    "crc_verify": f"WITH {_RUNS} SELECT run_id, count(*) AS records, count(*) FILTER (seq % 53 = 0) AS damaged, min(key) FILTER (seq % 53 = 0) AS first_damaged, count(*) FILTER (seq % 53 = 0) = 0 AS passed FROM runs GROUP BY run_id",
    "cache_lru_sim": """WITH requests AS (SELECT event_id // 2500 AS cache, event_id AS seq, event_id % 2 = 0 AS puts, user_id % 40 AS block FROM events),
lists AS (SELECT cache, list({'puts': puts, 'block': block, 'held': CAST([] AS BIGINT[]), 'hits': CAST(0 AS BIGINT), 'misses': CAST(0 AS BIGINT)} ORDER BY seq) AS l FROM requests GROUP BY cache),
folded AS (SELECT cache, list_reduce(list_prepend({'puts': false, 'block': CAST(-1 AS BIGINT), 'held': CAST([] AS BIGINT[]), 'hits': CAST(0 AS BIGINT), 'misses': CAST(0 AS BIGINT)}, l),
lambda a, x: {'puts': x.puts, 'block': x.block,
'held': CASE WHEN x.puts AND NOT list_contains(a.held, x.block) THEN CASE WHEN 928 * (len(a.held) + 1) > 20000 THEN list_append(a.held[2:], x.block) ELSE list_append(a.held, x.block) END
  WHEN NOT x.puts AND list_contains(a.held, x.block) THEN list_append(list_filter(a.held, lambda h: h <> x.block), x.block) ELSE a.held END,
'hits': a.hits + CASE WHEN NOT x.puts AND list_contains(a.held, x.block) THEN 1 ELSE 0 END,
'misses': a.misses + CASE WHEN NOT x.puts AND NOT list_contains(a.held, x.block) THEN 1 ELSE 0 END}) AS e FROM lists)
SELECT cache, e.hits AS hits, e.misses AS misses FROM folded""",
}
