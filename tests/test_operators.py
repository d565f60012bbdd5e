"""The literal cases of each operator."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.config import StoreConfig
from tidelog.errors import StoreError
from tidelog.functions.hashing import murmur128, murmur128_many
from tidelog.functions.text import display, format_bytes
from tidelog.model import CHANGELOG, normalise
from tidelog.operators import compaction, layout, log, membership, metrics, resolve, simulate

RUNS = "run_id long, seq long, op int, key string, value string"


def changes(spark, rows):
    return spark.createDataFrame([(i, op, bytearray(k), bytearray(v)) for i, (op, k, v) in enumerate(rows)], CHANGELOG)


def state(df):
    return {bytes(r.key): bytes(r.value) for r in resolve.live(df).collect()}


def test_put_get_delete(spark):
    df = changes(spark, [(1, b"key1", b"value1"), (1, b"k2", b"x"), (2, b"k2", b"")])
    assert state(df) == {b"key1": b"value1"}
    assert resolve.get(df, bytearray(b"key1")).first().status == "FOUND"
    assert resolve.get(df, bytearray(b"k2")).first().status == "DELETED"
    assert resolve.get(df, bytearray(b"zz")).first().status == "NOT_FOUND"


def test_sizes(spark):
    assert resolve.state_size(changes(spark, [(1, b"k" * 10, b"v" * 90)])).first()[0] == 164
    assert resolve.state_size(changes(spark, [(2, b"key1", b"")])).first()[0] == 68
    assert resolve.state_size(changes(spark, [(2, b"key1", b""), (1, b"key1", b"val")])).first()[0] == 71
    assert resolve.state_size(changes(spark, [])).first()[0] == 0


def test_empty_put_is_a_delete(spark):
    df = normalise(changes(spark, [(1, b"k", b"old"), (1, b"k", b"")]))
    assert state(df) == {} and resolve.get(df, bytearray(b"k")).first().status == "DELETED"


def test_snapshot_is_sorted_unsigned(spark):
    keys = [b"", b"\x7f", b"\x80", b"\xff", b"\x01\x00", b"\x01"]
    got = [bytes(r.key) for r in resolve.snapshot(changes(spark, [(1, k, b"v") for k in keys])).collect()]
    assert got == sorted(keys)


def test_random_histories_match_a_dict(spark):
    r = random.Random(5)
    for _ in range(3):
        rows = [(r.choice((1, 1, 2)), bytes([r.randrange(20)]), bytes([r.randrange(1, 9)])) for _ in range(300)]
        want = {}
        for op, k, v in rows:
            want.pop(k, None) if op == 2 else want.__setitem__(k, v)
        assert state(changes(spark, rows).repartition(5)) == want


def test_merge_in_any_grouping(spark):
    rows = [(n, n * 10 + k, r, f"k{k}", f"v{n}") for n in range(6) for k in range(10) if (r := 2 if (n + k) % 4 == 0 else 1)]
    runs = spark.createDataFrame(rows, RUNS)
    whole = sorted(map(tuple, compaction.compact(runs, True).collect()))
    first = compaction.compact(runs.filter("run_id in (1, 4, 2)"), False)
    rest = runs.filter("run_id not in (1, 4, 2)").select("key", "seq", "op", "value")
    assert sorted(map(tuple, compaction.compact(first.unionByName(rest), True).collect())) == whole


def test_minor_keeps_and_major_drops_tombstones(spark):
    runs = spark.createDataFrame([(0, 0, 1, "key1", "val1"), (1, 1, 2, "key1", "")], RUNS)
    assert compaction.compact(runs, False).first().op == 2
    assert compaction.compact(runs, True).isEmpty()


def test_log_prefix_and_replay(spark):
    rows = [(1, 0, 1, "key1", "a", False), (1, 1, 1, "key2", "b", False), (2, 2, 1, "key3", "c", False), (2, 3, 2, "key1", "", False), (3, 4, 1, "key4", "d", True), (3, 5, 1, "key5", "e", False), (4, 6, 9, "key2", "?", False)]
    wal = spark.createDataFrame(rows, "file_no long, seq long, op int, key string, value string, bad boolean")
    assert {r.key for r in log.replay(wal).filter("op = 1").collect()} == {"key2", "key3"}
    report = {r.file_no: (r.records, r.valid_records, r.truncated) for r in log.prefix_report(wal).collect()}
    assert report[3] == (2, 0, True) and report[1] == (2, 2, False)


def test_file_numbers(spark):
    names = ["wal-7.log", "compacted.sst", "a1b22", "99999999999999999999999"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(log.file_number(F.col("name"))).collect()] == [7, 0, 122, 0]


def test_sparse_index_and_floor(spark):
    runs = spark.createDataFrame([(0, i, 1, f"key-{i:03d}", "v") for i in range(300)], RUNS)
    index = layout.sparse_index(runs)
    assert sorted(r.key for r in index.collect()) == ["key-000", "key-128", "key-256"]
    probes = spark.createDataFrame([("key-299",), ("a",)], "key string")
    found = {r.key: r.offset for r in layout.floor_lookup(index, probes).collect()}
    assert found == {"key-299": 41 + 256 * 21, "a": -1}
    index = spark.createDataFrame([(0, "k1", 100), (0, "k5", 200), (0, "k9", 300)], "run_id long, key string, offset long")
    probes = spark.createDataFrame([(k,) for k in "k0 k1 k2 k5 k6 k9 kz".split()], "key string")
    found = {r.key: r.offset for r in layout.floor_lookup(index, probes).collect()}
    assert [found[k] for k in "k0 k1 k2 k5 k6 k9 kz".split()] == [-1, 100, 100, 200, 200, 300, 300]


def test_murmur_known_values():
    assert murmur128(b"") == (0, 0)
    assert murmur128(b"hello") == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    assert murmur128(b"The quick brown fox jumps over the lazy dog") == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)


def murmur_by_definition(data):
    """The published algorithm with whole numbers, a byte string at a time."""
    m, c1, c2 = (1 << 64) - 1, 0x87C37B91114253D5, 0x4CF5AD432745937F
    turn = lambda x, n: (x << n | x >> 64 - n) & m
    k1 = lambda x: turn(x * c1 & m, 31) * c2 & m
    k2 = lambda x: turn(x * c2 & m, 33) * c1 & m
    part = lambda i: int.from_bytes(data[i : i + 8], "little")
    a = b = 0
    end = len(data) - len(data) % 16
    for i in range(0, end, 16):
        a = ((turn(a ^ k1(part(i)), 27) + b) * 5 + 0x52DCE729) & m
        b = ((turn(b ^ k2(part(i + 8)), 31) + a) * 5 + 0x38495AB5) & m
    a, b = a ^ k1(part(end)) ^ len(data), b ^ k2(part(end + 8)) ^ len(data)
    a = a + b & m
    b = a + b & m
    mix = lambda x: ((y := ((x ^ x >> 33) * 0xFF51AFD7ED558CCD & m)) ^ y >> 33) * 0xC4CEB9FE1A85EC53 & m
    a, b = mix(a), mix(b)
    a, b = a ^ a >> 33, b ^ b >> 33
    a = a + b & m
    return a, a + b & m


@given(st.lists(st.binary(max_size=70), max_size=20))
@settings(max_examples=200, deadline=None)
def test_murmur_of_many_keys(keys):
    a, b = murmur128_many(keys)
    assert list(zip(a.tolist(), b.tolist())) == [murmur_by_definition(k) for k in keys]
    for bits, hashes in ((977, 7), (1 << 40, 3)):
        want = [[((x + i * y) & (1 << 63) - 1) % bits for i in range(hashes)] for x, y in map(murmur_by_definition, keys)]
        assert membership.positions(keys, bits, hashes).tolist() == want


def test_bloom_pieces_hold_the_filter(spark):
    bits, hashes = membership.sizing(3000, 0.01)
    keys = spark.range(3000).selectExpr("concat('key-', id) as key")
    bloom = membership.build(keys.unionByName(keys).unionByName(spark.sql("select cast(null as string) key")), bits, hashes)
    words = sorted(map(tuple, bloom.collect()))
    want = {int(p) for k in range(3000) for p in membership.positions([b"key-%d" % k], bits, hashes)[0]}
    assert {64 * w + i for w, m in words for i in range(64) if m >> i & 1} == want
    pieces = membership.segments(bloom, bits, 512)
    assert {len(r.bitmap) for r in pieces.collect()} == {512}
    assert sorted(map(tuple, membership.wrap(pieces, 512).collect())) == words


def test_bloom(spark):
    bits, hashes = membership.sizing(2000, 0.01)
    keys = spark.range(2000).selectExpr("concat('key-', id) as key")
    bloom = membership.build(keys, bits, hashes)
    assert membership.might_contain(keys, bloom, bits, hashes).filter("not might_contain").isEmpty()
    others = spark.range(5000).selectExpr("concat('check-', id) as key")
    assert membership.might_contain(others, bloom, bits, hashes).filter("might_contain").count() < 100
    empty = membership.build(keys.limit(0), 0, 1)
    assert membership.might_contain(keys.limit(3), empty, 0, 1).filter("might_contain").isEmpty()


def test_lru_evicts_one_block():
    lru = simulate.LruCache(2000)
    lru.put(0, 800), lru.put(800, 800)
    assert lru.get(0) and lru.get(800)
    lru.put(1600, 800)
    assert not lru.get(0) and lru.get(800) and lru.get(1600)
    lru.evict(800), lru.evict(7)
    assert not lru.get(800) and lru.size == 928
    lru.clear()
    assert lru.size == 0 and not lru.get(1600)


def test_budget():
    b = simulate.Budget(100)
    b.register("m")
    b.allocate("m", 60)
    with pytest.raises(StoreError, match="BUDGET_EXCEEDED"):
        b.allocate("m", 50)
    assert b.used == 60
    b.allocate("unknown", 0)
    with pytest.raises(StoreError):
        b.allocate("unknown", 1)


def test_backpressure(spark):
    lags = spark.createDataFrame([("a", 0, 50), ("a", 1, 150), ("a", 2, None)], "shard string, seq long, lag_ms long")
    assert [r.can_write for r in simulate.backpressure(lags, 100).orderBy("seq").collect()] == [True, False, True]


def test_flush_counts_an_overwrite_once(spark):
    rows = spark.createDataFrame([(0, i, 1, "k", "v" * 36) for i in range(50)], RUNS)
    assert simulate.flush_segments(rows, 200).first().flushes == 0
    rows = spark.createDataFrame([(0, i, 1, f"k{i:02d}", "v" * 33) for i in range(10)], RUNS)
    assert tuple(simulate.flush_segments(rows, 200).first()) == (0, 5, 9, 0)


@pytest.mark.parametrize("values, want", [(range(1, 101), (50, 90, 99, 100)), (range(11, 21), (15, 19, 20, 20)), ([], None)])
def test_percentiles(spark, values, want):
    df = spark.createDataFrame([("r", v) for v in values], "kind string, latency_ms long")
    got = metrics.percentiles(df).first()
    assert got is None if want is None else (got.p50, got.p90, got.p99, got.p100) == want


def test_sampling_and_ring(spark):
    ops = spark.range(1, 201).select(F.col("id").alias("seq"), F.lit("read").alias("kind"), F.col("id").alias("latency_ms"), F.lit(True).alias("enabled"))
    assert sorted(r.latency_ms for r in metrics.sampled(ops).collect()) == [100, 200]
    assert metrics.percentiles(metrics.last_samples(ops, 10)).first().p50 == 195
    row = metrics.snapshot(ops, 500, 1 << 20).first()
    assert (row.read_latency_p50_ms, row.read_latency_p999_ms, row.read_throughput_ops_per_sec, row.cache_hit_ratio) == (100, 200, 200, 0.0)


def test_metric_texts(spark):
    names = [f[0] for f in metrics.FIELDS]
    row = spark.createDataFrame([(100, 50, 1, 5, 10, 2, 8, 15, 0.95, 200, 1024, 2048, 4096, 1, 0)], ", ".join(f"{n} {'double' if n == 'cache_hit_ratio' else 'long'}" for n in names))
    text = metrics.format_text(row).first().text
    assert "Throughput: Read: 100 ops/sec" in text and "Cache Hit Ratio: 95.00%" in text and "Memory: Heap: 1.00 KB, Off-Heap: 2.00 KB" in text
    lines = [r.line for r in metrics.exposition(row).orderBy("position").collect()]
    for want in ("kvstore_read_throughput_ops_per_sec 100", "# TYPE kvstore_cache_hit_ratio gauge", "kvstore_cache_hit_ratio 0.95", "kvstore_checksum_errors_total 1"):
        assert want in lines


def test_texts(spark):
    df = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 20,), (3 << 40,)], "n long")
    assert [r[0] for r in df.select(format_bytes(F.col("n"))).collect()] == ["0 B", "1023 B", "1.50 KB", "5.00 MB", "3.00 TB"]
    df = spark.createDataFrame([(bytearray(b"a\x01"),), (bytearray(b"\xff\x01"),)], "key binary")
    assert [r[0] for r in df.select(display("key")).collect()] == ["a\x01", "0xff01"]


def test_config():
    assert StoreConfig().memtable_max == 64 << 20
    for bad in ({"max_memory": 100, "memtable_max": 60, "block_cache_max": 50}, {"wal_batch": 0}):
        with pytest.raises(StoreError, match="INVALID_CONFIGURATION"):
            StoreConfig(**bad)


def test_tracker_releases_and_backpressure_waits():
    b = simulate.Budget(100)
    with simulate.Tracker(b, "cache") as t:
        t.allocate(70)
        assert (t.used, b.used) == (70, 70)
    assert b.used == 0
    p = simulate.Backpressure(100)
    p.signal(50)
    p.wait(0)
    p.signal(150)
    with pytest.raises(StoreError, match="WRITE_BACKPRESSURE"):
        p.wait(0.03)
    p.complete()
    assert p.can_write() and p.lag_ms == 0
