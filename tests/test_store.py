"""The store over files: restarts, deletes, compaction, streams, binary formats."""

import io
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidelog import inspect
from tidelog.config import StoreConfig
from tidelog.engine import Store
from tidelog.errors import StoreError
from tidelog.model import CHANGELOG, DELETE, PUT
from tidelog.operators import membership
from tidelog.operators.runs import RunStore
from tidelog.scheduler import Compactor
from tidelog.sources.binary import PushedSstSource, RunFile, SstSource, WalSource, decode_index, decode_log, decode_run, encode_log_record, encode_run, verify_run
from tidelog.streaming.ingest import ingest, latest_by_key


def test_restart_keeps_everything(spark, tmp_path):
    with Store(spark, str(tmp_path)) as s:
        s.write([(PUT, b"a", b"1"), (PUT, b"b", b"2")])
    for _ in range(2):  # a second restart loses nothing
        with Store(spark, str(tmp_path)) as s:
            assert s.get(b"a") == b"1"
    with pytest.raises(StoreError, match="ENGINE_CLOSED"):
        s.get(b"a")


def test_delete_hides_flushed_value(spark, tmp_path):
    with Store(spark, str(tmp_path)) as s:
        s.put(b"k", b"old")
        s.flush()
        s.delete(b"k")
        assert s.get(b"k") is None
        s.flush()
        assert s.get(b"k") is None and s.get(b"none") is None


def test_compaction_and_vacuum(spark, tmp_path):
    with Store(spark, str(tmp_path), StoreConfig(compaction_threshold=3)) as s:
        for i in range(3):
            s.write([(PUT, b"same", b"%d" % i), (PUT, b"k%d" % i, b"v")])
            s.flush()
        assert len(s.runs.entries()) == 1
        assert s.get(b"same") == b"2"
        assert [bytes(r.key) for r in s.scan(b"k1", b"k9").orderBy("key").collect()] == [b"k1", b"k2"]
        assert s.runs.vacuum() == 3
    with Store(spark, str(tmp_path)) as s:
        assert s.get(b"same") == b"2" and s.get(b"k0") == b"v"


def test_minor_compaction_keeps_tombstones(spark, tmp_path):
    with Store(spark, str(tmp_path), StoreConfig(compaction_threshold=99)) as s:
        for op, v in ((PUT, b"1"), (DELETE, b""), (PUT, b"x")):
            s.write([(op, b"k" if v != b"x" else b"other", v)])
            s.flush()
        paths = [e[0] for e in s.runs.entries()]
        s.runs.compact(paths[1:])
        assert len(s.runs.entries()) == 2 and s.get(b"k") is None


def test_two_writers_do_not_both_publish(spark, tmp_path):
    a = RunStore(spark, str(tmp_path))
    at = a.version()
    a.commit([], at)
    with pytest.raises(StoreError, match="IO_ERROR"):
        a.commit([], at)


def test_streaming_ingest_and_state(spark, tmp_path):
    rows = [(i, DELETE if i % 7 == 0 else PUT, bytearray(b"k%d" % (i % 5)), bytearray(b"" if i % 7 == 0 else b"v%d" % i)) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[part * 20 : part * 20 + 20], CHANGELOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {}
    for _, op, k, v in rows:
        want.pop(bytes(k), None) if op == DELETE else want.__setitem__(bytes(k), bytes(v))
    with Store(spark, str(tmp_path / "store")) as s:
        ingest(spark.readStream.schema(CHANGELOG).parquet(str(tmp_path / "in")), s, str(tmp_path / "cp"), 1).awaitTermination()
        assert {bytes(r.key): bytes(r.value) for r in s.scan().collect()} == want
    q = latest_by_key(spark.readStream.schema(CHANGELOG).parquet(str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("newest").start()
    q.processAllAvailable()
    q.stop()
    top = spark.table("newest").groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("n")).filter("n.op = 1")
    assert {bytes(r.key): bytes(r.n.value) for r in top.collect()} == want


def test_log_format_stops_at_damage():
    records = [encode_log_record(PUT, b"k1", b"v1"), encode_log_record(DELETE, b"k2", b""), encode_log_record(PUT, b"k3", b"v3-much-longer-value")]
    data = b"".join(records)
    assert [(op, k, v) for _, op, k, v, _ in decode_log(data)] == [(1, b"k1", b"v1"), (2, b"k2", b""), (1, b"k3", b"v3-much-longer-value")]
    assert len(list(decode_log(data[: len(records[0]) + 5]))) == 1
    broken = bytearray(data)
    broken[12] ^= 0xFF
    assert list(decode_log(bytes(broken))) == []
    assert len(list(decode_log(data + bytes(64)))) == 3


def test_run_format(tmp_path, capsys):
    data = encode_run([(b"key-%03d" % i, b"" if i == 5 else b"v") for i in range(300)])
    assert [k for k, _ in decode_index(data)] == [b"key-000", b"key-128", b"key-256"]
    assert len(list(decode_run(data))) == 300 and list(decode_run(data))[5][1] == DELETE
    for at in (41, 53):
        broken = bytearray(data)
        broken[at] ^= 0xFF
        with pytest.raises(StoreError, match="CHECKSUM_MISMATCH"):
            list(decode_run(bytes(broken)))
    head = bytearray(data)
    head[3] ^= 0xFF
    with pytest.raises(StoreError, match="CORRUPT_SSTABLE_HEADER"):
        list(decode_run(bytes(head)))
    with pytest.raises(StoreError, match="CHECKSUM_MISMATCH"):
        list(decode_run(data[:60]))
    tail = bytearray(data)
    tail[-1] ^= 0xFF
    with pytest.raises(StoreError, match="CHECKSUM_MISMATCH"):
        verify_run(bytes(tail))
    path = tmp_path / "x.sst"
    path.write_bytes(encode_run([(b"key%d" % i, b"value%d" % i if i < 3 else b"") for i in range(1, 4)]))
    assert inspect.main([str(path), "--verify", "--list"]) == 0
    out = capsys.readouterr().out
    assert "Integrity Check: PASSED\nRecords scanned: 3" in out and "key1 => value1" in out and "key3 => [TOMBSTONE]" in out
    inspect.main([str(path), "--list", "--start-key", "key2"])
    out = capsys.readouterr().out
    assert "key1 =>" not in out and "Total records listed: 2" in out
    assert inspect.main([str(tmp_path / "none")]) == 1


def test_data_sources(spark, tmp_path):
    spark.dataSource.register(WalSource)
    spark.dataSource.register(SstSource)
    rows = spark.createDataFrame([(PUT, bytearray(b"a"), bytearray(b"1")), (DELETE, bytearray(b"b"), bytearray(b""))], "op int, key binary, value binary")
    for kind in ("wal", "sst"):
        rows.coalesce(1).sortWithinPartitions("key").write.format(kind).mode("append").save(str(tmp_path / kind))
        back = spark.read.format(kind).load(str(tmp_path / kind))
        assert sorted((bytes(r.key), r.op) for r in back.collect()) == [(b"a", PUT), (b"b", DELETE)]


def test_sinks_append_and_overwrite(spark, tmp_path):
    spark.dataSource.register(WalSource)
    spark.dataSource.register(SstSource)
    row = lambda i: spark.createDataFrame([(PUT, bytearray(b"k%d" % i), bytearray(b"v"))], "op int, key binary, value binary").coalesce(1)
    for kind in ("wal", "sst"):
        path = str(tmp_path / kind)
        for i in range(3):
            row(i).write.format(kind).mode("append").save(f"file://{path}" if i else path)
        assert sorted(bytes(r.key) for r in spark.read.format(kind).load(path).collect()) == [b"k0", b"k1", b"k2"]
        assert spark.read.format(kind).load(f"{path}/*1.{kind}").count() == 1
        row(9).write.format(kind).mode("overwrite").save(path)
        assert [bytes(r.key) for r in spark.read.format(kind).load(path).collect()] == [b"k9"]


def test_point_reads_touch_one_block(spark, tmp_path):
    rows = [(b"key-%03d" % i, b"" if i == 200 else b"v%d" % i) for i in range(300)]
    read = []

    class Watched(io.BytesIO):
        def size(self):
            return len(self.getvalue())

        def read(self, n=-1):
            read.append(n)
            return super().read(n)

    data = encode_run(rows)
    run = RunFile(Watched(data))
    read.clear()
    assert run.get(b"key-130") == ("FOUND", b"v130") and len(read) == 1 and read[0] < len(data) / 2
    assert run.get(b"key-200") == ("DELETED", None) and run.get(b"key-1305") == run.get(b"a") == run.get(b"z") == ("NOT_FOUND", None)
    assert [k for _, _, k, _ in run.scan(b"key-127", b"key-129")] == [b"key-127", b"key-128", b"key-129"]
    bits, hashes = membership.sizing(300, 0.01)
    held = {int(p) for p in membership.positions([k for k, _ in rows], bits, hashes).ravel()}
    run = RunFile(Watched(data), lambda k: held.issuperset(membership.positions([k], bits, hashes)[0].tolist()), 2)
    read.clear()
    assert all(run.get(k) == (("FOUND", v) if v else ("DELETED", None)) for k, v in rows) and len(read) == 3  # one read a block
    assert sum(run.get(b"key-%03dx" % i)[0] != "NOT_FOUND" for i in range(300)) == 0
    read.clear()
    assert run.get(b"key-299") == ("FOUND", b"v299") and run.get(b"key-130") == ("FOUND", b"v130") and len(run.blocks) == 2
    denied = RunFile(Watched(data), lambda k: False)
    read.clear()
    assert denied.get(b"key-130") == ("NOT_FOUND", None) and not read
    (tmp_path / "1.sst").write_bytes(data)
    spark.dataSource.register(PushedSstSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = spark.read.format("sst_pushed").load(str(tmp_path)).filter(F.col("key") == F.lit(bytearray(b"key-130")))
        assert [bytes(r.value) for r in found.collect()] == [b"v130"]
        part = spark.read.format("sst_pushed").load(str(tmp_path)).filter((F.col("key") > F.lit(bytearray(b"key-126"))) & (F.col("key") <= F.lit(bytearray(b"key-129"))))
        assert part.count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_tagged_batch_counts_once(spark, tmp_path):
    batch = spark.createDataFrame([(0, PUT, bytearray(b"k"), bytearray(b"old"))], CHANGELOG)
    with Store(spark, str(tmp_path), StoreConfig(memtable_max=150)) as s:
        s.append(batch, "b.0")
        s.put(b"k", b"new")  # 68 bytes each: no flush yet
        assert not s.runs.entries()
        s.append(batch, "b.0")
        assert s.get(b"k") == b"new"
        s.put(b"l", b"x" * 20)
        assert len(s.runs.entries()) == 1 and s._batches() == []
        s.append(batch, "b.0")
        assert s.get(b"k") == b"new"


def test_recovery_flushes_a_long_log(spark, tmp_path):
    with Store(spark, str(tmp_path)) as s:
        s.write([(PUT, b"k%d" % i, b"x" * 100) for i in range(3)])
        assert s.log_bytes() == 3 * (64 + 2 + 100) and not s.runs.entries()
    with Store(spark, str(tmp_path), StoreConfig(memtable_max=300)) as s:
        assert s.log_bytes() == 0 and len(s.runs.entries()) == 1 and s.get(b"k2") == b"x" * 100


def test_a_run_flushed_during_a_merge_stays(spark, tmp_path):
    with Store(spark, str(tmp_path), StoreConfig(compaction_threshold=99)) as s:
        for ops in ([(PUT, b"a", b"1"), (PUT, b"b", b"1")], [(DELETE, b"a", b"")]):
            s.write(ops)
            s.flush()
        write = s.runs.write

        def late(rows, files=None):
            entry = write(rows, files)
            s.runs.write = write
            s.put(b"b", b"2")
            s.flush()
            return entry

        s.runs.write = late
        old = [e[0] for e in s.runs.entries()]
        assert s.compact() and len(s.runs.entries()) == 2
        assert s.get(b"a") is None and s.get(b"b") == b"2"
        with pytest.raises(StoreError, match="replaced the same runs"):
            s.runs.publish([(old[0],)], [])


def test_background_compaction(spark, tmp_path):
    seen, errors, ended = [], [], threading.Event()
    with Store(spark, str(tmp_path), StoreConfig(compaction_threshold=3, backpressure_lag_ms=60_000)) as s:
        with Compactor(s, 0.05, 0.05, lambda n: (seen.append(n), ended.set()), errors.append) as c:
            for i in range(2):
                s.put(b"k%d" % i, b"v")
                s.flush()
            time.sleep(0.3)
            assert not seen and s.backpressure.lag_ms == 0
            s.put(b"k0", b"new")
            s.flush()
            assert ended.wait(60)
        assert not errors and seen[0] == 3 and len(s.runs.entries()) == 1 and not c._thread.is_alive()
        assert s.get(b"k0") == b"new" and s.backpressure.lag_ms == 0
        with pytest.raises(StoreError, match="INVALID_CONFIGURATION"):
            c.start()
        failing = Compactor(s, failed=errors.append)
        s.compact = lambda since=None: 1 / 0
        s.runs.entries = lambda: [()] * 3
        assert not failing.check() and isinstance(errors[0], ZeroDivisionError)
        time.sleep(0.01)
        assert not failing.check() and s.backpressure.lag_ms >= 10  # still due since the first look
        failing._single.acquire()
        assert not failing.check() and len(errors) == 2
