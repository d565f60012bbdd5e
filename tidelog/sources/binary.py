"""Python data sources `wal` and `sst` for the binary log and sorted-run formats, and their encoders.

    spark.dataSource.register(WalSource); spark.read.format("wal").load("/logs/*.wal")

A log file yields its valid prefix: reading stops at the first record that is cut off or fails its checksum.  A run file
raises on a bad magic number or checksum.  One file is one partition.  Paths are local ones or URIs of any file system that
pyarrow opens.

`sst_pushed` (PushedSstSource) reads run files like `sst`, but filters on the key are pushed, for which Spark wants
spark.sql.python.filterPushdown.enabled: only the blocks that the sparse index names for the range are read, and reading
stops at the first key beyond it.

Each task writes one file under a number of its own, beyond those that are there; append adds files, overwrite removes the
ones that were there once the new ones are in place.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
import struct
import uuid
import zlib
from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from tidelog.errors import StoreError

# Fixed values of the formats: magic number and version of a run file, layouts of header, record and index fields.
MAGIC, VERSION, INTERVAL = 0x4B565353, 1, 128
HEADER = struct.Struct(">IBqqqqI")
RUN_HEAD, LOG_HEAD = struct.Struct(">Bii"), struct.Struct("=BBii")
PUT, DELETE = 1, 2
RECORD_MAX = 100 << 20


def encode_log_record(op: int, key: bytes, value: bytes) -> bytes:
    if 14 + len(key) + len(value) > RECORD_MAX:
        raise StoreError("IO_ERROR", "a log record is larger than 100 MiB")
    body = LOG_HEAD.pack(VERSION, op, len(key), len(value)) + key + value
    return body + struct.pack("=I", zlib.crc32(body))


def decode_log(data: bytes) -> Iterator[tuple[int, int, bytes, bytes, int]]:
    """(offset, op, key, value, crc) of the valid prefix."""
    at = 0
    while at + LOG_HEAD.size <= len(data):
        version, op, k, v = LOG_HEAD.unpack_from(data, at)
        end = at + LOG_HEAD.size + k + v
        if not version or k < 0 or v < 0 or end + 4 > len(data):
            return
        (crc,) = struct.unpack_from("=I", data, end)
        if crc != zlib.crc32(data[at:end]):
            return
        body = data[at + LOG_HEAD.size : end]
        yield at, op, body[:k], body[k:], crc
        at = end + 4


def encode_run(rows: list[tuple[bytes, bytes]], created_ms: int = 0) -> bytes:
    """A run file of key-sorted (key, value) rows; an empty value is a tombstone."""
    data, index, positions = bytearray(), bytearray(), []
    for i, (key, value) in enumerate(rows):
        if i % INTERVAL == 0:
            positions.append(len(index))
            index += struct.pack(">i", len(key)) + key + struct.pack(">q", HEADER.size + len(data))
        body = RUN_HEAD.pack(PUT if value else DELETE, len(key), len(value)) + key + value
        data += body + struct.pack(">I", zlib.crc32(body))
    tail = bytes(index) + b"".join(struct.pack(">q", p) for p in positions) + struct.pack(">q", len(positions))
    checksum = zlib.crc32(tail, zlib.crc32(bytes(data)))
    return HEADER.pack(MAGIC, VERSION, len(rows), HEADER.size + len(data), HEADER.size, created_ms, checksum) + bytes(data) + tail


def decode_header(data: bytes) -> dict:
    names = ("magic", "version", "key_count", "index_offset", "data_offset", "created_time", "checksum")
    out = dict(zip(names, HEADER.unpack_from(data, 0))) if len(data) >= HEADER.size else {"magic": 0}
    if out["magic"] != MAGIC:
        raise StoreError("CORRUPT_SSTABLE_HEADER", "not a run file")
    return out


def decode_run(data: bytes, start: int | None = None) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(offset, op, key, value) of every record from `start`, tombstones included."""
    head = decode_header(data)
    at = head["data_offset"] if start is None else start
    yield from decode_records(data[at : head["index_offset"]] if len(data) >= head["index_offset"] else data[at:], at)


def verify_run(data: bytes) -> None:
    """Raises unless the header's checksum is that of all bytes after it."""
    if decode_header(data)["checksum"] != zlib.crc32(data[HEADER.size :]):
        raise StoreError("CHECKSUM_MISMATCH", "the file as a whole")


def decode_records(data: bytes, first: int = 0) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(offset, op, key, value) of records that lie one after another from the offset `first` of their file."""
    at = 0
    while at < len(data):
        if at + RUN_HEAD.size > len(data):
            raise StoreError("CHECKSUM_MISMATCH", f"record at {first + at} is cut off")
        op, k, v = RUN_HEAD.unpack_from(data, at)
        end = at + RUN_HEAD.size + k + v
        if k < 0 or v < 0 or end + 4 > len(data) or struct.unpack_from(">I", data, end)[0] != zlib.crc32(data[at:end]):
            raise StoreError("CHECKSUM_MISMATCH", f"record at {first + at}")
        yield first + at, op, data[at + RUN_HEAD.size : at + RUN_HEAD.size + k], data[at + RUN_HEAD.size + k : end]
        at = end + 4


class RunFile:
    """A run file read by position: its header and sparse index once, then only the blocks that are asked for.

    `might_contain(key)`, if given, spares the file for keys that it denies; it must never deny one that is there.  A cache
    keeps the bytes of up to `cached` blocks, the least recently used one goes first.
    """

    def __init__(self, file, might_contain: Callable[[bytes], bool] | None = None, cached: int = 0):
        self.file, self.size, self.might_contain = file, file.size(), might_contain
        self.cached, self.blocks = cached, OrderedDict()
        self.head = decode_header(self._at(0, HEADER.size))
        tail = self._at(self.head["index_offset"], self.size - self.head["index_offset"])
        (n,) = struct.unpack_from(">q", tail, len(tail) - 8)
        self.keys, self.offsets = [], []
        for (p,) in struct.iter_unpack(">q", tail[len(tail) - 8 - 8 * n : len(tail) - 8]):
            (k,) = struct.unpack_from(">i", tail, p)
            self.keys.append(tail[p + 4 : p + 4 + k])
            self.offsets.append(struct.unpack_from(">q", tail, p + 4 + k)[0])

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    def _block(self, start: int, end: int) -> bytes:
        if not self.cached:
            return self._at(start, end - start)
        if start not in self.blocks:
            self.blocks[start] = self._at(start, end - start)
            if len(self.blocks) > self.cached:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(start)
        return self.blocks[start]

    def scan(self, low: bytes | None = None, high: bytes | None = None) -> Iterator[tuple[int, int, bytes, bytes]]:
        """Records with low <= key <= high, block by block from the floor of low; stops at the first key beyond high."""
        first = 0 if low is None else max(0, bisect_right(self.keys, low) - 1)
        ends = [*self.offsets[1:], self.head["index_offset"]]
        for start, end in zip(self.offsets[first:], ends[first:]):
            for record in decode_records(self._block(start, end), start):
                if high is not None and record[2] > high:
                    return
                if low is None or record[2] >= low:
                    yield record

    def get(self, key: bytes) -> tuple[str, bytes | None]:
        """FOUND with the value, DELETED or NOT_FOUND; reads one block at most."""
        if self.might_contain is not None and not self.might_contain(key):
            return "NOT_FOUND", None
        for _, op, _, value in self.scan(key, key):
            return ("DELETED", None) if op == DELETE else ("FOUND", value)
        return "NOT_FOUND", None


def decode_index(data: bytes) -> list[tuple[bytes, int]]:
    """(key, offset) of the sparse index, read through the footer."""
    start = decode_header(data)["index_offset"]
    (n,) = struct.unpack_from(">q", data, len(data) - 8)
    out = []
    for (p,) in struct.iter_unpack(">q", data[len(data) - 8 - 8 * n : len(data) - 8]):
        (k,) = struct.unpack_from(">i", data, start + p)
        key = data[start + p + 4 : start + p + 4 + k]
        out.append((key, struct.unpack_from(">q", data, start + p + 4 + k)[0]))
    return out


class FilePart(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it; a plain path is local."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), os.path.abspath(path)


def _number(path: str) -> int:
    return int("".join(c for c in posixpath.basename(path) if c.isascii() and c.isdigit()) or 0)


def _files(path: str, suffix: str) -> list[str]:
    """Files of a folder, or those that a pattern names in one; as paths in their file system, in order of names."""
    if any(c in path for c in "*?["):
        folder, pattern = path.rsplit("/", 1)
    else:
        folder, pattern = path, f"*{suffix}"
    fs, own = _open(folder)
    info = fs.get_file_info(own)
    if info.type == pyarrow.fs.FileType.File:
        return [own]
    found = fs.get_file_info(pyarrow.fs.FileSelector(own, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, pattern))


class _Reader(DataSourceReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.paths = path, _files(path, suffix)

    def partitions(self):
        return [FilePart(p, _number(p)) for p in self.paths]

    def _input(self, partition):
        return _open(self.path.rsplit("/", 1)[0] if "*" in self.path else self.path)[0].open_input_file(partition.path)


class _WalReader(_Reader):
    def read(self, partition):
        with self._input(partition) as f:
            for at, op, key, value, crc in decode_log(f.read()):
                yield (partition.number, at, op, key, value, crc)


class _SstReader(_Reader):
    low: bytes | None = None
    high: bytes | None = None

    def read(self, partition):
        with self._input(partition) as f:
            for at, op, key, value in RunFile(f).scan(self.low, self.high):
                yield (partition.number, at, op, key, value)


class _PushedSstReader(_SstReader):
    def pushFilters(self, filters):
        """Takes the bounds of the key; Spark applies every filter again, so open bounds may be read closed."""
        for f in filters:
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == ("key",) and f.value is not None:
                value = bytes(f.value)
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = value if self.low is None else max(self.low, value)
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = value if self.high is None else min(self.high, value)
            yield f


class _Written(WriterCommitMessage):
    def __init__(self, trial: str, path: str):
        self.trial, self.path = trial, path


class _Writer(DataSourceWriter):
    """Each task writes one file beside its final name; the driver renames them when all are there."""

    def __init__(self, path: str, suffix: str, encode, overwrite: bool):
        self.path, self.suffix, self.encode = path, suffix, encode
        there = _files(path, suffix)
        self.first = 1 + max(map(_number, there), default=-1)
        self.replaced = there if overwrite else []

    def write(self, iterator):
        from pyspark import TaskContext

        fs, folder = _open(self.path)
        fs.create_dir(folder, recursive=True)
        path = f"{folder}/{self.first + TaskContext.get().partitionId():012d}{self.suffix}"
        trial = f"{folder}/.{uuid.uuid4().hex}.tmp"
        content = self.encode(iterator)
        if content:
            with fs.open_output_stream(trial) as f:
                f.write(content)
        return _Written(trial if content else "", path)

    def commit(self, messages):
        fs, _ = _open(self.path)
        made = [m for m in messages if m and m.trial]
        if any(fs.get_file_info(m.path).type != pyarrow.fs.FileType.NotFound for m in made):
            self.abort(messages)
            raise StoreError("IO_ERROR", "another writer has added files meanwhile")
        for m in made:
            fs.move(m.trial, m.path)
        for path in self.replaced:
            fs.delete_file(path)

    def abort(self, messages):
        fs, _ = _open(self.path)
        for m in messages:
            if m and m.trial and fs.get_file_info(m.trial).type != pyarrow.fs.FileType.NotFound:
                fs.delete_file(m.trial)


def _encode_log(rows) -> bytes:
    return b"".join(encode_log_record(r["op"], bytes(r["key"]), bytes(r["value"])) for r in rows)


def _encode_run(rows) -> bytes:
    pairs = [(bytes(r["key"]), bytes(r["value"]) if r["op"] == PUT else b"") for r in rows]
    return encode_run(pairs) if pairs else b""


class WalSource(DataSource):
    """Log files; writing expects rows (op, key, value) in order within each partition."""

    @classmethod
    def name(cls):
        return "wal"

    def schema(self):
        return "file_no bigint, offset bigint, op int, key binary, value binary, crc32 bigint"

    def reader(self, schema):
        return _WalReader(self.options["path"], ".wal")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], ".wal", _encode_log, overwrite)


class SstSource(DataSource):
    """Run files; writing expects rows (op, key, value) with unique keys sorted within each partition."""

    @classmethod
    def name(cls):
        return "sst"

    def schema(self):
        return "run_id bigint, offset bigint, op int, key binary, value binary"

    def reader(self, schema):
        return _SstReader(self.options["path"], ".sst")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], ".sst", _encode_run, overwrite)


class PushedSstSource(SstSource):
    """Run files, of which only the blocks that filters on the key allow are read."""

    @classmethod
    def name(cls):
        return "sst_pushed"

    def reader(self, schema):
        return _PushedSstReader(self.options["path"], ".sst")
