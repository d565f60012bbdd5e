"""What the corpus operators share: tables, shared storage, code shipping and byte-level text kernels.

Text kernels work on the UTF-8 bytes of a whole Arrow column at once.  A polynomial prefix hash gives
the hash of any byte span in constant time, so words, affixes and shingles need no Python strings.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.cluster import ship  # noqa: F401  the operators call it as common.ship

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS = {"up": np.ones(1, U64), "down": np.ones(1, U64)}
#: Bytes of text handled at once inside a worker; a longer text is handled alone.
CHUNK = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything but ASCII letters, digits and bytes of multi-byte characters.
PUNCT = np.ones(256, bool)
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


# --- tables and storage -----------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; a folder of its own only where that is unset in local mode."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        at = getattr(sc, "_tidelog_dir", None) or tempfile.mkdtemp(prefix="tidelog-")
        sc._tidelog_dir = at
    return str(at).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidelog/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes the rows to the shared folder and reads them back; drop() deletes them.

    Shuffle files of the write go when it is done, for nothing reads them again.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidelog_path = path
    for paths in _scopes:
        paths.append((spark, path))
    return out


_scopes: list[list] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that materialise() made and that nothing reads any more."""
    for t in tables:
        _delete(t.sparkSession, t._tidelog_path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Deletes on leaving whatever materialise() made inside; what is to stay has to be written by then."""
    made: list = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        for spark, path in made:
            _delete(spark, path)


#: Rows of the bit map that marked() broadcasts, 64 bits in each: about 16 MB at most.
MAP_ROWS = 1 << 19


def marked(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose doc_id is not in the one column of ids, and those whose doc_id is.

    A bit map of the hashed ids, of bounded size, is broadcast.  Rows that it rules out stay where they are; only the
    others are shuffled and joined exactly.  So the texts that move are those with a listed id and the share that the
    map lets through by chance, which is small up to some ten million ids and grows to all rows beyond.
    """
    tag = uuid.uuid4().hex[:8]
    key, word, bits = f"key_{tag}", f"word_{tag}", f"bits_{tag}"
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct()
    ids = materialise(ids, "ids")
    cell = lambda of: F.pmod(F.xxhash64(of.cast("long")), F.lit(64 * MAP_ROWS))
    bit = lambda of: F.call_function("shiftleft", F.lit(1).cast("long"), cell(of).bitwiseAND(63).cast("int"))
    held = ids.select(F.shiftright(cell(F.col(key)), 6).alias(word), bit(F.col(key)).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    own = docs["doc_id"]
    near = docs.join(F.broadcast(held), F.shiftright(cell(own), 6) == F.col(word), "left")  # MAP_ROWS rows at most
    maybe = own.isNotNull() & (F.coalesce(F.col(bits), F.lit(0)).bitwiseAND(bit(own)) != 0)
    names = [docs[f"`{c}`"] for c in docs.columns]
    sure, rest = near.filter(~maybe).select(names), near.filter(maybe).select(names)
    known = ids.hint("merge")
    on = rest["doc_id"].cast("long") == known[key]
    return sure.unionByName(rest.join(known, on, "left_anti")), rest.join(known, on, "left_semi")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) only, whatever else the table carries."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def remainder(mod: int):
    """crc32 of doc_id as text, modulo mod; a null doc_id counts as an empty text."""
    return F.expr(f"pmod(crc32(cast(coalesce(cast(doc_id as string), '') as binary)), {mod})")


# --- memory of a worker -------------------------------------------------------------------------------------

_caches: list[dict] = []
_last = ""


def cache() -> dict:
    """A memory that lasts in a worker until a task of another operator begins there."""
    _caches.append({})
    return _caches[-1]


def give_back() -> None:
    """Returns freed memory to the system, which the allocators would keep for a worker that may never need it again."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError, TypeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def begin(operator: str) -> None:
    """A task of the operator begins: what others remember goes, for workers outlive the stages that used them."""
    global _last
    if operator != _last:
        _last = operator
        for x in _caches:
            x.clear()
        gc.collect()
        give_back()


def tidy(operator: str, run: Callable) -> Callable:
    """The same function for mapInArrow, which holds only its own operator's memory while it runs and only caches after it."""

    def tidied(batches):
        begin(operator)
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


# --- kernels ------------------------------------------------------------------------------------------------


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offset of each row; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    at = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(batch: pa.RecordBatch, at_most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch (doc_id, text) of about at_most bytes of text; each has one row at least."""
    column = batch.column(1)
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64)
    ends = np.cumsum(sizes)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + at_most, side="right")))
        yield batch.slice(i, j - i)
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, CHUNK + 1)
        for key, factor in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(size, factor, U64)
            x[0] = 1
            _POWERS[key] = np.cumprod(x, dtype=U64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Spans:
    """Hashes of byte spans of one block of text."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separators within rows, and for each row its first word's index."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    first, last = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    head[first] = inside[first]
    tail[last] = inside[last]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; 0 for an empty row."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


# --- fixed-size counters over the whole corpus ----------------------------------------------------------------

#: Counters in one row of a partial count table.
CELLS = 1 << 14


def count_rows(counts: np.ndarray, first: int = 0) -> Iterator[tuple[int, bytes]]:
    """(chunk, compressed int64 counters) rows of a count array; chunks without a count are left out."""
    for k in range(0, len(counts), CELLS):
        part = counts[k : k + CELLS]
        if part.any():
            yield first + k // CELLS, zlib.compress(part.astype("<i8").tobytes(), 1)


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(zlib.decompress(raw.as_buffer()), "<i8")
            if k in sums:
                sums[k] += x
            else:
                sums[k] = x.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["chunk", "counts"])


def total_counts(partial: DataFrame, size: int) -> np.ndarray:
    """Adds up count_rows of all tasks; the result has a fixed size, whatever the corpus holds.

    Sums stream through the tasks, each of which holds its chunks once.
    """
    chunks = -(-size // CELLS)
    rows = partial.select("chunk", "counts").repartition(min(chunks, 64), "chunk").mapInArrow(_add_up, "chunk int, counts binary")
    out = np.zeros(chunks * CELLS, np.int64)
    for r in rows.collect():  # at most `chunks` rows of fixed size
        x = np.frombuffer(zlib.decompress(r.counts), "<i8")
        out[r.chunk * CELLS : r.chunk * CELLS + len(x)] += x
    return out[:size]
