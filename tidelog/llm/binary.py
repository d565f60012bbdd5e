"""Token ids in flat binary files with 64-bit document offsets, memory-mapped for reading.

A dataset is a folder of parts.  Part k holds the documents of one range of doc_id in ascending order:

* part-k.ids   the ids of its documents one after another, unsigned little-endian integers of `width` bytes;
* part-k.idx   for each document its doc_id, and the position in the part at which it ends, as int64 pairs.

A part is written beside its final name and renamed, so a task that is run again writes the same part.  The global
base of each part is the prefix sum of the id counts of those before it, so every document has a global start
without any pass over the ids.  Null texts count as empty; a null doc_id sorts first; repeated rows keep their copies,
ordered by text; an empty table gives no parts and reads back as no rows.
"""

from __future__ import annotations

import os
import unicodedata
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common

#: Distinct words whose ids a worker remembers before it starts anew.
REMEMBERED = 1 << 20
#: Bytes of text that one part is made from, about.
PART_BYTES = 32 << 20
_NONE = np.iinfo(np.int64).min
_tokenizers: dict[str, "WordTokenizer"] = {}
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
#: Characters from here on are left to the library.
_TOP = 0x3000


def _class_of(point: int) -> int:
    c = chr(point)
    kind = unicodedata.category(c)
    if point in (0x85, 0xA0) or kind[0] == "Z" or 9 <= point <= 13:
        return _SPACE
    # what joins with its neighbours or grows in lower case would change where words begin
    if kind[0] == "M" or kind in ("Cn", "Cs") or point == 0x130 or 0x1100 <= point < 0x1200 or unicodedata.normalize("NFC", c) != c:
        return _ODD
    return {"L": _LETTER, "N": _DIGIT}.get(kind[0], _OTHER)


def tokenizer(path: str) -> "WordTokenizer":
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class WordTokenizer:
    """Encodes with the tokenizers library, which sees each distinct word once while it is remembered.

    Only for tokenizers whose ids of a word do not depend on its neighbours and that split as word_bpe_49k does: at white
    space, which is dropped, into contractions, runs of letters, single digits and runs of other characters.  Words are
    found, hashed and looked up a block at a time.  Texts with characters that may join their neighbours, from rarer
    scripts, or with what may be a special token go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.classes = np.array([_class_of(i) for i in range(_TOP)], np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.begin, self.length = np.zeros(REMEMBERED, np.int64), np.zeros(REMEMBERED, np.int64)
        self.ids, self.used = np.zeros(4 * REMEMBERED, "<u4"), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")

    def _classes(self, low: np.ndarray) -> np.ndarray:
        """The class of every byte; all bytes of a character have that of the character."""
        out = self.classes[np.minimum(low, 127)]
        lead = np.flatnonzero(low >= 0xC0)
        if len(lead):
            b = [low[np.minimum(lead + i, len(low) - 1)].astype(np.int64) for i in range(3)]
            two, three = (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
            point = np.where(b[0] < 0xE0, two, three)
            kind = np.where((b[0] >= 0xF0) | (point >= _TOP), _ODD, self.classes[np.minimum(point, _TOP - 1)]).astype(np.uint8)
            out[lead] = kind
            out[lead + 1] = kind
            long = b[0] >= 0xE0
            out[lead[long] + 2] = kind[long]
            longer = b[0] >= 0xF0
            out[lead[longer] + 3] = kind[longer]
        return out

    def _words(self, low: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words of all rows."""
        n = len(low)
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        start = edge[:-1].copy()
        start[1:] |= kind[1:] != kind[:-1]
        start |= (kind == _DIGIT) & ((low & 0xC0) != 0x80)
        same = lambda i: (i < n) & (kind[np.minimum(i, n - 1)] == _LETTER) & ~edge[np.minimum(i, n)]
        p = np.flatnonzero((low == 39) & start)  # an apostrophe before a letter may begin a contraction
        p = p[same(p + 1)]
        if len(p):
            a = low[p + 1]
            b = np.where(same(p + 2), low[np.minimum(p + 2, n - 1)], 0)
            one = np.isin(a, list(b"stmd"))
            two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
            p, size = p[one | two], np.where(one, 1, 2)[one | two]
            start[p + 1] = False
            rest = p + 1 + size
            rest = rest[same(rest)]
            start[rest] = True
        inside = kind != _SPACE
        start &= inside
        stop = np.ones(n, bool)
        stop[:-1] = start[1:] | ~inside[1:] | edge[1:-1]
        return np.flatnonzero(start), np.flatnonzero(stop & inside) + 1

    def _slots(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each word's ids among the remembered ones."""
        word, first, back = np.unique(common.Spans(low).hash(start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(word) > REMEMBERED:
            self._forget()
            if len(word) > REMEMBERED:  # one very long text
                self.begin, self.length = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        slots = np.fromiter(map(self.known.get, word.tolist(), [-1] * len(word)), np.int64, len(word))
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw = low.tobytes()
            made = self.own.encode_batch_fast([raw[a:b].decode() for a, b in zip(start[first[new]].tolist(), end[first[new]].tolist())], add_special_tokens=False)
            lists = [e.ids for e in made]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            at, total = len(self.known), int(size.sum())
            if self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(total, len(self.ids)), "<u4")])
            self.ids[self.used : self.used + total] = [i for x in lists for i in x]
            slots[new] = np.arange(at, at + len(new))
            self.begin[at : at + len(new)] = self.used + np.cumsum(size) - size
            self.length[at : at + len(new)] = size
            self.used += total
            self.known.update(zip(word[new].tolist(), range(at, at + len(new))))
        return slots[back]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a block one after another, and the bounds of each row in them."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(rows + 1, np.int64)
        low = common.LOWER[data]
        kind = self._classes(low)
        odd = kind == _ODD
        odd[:-1] |= (low[:-1] == 60) & (low[1:] == 124)  # <|
        apart = common.row_sums(odd.astype(np.int64), offsets) > 0
        if apart.any():
            kind[np.repeat(apart, np.diff(offsets))] = _SPACE
        start, end = self._words(low, kind, offsets)
        slots = self._slots(low, start, end) if len(start) else np.zeros(0, np.int64)
        length = self.length[slots]
        upto = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.arange(upto[-1]) + np.repeat(self.begin[slots] - upto[:-1], length)]
        bounds = upto[np.searchsorted(start, offsets)]
        if apart.any():
            lists = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            for i in np.flatnonzero(apart).tolist():
                lists[i] = self.whole(data[offsets[i] : offsets[i + 1]].tobytes().decode())
            flat, bounds = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
        return flat, bounds


def _open(uri: str):
    """The file system of a folder and the folder's path in it; plain paths are local."""
    return pa.fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{os.path.abspath(uri)}")


def write(docs: DataFrame, path: str, out: str, end_id: int = 2, width: int = 2, parts: int | None = None) -> DataFrame:
    """Encodes (doc_id, text), appends end_id to each document and writes the parts to the folder `out`.

    Returns the manifest (part, n_docs, n_ids, base), one row a part, base being the ids in earlier parts.
    """
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.texts(docs)
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-size // PART_BYTES))
    kind = np.dtype(f"<u{width}")

    def run(batches):
        own, fs, folder = tokenizer(path), *_open(out)
        fs.create_dir(folder, recursive=True)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"{folder}/part-{part:06d}"
        trial = f"{folder}/_{uuid.uuid4().hex}"
        n_docs = n_ids = 0
        index = []
        with fs.open_output_stream(f"{trial}.ids") as f:
            for batch in batches:
                for b in common.pieces(batch):
                    flat, bounds = own.encode(*common.bytes_of(b.column(1)))
                    ids = np.insert(flat, bounds[1:], end_id)
                    if ids.max() >= 1 << 8 * width:
                        raise ValueError(f"an id needs more than {width} bytes")
                    ends = n_ids + bounds[1:] + np.arange(1, len(bounds))
                    index.append(np.stack([np.array(b.column(0).fill_null(_NONE)), ends], 1).astype("<i8"))
                    f.write(ids.astype(kind).tobytes())
                    n_docs, n_ids = n_docs + b.num_rows, int(ends[-1])
        if n_docs:
            with fs.open_output_stream(f"{trial}.idx") as f:
                f.write(np.concatenate(index).tobytes())
            for x in ("ids", "idx"):
                fs.move(f"{trial}.{x}", f"{name}.{x}")
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n_docs]), pa.array([n_ids])], names=["part", "n_docs", "n_ids"])
        else:
            fs.delete_file(f"{trial}.ids")

    # equal doc_ids fall into one range, and the text settles their order
    ordered = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    found = sorted(ordered.mapInArrow(run, "part int, n_docs long, n_ids long").collect())  # one small row a part
    base = list(accumulate((r.n_ids for r in found), initial=0))
    return spark.createDataFrame([(*r, b) for r, b in zip(found, base)], "part int, n_docs long, n_ids long, base long")


def _mapped(fs, path: str):
    return pa.memory_map(path) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(path)


def read(spark: SparkSession, manifest: DataFrame, out: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary little-endian uint32), one row a document, from the files of `out`."""
    return _read(spark, manifest, out, width, "ids binary", lambda raw: pa.array([x.tobytes() for x in raw], pa.binary()))


def read_crc(spark: SparkSession, manifest: DataFrame, out: str, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), one row a document, from the files of `out`."""
    return _read(spark, manifest, out, width, "ids_crc32 long", lambda raw: pa.array([zlib.crc32(x.tobytes()) for x in raw], pa.int64()))


def _read(spark, manifest, out, width, column, make):
    common.ship(spark)
    kind, block = np.dtype(f"<u{width}"), 4096

    def run(batches):
        fs, folder = _open(out)
        for b in batches:
            for part, n_docs, base in zip(*(b.column(i).to_pylist() for i in range(3))):
                with _mapped(fs, f"{folder}/part-{part:06d}.idx") as f, _mapped(fs, f"{folder}/part-{part:06d}.ids") as g:
                    before = 0
                    for k in range(0, n_docs, block):
                        f.seek(k * 16)
                        index = np.frombuffer(f.read(16 * min(block, n_docs - k)), "<i8").reshape(-1, 2)
                        starts = np.concatenate([[before], index[:-1, 1]])
                        raw = []
                        for s, e in zip(starts, index[:, 1]):
                            g.seek(int(s) * width)
                            raw.append(np.frombuffer(g.read(int(e - s) * width), kind).astype("<u4"))
                        before = int(index[-1, 1])
                        ids = pa.array(index[:, 0], mask=index[:, 0] == _NONE)
                        yield pa.RecordBatch.from_arrays([ids, pa.array(base + starts), pa.array(index[:, 1] - starts), make(raw)], names=["doc_id", "start", "n_tokens", column.split()[0]])

    parts = manifest.select("part", "n_docs", "base")
    return parts.repartition(max(1, min(parts.count(), 10_000)), "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, {column}")
