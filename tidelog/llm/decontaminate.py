"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of words in which numbers, names and units are typed placeholders: a word that begins with a
digit or spells a number is a number, a known unit after a number is a unit, a capitalised word inside a sentence is a name.
A capitalised word that begins a sentence may be a name or not, so the template view has two readings: it is literal in one
and a name in the other.  Windows of `window` words are hashed in both readings and in a literal view of lower-cased words.  Windows of documents
that a bit map of the benchmark's hashes may hold are hash-joined with the benchmark's windows.  The slots of all template
windows of one document and item that lie on one diagonal must then agree in one of the readings: each value of the item stands for one value of
the document, so a question with new numbers and names is found, and a text that merely has the
same shape is not.

An item shorter than a window is one window of its own length, of whatever length, so a text that holds a short item word
for word is found.  A template window needs `least` literal words, for fewer prove nothing.  A null or empty text has
no windows.  Texts are read whole.  Repeated rows count once; a row without doc_id is never found.  Where both readings
agree as well, the one with more slots is given.  Empty tables give no rows.  Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

WINDOW, LEAST = 8, 5
# Words that spell numbers, and units of measure.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres s ms second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees mph kmh".split()
FILTER_BITS = (1 << 16, 1 << 26)
_U = common.U64
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in '.!?:;\n"']] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.array([chr(c).isupper() or chr(c).istitle() for c in range(0x1FFFF)])  # by code point
NUMBER, NAME, UNIT = 1, 2, 3
_SCHEMA = pa.schema([("id", pa.int64()), ("at", pa.int64()), ("n_words", pa.int64()), ("hash", pa.int64()), ("literal", pa.bool_()), ("readings", pa.int64()), ("slots", pa.list_(pa.string()))])
_DDL = "id long, at long, n_words long, hash long, literal boolean, readings long, slots array<string>"


def _known(words: list[str]) -> np.ndarray:
    column = pa.array(words, pa.string())
    data, at = common.bytes_of(column)
    return np.sort(common.Spans(data).hash(at[:-1], at[1:]))


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << 16, bool)
    bits[(known >> _U(48)).astype(np.int64)] = True
    out = bits[(h >> _U(48)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = np.isin(h[at], known)
    return out


def _capital(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the UTF-8 character at each start is a capital."""
    b = [data[np.minimum(start + i, len(data) - 1)].astype(np.int64) for i in range(4)]
    two = (b[0] & 31) << 6 | b[1] & 63
    three = (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63
    four = (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63
    point = np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [b[0], two, three], four)
    return _UPPER[np.minimum(point, len(_UPPER) - 1)]


class Words:
    """The words of a block in all views."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        low = common.LOWER[data]
        self.start, self.end, self.bounds = common.words(low, offsets, common.PUNCT)
        self.literal = common.Spans(low).hash(self.start, self.end)
        n = len(self.start)
        self.kinds = [np.zeros(n, np.int8)] * 2  # by reading
        if not n:
            self.templates = [self.literal] * 2
            return
        first = np.zeros(n, bool)
        first[self.bounds[:-1][self.bounds[:-1] < n]] = True
        ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
        after = np.concatenate([[0], self.end[:-1]])
        begins = first | (ends[self.start] > ends[np.minimum(after, self.start)])
        capital = _capital(data, self.start)
        number = _DIGIT[data[self.start]] | _member(self.literal, _NUMBERS)
        follows = np.flatnonzero(np.concatenate([[False], number[:-1]]) & ~first & ~number)
        units = follows[_member(self.literal[follows], _UNITS)]
        self.kinds = [np.where(name, NAME, 0).astype(np.int8) for name in (capital & ~begins, capital)]
        for kind in self.kinds:
            kind[number] = NUMBER
            kind[units] = UNIT
        mark = common.mix(np.arange(4, dtype=_U) + _U(77))
        self.templates = [np.where(kind > 0, mark[kind], self.literal) for kind in self.kinds]

    def windows(self, view: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all windows of `size` words, and the first word of each."""
        rows = np.diff(self.bounds)
        n = np.maximum(0, rows - size + 1)
        first = np.arange(n.sum()) + np.repeat(self.bounds[:-1] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        h = np.full(len(first), salt * 1000 + size, _U)
        for j in range(size):
            h = h * _U(0x9FB21C651E98DF25) + view[first + j]
        return common.mix(h), first

    def slots(self, first: int, size: int, kind: np.ndarray) -> list[str]:
        return [bytes(self.data[self.start[i] : self.end[i]]).decode().lower() for i in range(first, first + size) if kind[i]]


_NUMBERS, _UNITS = _known(NUMBERS), _known(UNITS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)


def _found(b: pa.RecordBatch, sizes, window: int, least: int, may_hold):
    """Rows of _SCHEMA for the windows of a block whose hash may_hold accepts; with sizes None, an item's own windows."""
    words = Words(*common.bytes_of(b.column(1)))
    ids = b.column(0).to_pylist()
    count = np.diff(words.bounds)
    for size in sorted(set(np.clip(count, 1, window).tolist())) if sizes is None else sizes:
        unlike = np.concatenate([[0], np.cumsum(words.kinds[0] != words.kinds[1])])
        # a window that both readings give alike is one row of both
        for readings, view in ((0, words.literal), (1, words.templates[0]), (2, words.templates[1])):
            literal, kind = not readings, words.kinds[readings == 2]
            h, first = words.windows(view, size, 1 + literal)
            alike = unlike[first + size] == unlike[first]
            keep = np.ones(len(h), bool) if may_hold is None else may_hold(h)
            if not literal:
                plain = np.concatenate([[0], np.cumsum(kind == 0)])
                fixed = plain[first + size] - plain[first]
                keep &= (fixed >= least) & (fixed < size)
            if readings == 2:
                keep &= ~alike
            at = np.flatnonzero(keep)
            row = np.searchsorted(words.bounds, first[at], side="right") - 1
            if sizes is None:  # each item in windows of its own size
                own = np.clip(count[row], 1, window) == size
                at, row = at[own], row[own]
            for i, r in zip(at.tolist(), row.tolist()):
                if ids[r] is not None:
                    f = int(first[i])
                    yield (ids[r], f - int(words.bounds[r]), size, int(h[i].view(np.int64)), literal, 3 if readings and alike[i] else readings, [] if literal else words.slots(f, size, kind))


def benchmark_windows(items: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(item_id, item_at, n_words, hash, literal, item_readings, item_slots): every window of every item, materialised."""

    def run(batches):
        for batch in batches:
            for b in common.pieces(batch):
                rows = list(_found(b, None, window, least, None))
                if rows:
                    yield _batch(rows)

    rows = items.selectExpr("cast(item_id as long) id", "cast(text as string) text").mapInArrow(run, _DDL)
    return common.materialise(rows.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), "n_words", "hash", "literal", F.col("readings").alias("item_readings"), F.col("slots").alias("item_slots")).distinct(), "windows")


def _filter_of(windows: DataFrame) -> np.ndarray:
    count = windows.count()
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (32 * max(1, count) - 1).bit_length()))
    bit = F.expr(f"pmod(hash, {size}L)")
    words = windows.select(F.shiftright(bit, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("v"))
    out = np.zeros(size // 64, np.int64)
    rows = words.toArrow()  # FILTER_BITS[1] / 64 rows at most
    out[rows.column("word").to_numpy()] = rows.column("v").to_numpy()
    return out.view(np.uint8)


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, n_windows, literal_windows, slots): the items that each document holds, exactly or re-parameterised."""
    spark = docs.sparkSession
    common.ship(spark)
    own = benchmark_windows(items, window, least)
    sizes = sorted(r.n_words for r in own.select("n_words").distinct().collect())  # from 1 to window
    shared = spark.sparkContext.broadcast(_filter_of(own))  # a bit map of bounded size

    def run(batches):
        bits = shared.value

        def may_hold(h):
            at = (h & _U(8 * len(bits) - 1)).astype(np.int64)
            return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            for b in common.pieces(batch):
                rows = list(_found(b, sizes, window, least, may_hold))
                if rows:
                    yield _batch(rows)

    seen = common.texts(docs).mapInArrow(run, _DDL).select(F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), "n_words", "hash", "literal", "readings", "slots")
    met = seen.join(own, ["hash", "n_words", "literal"])
    pair = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    both = F.col("readings").bitwiseAND(F.col("item_readings"))
    first = ~F.col("literal") & (both.bitwiseAND(1) > 0)
    second = ~F.col("literal") & ((both.bitwiseAND(2) > 0) | (both == 0))
    slots = lambda of: F.array_distinct(F.flatten(F.collect_set(F.when(of, F.transform(pair, lambda p: F.struct(p["i"].alias("item"), p["d"].alias("doc")))))))
    lines = met.groupBy("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("diagonal")).agg(
        F.count_distinct("item_at").alias("n_windows"),
        F.count_distinct(F.when(F.col("literal"), F.col("item_at"))).alias("literal_windows"),
        slots(first).alias("first"),  # an item's slots at most
        slots(second).alias("second"),
    )
    agree = lambda slots: (F.size(slots) > 0) & (F.size(slots) == F.size(F.array_distinct(F.transform(slots, lambda p: p["item"]))))
    lines = lines.filter((F.col("literal_windows") > 0) | agree("first") | agree("second"))
    lines = lines.withColumn("slots", F.when(agree("second") & ~(agree("first") & (F.size("first") >= F.size("second"))), F.col("second")).otherwise(F.col("first")))
    return lines.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"), F.sum("literal_windows").alias("literal_windows"), F.max("slots").alias("slots"))


def keep(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    kept, _ = common.marked(docs, find(docs, items).select("doc_id"))
    return kept
