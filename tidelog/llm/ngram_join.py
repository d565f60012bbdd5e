"""Exact Jaccard join of documents on word n-grams by T-occurrence search, and its connected classes.

Words are runs of bytes other than ASCII white space, A-Z lower-cased.  A document's set are its distinct shingles of k
words, each a 64-bit hash; with fewer words the whole sequence is one; without words the set is empty.  Two documents link
when their sets' Jaccard similarity is num/den or more.

1. Every text gives the size and a 128-bit digest of its set; equal sets are one class from here on.
2. Two bounded sketches count shingles and words of the whole corpus.  They order all shingles from rare to frequent; any
   order gives the same result, this one keeps inverted lists short.
3. A set of size n can only link to one it shares ceil(num n / den) shingles with, so linked sets share one of their
   first n - ceil(num n / den) + 1 shingles.  These go to their lists.  Classes that meet in a list may link if their
   sizes allow it and the counts of their shingles in 128 or more hash buckets do: the sum of differences is at most the size of the
   symmetric difference, so the test loses nothing.  Classes that may link are connected, and the components of that graph
   part the corpus into independent searches.  Of a list's entries in one task beyond LIST_ROWS only bounds travel, so a
   list as long as the corpus is still a few rows a task.
4. Within a component the sets meet (search): a T-occurrence search by DivideSkip over inverted lists.  Only the texts of
   classes that may link travel, compressed, and become sets again where they meet.
5. A component too large for one task is cut by size ranges, and each range into blocks.  First every set meets its own
   block.  Then a few members of each cluster found so far meet, until no clusters join any more.  What may still be
   missing are links between different clusters, and for these the sets outside the largest cluster of a range meet
   all others.  So a group of copies, however large, is dealt out a fixed number of times; only sets that stay apart although
   they may link are dealt out more often.

Copies are never paired.  A null or empty text has an empty set and links with nothing.  A row without doc_id takes part in
nothing and has no component_id.  Repeated rows keep their copies.  An empty table gives no rows.  Ties in size or order do not
change the result, for it is exact.  Texts are read whole.  Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common, graph

#: Cells of each sketch; 2 * 8 MB, whatever the corpus.
CELLS = 1 << 20
#: Classes and shingles that one search holds at most; a single set may be larger.
GROUP_CLASSES, GROUP_SHINGLES = 2000, 1_500_000
#: Entries of one list that one task sends on singly, and that meet in one task; more are connected by their sizes alone.
LIST_ROWS, MEET_ROWS = 64, 5_000
#: Members of each cluster that meet those of others, and rounds of such meetings at most; an exact round follows.
MEMBERS, ROUNDS = 4, 6
#: DivideSkip's weight of a probe against a merge step.
MU = 0.0085
#: Hash buckets, at least, whose counts tell apart sets that cannot link.
BUCKETS = 128
#: Bits of the filter of classes that may link.
FILTER_BITS = (1 << 16, 1 << 26)
_U = common.U64


def needed(n, num: int, den: int):
    """The least overlap of a set of size n with any set it links to."""
    return (num * n + den - 1) // den


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Hashes of all shingles, the row bounds in them, the hashes of all words, and for each shingle its first word and length."""
    low = common.LOWER[data]
    start, end, bounds = common.words(low, offsets, common.SPACE)
    word = common.Spans(low).hash(start, end)
    size = np.diff(bounds)
    n = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.arange(at[-1]) - np.repeat(at[:-1], n) + np.repeat(bounds[:-1], n)
    length = np.repeat(np.minimum(size, k), n)
    h = length.astype(_U)
    for j in range(k):
        has = length > j
        w = word[np.where(has, first + j, 0)] if len(word) else np.zeros(0, _U)
        h = np.where(has, common.mix(h * _U(0x9FB21C651E98DF25) + w), h)
    return h, at, word, (first, length)


def sort_rows(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts each row and drops repeats; the values and their new bounds."""
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        values[s:e].sort()
    if not len(values):
        return values, at
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[at[:-1][at[:-1] < len(values)]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return values[new], kept[at]


def digests(sets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of each row's hashes."""
    return tuple(common.row_sums(common.mix(sets ^ _U(salt)), at).view(np.int64) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def bucket_counts(sets: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set the counts of its hashes by bucket, 255 at most a bucket; BUCKETS buckets, or more for a large set.

    Buckets are ranges of hashes, so neighbours added up give a coarser count.  About 16 hashes to a bucket tell unrelated
    sets apart, whatever their size.
    """
    n = np.diff(at)
    level = np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / 16)).astype(np.int64) - BUCKETS.bit_length() + 1)
    out: list[bytes] = [b""] * len(n)
    for up in np.unique(level).tolist():
        some = np.flatnonzero(level == up)
        width = BUCKETS << up
        for k in range(0, len(some), max(1, 4096 >> up)):
            own = some[k : k + max(1, 4096 >> up)]
            row = np.repeat(np.arange(len(own)), n[own])
            pick = np.arange(len(row)) + np.repeat(at[own] - np.concatenate([[0], np.cumsum(n[own])[:-1]]), n[own])
            counts = np.bincount(row * width + (sets[pick] >> _U(65 - width.bit_length())).astype(np.int64), minlength=len(own) * width)
            rows = np.minimum(counts, 255).astype(np.uint8).reshape(len(own), width)
            for i, x in zip(own.tolist(), rows):
                out[i] = x.tobytes()
    return out


def _signatures(k: int):
    names = ["doc_id", "n", "d1", "d2", "sig", "chunk", "counts"]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        counts = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            for b in common.pieces(batch):
                h, at, word, _ = shingles(*common.bytes_of(b.column(1)), k)
                sets, at = sort_rows(h, at)
                for base, x in ((0, sets), (CELLS, word)):
                    counts[base : base + CELLS] += np.bincount((x >> _U(44)).astype(np.int64), minlength=CELLS)
                d1, d2 = digests(sets, at)
                made = [b.column(0), pa.array(np.diff(at)), pa.array(d1), pa.array(d2), pa.array(bucket_counts(sets, at), pa.binary())]
                yield pa.RecordBatch.from_arrays([*made, *(pa.nulls(b.num_rows, t) for t in kinds[-2:])], names=names)
        for chunk, raw in common.count_rows(counts):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in kinds[:-2]), pa.array([chunk], kinds[-2]), pa.array([raw], kinds[-1])], names=names)

    return run


def ranks(h: np.ndarray, word: np.ndarray, where: tuple, k: int, counts: np.ndarray) -> np.ndarray:
    """A 64-bit value of each shingle, the same wherever it stands, that orders the corpus's shingles from rare to frequent.

    First how far its count stands out of the sketch's noise, then its rarest word's count, then its hash.
    """
    first, length = where
    seen = counts[:CELLS][(h >> _U(44)).astype(np.int64)]
    noise = 4 * counts[:CELLS].mean() + 8
    loud = np.maximum(0, np.floor(np.log2(np.maximum(seen, 1) / noise)) + 1).astype(_U)
    word_count = counts[CELLS:][(word >> _U(44)).astype(np.int64)]
    rarest = np.full(len(h), np.iinfo(np.int64).max)
    for j in range(k):
        has = length > j
        rarest = np.where(has, np.minimum(rarest, word_count[np.where(has, first + j, 0)]), rarest) if len(word) else rarest
    rare = np.floor(2 * np.log2(np.maximum(rarest, 1))).astype(_U)
    return (np.minimum(loud, _U(31)) << _U(59)) | (np.minimum(rare, _U(127)) << _U(52)) | (common.mix(h) >> _U(12))


def chain(key, lo, hi, node, num: int, den: int):
    """Sorts entries by list and size; also gives where a chain of entries whose sizes may link begins."""
    order = np.lexsort((node, lo, key))
    key, lo, hi, node = key[order], lo[order], hi[order], node[order]
    twin = np.zeros(len(key), bool)
    twin[1:] = (key[1:] == key[:-1]) & (node[1:] == node[:-1]) & (lo[1:] == lo[:-1]) & (hi[1:] == hi[:-1])
    key, lo, hi, node = key[~twin], lo[~twin], hi[~twin], node[~twin]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    lists = np.cumsum(fresh)
    reach = np.maximum.accumulate(lists * (1 << 32) + hi) - lists * (1 << 32)  # largest size so far in the list
    fresh[1:] |= reach[:-1] * den < lo[1:] * num
    return (key, lo, hi, node), fresh


def collapse(entries, fresh, at_most: int):
    """Puts chains of more than at_most entries into one entry each, from smallest to largest size, with the smallest node.

    Gives all entries, where their chains begin, and the (node, smallest) pairs of what was put together.
    """
    key, lo, hi, node = entries
    at = np.flatnonzero(fresh)
    size = np.diff(np.append(at, len(key)))
    long = size > at_most
    if not long.any():
        return entries, fresh, (node[:0], node[:0])
    inside = np.repeat(long, size)
    least = np.minimum.reduceat(node, at)
    to = np.repeat(least, size)
    pairs = np.unique(np.stack([node[inside], to[inside]], 1), axis=0)
    hi = np.where(inside, np.repeat(np.maximum.reduceat(hi, at), size), hi)
    node = np.where(inside, to, node)
    keep = ~inside | fresh
    return (key[keep], lo[keep], hi[keep], node[keep]), fresh[keep], (pairs[:, 0], pairs[:, 1])


_LISTS = pa.schema([("edge", pa.bool_()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("node", pa.int64())])


def _rows(entries, pairs):
    for edge, (key, lo, hi, node) in ((False, entries), (True, (pairs[0], pairs[0], pairs[0], pairs[1]))):
        for k in range(0, len(key), 1 << 16):
            s = slice(k, k + (1 << 16))
            n = len(key[s])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, edge)), *(pa.array(x[s]) for x in (key, lo, hi, node))], schema=_LISTS)


def _prefixes(k, num, den, shared):
    at_most = LIST_ROWS

    def run(batches):
        counts, held, size = shared.value, [], 0

        def flush():
            entries, _, pairs = collapse(*chain(*(np.concatenate(x) for x in zip(*held)), num, den), at_most)
            return _rows(entries, pairs)

        for batch in batches:
            for b in common.pieces(batch):
                h, at, word, where = shingles(*common.bytes_of(b.column(1)), k)
                every = at
                own, at = sort_rows(h.copy(), every)
                d1, _ = digests(own, at)
                n = np.diff(at)
                order, bounds = sort_rows(ranks(h, word, where, k, counts), every)
                take = np.where(n > 0, n - needed(n, num, den) + 1, 0)
                pick = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(take.sum())
                own_n = np.repeat(n, take)
                held.append((order[pick].view(np.int64), own_n, own_n, np.repeat(d1, take)))
                size += len(pick)
                if size > 800_000:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _merge_lists(num, den):
    at_most = MEET_ROWS

    def run(batches):
        held = []
        for b in batches:
            edge = np.asarray(b.column(0).to_numpy(zero_copy_only=False), bool)
            if edge.any():
                yield b.filter(pa.array(edge))
            if not edge.all():
                held.append(tuple(b.column(i).to_numpy()[~edge] for i in range(1, 5)))
        if held:
            entries, fresh, pairs = collapse(*chain(*(np.concatenate(x) for x in zip(*held)), num, den), at_most)
            size = np.diff(np.append(np.flatnonzero(fresh), len(fresh)))
            meet = np.repeat(size > 1, size)
            key, lo, hi, node = (x[meet] for x in entries)
            # each chain is a list of its own from here on
            key = common.mix(key.view(_U) + common.mix(np.cumsum(fresh)[meet].astype(_U))).view(np.int64)
            yield from _rows((key, lo, hi, node), pairs)

    return run


class Buckets:
    """The bucket counts of some sets, at any resolution that a set has."""

    def __init__(self, sigs: list[bytes]):
        self.width = np.array([len(x) for x in sigs])
        self.sigs, self.made = sigs, {}

    def at(self, width: int) -> np.ndarray:
        """(sets, width): the counts of all sets that have as many buckets; zeros for the others."""
        if width not in self.made:
            out = np.zeros((len(self.sigs), width), np.int16)
            for w in np.unique(self.width[self.width >= width]).tolist():
                some = np.flatnonzero(self.width == w)
                raw = np.frombuffer(b"".join(self.sigs[i] for i in some.tolist()), np.uint8)
                out[some] = raw.reshape(len(some), width, w // width).sum(2, dtype=np.int16)
            self.made[width] = out
        return self.made[width]

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of sets a lower bound of the size of their symmetric difference."""
        common_width = np.minimum(self.width[x], self.width[y])
        out = np.zeros(len(x), np.int64)
        for w in np.unique(common_width).tolist():
            some = np.flatnonzero(common_width == w)
            counts = self.at(w)
            out[some] = np.abs(counts[x[some]] - counts[y[some]]).sum(1, dtype=np.int64)
        return out


def near(size: np.ndarray, buckets: Buckets, num: int, den: int) -> np.ndarray:
    """For each entry of a list the first entry it is connected with by pairs whose sizes and bucket counts may link."""
    label = np.full(len(size), -1)
    for seed in range(len(size)):
        if label[seed] >= 0:
            continue
        label[seed] = seed
        queue = [seed]
        while queue:
            x = queue.pop()
            other = np.flatnonzero((label < 0) & (size * den >= size[x] * num) & (size * num <= size[x] * den))
            if not len(other):
                continue
            hit = other[buckets.apart(other, np.full(len(other), x)) * (den + num) <= (den - num) * (size[other] + size[x])]
            label[hit] = seed
            queue += hit.tolist()
    return label


def _meet(num, den):
    """Streams over (key, lo, hi, node, sig) sorted by key and gives the edges (a, b) of classes that may link."""

    def edges(key, lo, hi, node, sig):
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(at[1:], len(key))
        pair = (ends - at == 2) & (lo[at] == hi[at]) & (lo[ends - 1] == hi[ends - 1])
        a, b = [], []
        pairs = at[pair]
        for k in range(0, len(pairs), 1 << 13):
            i = pairs[k : k + (1 << 13)]
            own = Buckets([sig[j] for j in np.stack([i, i + 1], 1).ravel().tolist()])
            apart = own.apart(np.arange(0, 2 * len(i), 2), np.arange(1, 2 * len(i), 2))
            i = i[apart * (den + num) <= (den - num) * (lo[i] + lo[i + 1])]
            a.append(node[i])
            b.append(node[i + 1])
        for s, e in zip(at[~pair].tolist(), ends[~pair].tolist()):
            boxed = (lo[s:e] != hi[s:e]).any()  # bounds of many classes: connected as they stand
            label = np.zeros(e - s, np.int64) if boxed else near(lo[s:e], Buckets(sig[s:e]), num, den)
            a.append(node[s:e])
            b.append(node[s:e][label])
        a, b = np.concatenate(a), np.concatenate(b)
        found = np.unique(np.stack([a[a != b], b[a != b]], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

    def run(batches):
        held, sigs = None, []
        for b in batches:
            new = [b.column(i).to_numpy() for i in range(4)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            sigs += b.column(4).to_pylist()
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last list may go on
            if cut > 50_000:
                yield edges(*(x[:cut] for x in held), sigs[:cut])
                held, sigs = [x[cut:] for x in held], sigs[cut:]
        if held is not None and len(held[0]):
            yield edges(*held, sigs)

    return run


def _texts(k, shared):
    """(n, d1, d2, raw): the compressed text of one document of each class that the bit map may hold, once a block."""
    names = ["n", "d1", "d2", "raw"]

    def run(batches):
        bits, held, size = shared.value, {}, 0

        def flush():
            cols = [pa.array([key[i] for key in held], pa.int64()) for i in range(3)]
            return pa.RecordBatch.from_arrays([*cols, pa.array(list(held.values()), pa.binary())], names=names)

        for batch in batches:
            for b in common.pieces(batch):
                data, offsets = common.bytes_of(b.column(1))
                h, at, _, _ = shingles(data, offsets, k)
                sets, at = sort_rows(h, at)
                d1, d2 = digests(sets, at)
                known = np.asarray(b.column(0).is_valid())
                for i in np.flatnonzero((np.diff(at) > 0) & known & _may_hold(bits, d1)).tolist():
                    key = (int(at[i + 1] - at[i]), int(d1[i]), int(d2[i]))
                    if key not in held:
                        held[key] = zlib.compress(data[offsets[i] : offsets[i + 1]].tobytes(), 1)
                        size += len(held[key]) + 100
                if size > 16 << 20:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return run


def _bit(d1: np.ndarray, size: int) -> np.ndarray:
    return (common.mix(d1.view(_U)) & _U(size - 1)).astype(np.int64)


def _may_hold(bits: np.ndarray, d1: np.ndarray) -> np.ndarray:
    at = _bit(d1, 8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _filter_of(nodes: DataFrame, count: int) -> np.ndarray:
    """A bit map of the nodes' hashes, of bounded size."""
    size = min(FILTER_BITS[1], max(FILTER_BITS[0], 1 << (16 * count - 1).bit_length()))

    def run(batches):
        for b in batches:
            at = _bit(b.column(0).to_numpy().copy(), size)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63)], names=["word", "bit"])

    rows = nodes.select("node").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.expr("bit_or(shiftleft(1L, int(bit)))").alias("v")).toArrow()
    out = np.zeros(size // 64, np.int64)  # at most FILTER_BITS[1] / 64 rows
    out[rows.column("word").to_numpy()] = rows.column("v").to_numpy()
    return out.view(np.uint8)


def merge_skip(lists: list[list[int]], need: int) -> Iterator[tuple[int, int]]:
    """(record, count) of the records that stand in `need` or more of the sorted lists, in ascending order.

    A heap holds the lists' heads.  Where too few agree, need - 1 heads are taken off and jump to the next one left, for
    no record before it can stand in enough lists.
    """
    at = [0] * len(lists)
    heap = [(x[0], i) for i, x in enumerate(lists) if x]
    heapq.heapify(heap)
    while len(heap) >= need:
        record, taken = heap[0][0], []
        while heap and heap[0][0] == record:
            taken.append(heapq.heappop(heap)[1])
        if len(taken) >= need:
            yield record, len(taken)
            beyond = record + 1
        else:
            while heap and len(taken) < need - 1:
                taken.append(heapq.heappop(heap)[1])
            if not heap:
                return
            beyond = max(record + 1, heap[0][0])
        for i in taken:
            at[i] = bisect_left(lists[i], beyond, at[i])
            if at[i] < len(lists[i]):
                heapq.heappush(heap, (lists[i][at[i]], i))


def search(sets: list[np.ndarray], num: int, den: int, clusters: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets of sorted hashes that connect every class of linked sets; by DivideSkip.

    Sets go by size, each against those before it that are not in its cluster yet.  Of its inverted lists the longest, T /
    (MU log2(longest) + 1) of them, are set aside; a set with enough overlap T stands often enough in the short ones,
    which are heap-merged, and is then looked up in each long one by binary search.
    """
    count = len(sets)
    if count < 2:
        return []
    size = np.array([len(s) for s in sets])
    order = np.argsort(size, kind="stable")
    size = size[order]
    _, token, df = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    token, df = rank[token], np.sort(df, kind="stable")
    bounds = np.concatenate([[0], np.cumsum(size)])
    # all inverted lists, shortest first, as one sorted array of list * count + set
    entries = np.sort(token * count + np.repeat(np.arange(count), size))
    list_at = np.concatenate([[0], np.cumsum(df)])
    label = np.arange(count) if clusters is None else np.unique(np.array(clusters)[order], return_inverse=True)[1]
    links = []
    for i in range(1, count):
        n = int(size[i])
        least = needed(n, num, den)
        low = int(np.searchsorted(size, least))
        if not (label[low:i] != label[i]).any():
            continue
        mine = np.sort(token[bounds[i] : bounds[i + 1]])
        aside = min(least - 1, int(least / (MU * np.log2(max(2, df[mine[-1]])) + 1)))
        need, short, long = least - aside, mine[: n - aside], mine[n - aside :]
        short = short[df[short] > 1]
        length = df[short]
        where = np.arange(length.sum()) + np.repeat(list_at[short] - np.concatenate([[0], np.cumsum(length)[:-1]]), length)
        own_list, who = np.repeat(np.arange(len(short)), length), entries[where] % count
        begin = low
        while True:
            left = (who >= begin) & (who < i)
            left[left] = label[who[left]] != label[i]
            cuts = np.searchsorted(own_list[left], np.arange(len(short) + 1)).tolist()
            flat = who[left].tolist()
            found = -1
            for j, often in merge_skip([flat[a:b] for a, b in zip(cuts, cuts[1:]) if a < b], need):
                must = -(-num * (n + int(size[j])) // (num + den))
                if often + aside < must:
                    continue
                asked = long * count + j
                at = np.minimum(np.searchsorted(entries, asked), len(entries) - 1)
                if often + int((entries[at] == asked).sum()) >= must:
                    found = j
                    break
            if found < 0:
                break
            links.append((i, found))
            label[label == label[found]] = label[i]
            begin = found + 1
            if not (label[begin:i] != label[i]).any():
                break
    return [(int(order[a]), int(order[b])) for a, b in links]


def _search_groups(k, num, den):
    """Streams over (group, cluster, rep, raw) sorted by group and gives the links (a, b) between representatives."""

    def run(batches):
        now, held, out = None, {}, []

        def close():
            if len(held) > 1:
                raws = [zlib.decompress(x[1]) for x in held.values()]
                offsets = np.cumsum([0, *map(len, raws)])
                h, at, _, _ = shingles(np.frombuffer(b"".join(raws), np.uint8), offsets, k)
                flat, at = sort_rows(h, at)
                reps = list(held)
                for a, b in search(np.split(flat, at[1:-1]), num, den, [x[0] for x in held.values()]):
                    out.append((reps[a], reps[b]))

        def batch():
            made = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
            out.clear()
            return made

        for b in batches:
            group, cluster, rep = (b.column(i).to_pylist() for i in range(3))
            for i, g in enumerate(group):
                if g != now:
                    close()
                    now, held = g, {}
                    if len(out) > 10_000:
                        yield batch()
                if rep[i] not in held:
                    held[rep[i]] = (cluster[i], b.column(3)[i].as_py())
        close()
        if out:
            yield batch()

    return run


def _links(raw: DataFrame, plan: DataFrame, k: int, num: int, den: int, name: str) -> DataFrame:
    """The links (a, b) that searches in the groups of plan (n, d1, d2, rep, cluster, group) find."""
    met = raw.join(plan.hint("merge"), ["n", "d1", "d2"]).select("group", "cluster", "rep", "raw")
    return common.materialise(met.repartition("group").sortWithinPartitions("group").mapInArrow(_search_groups(k, num, den), "a long, b long"), name)


def _blocks(classes, total, part: int = 1):
    """How many blocks keep within the bounds of one search; `part` of them share it."""
    return F.greatest(F.lit(1), F.ceil(classes * part / GROUP_CLASSES), F.ceil(total * part / GROUP_SHINGLES)).cast("int")


def _counted(plan: DataFrame, *by) -> DataFrame:
    return plan.groupBy(*by).agg(F.count("*").alias("classes"), F.sum("n").alias("total"))


def _clusters(plan: DataFrame, links: list[DataFrame]) -> DataFrame:
    """plan with the cluster of each class by all links so far."""
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    found = graph.components(every)
    roots = found.select(F.col("node").alias("rep"), F.col("root").alias("cluster"))
    made = common.materialise(plan.drop("cluster").join(roots, "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep")), "clusters")
    common.drop(found)
    return made


def _large(raw: DataFrame, wide: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links within components that exceed one search; wide has (comp, n, d1, d2, rep)."""
    # sizes that may link lie in one size range or in two adjacent ones
    step = float(np.log(den / num)) if den > num else 1e-9
    wide = wide.withColumn("band", F.floor(F.log("n") / F.lit(step) + 1e-9))
    wide = wide.withColumn("key", F.explode(F.array(F.xxhash64("comp", "band"), F.xxhash64("comp", F.col("band") - 1))))
    wide = common.materialise(wide.join(_counted(wide, "key").select("key", _blocks(F.col("classes"), F.col("total")).alias("blocks")), "key").withColumn("cluster", F.col("rep")), "wide")
    columns = ["n", "d1", "d2", "rep", "cluster", "group"]
    block = lambda of, salt, blocks: F.pmod(F.xxhash64(*of, F.lit(salt)), blocks)
    raw = common.materialise(raw.join(wide.select("n", "d1", "d2").distinct().hint("merge"), ["n", "d1", "d2"], "left_semi"), "large-raw")
    links = [_links(raw, wide.withColumn("group", F.xxhash64("key", block(["d1", "d2"], 0, F.col("blocks")))).select(columns), k, num, den, "links")]
    split = wide.filter("blocks > 1")  # the others have met whole
    before = None
    for r in range(1, ROUNDS + 2):
        now = _clusters(split, links)
        many = now.groupBy("key").agg(F.count_distinct("cluster").alias("clusters")).filter("clusters > 1")
        left = many.agg(F.sum("clusters")).first()[0]
        if not left or before and left > 0.8 * before or r > ROUNDS:
            break
        before = left
        few = now.join(many.select("key"), "key", "left_semi").groupBy("key", "cluster", block(["d1"], r, F.lit(MEMBERS)).alias("member")).agg(F.min(F.struct(F.xxhash64("d2", F.lit(r)), "n", "d1", "d2", "rep")).alias("x"))
        few = few.select("key", "cluster", "x.n", "x.d1", "x.d2", "x.rep")
        few = few.join(_counted(few, "key").select("key", _blocks(F.col("classes"), F.col("total")).alias("blocks")), "key")
        links.append(_links(raw, few.withColumn("group", F.xxhash64("key", block(["cluster"], r, F.col("blocks")))).select(columns), k, num, den, "links"))
        common.drop(now)
    if left:
        links.append(_links(raw, _rest(now).select(columns), k, num, den, "links"))
    common.drop(now, wide, raw)
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    out = common.materialise(every, "links")
    common.drop(*links)
    return out


def _rest(now: DataFrame) -> DataFrame:
    """Groups in which all sets of different clusters of a key meet: those outside its largest cluster meet all others in blocks."""
    sizes = _counted(now, "key", "cluster")
    most = sizes.groupBy("key").agg(F.max_by("cluster", F.struct("classes", "cluster")).alias("most"), F.count("*").alias("clusters")).filter("clusters > 1")
    sizes = sizes.join(most, "key").groupBy("key", "most").agg(*(F.sum(F.when((F.col("cluster") == F.col("most")) == main, F.col(c))).alias(f"{c}_{side}") for side, main in (("m", True), ("o", False)) for c in ("classes", "total")))
    sizes = sizes.select("key", "most", *(_blocks(F.col(f"classes_{x}"), F.col(f"total_{x}"), 2).alias(f"blocks_{x}") for x in "mo"))
    rows = now.join(sizes, "key").withColumn("main", F.col("cluster") == F.col("most"))
    own = F.pmod(F.xxhash64("d1", "d2"), F.when(F.col("main"), F.col("blocks_m")).otherwise(F.col("blocks_o"))).cast("int")
    rows = rows.withColumn("own", own)
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # a pair is (block of the largest cluster, block of the others), or two blocks of the others
    main = F.transform(upto(F.col("blocks_o")), lambda o: F.xxhash64("key", F.lit("m"), "own", o))
    other = F.concat(
        F.transform(upto(F.col("blocks_m")), lambda m: F.xxhash64("key", F.lit("m"), m, "own")),
        F.transform(upto(F.col("blocks_o")), lambda o: F.xxhash64("key", F.lit("o"), F.least("own", o), F.greatest("own", o))),
    )
    return rows.withColumn("group", F.explode(F.when(F.col("main"), main).otherwise(other)))


def classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the smallest doc_id reachable by links, the document's own included."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = common.texts(docs)
    first = common.materialise(rows.mapInArrow(_signatures(k), "doc_id long, n long, d1 long, d2 long, sig binary, chunk int, counts binary"), "signatures")
    counts = common.total_counts(first.filter("chunk is not null"), 2 * CELLS)
    signed = first.filter("chunk is null")
    alike = signed.filter("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("sig").alias("sig"))
    alike = common.materialise(alike, "classes")
    work = signed.agg(F.sum(F.expr(f"n * {den - num} / {den} + 1"))).first()[0] or 0
    kept = common.materialise(signed.select("doc_id", "n", "d1", "d2"), "digests")
    common.drop(first)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(work // 1_000_000) + 1)
    shared = spark.sparkContext.broadcast(counts)  # two sketches of fixed size
    shape = "edge boolean, key long, lo long, hi long, node long"
    lists = rows.mapInArrow(_prefixes(k, num, den, shared), shape)
    met = common.materialise(lists.repartition(tasks, "key").mapInArrow(_merge_lists(num, den), shape), "met")
    signs = alike.groupBy("d1").agg(F.max("sig").alias("sig"))
    entries = met.filter("not edge").join(signs.hint("merge"), F.col("node") == F.col("d1")).select("key", "lo", "hi", "node", "sig")
    edges = entries.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(num, den), "a long, b long")
    edges = edges.unionByName(met.filter("edge").select(F.col("key").alias("a"), F.col("node").alias("b")))
    may_link = graph.components(edges)
    common.drop(met)
    nodes = may_link.count()
    linked = None
    if nodes:
        bits = spark.sparkContext.broadcast(_filter_of(may_link, nodes))  # FILTER_BITS[1] / 8 bytes at most
        raw = common.materialise(rows.mapInArrow(_texts(k, bits), "n long, d1 long, d2 long, raw binary"), "raw")
        plan = alike.select("n", "d1", "d2", "rep").join(may_link.select(F.col("node").alias("d1"), F.col("root").alias("comp")).hint("merge"), "d1")
        plan = common.materialise(plan, "plan")
        share = _counted(plan, "comp").filter((F.col("classes") > GROUP_CLASSES) | (F.col("total") > GROUP_SHINGLES))
        large = common.materialise(share.select("comp"), "large")
        small = plan.join(large, "comp", "left_anti").select("n", "d1", "d2", "rep", F.col("rep").alias("cluster"), F.col("comp").alias("group"))
        links = [_links(raw, small, k, num, den, "links")]
        if not large.isEmpty():
            links.append(_large(raw, plan.join(large, "comp", "left_semi"), k, num, den))
        linked = graph.components(links[0] if len(links) == 1 else links[0].unionByName(links[1]))
        common.drop(raw, plan, large, *links)
    common.drop(may_link)
    if linked is not None:
        alike_to = alike.join(linked.select(F.col("node").alias("rep"), F.col("root").alias("linked")), "rep", "left")
    else:
        alike_to = alike.withColumn("linked", F.lit(None).cast("long"))
    joined = alike_to.filter("copies > 1 or linked is not null").select("n", "d1", "d2", F.coalesce("linked", "rep").alias("of"))
    joined = common.materialise(joined, "joined")
    common.drop(alike, *([] if linked is None else [linked]))
    same = [kept[c] == joined[c] for c in ("n", "d1", "d2")]
    out = kept.join(joined, same[0] & same[1] & same[2] & kept["doc_id"].isNotNull(), "left")
    return out.select(kept["doc_id"], kept["n"].alias("n_shingles"), F.when(kept["n"] > 0, F.coalesce("of", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs without those of near duplicates whose component has a smaller doc_id; all columns stay.

    Rows without words or without doc_id stay, as do all rows that repeat a doc_id that stays.
    """
    found = classes(docs, k, num, den)
    kept, _ = common.marked(docs, found.filter("component_id <> doc_id").select("doc_id"))
    return kept
