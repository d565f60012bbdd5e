"""Cross-entropy difference of two word bigram models that share one vocabulary.

The background model counts every document, the target model the documents marked as targets.  Both have every word of the
corpus, count words and bigrams exactly (by 64-bit hashes of them), are smoothed alike, and give probabilities that add
up to one.  A document's score is the mean over its tokens of target loss minus background loss: the lower, the more
it is like the targets.  A document never scores itself: its own counts are taken off both models first, so a
target and a like document that is none score alike, and one that stands there twice is well known to the background.

1. Texts are packed into blocks of about BLOCK tokens, compressed, with the targets marked.
2. Each block sends its distinct words and bigrams with their counts to shards, ranges of hashes, as sorted arrays.
3. A shard adds up what all blocks sent and answers each with the totals of just what it sent.
4. A block meets its answers and scores its documents.

So counts grow with the corpus and nothing of it is broadcast; a word in every text is one entry a block.

A null, empty or wordless text has no tokens, losses 0 and score 0.  Without any target both models are the background.
Texts are read whole; one longer than a block is a block.  Repeated rows count, and are scored, as often as they stand there; a
null doc_id is never a target.  An empty table gives no rows.  Further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

SMOOTHING = 16.0
#: Tokens of a block, about.
BLOCK = 600_000
_U = common.U64
_CODEC = pa.Codec("zstd", compression_level=6)
#: What stands before the first token of a document.
START = _U(1)
_BLOCKS = pa.schema([("block", pa.string()), ("tokens", pa.int64()), ("raw", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary()), ("known", pa.binary()), ("target", pa.binary())])
_BLOCKS_DDL = "block string, tokens long, raw binary, sizes binary, ids binary, known binary, target binary"
_REPLIES = pa.schema([("block", pa.string()), ("shard", pa.int64()), ("n", pa.binary()), ("t", pa.binary()), ("words", pa.int64()), ("c", pa.int64()), ("ct", pa.int64())])


def _small(x: np.ndarray) -> bytes:
    """Counts in as few bytes as the largest needs, compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << 8 * w)
    return bytes([width]) + zlib.compress(x.astype(f"<u{width}").tobytes(), 1)


def _counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)


def _steps(keys: np.ndarray) -> bytes:
    """Sorted 64-bit values as steps of as few bytes as the largest needs."""
    steps = np.diff(keys, prepend=_U(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _keys(raw: bytes) -> np.ndarray:
    width = raw[0]
    wide = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    wide[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=_U)


def _word_key(word: np.ndarray) -> np.ndarray:
    return common.mix(word ^ _U(0x2545F4914F6CDD1D)) | _U(1)


class Block:
    """The words and bigrams of some documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = common.LOWER[data]
        start, end, self.bounds = common.words(low, offsets, common.PUNCT)
        h = common.Spans(low).hash(start, end)
        self.tokens = np.diff(self.bounds)
        self.words, at = np.unique(np.append(h, START), return_inverse=True)
        first, at = at[-1], at[:-1]
        before = np.concatenate([[first], at[:-1]])[: len(at)]
        before[self.bounds[:-1][self.bounds[:-1] < len(at)]] = first
        self.start = int(first)
        bigrams, gram = np.unique(before * len(self.words) + at, return_inverse=True)
        self.before, self.word = bigrams // len(self.words), bigrams % len(self.words)
        # the distinct bigrams of each document, and how often each is there
        doc = np.repeat(np.arange(len(self.tokens)), self.tokens)
        own, self.n = np.unique(doc * max(1, len(bigrams)) + gram, return_counts=True)
        self.doc, self.gram = own // max(1, len(bigrams)), own % max(1, len(bigrams))
        keys = np.concatenate([_word_key(self.words), common.mix(common.mix(self.words[self.before]) * _U(0x9FB21C651E98DF25) + self.words[self.word]) & ~_U(1)])
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By key how often the word stands before another or the bigram occurs, in all documents and in targets."""
        out = []
        for weight in (self.n, self.n * target[self.doc]):
            grams = np.bincount(self.gram, weight, len(self.before))
            words = np.bincount(self.before, grams, len(self.words))
            out.append(np.concatenate([words, grams])[self.order].astype(np.int64))
        return out[0], out[1]

    def losses(self, totals: np.ndarray, own: np.ndarray, words: int, all_words: int) -> np.ndarray:
        """Each document's summed loss by a model of these totals; own marks the documents that it counted.

        words is how many words there are, all_words how often any of them stands before another.
        """
        by_key = np.empty(len(totals), np.int64)
        by_key[self.order] = totals
        context, gram = by_key[: len(self.words)], by_key[len(self.words) :]
        # how often each word stands before another in its own document
        pair = self.doc * len(self.words) + self.before[self.gram]
        at, back = np.unique(pair, return_inverse=True)
        times = np.bincount(back, self.n, len(at))
        counted = own[self.doc]
        before = context[self.before[self.gram]] - counted * times[back]
        asked = self.doc * len(self.words) + self.word[self.gram]
        where = np.minimum(np.searchsorted(at, asked), max(0, len(at) - 1))
        self_word = np.where(at[where] == asked, times[where], 0) if len(at) else np.zeros(0)
        taken = counted * np.maximum(0, self.tokens - 1)[self.doc]
        unigram = (context[self.word[self.gram]] - counted * self_word + 0.5) / (all_words - taken + 0.5 * (words + 1))
        loss = -np.log((gram[self.gram] - counted * self.n + SMOOTHING * unigram) / (before + SMOOTHING))
        return np.bincount(self.doc, loss * self.n, len(self.tokens))


def _pack(batches):
    held, size = [], 0

    def flush():
        raws, offs, ids, target = zip(*held)
        sizes = np.concatenate([np.diff(x) for x in offs])
        every = pa.concat_arrays(ids)
        made = [uuid.uuid4().hex, size, _CODEC.compress(b"".join(raws), asbytes=True), sizes.astype("<i8").tobytes(), every.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(), np.asarray(every.is_valid()).astype(np.uint8).tobytes(), np.concatenate(target).astype(np.uint8).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(made, _BLOCKS)], schema=_BLOCKS)

    for batch in batches:
        for b in common.pieces(batch):
            data, offsets = common.bytes_of(b.column(1))
            held.append((data.tobytes(), offsets, b.column(0), np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)))
            size += len(common.words(data, offsets, common.PUNCT)[0])
            if size >= BLOCK:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _unpack(raw: bytes, sizes: bytes) -> Block:
    offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])
    return Block(np.frombuffer(_CODEC.decompress(raw, int(offsets[-1]), asbytes=True), np.uint8), offsets)


def _requests(shards: int):
    names = ["block", "shard", "keys", "n", "t"]

    def run(batches):
        for b in batches:
            for block, raw, sizes, target in zip(*(b.column(i).to_pylist() for i in range(4))):
                own = _unpack(raw, sizes)
                n, t = own.counts(np.frombuffer(target, np.uint8))
                shard = (own.keys >> _U(32)) * _U(shards) >> _U(32)
                cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
                spans = list(zip(cut.tolist(), [*cut[1:].tolist(), len(shard)]))
                for k in range(0, len(spans), 256):
                    part = spans[k : k + 256]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block] * len(part)), pa.array([int(shard[x]) for x, _ in part]), *(pa.array([f(of[x:y]) for x, y in part], pa.binary()) for f, of in ((_steps, own.keys), (_small, n), (_small, t)))],
                        names=names,
                    )

    return run


def _add_up(batches):
    """Streams over requests sorted by shard: the totals for each block's keys, and a row of sums a shard."""
    start = int(_word_key(np.array([START]))[0])
    now, held = None, []

    def close():
        keys = [_keys(x[1]) for x in held]
        every, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = [np.bincount(back, np.concatenate([_counts(x[i]) for x in held]), len(every)).astype(np.int64) for i in (2, 3)]
        at = 0
        for x, own in zip(held, keys):
            mine = back[at : at + len(own)]
            at += len(own)
            yield row(x[0], now, _small(total[0][mine]), _small(total[1][mine]), None, None, None)
        word = (every & _U(1) == 1) & (every != _U(start))
        yield row(None, now, None, None, int(word.sum()), *(int(x[word].sum()) for x in total))

    def row(*values):
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _REPLIES)], schema=_REPLIES)

    for b in batches:
        for block, shard, keys, n, t in zip(*(b.column(i).to_pylist() for i in range(5))):
            if shard != now:
                if held:
                    yield from close()
                now, held = shard, []
            held.append((block, keys, n, t))
    if held:
        yield from close()


def _score(words: int, totals: tuple[int, int]):
    """Streams over blocks, each followed by its answers in order of shards."""
    names = ["doc_id", "n_tokens", "loss_target", "loss_background", "score"]
    any_target = totals[1] is not None

    def run(batches):
        held = None

        def close():
            raw, sizes, ids, known, target, answers = held
            own = _unpack(raw, sizes)
            n, t = (np.concatenate([_counts(a[i]) for a in answers]) for i in (0, 1))
            every = np.ones(len(own.tokens), np.int64)
            background = own.losses(n, every, words, totals[0])
            like = own.losses(t, np.frombuffer(target, np.uint8).astype(np.int64), words, totals[1]) if any_target else background
            mean = [x / np.maximum(1, own.tokens) for x in (like, background)]
            ids = pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(known, np.uint8) == 0)
            return pa.RecordBatch.from_arrays([ids, pa.array(own.tokens), *map(pa.array, mean), pa.array(mean[0] - mean[1])], names=names)

        for b in batches:
            for shard, raw, sizes, ids, known, target, n, t in zip(*(b.column(i).to_pylist() for i in range(8))):
                if shard < 0:
                    if held:
                        yield close()
                    held = (raw, sizes, ids, known, target, [])
                else:
                    held[5].append((n, t))
        if held:
            yield close()

    return run


def differences(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, loss_target, loss_background, score); targets has the doc_id of each target document."""
    spark = docs.sparkSession
    common.ship(spark)
    others, wanted = common.marked(common.texts(docs), targets.select("doc_id"))
    flagged = others.withColumn("target", F.lit(False)).unionByName(wanted.withColumn("target", F.lit(True)))
    blocks = common.materialise(flagged.mapInArrow(_pack, _BLOCKS_DDL), "blocks")
    size = blocks.agg(F.count("*").alias("blocks"), F.sum("tokens").alias("tokens")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size.tokens or 0) // BLOCK + 1)
    asked = blocks.select("block", "raw", "sizes", "target").mapInArrow(_requests(4 * parts), "block string, shard long, keys binary, n binary, t binary")
    replies = asked.repartition(parts, "shard").sortWithinPartitions("shard", "block").mapInArrow(_add_up, "block string, shard long, n binary, t binary, words long, c long, ct long")
    replies = common.materialise(replies, "replies")  # which also ends the life of the requests
    total = replies.filter("block is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("words", "c", "ct"))).first()
    any_target = not wanted.isEmpty()
    empty = F.lit(None).cast("binary")
    left = blocks.select("block", F.lit(-1).cast("long").alias("shard"), "raw", "sizes", "ids", "known", "target", empty.alias("n"), empty.alias("t"))
    right = replies.filter("block is not null").select("block", "shard", *(empty.alias(c) for c in ("raw", "sizes", "ids", "known", "target")), "n", "t")
    met = left.unionByName(right).repartition(max(parts, size.blocks), "block").sortWithinPartitions("block", "shard").drop("block")
    return met.mapInArrow(_score(total.words, (total.c, total.ct if any_target else None)), "doc_id long, n_tokens long, loss_target double, loss_background double, score double")
