"""Toxicity by a linear-chain conditional random field over tokens.

Labels mark documents.  On a bounded sample of them (`per_class` toxic documents and three times as many others, those whose
hashed ids are smallest) a token counts as toxic if its document is toxic and one of its features (the word, its beginnings)
occurs in toxic documents so much more than in others that chance would hardly do it.  From these labelled tokens a CRF with
the two states fine and toxic learns hashed features and transitions, by gradient ascent in numpy.  Forward-backward gives
each token's marginal; a document's score is a logistic function of its largest marginal and of their sum.  Tokens with a
marginal of one half or more form the offending spans.

Forward and backward passes are products of 2 x 2 matrices.  They run as a blocked scan over the tokens of a whole block
of documents, cut into equal lanes; a document boundary is a matrix that forgets what came before, so long texts cost
no more steps than short ones.

A null text counts as empty; an empty text has no tokens and the score that no toxic token gives.  Texts are read whole.
Without labelled rows of both kinds the score is the share of toxic rows, 0 if there are none.  Repeated rows are scored alike; a
doc_id with several labels is toxic if one says so; of equal hashes the smaller doc_id is learned from.  A null doc_id is
scored but never learned from.  An empty table gives no rows.  Further columns, whatever their names, are ignored or, by keep, kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

BITS = 18
BEGINNINGS = (3, 4, 5, 6)
FEATURES = 1 + len(BEGINNINGS)
#: Steps of one lane of the scan.
STEPS = 128


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # emission of the toxic state, by feature bucket
    start: np.ndarray  # log potential of each state at a document's first token
    moves: np.ndarray  # log potential from state to state
    logistic: tuple[float, float, float]  # of the largest marginal, of log(1 + their sum), bias


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, each row's first token, and (tokens, FEATURES) feature buckets."""
    low = common.LOWER[data]
    start, end, bounds = common.words(low, offsets, common.PUNCT)
    spans = common.Spans(low)
    made = np.empty((len(start), FEATURES), np.int32)
    salt = [common.U64(0x9E37 + 0x1F123BB5 * k) for k in range(FEATURES)]
    made[:, 0] = (common.mix(spans.hash(start, end) ^ salt[0]) >> common.U64(64 - BITS)).astype(np.int32)
    for k, n in enumerate(BEGINNINGS, 1):  # a shorter word stands for itself
        h = spans.hash(start, np.minimum(end, start + n))
        made[:, k] = (common.mix(h ^ salt[k]) >> common.U64(64 - BITS)).astype(np.int32)
    return start, end, bounds, made


def tokens_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's first token and the feature buckets of all tokens, made a block of texts at a time."""
    made, sizes = [np.empty((0, FEATURES), np.int32)], []
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for b in common.pieces(batch):
        _, _, bounds, feats = tokens(*common.bytes_of(b.column(1)))
        made.append(feats)
        sizes += np.diff(bounds).tolist()
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), np.concatenate(made)


def _chain(emission: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(4, STEPS, lanes) matrices m00 m01 m10 m11 of every token, padded by identities."""
    n = len(emission)
    lanes = max(1, -(-n // STEPS))
    e = np.exp(np.clip(emission, -30, 30))
    m = np.zeros((4, lanes * STEPS))
    m[0], m[3] = 1, 1
    a = np.exp(moves)
    s = np.exp(start)
    for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        m[k, :n] = np.where(first, s[j], a[i, j]) * (e if j else 1.0)
    m /= m.max(0)
    return m.reshape(4, lanes, STEPS).transpose(0, 2, 1).copy()


def marginals(emission: np.ndarray, first: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The toxic marginal of every token, and the expected number of each move (2 x 2) between tokens of one document."""
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2))
    m = _chain(emission, first, start, moves)
    lanes = m.shape[2]
    p = np.zeros((4, lanes))
    p[0], p[3] = 1, 1
    for t in range(STEPS):
        a, b, c, d = m[:, t]
        p = np.stack([p[0] * a + p[1] * c, p[0] * b + p[1] * d, p[2] * a + p[3] * c, p[2] * b + p[3] * d])
        p /= p.max(0)
    ahead, back = np.empty((2, lanes)), np.empty((2, lanes))
    x, y = 0.5, 0.5
    for lane, (a, b, c, d) in enumerate(p.T.tolist()):
        ahead[:, lane] = x, y
        x, y = x * a + y * c, x * b + y * d
        x, y = x / (x + y), y / (x + y)
    x, y = 0.5, 0.5
    for lane, (a, b, c, d) in zip(range(lanes - 1, -1, -1), p.T[::-1].tolist()):
        back[:, lane] = x, y
        x, y = a * x + b * y, c * x + d * y
        x, y = x / (x + y), y / (x + y)
    alpha, beta = np.empty((2, STEPS, lanes)), np.empty((2, STEPS, lanes))
    v = ahead
    for t in range(STEPS):
        v = np.stack([v[0] * m[0, t] + v[1] * m[2, t], v[0] * m[1, t] + v[1] * m[3, t]])
        v /= v.sum(0)
        alpha[:, t] = v
    v = back
    for t in range(STEPS - 1, -1, -1):
        beta[:, t] = v
        v = np.stack([m[0, t] * v[0] + m[1, t] * v[1], m[2, t] * v[0] + m[3, t] * v[1]])
        v /= v.sum(0)
    flat = lambda z: z.transpose(0, 2, 1).reshape(z.shape[0], -1)[:, :n]
    alpha, beta, m = flat(alpha), flat(beta), flat(m)
    both = alpha * beta
    toxic = both[1] / both.sum(0)
    moved = np.stack([alpha[i, :-1] * m[2 * i + j, 1:] * beta[j, 1:] for i in (0, 1) for j in (0, 1)])
    moved = (moved / moved.sum(0))[:, ~first[1:]]
    return toxic, moved.sum(1).reshape(2, 2)


def firsts(n: int, bounds: np.ndarray) -> np.ndarray:
    first = np.zeros(n, bool)
    first[bounds[:-1][bounds[:-1] < n]] = True
    return first


def summary(toxic: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(documents, 2): the largest marginal and log(1 + sum), 0 without tokens."""
    out = np.zeros((len(bounds) - 1, 2))
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some, 0] = np.maximum.reduceat(toxic, bounds[:-1][some])
    out[:, 1] = np.log1p(np.maximum(0, common.row_sums(toxic, bounds)))
    return out


def emissions(weights: np.ndarray, feats: np.ndarray) -> np.ndarray:
    out = np.zeros(len(feats))
    for k in range(FEATURES):
        out += weights[feats[:, k]]
    return out


def _in_blocks(weights, feats, bounds, start, moves, at_most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """marginals of many documents, about at_most tokens at a time."""
    p, moved = np.empty(len(feats)), np.zeros((2, 2))
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + at_most, side="right")) - 1)
        s = slice(bounds[i], bounds[j])
        p[s], m = marginals(emissions(weights, feats[s]), firsts(bounds[j] - bounds[i], bounds[i : j + 1] - bounds[i]), start, moves)
        moved += m
        i = j
    return p, moved


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def distinct(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The first document of each group of near copies, which share the least hash of their five-word windows under one of eight salts.

    Copies of one document are one observation: what they repeat says nothing about what marks toxic documents.
    """
    h = words.astype(common.U64)
    n = np.diff(bounds)
    size = np.where(n >= 5, n - 4, np.minimum(n, 1))
    first = np.arange(size.sum()) + np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    length = np.repeat(np.minimum(n, 5), size)
    window = length.astype(common.U64)
    for j in range(5):
        has = length > j
        window = np.where(has, common.mix(window * common.U64(0x9FB21C651E98DF25) + h[np.where(has, first + j, 0)]), window) if len(h) else window
    at = np.concatenate([[0], np.cumsum(size)])[:-1]
    some = np.flatnonzero(size > 0)
    group = np.arange(len(n))
    for salt in range(8):
        if not len(some):
            break
        least = np.minimum.reduceat(common.mix(window ^ common.U64(salt)), at[some])
        _, where, back = np.unique(least, return_index=True, return_inverse=True)
        for i, k in zip(some.tolist(), some[where[back]].tolist()):
            a, b = sorted((group[i], group[k]))
            if a != b:
                group[group == b] = a
    return np.unique(group)


def train(texts: list[str], labels: list[int], rounds: int = 30, chance: float = 1e-7) -> Model:
    """Fits the model on the distinct documents among the texts."""
    if texts:
        bounds, feats = tokens_of(texts)
        own = distinct(feats[:, 0], bounds).tolist()
        texts, labels = [texts[i] for i in own], [labels[i] for i in own]
    y = np.array(labels, int)
    share = float(y.mean()) if len(y) else 0.0
    none = Model(np.zeros(1 << BITS, np.float32), np.zeros(2), np.zeros((2, 2)), (0.0, 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))))
    if share in (0.0, 1.0):
        return none
    bounds, feats = tokens_of(texts)
    doc = np.repeat(np.arange(len(y)), np.diff(bounds))
    # in how many toxic and other documents each feature occurs
    toxic_docs, other_docs, where = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS, common.U64)
    for k in range(FEATURES):
        pairs = np.unique(feats[:, k].astype(np.int64) * len(y) + doc)
        bucket, of = pairs // len(y), pairs % len(y)
        toxic_docs += np.bincount(bucket, y[of], 1 << BITS)
        other_docs += np.bincount(bucket, 1 - y[of], 1 << BITS)
        np.add.at(where, bucket, common.mix(of.astype(common.U64) + common.U64(1)))
    support = np.log(chance) / np.log(share)
    odds = ((toxic_docs + 0.5) / (y.sum() + 1)) / ((other_docs + 0.5) / ((1 - y).sum() + 1))
    marked = (toxic_docs >= support) & (odds >= 20) & (toxic_docs >= 20 * other_docs)
    # many features of exactly the same documents are a passage that those share, not words that mark them
    _, back, size = np.unique(where[marked], return_inverse=True, return_counts=True)
    marked[np.flatnonzero(marked)[size[back] > 2 * FEATURES]] = False
    target = marked[feats].any(1) & (y[doc] == 1)
    f, t, first = feats, target.astype(float), firsts(len(feats), bounds)
    weights = np.zeros(1 << BITS)
    start, moves = np.array([0.0, -2.0]), np.array([[0.0, -2.0], [0.0, -1.0]])
    state = t.astype(int)
    pair = np.bincount((state[:-1] * 2 + state[1:])[~first[1:]], minlength=4).reshape(2, 2)
    begun = np.bincount(state[first], minlength=2)
    sq, sq_start, sq_moves = np.full(1 << BITS, 1e-3), np.full(2, 1e-3), np.full((2, 2), 1e-3)
    for _ in range(rounds if len(f) else 0):
        p, moved = _in_blocks(weights, f, bounds, start, moves)
        g = -0.01 * weights
        for k in range(FEATURES):
            g += np.bincount(f[:, k], t - p, 1 << BITS)
        q = p[first].sum()
        g_start = begun - np.array([first.sum() - q, q])
        g_moves = pair - moved
        sq, sq_start, sq_moves = sq + g * g, sq_start + g_start**2, sq_moves + g_moves**2
        weights += 0.7 * g / np.sqrt(sq)
        start = start + 0.3 * g_start / np.sqrt(sq_start)
        moves = moves + 0.3 * g_moves / np.sqrt(sq_moves)
    made = Model(weights.astype(np.float32), start, moves, (0.0, 0.0, 0.0))
    p, _ = _in_blocks(made.weights, feats, bounds, start, moves)
    x = np.column_stack([summary(p, bounds), np.ones(len(y))])
    w = np.zeros(3)
    for _ in range(50):  # Newton's method with a small ridge
        s = _sigmoid(x @ w)
        h = x.T @ (x * (s * (1 - s))[:, None]) + 0.05 * np.eye(3)
        w = w + np.linalg.solve(h, x.T @ (y - s) - 0.05 * w)
    return Model(made.weights, start, moves, tuple(w.tolist()))


def fit(docs: DataFrame, labels: DataFrame, learn_from, per_class: int = 800) -> Model:
    """Learns from at most 4 * per_class labelled documents that satisfy learn_from; only their texts are fetched."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn_from)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = []
    for value, most in ((1, per_class), (0, 3 * per_class)):
        chosen += known.filter(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    ids = spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "doc_id long, toxic int")  # 4 * per_class rows at most
    # a repeated doc_id may bring more rows than ids: which of them stay is settled by order
    sample = common.texts(docs).join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"), "text").limit(4 * per_class).collect()
    sample.sort(key=lambda r: (r.doc_id, r.text or ""))
    return train([r.text or "" for r in sample], [r.toxic for r in sample])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, spans); spans are offsets into the text's UTF-8 bytes."""
    return _rows(docs, model, ())


def _rows(docs: DataFrame, model: Model, carry: tuple[str, ...]) -> DataFrame:
    """The same with the columns of `carry` as c0, c1, ... so that no name clashes."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", *(f"`{c}` as c{i}" for i, c in enumerate(carry)))
    kinds = dict(docs.dtypes)
    schema = "doc_id long" + "".join(f", c{i} {kinds[c]}" for i, c in enumerate(carry)) + ", score double, spans array<struct<start:long,end:long>>"
    shared = spark.sparkContext.broadcast(model)  # a fixed number of feature buckets
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        own = shared.value
        for batch in batches:
            for b in common.pieces(batch):
                data, offsets = common.bytes_of(b.column(1))
                start, end, bounds, feats = tokens(data, offsets)
                first = firsts(len(start), bounds)
                p, _ = marginals(emissions(own.weights, feats), first, own.start, own.moves)
                x = summary(p, bounds)
                s = _sigmoid(x @ np.array(own.logistic[:2]) + own.logistic[2])
                bad = p >= 0.5
                heads = np.flatnonzero(bad & ~(np.concatenate([[False], bad[:-1]]) & ~first))
                tails = np.flatnonzero(bad & ~np.concatenate([(bad & ~first)[1:], [False]])) if len(bad) else heads
                row = np.searchsorted(bounds, heads, side="right") - 1
                at = offsets[row]
                flat = pa.StructArray.from_arrays([pa.array(start[heads] - at), pa.array(end[tails] - at)], fields=list(span))
                spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(s), spans], names=["doc_id", *(f"c{i}" for i in range(len(carry))), "score", "spans"])

    return rows.mapInArrow(common.tidy("toxicity", run), schema)


def keep(docs: DataFrame, labels: DataFrame, learn_from, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    model = fit(docs, labels, learn_from)
    rest = tuple(c for c in docs.columns if c != "doc_id")
    kept = _rows(docs, model, rest).filter(F.col("score") < threshold)
    return kept.select("doc_id", *(F.col(f"c{i}").alias(c) for i, c in enumerate(rest))).select(*docs.columns)
