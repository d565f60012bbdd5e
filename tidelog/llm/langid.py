"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

Training happens in numpy by stochastic gradient descent on a bounded sample of labelled rows (`sample_rows` documents,
the ones whose hashed ids are smallest).  Since the classifier is linear in the mean of its n-gram embeddings, prediction
folds embeddings and softmax weights into one small table per language and sums its cells over the whole text, a block of
texts at a time.

The softmax has one more class, for texts in no learned language: made-up examples of single letters repeated, letters drawn
or shuffled at random, and letters of scripts that no sampled text has.  It is never predicted, but what it takes lowers
the score of the best language.  A temperature fitted on a held-back part of the sample calibrates the scores, and
the rejection threshold is the score that all but a thousandth of its rightly predicted texts reach.

A null text, or one without a letter, is `und` with score 0 and is rejected; so is everything when no row is labelled.
Texts are read whole.  Repeated rows are predicted alike.  Of equal scores the first language by name is predicted.  An empty
table gives no rows.  Further columns, whatever their names, are ignored or, by keep, kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm import common

ORDERS = (2, 3, 4)
BITS = 16
#: Letters of scripts from which foreign examples are made, as ranges of code points.
SCRIPTS = ((0x3B1, 0x3CA), (0x430, 0x450), (0x561, 0x587), (0x5D0, 0x5EB), (0x627, 0x64B), (0x905, 0x93A), (0xE01, 0xE2F), (0x10D0, 0x10F1), (0x3041, 0x3097), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4))
_FOLD = common.LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: One row a language and one for no language: the logit of each n-gram bucket, all orders one after another.
    cells: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """For each order the bucket of every n-gram of the block, and the first and last (exclusive) n-gram of every row.

    Rows are framed by blanks, and everything but letters and bytes of multi-byte characters is a blank.
    """
    rows = len(offsets) - 1
    x = np.full(len(data) + rows + 1, 32, np.uint32)
    x[np.arange(len(data)) + np.repeat(np.arange(rows), np.diff(offsets)) + 1] = _FOLD[data]
    first, end = offsets[:-1] + np.arange(rows), offsets[1:] + np.arange(rows) + 2
    ids, firsts, ends = [], [], []
    for k, n in enumerate(ORDERS):
        size = max(0, len(x) - n + 1)
        v = x[:size].copy()
        for i in range(1, n):
            v |= x[i : size + i] << np.uint32(8 * i)
        v *= np.uint32(2654435761)
        ids.append((v >> np.uint32(32 - BITS)).astype(np.int32) + np.int32(k << BITS))
        firsts.append(np.minimum(first, size))
        ends.append(np.maximum(firsts[-1], end - n + 1))
    return ids, firsts, ends


def logits(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, languages + 1): mean cell of all n-grams plus bias."""
    ids, firsts, ends = grams(data, offsets)
    count = np.maximum(1, sum(e - f for f, e in zip(firsts, ends)))
    out = np.empty((len(offsets) - 1, len(model.cells)))
    for j, cells in enumerate(model.cells):
        total = np.zeros(len(offsets) - 1)
        for i, f, e in zip(ids, firsts, ends):
            sums = np.concatenate([[0.0], np.cumsum(cells[i], dtype=np.float64)])
            total += sums[e] - sums[f]
        out[:, j] = total / count + model.bias[j]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def foreign(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Made-up texts in no language of the given ones, a third as many."""
    seen = {ord(c) for t in texts for c in set(t)}
    scripts = [s for s in SCRIPTS if not any(c in seen for c in range(*s))]
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(chars: str | tuple[int, int]) -> str:
        size = int(rng.integers(1, 13))
        if isinstance(chars, str):
            return "".join(chars[i] for i in rng.integers(0, len(chars), size))
        return "".join(map(chr, rng.integers(*chars, size)))

    out = []
    for k in range(-(-len(texts) // 3)):
        n = int(rng.integers(1, 40))
        if k % 4 == 0:
            out.append(" ".join(letters[rng.integers(26)] * int(rng.integers(3, 30)) for _ in range(n if n < 5 else 1)))
        elif k % 4 == 1:
            out.append(" ".join(word(letters) for _ in range(n)))
        elif k % 4 == 2 or not scripts:
            chars = list(texts[int(rng.integers(len(texts)))][:400])
            rng.shuffle(chars)
            out.append("".join(chars) or "q")
        else:
            script = scripts[int(rng.integers(len(scripts)))]
            out.append(" ".join(word(script) for _ in range(n)))
    return out


def train(texts: list[str], langs: list[str], size: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7) -> Model:
    """Fits the model; each text also gives one excerpt of a few words, so that short texts are learned too."""
    names = tuple(sorted(set(langs)))
    if not names:
        return Model((), np.zeros((1, len(ORDERS) << BITS), np.float32), np.zeros(1), 1.0, 1.0)
    rng = np.random.default_rng(seed)
    examples, targets = [], []
    for t, lang in zip(texts, langs):
        words = t.split()
        k = int(rng.integers(1, 12))
        at = int(rng.integers(0, max(1, len(words) - k)))
        examples += [t, " ".join(words[at : at + k])]
        targets += [names.index(lang)] * 2
    held = np.repeat(rng.random(len(texts)) < 0.2, 2) if len(texts) >= 50 else np.zeros(len(targets), bool)
    other = foreign(texts, rng)
    examples += other
    y = np.array(targets + [len(names)] * len(other))
    held = np.append(held, np.zeros(len(other), bool))
    feats = []
    for t in examples:
        raw = np.frombuffer(t.encode(), np.uint8)
        ids, firsts, ends = grams(raw, np.array([0, len(raw)]))
        u, c = np.unique(np.concatenate([i[f[0] : e[0]] for i, f, e in zip(ids, firsts, ends)]), return_counts=True)
        feats.append((u, (c / max(1, c.sum())).astype(np.float32)))
    k = len(names) + 1
    embed = rng.uniform(-1 / size, 1 / size, (len(ORDERS) << BITS, size)).astype(np.float32)
    weights, bias = np.zeros((k, size), np.float32), np.zeros(k, np.float32)
    order = np.flatnonzero(~held)
    steps, step = max(1, epochs * len(order)), 0
    for _ in range(epochs):
        rng.shuffle(order)
        for i in order:
            u, c = feats[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = c @ embed[u]
            g = softmax((weights @ mean + bias)[None])[0]
            g[y[i]] -= 1
            back = weights.T @ g
            weights -= lr * np.outer(g, mean)
            bias -= 0.1 * lr * g
            # a step of fixed length for the mean, however many n-grams share it
            embed[u] -= 0.5 * lr / (c @ c) * np.outer(c, back)
    model = Model(names, np.ascontiguousarray((embed @ weights.T).T), bias.astype(float), 1.0, 0.0)
    check = np.flatnonzero(held) if held.any() else np.arange(len(targets))
    z = np.stack([c @ model.cells[:, u].T + model.bias for u, c in (feats[i] for i in check)])
    loss = lambda t: -np.log(np.maximum(1e-12, softmax(z / t)[np.arange(len(check)), y[check]])).mean()
    temperature = min((0.1 * 1.25**i for i in range(4, 24)), key=loss)
    p = softmax(z / temperature)
    right = p[:, :-1].max(1)[p[:, :-1].argmax(1) == y[check]]
    threshold = float(np.quantile(right, 0.001)) if len(right) else 1.0
    return Model(names, model.cells, model.bias, float(temperature), threshold)


def fit(docs: DataFrame, learn_from, sample_rows: int = 3000) -> Model:
    """Learns from at most sample_rows rows with a lang that satisfy the condition learn_from; only their texts are fetched."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(F.col("lang").isNotNull() & learn_from)
    ids = [r.doc_id for r in rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()]
    chosen = spark.createDataFrame([(i,) for i in set(ids)], "doc_id long")  # sample_rows at most
    found = rows.join(F.broadcast(chosen), "doc_id", "left_semi").filter("text is not null")
    # a repeated doc_id may bring more rows than ids: which of them stay is settled by order
    sample = found.orderBy(F.xxhash64("doc_id"), "doc_id", "lang", F.xxhash64("text"), "text").limit(sample_rows).collect()
    sample.sort(key=lambda r: (r.doc_id, r.lang, r.text))
    return train([r.text for r in sample], [r.lang for r in sample])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, accepted); only the text decides."""
    return _rows(docs, model, ())


def _rows(docs: DataFrame, model: Model, carry: tuple[str, ...]) -> DataFrame:
    """The same with the columns of `carry` as c0, c1, ... so that no name clashes."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", *(f"`{c}` as c{i}" for i, c in enumerate(carry)))
    kinds = dict(docs.dtypes)
    schema = "doc_id long" + "".join(f", c{i} {kinds[c]}" for i, c in enumerate(carry)) + ", lang_pred string, score double, accepted boolean"
    shared = spark.sparkContext.broadcast(model)  # languages x n-gram buckets, a fixed size

    def run(batches):
        own = shared.value
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        for batch in batches:
            for b in common.pieces(batch):
                data, offsets = common.bytes_of(b.column(1))
                lettered = common.row_sums(letter[data].astype(np.int64), offsets) > 0
                for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)):
                    lettered[i] = any(c.isalpha() for c in b.column(1)[int(i)].as_py())
                if own.langs:
                    p = softmax(logits(own, data, offsets) / own.temperature)
                    best, score = p[:, :-1].argmax(1), np.clip(p[:, :-1].max(1), 0, 1)
                else:
                    best, score, lettered = np.zeros(b.num_rows, int), np.zeros(b.num_rows), lettered & False
                names = np.array([*own.langs, "und"], object)[np.where(lettered, best, len(own.langs))]
                score = np.where(lettered, score, 0.0)
                made = [pa.array(names, pa.string()), pa.array(score), pa.array(lettered & (score >= own.threshold))]
                yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], *made], names=["doc_id", *(f"c{i}" for i in range(len(carry))), "lang_pred", "score", "accepted"])

    return rows.mapInArrow(common.tidy("langid", run), schema)


def keep(docs: DataFrame, learn_from, sample_rows: int = 3000) -> DataFrame:
    """The rows of docs whose text is not rejected, with all their columns."""
    model = fit(docs, learn_from, sample_rows)
    rest = tuple(c for c in docs.columns if c != "doc_id")
    kept = _rows(docs, model, rest).filter("accepted")
    return kept.select("doc_id", *(F.col(f"c{i}").alias(c) for i, c in enumerate(rest))).select(*docs.columns)
