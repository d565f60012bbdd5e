"""Bloom filters of runs: sizing, building, probing.

A filter is a table of its 64-bit words that have a bit set.  Words are combined by OR before and after one shuffle, so no task
holds a filter or gathers a run's keys, and a filter may be larger than a task's memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.cluster import ship
from tidelog.functions.hashing import murmur128_many


def sizing(n: int, fpp: float) -> tuple[int, int]:
    """Bits and hash functions for n keys at the false positive rate fpp."""
    bits = int(-n * math.log(fpp) / math.log(2) ** 2)
    return bits, max(1, round(bits / n * math.log(2))) if n else 1


def sizing_columns(n: Column, fpp: float) -> tuple[Column, Column]:
    bits = F.floor(-n * math.log(fpp) / math.log(2) ** 2)
    return bits, F.greatest(F.lit(1), F.floor(bits / n * math.log(2) + 0.5)).cast("long")


def positions(keys: Sequence[bytes], bits: int, hashes: int) -> np.ndarray:
    """One row a key with the bits it sets; no columns for an empty filter."""
    if not bits:
        return np.zeros((len(keys), 0), np.int64)
    a, b = murmur128_many(keys)
    step = np.arange(hashes, dtype=np.uint64)
    return ((a[:, None] + step * b[:, None] & np.uint64((1 << 63) - 1)) % np.uint64(bits)).astype(np.int64)


def _as_bytes(keys: pd.Series) -> list[bytes]:
    return [bytes(k) if isinstance(k, (bytes, bytearray)) else str(k).encode() for k in keys]


def _mask(at: np.ndarray) -> np.ndarray:
    return (np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64)


def build(keys: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(word, mask): the filter of a column `key`, null keys left out."""
    ship(keys.sparkSession)

    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.unique(positions(_as_bytes(pdf.key), bits, hashes))
            yield pd.DataFrame({"word": at // 64, "mask": _mask(at)})

    set_bits = keys.select("key").dropna().mapInPandas(per_batch, "word long, mask long")
    return set_bits.groupBy("word").agg(F.bit_or("mask").alias("mask"))


def might_contain(probes: DataFrame, bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """(key, might_contain) for every distinct probed key that is not null; each bit is looked up in its word by a join."""
    ship(probes.sparkSession)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = positions(_as_bytes(pdf.key), bits, hashes) if bits else np.full((len(pdf), 1), -1)  # a word that no filter has
            yield pd.DataFrame({"key": pdf.key.repeat(at.shape[1]), "word": at.ravel() // 64, "asked": _mask(at.ravel())})

    kind = probes.schema["key"].dataType.simpleString()
    asked = probes.select("key").dropna().distinct().mapInPandas(spread, f"key {kind}, word long, asked long")
    held = F.coalesce(F.col("mask").bitwiseAND(F.col("asked")) != 0, F.lit(False))
    return asked.join(bloom, "word", "left").select("key", held.alias("set")).groupBy("key").agg(F.bool_and("set").alias("might_contain"))


def segments(bloom: DataFrame, bits: int, size: int = 8192) -> DataFrame:
    """(segment, bitmap): the filter as pieces of its bit set of `size` bytes, the last one whole too; only pieces with a bit set."""
    ship(bloom.sparkSession)

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        piece = np.zeros(size // 8, "<i8")
        piece[pdf.word.to_numpy() % (size // 8)] = pdf["mask"].to_numpy()
        return pd.DataFrame({"segment": [key[0]], "bitmap": [piece.tobytes()]})

    return bloom.withColumn("segment", F.expr(f"word div {size // 8}")).groupBy("segment").applyInPandas(join, "segment long, bitmap binary")


def wrap(pieces: DataFrame, size: int = 8192) -> DataFrame:
    """The filter (word, mask) that pieces (segment, bitmap) of a bit set hold."""
    ship(pieces.sparkSession)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for segment, bitmap in zip(pdf.segment, pdf.bitmap):
                words = np.frombuffer(bytes(bitmap), "<i8")
                at = np.flatnonzero(words)
                yield pd.DataFrame({"word": at + segment * (size // 8), "mask": words[at]})

    return pieces.select("segment", "bitmap").mapInPandas(split, "word long, mask long")
