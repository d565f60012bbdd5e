"""Streaming forms of the store: changes append to it batch by batch, or resolve to newest versions in state."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidelog.engine import Store


def ingest(changes: DataFrame, store: Store, checkpoint: str, flush_every: int = 10) -> StreamingQuery:
    """Appends every micro-batch of a streaming changelog to the store, and makes a run of each `flush_every` batches.

    A batch is tagged with the checkpoint and its number, so one that is run again after a failure is appended once.
    """

    def each(batch: DataFrame, number: int) -> None:
        store.append(batch, f"{zlib.crc32(checkpoint.encode()):08x}.{number}")
        if number % flush_every == flush_every - 1:
            store.flush()

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_by_key(changes: DataFrame) -> DataFrame:
    """(key, seq, op, value): a row whenever a key's newest version changes; a late lower seq loses, tombstones stay in state."""

    def newest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        best = held
        for pdf in frames:
            row = pdf.loc[pdf.seq.idxmax()]
            if best is None or row.seq > best[0]:
                best = (int(row.seq), int(row.op), row.value)
        if best is not None and best != held:
            state.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "op": [best[1]], "value": [best[2]]})

    kinds = {f.name: f.dataType.simpleString() for f in changes.schema}
    value = kinds["value"]
    return (
        changes.select("key", F.col("seq").cast("long").alias("seq"), F.col("op").cast("int").alias("op"), "value")
        .groupBy("key")
        .applyInPandasWithState(newest, f"key {kinds['key']}, seq long, op int, value {value}", f"seq long, op int, value {value}", "update", GroupStateTimeout.NoTimeout)
    )
