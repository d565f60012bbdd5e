"""Settings, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, fields

from tidelog.errors import StoreError

MIB, GIB = 1 << 20, 1 << 30


@dataclass(frozen=True)
class StoreConfig:
    max_memory: int = 100 * GIB
    memtable_max: int = 64 * MIB
    block_cache_max: int = 8 * GIB
    compaction_buffer_max: int = 64 * MIB
    backpressure_lag_ms: int = 30_000
    bloom_bits_per_key: int = 10
    wal_fsync_interval_ms: int = 100
    wal_batch: int = 1000
    compaction_threshold: int = 4
    index_interval: int = 128

    def __post_init__(self):
        for f in fields(self):
            if getattr(self, f.name) <= 0:
                raise StoreError("INVALID_CONFIGURATION", f"{f.name} must be positive")
        if self.memtable_max + self.block_cache_max > self.max_memory:
            raise StoreError("INVALID_CONFIGURATION", "memtable and block cache exceed the memory allowed")
