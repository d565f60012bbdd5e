"""Errors with the numeric codes of the storage contract."""

from __future__ import annotations

# The public error codes.
CODES = {
    "CHECKSUM_MISMATCH": 1001,
    "CORRUPT_WAL_RECORD": 1002,
    "CORRUPT_SSTABLE_HEADER": 1003,
    "BUDGET_EXCEEDED": 2001,
    "CACHE_EVICTION_FAILED": 2002,
    "IO_ERROR": 3000,
    "WAL_WRITE_FAILED": 3001,
    "WAL_FLUSH_FAILED": 3002,
    "RECOVERY_FAILED": 3003,
    "WRITE_BACKPRESSURE": 4001,
    "LOCK_TIMEOUT": 4002,
    "ENGINE_CLOSED": 5001,
    "INVALID_CONFIGURATION": 5002,
    "KEY_NOT_FOUND": 5003,
}


class StoreError(Exception):
    def __init__(self, name: str, message: str):
        super().__init__(f"{name} ({CODES[name]}): {message}")
        self.name, self.code = name, CODES[name]
