"""Display of sizes and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the powers of 1024.
POWERS = "KMGTPE"


def format_bytes(n: Column, largest: str = POWERS[-1]) -> Column:
    """`N B` under 1024, else two decimals, rounded half up, in the largest unit up to `largest` that leaves one or more; null of null."""
    out = F.format_string("%d B", n)
    for i, letter in enumerate(POWERS[: POWERS.index(largest) + 1], 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.2f {letter}B", F.floor(n / float(1024**i) * 100 + 0.5) / 100)).otherwise(out)
    return F.when(n.isNotNull(), out)


def display(key: str) -> Column:
    """A binary column as text if it is valid UTF-8, else as 0x and lower-case hex."""
    return F.coalesce(F.try_validate_utf8(F.col(key).cast("string")), F.concat(F.lit("0x"), F.lower(F.hex(key))))
