"""Stateless randomness: a number of (0, 1) from a seed, a stream's name and a row's key.

It doesn't depend on partitioning or retries, and DuckDB computes the same from the same SQL.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, stream: str, *key: Column | str) -> Column:
    parts = [F.lit(str(seed)), F.lit(stream), *((F.col(k) if isinstance(k, str) else k).cast("string") for k in key)]
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def uniform_py(seed: int, stream: str, *key: object) -> float:
    """The same number on the driver."""
    text = "|".join(map(str, (seed, stream, *key)))
    return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / float(1 << 52)
