"""Seeded, engine-portable pseudo-random keys.

``rand(seed)`` depends on partitioning, so it changes when a task is retried on
a different split. An md5 of (seed, key parts) does not: every decision below is
a pure function of the row, which makes re-runs and executor loss harmless.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed: int, *parts: str | Column) -> Column:
    """md5 hex of 'seed:part1:part2...'."""
    cols: list[Column] = [F.lit(str(seed))]
    for p in parts:
        c = F.col(p) if isinstance(p, str) else p
        cols += [F.lit(":"), c.cast("string")]
    return F.md5(F.concat(*cols))


def hex_threshold(p: float) -> str:
    """8 hex digits h with P(first 8 hex digits of md5 < h) = p (to 2^-32)."""
    if not 0.0 <= p <= 1.0:
        raise ValueError("probability must be in [0, 1]")
    v = min(int(p * (1 << 32)), (1 << 32) - 1) if p < 1.0 else (1 << 32)
    return "g" * 8 if v >= (1 << 32) else f"{v:08x}"


def bernoulli(seed: int, p: float, *parts: str | Column) -> Column:
    """True with probability ``p``, decided by the key alone."""
    return F.substring(seeded_digest(seed, *parts), 1, 8) < F.lit(hex_threshold(p))
