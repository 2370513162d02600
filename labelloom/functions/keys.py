"""Keyed randomness: every draw is an md5 of (key, purpose).

Draws never depend on row position or partitioning, so a retried task or a
different cluster size gives the same split.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def draw(key, purpose: str) -> Column:
    """60-bit unsigned integer drawn from (key, purpose): modulo a row count it reaches every row."""
    digest = F.md5(F.concat(_col(key).cast("string"), F.lit(f"|{purpose}")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def uniform(key, purpose: str) -> Column:
    """Uniform double in [0, 1)."""
    return draw(key, purpose) / F.lit(float(1 << 60))


def order_digest(key, seed: int) -> Column:
    """Hex digest whose text order is a seeded shuffle of the keys."""
    return F.md5(F.concat(F.lit(f"{seed}|"), _col(key).cast("string")))


def epoch_micros(ts) -> Column:
    """Microseconds since 1970 of a TIMESTAMP_NTZ or TIMESTAMP column (UTC)."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), _col(ts))
