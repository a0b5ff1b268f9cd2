"""Seeded, partition-independent hashing built on md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60
_HEX_DIGITS = HASH_BITS // 4


def text_hash(value: Column) -> Column:
    """First 60 bits of md5 as a non-negative BIGINT."""
    return F.conv(F.substring(F.md5(value), 1, _HEX_DIGITS), 16, 10).cast("bigint")


def seeded_hash(keys: list[str | Column], seed: int = 42) -> Column:
    """Order rows pseudo-randomly by key: the same for any partitioning or engine."""
    parts = [F.col(k) if isinstance(k, str) else k for k in keys]
    texts = [p.cast("string") for p in parts]
    return text_hash(F.concat_ws("|", *texts, F.lit(str(seed))))


def hash_slot(value: Column, slots: int) -> Column:
    """Slot number in ``0..slots-1`` of a text value."""
    return F.pmod(text_hash(value), F.lit(slots).cast("bigint"))
